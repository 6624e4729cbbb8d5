"""Exact token counts of every prefix of every text, by dynamic programming.

The encoding of a prefix ends in exactly one token. It is the token t that ends there and follows the last token of the
prefix before t in an encoding of the two alone: a sequence of tokens is the encoding of its text when every two
neighbours are the encoding of theirs. So count(prefix) = count(prefix without t) + 1, from left to right, and no prefix
is encoded anew. A text falls into runs that no piece of the model joins (spaces with the word behind them, digits, other
signs); a worker keeps the counts of short runs, and a text's counts are theirs, joined.

``index`` keeps one signed byte a code point: by how much the count changes there. From it ``counts``, ``longest`` and
``tokens`` answer how many tokens any prefix has and where a budget ends, without a tokenizer.

Works for sentencepiece models of kind BPE with the identity normalizer, byte fallback and a dummy space in front; a
model of another kind is refused. Positions are code points.

Defined cases: null and empty texts have no tokens and an empty index; strings of special tokens are ordinary text;
texts of any length are counted whole; repeated rows and null doc_ids are rows like any other; all columns of the input
come back untouched beside ``prefix`` (columns of the input with that name are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, load, release, stored

SPACE, LIMIT = "▁", 4096
#: Runs of at most this many code points are kept by a worker, so many of them at most; what isn't kept is counted anew.
SHORT, KEPT, NEVER = 48, 600_000, float("inf")
#: Ways to cut a text into runs that no piece joins: spaces with a word, a digit or other signs behind them; or spaces
#: with all behind them. The first that every piece of the model fits whole is used.
_MARKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\u2010-\u203A"
_WORD = rf"[^0-9{_MARKS}{SPACE}]+"
CUTS = [re.compile(p) for p in (rf"{SPACE}+(?:{_WORD}|[0-9]|[{_MARKS}]*)|{_WORD}|[0-9]|[{_MARKS}]+", rf"{SPACE}+[^{SPACE}]*")]


class Counter:
    """Prefix counts under one sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        plain = [i for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in plain}
        self._check()
        places = {s: 2 * i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: places[s] for p, s in self.score.items()}
        #: Pieces that are tokens of their own text, the two parts each is merged from, and how long those are that end
        #: with a character.
        made = {p: self._merges(p) for p in self.score}
        self.whole = {p for p, (parts, _) in made.items() if parts == [p]}
        self.halves = {p: halves for p, (_, halves) in made.items() if halves}
        self.sizes: dict[str, list[int]] = {}
        for p in self.whole:
            self.sizes.setdefault(p[-1], []).append(len(p))
        self.sizes = {c: sorted({1, *n}, reverse=True) for c, n in self.sizes.items()}
        self.runs: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _check(self) -> None:
        self.cut = next((c for c in CUTS if all(map(c.fullmatch, self.score))), None)
        probe = self.model.encode("Ａ b  \U0010fffd", out_type=str)
        if not self.cut or not any(self.model.is_byte(i) for i in range(self.model.get_piece_size())) or self.merged(f"{SPACE}Ａ{SPACE}b{SPACE}{SPACE}\U0010fffd") != probe:
            raise ValueError("prefix counts need a sentencepiece BPE model with byte fallback, identity normalizer and a space in front")

    def _bytes(self, symbol: str) -> list[str]:
        return [symbol] if symbol in self.score else [f"<0x{b:02X}>" for b in symbol.encode("utf-8", "replace")]

    def merged(self, text: str) -> list[str]:
        """The tokens of a short run: the best-scored pair is merged first, the leftmost of equal ones."""
        return [t for p in self._merges(text)[0] for t in self._bytes(p)]

    def _merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What a run's characters are merged to, and the two parts of the last merge."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts, last
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stand(self, left: str, right: str) -> bool:
        """Whether left and right stay two tokens side by side.

        Undoes their merges from the latest on: a merge across the border happens if its parts stood there before the
        merge that took one of them up. Of equal ranks the leftmost comes first.
        """
        rank, halves, limit = self.rank, self.halves, NEVER
        while True:
            if rank.get(left + right, NEVER) < limit:
                return False
            of_left, of_right = halves.get(left), halves.get(right)
            if of_left and (not of_right or rank[left] > rank[right]):
                limit, left = rank[left], of_left[1]
            elif of_right:
                limit, right = rank[right] + 1, of_right[0]
            else:
                return True

    def _run(self, run: str) -> bytes:
        """The changes of the count at every code point of a run."""
        n, whole, pairs = len(run), self.whole, self.pairs
        if len(pairs) > KEPT:
            pairs.clear()
        last, count = [""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for size in self.sizes.get(run[end - 1], (1,)):
                if size > end:
                    continue
                token = run[end - size : end]
                if size > 1 and token not in whole:
                    continue
                before = last[end - size]
                stands = pairs.get((before, token)) if before else True
                if stands is None:
                    stands = pairs[before, token] = self._stand(before, token)
                if stands:
                    last[end], count[end] = token, count[end - size] + (1 if token in whole else len(self._bytes(token)))
                    break
            else:
                raise ValueError(f"no last token at {end} of {run[:64]!r}")
        return bytes([(b - a) & 255 for a, b in itertools.pairwise(count)])

    def changes(self, text: str | None) -> bytes:
        """One signed byte for the space in front and one a code point; empty for an empty text."""
        if not text:
            return b""
        out, known = [], self.runs
        for run in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            got = known.get(run)
            if got is None:
                got = self._run(run)
                if len(run) <= SHORT:
                    if len(known) >= KEPT:
                        known.clear()
                    known[run] = got
            out.append(got)
        return b"".join(out)


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(path)


def prefix_counts(changes: bytes | None) -> np.ndarray:
    """Tokens of every prefix: element i is that of the first i code points."""
    got = np.cumsum(np.frombuffer(changes or b"\0", np.int8), dtype=np.int64)
    got[0] = 0  # the space in front is a token only before something
    return got


def index(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with ``prefix``: the changes of its token count, packed. ``tokenizer`` is a path that every worker can open."""

    @F.pandas_udf("binary")
    def changes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer)
        for texts in parts:
            yield pd.Series([counter.changes(t) for t in texts], dtype=object)
        release()

    return docs.withColumn("prefix", changes(F.col(text)))


def _answers(kind: str, made):
    @F.pandas_udf(kind)
    def answer(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([made(*row) for row in zip(*columns, strict=True)], dtype="int64")

    return answer


def counts(prefix: Column, at: Column) -> Column:
    """Tokens of the first `at` code points; positions beyond the text count it whole, negative or null ones nothing."""
    made = lambda p, i: prefix_counts(p)[int(min(max(0 if i is None or i != i else i, 0), max(len(p or b"") - 1, 0)))]
    return _answers("long", made)(prefix, at.cast("long"))


def longest(prefix: Column, budget: Column) -> Column:
    """Code points of the longest prefix with at most `budget` tokens (a longer prefix can have fewer tokens)."""
    made = lambda p, b: int(np.flatnonzero(prefix_counts(p) <= (0 if b is None or b != b else max(b, 0)))[-1])
    return _answers("long", made)(prefix, budget.cast("long"))


def tokens(prefix: Column, budgets: Sequence[int] = ()) -> Column:
    """Struct: n_tokens of the whole text and, for each budget, cut_<budget>: code points of the longest prefix within it."""
    names = ["n_tokens", *[f"cut_{b}" for b in budgets]]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = np.zeros((len(rows), len(names)), np.int64)
            for i, p in enumerate(rows):
                got = prefix_counts(p)
                out[i] = [got[-1], *[len(got) - 1 if got[-1] <= b else np.flatnonzero(got <= b)[-1] for b in budgets]]
            yield pd.DataFrame(out, columns=names)

    return answer(prefix)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, read from their stored prefix counts.

    Returns doc_id, n_bytes, n_tokens, over_limit, and cut: code points of the longest prefix of at most 4096 tokens.
    """
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    with batch_rows(spark, 1000):
        kept = stored(index(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "prefix"), "prefixes", "zstd")
    got = kept.select("doc_id", "n_bytes", tokens(F.col("prefix"), (LIMIT,)).alias("t"))
    return got.select("doc_id", "n_bytes", "t.n_tokens", (F.col("t.n_tokens") > LIMIT).alias("over_limit"), F.col(f"t.cut_{LIMIT}").alias("cut"))
