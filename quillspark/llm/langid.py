"""Language identification by interpolated Kneser-Ney models over the characters of words.

Words are lower-cased and padded with spaces. A language's model interpolates orders 4 to 1: raw counts on order 4,
continuation counts below, absolute discounts from the counts of counts. All languages share sorted arrays of n-gram
hashes, one an order, with a row of log probabilities (one a language) for every n-gram. A text takes the language of
the lowest cross-entropy per character. A softmax over cross-entropies, its sharpness fitted on held-back learning
rows, gives the score; a text below the score at which those rows reach the wanted precision is marked as rejected.

Learning takes a hash sample of about ``per_language`` documents a language, whole texts, which bounds the model;
prediction covers every row and whole texts.

Defined cases: und with score 0 for null texts and texts without a letter, and for all texts if nothing was learned;
ties go to the language that sorts first; rows without a language are not learned from; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, text_batches

PER_LANGUAGE = 1_500
ORDER = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each position."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(n - 1, -1, -1):
        moved = codes if k == 0 else np.concatenate([np.zeros(k, np.uint64), codes[:-k]])
        h = (h + moved + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, each behind three spaces and before one; which are predicted; and whose word."""
    text = "".join("   " + w + " " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 4
    starts = np.cumsum(lengths) - lengths
    predicted = np.ones(len(codes), bool)
    for k in range(3):
        predicted[starts + k] = False
    return codes, predicted, np.repeat(np.arange(len(words)), lengths)


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # sorted hashes, order 1 first
    probs: list[np.ndarray] = field(default_factory=list)  # probabilities, a row an n-gram
    contexts: list[np.ndarray] = field(default_factory=list)  # sorted hashes of contexts of order 2 and more
    backoff: list[np.ndarray] = field(default_factory=list)  # weight of the lower order after a context
    floor: np.ndarray | None = None  # probability of a character never seen
    sharpness: float = 10.0
    accept: float = 0.0

    def log10(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the code at each of the positions, a column a language."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        scale = np.ones_like(out)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            h = _hashes(codes, n)[at[left]]
            i = np.minimum(np.searchsorted(self.grams[n - 1], h), len(self.grams[n - 1]) - 1)
            hit = self.grams[n - 1][i] == h
            out[left[hit]] = scale[left[hit]] * self.probs[n - 1][i[hit]]
            left = left[~hit]
            if not left.size:
                break
            if n > 1:
                c = _hashes(codes, n - 1)[at[left] - 1]
                i = np.minimum(np.searchsorted(self.contexts[n - 2], c), len(self.contexts[n - 2]) - 1)
                known = self.contexts[n - 2][i] == c
                scale[left[known]] *= self.backoff[n - 2][i[known]]
            else:
                out[left] = scale[left] * self.floor
        return np.log10(out)

    def words(self, words: list[str]) -> np.ndarray:
        """A row a word: log probability in each language, characters predicted, whether it has a letter."""
        out = np.zeros((len(words), len(self.languages) + 2))
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            codes, predicted, whose = _padded(part)
            at = np.flatnonzero(predicted)
            logs = self.log10(codes, at)
            starts = np.flatnonzero(np.diff(whose[at], prepend=-1))
            out[a : a + len(part), : len(self.languages)] = np.add.reduceat(logs.astype(np.float64), starts)
            out[a : a + len(part), -2] = np.diff(starts, append=len(at))
            out[a : a + len(part), -1] = [any(map(str.isalpha, w)) for w in part]
        return out

    def entropies(self, parts: Iterator[list[str | None]], limit: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts: cross-entropy per character in each language, and which texts have a letter.

        Rows of words that were seen are kept until there are too many, which changes speed only.
        """
        waiting: list[str] = []

        class Codes(dict):
            def __missing__(self, key: str) -> int:
                waiting.append(key)
                self[key] = code = len(self)
                return code

        codes, table = Codes(), np.zeros((0, len(self.languages) + 2))
        for texts in parts:
            out, letter = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
            for i, text in enumerate(texts):
                at = np.fromiter(map(codes.__getitem__, text.lower().split()), np.int64) if isinstance(text, str) else np.zeros(0, np.int64)
                if waiting:
                    table = self._grown(table, len(codes), waiting)
                if len(at):
                    total = table[at].sum(0)
                    out[i], letter[i] = -total[:-2] / total[-2], total[-1] > 0
                if len(codes) > limit:
                    codes.clear()
            yield out, letter

    def _grown(self, table: np.ndarray, n: int, waiting: list[str]) -> np.ndarray:
        if len(table) < n:
            table = np.concatenate([table[: n - len(waiting)], np.zeros((max(n, 2 * len(table)) - n + len(waiting), table.shape[1]))]) if n - len(waiting) else np.zeros((max(1024, 2 * n), table.shape[1]))
        table[n - len(waiting) : n] = self.words(waiting)
        waiting.clear()
        return table

    def predict(self, texts: Iterator[list[str | None]]) -> Iterator[pd.DataFrame]:
        for ce, letter in self.entropies(texts) if self.languages else ((np.zeros((len(t), 1)), np.zeros(len(t), bool)) for t in texts):
            best = ce.argmin(1)
            share = 1 / np.exp(-self.sharpness * (ce - ce.min(1, keepdims=True))).sum(1)
            names = np.array([*self.languages, "und"], dtype=object)
            score = np.where(letter, share, 0.0)
            yield pd.DataFrame({"lang_pred": names[np.where(letter, best, len(names) - 1)], "score": score, "rejected": score < self.accept})

    def identify(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with lang_pred, score and rejected."""
        model = self
        text_batches(docs.sparkSession)

        @F.pandas_udf("lang_pred string, score double, rejected boolean")
        def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from model.predict(list(x) for x in parts)
            release()

        kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
        return docs.select(F.struct(*kept).alias("row"), found(F.col(text)).alias("found")).select("row.*", "found.*")


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Character 4-grams of padded words by language, summed over each batch."""
    for frame in frames:
        for lang, texts in frame.groupby("lang")["text"]:
            words = Counter()
            for t in texts:
                words.update(t.lower().split())
            grams: Counter = Counter()
            for w, n in words.items():
                p = "   " + w + " "
                for i in range(len(w) + 1):
                    grams[p[i : i + 4]] += n
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})


def build(languages: list[str], rows: list[tuple[str, str, int]]) -> Model:
    """The models from (language, 4-gram, count); none where there is no row."""
    if not rows:
        return Model([])
    model, many = Model(languages), len(languages)
    of = {x: i for i, x in enumerate(languages)}
    grams = sorted({g for _, g, _ in rows})
    place = {g: i for i, g in enumerate(grams)}
    counts = np.zeros((len(grams), many))
    for lang, g, n in rows:
        counts[place[g], of[lang]] += n
    levels = [(grams, counts)]
    for _ in range(ORDER - 1):  # how many different characters precede the shorter n-gram
        longer, held = levels[0]
        short = sorted({g[1:] for g in longer})
        at = {g: i for i, g in enumerate(short)}
        lower = np.zeros((len(short), many))
        np.add.at(lower, [at[g[1:]] for g in longer], held > 0)
        levels.insert(0, (short, lower))
    vocabulary = len(levels[0][0]) + 1
    below, index = None, {}
    for n, (names, c) in enumerate(levels, 1):
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(np.where(once + twice > 0, once / np.maximum(1, once + 2 * twice), 0.5), 0.1, 0.95)
        heads = sorted({g[:-1] for g in names})
        at = {g: i for i, g in enumerate(heads)}
        head = np.array([at[g[:-1]] for g in names])
        total, kinds = np.zeros((len(heads), many)), np.zeros((len(heads), many))
        np.add.at(total, head, c)
        np.add.at(kinds, head, c > 0)
        rest = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
        lower = np.full((len(names), many), 1 / vocabulary) if n == 1 else below[[index[g[1:]] for g in names]]
        p = np.maximum(c - discount, 0) / np.maximum(total, 1e-9)[head] + rest[head] * lower
        below, index = p, {g: i for i, g in enumerate(names)}
        key = _keys(names, n)
        order = np.argsort(key)
        model.grams.append(key[order])
        model.probs.append(p[order].astype(np.float32))
        if n == 1:
            model.floor = (rest[0] / vocabulary).astype(np.float32)
        else:
            key = _keys(heads, n - 1)
            order = np.argsort(key)
            model.contexts.append(key[order])
            model.backoff.append(rest[order].astype(np.float32))
    return model


def _keys(names: list[str], n: int) -> np.ndarray:
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _hashes(codes, n)[n - 1 :: n]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, precision: float = 0.99, seed: int = 3) -> Model:
    """A model from docs(doc_id, text, lang); one of four sampled documents calibrates the score."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < share).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(4)))
    grams = lambda part: part.select("lang", "text").mapInPandas(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    rows = [tuple(r) for r in grams(sample.where("fold > 0"))]
    model = build(sorted({r[0] for r in rows}), rows)

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(frames)
        for frame, (ce, letter) in zip(frames, model.entropies(list(f["text"]) for f in frames), strict=True):
            yield pd.DataFrame({"lang": frame["lang"], "ce": list(ce)})[letter]

    # Where no row is left to learn from but those that calibrate, nothing is calibrated.
    tries = sample.where("fold = 0").select("lang", "text").mapInPandas(tried, "lang string, ce array<double>").collect() if rows else []
    checked = [r for r in tries if r["lang"] in model.languages]
    if checked:
        ce = np.array([r["ce"] for r in checked])
        true = np.array([model.languages.index(r["lang"]) for r in checked])
        gap = ce - ce.min(1, keepdims=True)

        def loss(s: float) -> float:
            return float((np.log(np.exp(-s * gap).sum(1)) + s * gap[np.arange(len(true)), true]).mean())

        model.sharpness = min(np.geomspace(1, 200, 40), key=loss)
        share = 1 / np.exp(-model.sharpness * gap).sum(1)
        order = np.argsort(-share)
        good = np.cumsum((ce.argmin(1) == true)[order]) / np.arange(1, len(order) + 1) >= precision
        model.accept = float(share[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    # Calibrated on rows it had not seen, the model is now learned from all of them, so no language of the sample is lost.
    rows += [tuple(r) for r in grams(sample.where("fold = 0"))]
    final = build(sorted({r[0] for r in rows}), rows)
    final.sharpness, final.accept = model.sharpness, model.accept
    return final


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the languages of other documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held))
    return model.identify(docs.select("doc_id", "text")).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
