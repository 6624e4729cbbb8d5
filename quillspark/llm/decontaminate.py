"""Benchmark decontamination: BM25 retrieval of test items with block-max bounds, then verification.

Items are cut into segments of at most half a passage and indexed by term; a weight is a term's BM25 impact as a share
of its segment's score for itself, so one threshold serves segments of all lengths. Every training text is cut into
overlapping passages, each a query of its distinct terms. Block maxima of the weights, summed over the query, bound
every segment of a block: blocks below the threshold are passed over, the postings of the others are scored in full
and all segments above the threshold are retrieved. Whole batches of passages run at once, as arrays; these bounds
stand in for the pivot that a document-at-a-time traversal would move.

An item is verified where at least ``overlap`` of its five-word shingles (fewer words: the whole sequence) are in the
document, and as much of its answer's words if it marks an answer ("answer:"). Without a mark answer_overlap tells the
share of the last sentence's words and decides nothing: last sentences can be a single word.

An index holds at most ``shard_items`` items; more items make more indexes, each a broadcast of its own, all searched
in one pass over the texts: a worker's memory grows with the benchmark (about 3 kB an item), not with the corpus. Words are lower-cased (A-Z) and stripped of common punctuation. Defined cases: null or empty texts and items
match nothing; repeated rows are searched each; several items of one id are searched each and reported once, those
without an id each; an empty benchmark or corpus gives no hits. A column named hits is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, text_batches

SHINGLE, OVERLAP, THRESHOLD = 5, 0.8, 0.5
HALF, SHARD_ITEMS, BLOCKS = 64, 20_000, 32
_TABLE = bytes(ord(" ") if chr(c) in ".,;:!?\"'()[]{}" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<item_id:bigint,score:double,overlap:double,answer_overlap:double>>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if isinstance(text, str) else []


def answer(text: str) -> tuple[str, bool]:
    """What follows "answer:", else the last sentence; and whether it is marked."""
    if m := re.search(r"(?is)\banswer\s*:(.*\S.*)$", text):
        return m[1], True
    return re.split(r"(?<=[.!?])\s+|\n+", text.strip())[-1], False


def _shingles(codes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    n = min(n, len(codes))
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ (codes[k : k + len(h)].astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(31)
    return h


class _Vocabulary(dict):
    def __missing__(self, key: bytes) -> int:
        return -1


class Index:
    """Segments of test items by term, with block maxima."""

    def __init__(self, items: list[tuple[int | None, str | None]], k1: float = 1.2, b: float = 0.75, half: int = HALF, blocks: int = BLOCKS):
        self.half, self.vocabulary, self.items, segments = half, _Vocabulary(), [], []
        for item_id, text in items:
            if not (own := words(text)):
                continue
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own])
            last, marked = answer(text)
            tail = [c for c in (self.vocabulary[w] for w in words(last)) if c >= 0]
            self.items.append((item_id if item_id is None else int(item_id), np.unique(_shingles(codes)), len(codes), np.unique(tail), marked))
            segments += [(len(self.items) - 1, codes[a : a + half]) for a in range(0, len(codes), half)]
        self.owner = np.array([i for i, _ in segments], dtype=np.int64)
        self.terms, n = len(self.vocabulary), len(segments)
        rows = [(np.unique(c, return_counts=True), len(c), s) for s, (_, c) in enumerate(segments)]
        df = np.zeros(self.terms)
        for (t, _), _, _ in rows:
            df[t] += 1
        mean = np.mean([size for _, size, _ in rows]) if rows else 1.0
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        term, seg, weight = [], [], []
        for (t, f), size, s in rows:
            impact = idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean))
            term.append(t)
            seg.append(np.full(len(t), s))
            weight.append(impact / impact.sum())
        term, seg, weight = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((term, np.int64), (seg, np.int64), (weight, float)))
        order = np.lexsort((seg, term))
        self.seg, self.weight = seg[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(self.terms + 1))
        self.block = np.arange(n) // max(1, -(-n // blocks))
        self.most = np.zeros((self.terms, int(self.block.max(initial=-1)) + 1), np.float32)
        np.maximum.at(self.most, (term, self.block[seg]), weight.astype(np.float32))

    def retrieve(self, docs: list[np.ndarray], threshold: float) -> list[dict[int, float]]:
        """For each text's term codes (-1: not indexed): item -> the best score of its segments, all above threshold."""
        out: list[dict[int, float]] = [{} for _ in docs]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        halves = np.maximum(1, -(-sizes // self.half))
        firsts = np.cumsum(halves) - halves
        codes = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = np.repeat(firsts, sizes) + within // self.half
        known = codes >= 0
        codes, passage, within = codes[known], passage[known], within[known]
        back = within >= self.half  # the second half of the passage before
        key = np.unique(np.concatenate([passage * self.terms + codes, (passage[back] - 1) * self.terms + codes[back]]))
        if not key.size:
            return out
        passage, code = key // self.terms, key % self.terms
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        bound = np.zeros((len(starts), self.most.shape[1]), np.float32)
        ends = np.append(starts[1:], len(code))
        for a in range(0, len(starts), 4000):
            z = min(a + 4000, len(starts))
            bound[a:z] = np.add.reduceat(self.most[code[starts[a] : ends[z - 1]]], starts[a:z] - starts[a], axis=0)
        open_ = bound >= threshold - 1e-4
        row = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(code)))
        on = open_.any(1)[row]
        code, row = code[on], row[on]
        n = self.first[code + 1] - self.first[code]
        at = np.repeat(self.first[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row, seg, weight = np.repeat(row, n), self.seg[at], self.weight[at]
        on = open_[row, self.block[seg]]
        pair, where = np.unique(row[on] * len(self.block) + seg[on], return_inverse=True)
        score = np.bincount(where, weight[on], len(pair))
        for p, s in zip(pair[score >= threshold], score[score >= threshold], strict=True):
            doc = int(np.searchsorted(firsts, passage[starts[p // len(self.block)]], "right") - 1)
            item = int(self.owner[p % len(self.block)])
            out[doc][item] = max(float(s), out[doc].get(item, 0.0))
        return out

    def search(self, texts: list[str | None], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple]]:
        """Verified hits of each text: (item_id, score, overlap, answer_overlap)."""
        out, docs, chars, begun = [[] for _ in texts], [], 0, 0

        def flush(end: int) -> None:
            for i, (codes, found) in enumerate(zip(docs, self.retrieve(docs, threshold) if self.terms else [{}] * len(docs), strict=True)):
                held, hits = {}, {}
                for item, score in found.items():
                    item_id, shingles, size, tail, marked = self.items[item]
                    n = min(SHINGLE, size)
                    if n not in held:
                        held[n] = np.unique(_shingles(codes, n)) if len(codes) >= n else np.zeros(0, np.uint64)
                    share = float(np.isin(shingles, held[n]).mean())
                    last = float(np.isin(tail, codes).mean()) if tail.size else 1.0
                    if share >= overlap and (last >= overlap or not marked):
                        own = ("none", item) if item_id is None else item_id
                        hits[own] = max(hits.get(own, ()), (item_id, score, share, last))
                out[begun + i] = sorted(hits.values(), key=lambda h: (h[0] is None, h[0] or 0, h[1:]))

        for i, text in enumerate(texts):
            docs.append(np.fromiter(map(self.vocabulary.__getitem__, words(text)), np.int64))
            chars += len(text or "") + 50
            if chars > 2_000_000:
                flush(i)
                docs, chars, begun = [], 0, i + 1
        flush(len(texts))
        return out


def _finder(index, threshold: float, overlap: float):
    @F.pandas_udf(HITS)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            hits = index.value.search(list(texts), threshold, overlap)
            yield pd.Series([[dict(zip(("item_id", "score", "overlap", "answer_overlap"), h, strict=True)) for h in own] for own in hits], dtype=object)
        release()

    return found


def search(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """docs with hits, an array of the verified items(item_id, text) of each."""
    shards = max(1, -(-items.count() // shard_items))
    # The row goes on whole, so none of its columns can clash with those added here.
    out = docs.select(F.struct(*[c for c in docs.columns if c != "hits"]).alias("row"), F.col(text).alias("text"))
    text_batches(docs.sparkSession)
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64(F.col("item_id"), F.col("text")), F.lit(shards)) == shard).select("item_id", "text").orderBy("item_id", "text").collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own]))
        out = out.withColumn(f"_hits{shard}", _finder(index, threshold, overlap)(F.col("text")))
    return out.select("row", F.concat(*[f"_hits{s}" for s in range(shards)]).alias("hits")).select("row.*", "hits")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, a row for each document and item."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = search(docs, load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.score", "hit.overlap", "hit.answer_overlap")
