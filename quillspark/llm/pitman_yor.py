"""Scores of a hierarchical Pitman-Yor language model whose seating is sampled by Gibbs over the whole corpus.

The root restaurant serves words drawn from a uniform base over the vocabulary and one unknown word. Under it, sharing
it as parent, are context restaurants: one for the start of a text, one for every frequent previous word (at least one
of ``contexts`` tokens, so there are at most that many) and some that rarer previous words share by hash. A word's
probability in a context is ((customers - d tables) + (theta + d all tables) root probability) / (theta + all
customers), averaged over samples of the seating.

Everything that grows with the corpus is partitioned by word: a bucket holds all occurrences of its words, so the
root and the context counts of a word meet there. Frequent words are spread over buckets by word and context; what
they share is a vector of at most ``hot`` numbers. A sweep draws the tables of each (context, word) from their
conditional law given the last sweep's totals; only the totals (a vector bounded by contexts and hot words) reach the
driver, summed in a fixed number of tasks. Draws are seeded by bucket and sweep, so a bucket replays earlier sweeps
instead of keeping state and lost executors cost nothing but time. Up to EXACT customers the law is exact (generalised
Stirling numbers); beyond, further customers are seated in growing runs.

Occurrences travel as packed arrays of a chunk of documents and come back to the chunk as sums per document. A pair of
words sends at most ``few`` documents of a chunk; where more hold it, they stay and its probability comes back. Words are
known by 64-bit hashes. Defined cases: a null or empty text is its end token alone; rows without a doc_id are learned
from; repeated rows are scored each; without learning rows each token gets the base; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, input_bytes, load, release, stored, text_batches

CONTEXTS, SHARED, HOT = 32_768, 32_767, 4_096  # with the start of a text, contexts fit 16 bits
BUCKET_BYTES, BUCKETS, CHUNK_TOKENS, CHUNK_DOCS = 16 << 20, 24, 700_000, 60_000
EXACT, BURN, SAMPLES = 100, 2, 2
END = np.uint64(0)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string."""
    from zstandard import ZstdCompressor

    head = ";".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    return ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(";"):
        kind, n = part.split(":")
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash."""
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


class _Words:
    """Codes of words with their hashes and, as previous words, their contexts; emptied when it is full."""

    def __init__(self, own: np.ndarray | None = None, limit: int = 180_000):
        self.own, self.limit = own, limit
        self.clear()

    def clear(self) -> None:
        waiting: list[bytes] = []

        class Codes(dict):
            def __missing__(self, key: bytes) -> int:
                waiting.append(key)
                self[key] = code = len(self) + 1
                return code

        self.codes, self.waiting = Codes(), waiting
        self.hashes, self.contexts = np.array([END]), np.zeros(1, np.uint16)  # code 0: the end as a word, the start as context

    @property
    def full(self) -> bool:
        return len(self.codes) > self.limit

    def of(self, text: str | None) -> np.ndarray:
        """Codes of the words of a text and of its end."""
        found = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
        out = np.zeros(len(found) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.codes.__getitem__, found), np.int32, len(found))
        return out

    def settle(self) -> None:
        from xxhash import xxh64_intdigest

        if self.waiting:
            h = np.maximum(np.array([xxh64_intdigest(w) for w in self.waiting], np.uint64), np.uint64(1))
            self.waiting.clear()
            self.hashes = np.concatenate([self.hashes, h])
            if self.own is not None:
                at = np.minimum(np.searchsorted(self.own, h), max(0, len(self.own) - 1))
                mine = self.own[at] == h if len(self.own) else np.zeros(len(h), bool)
                shared = len(self.own) + (h % np.uint64(SHARED)).astype(np.int64)
                self.contexts = np.concatenate([self.contexts, (1 + np.where(mine, at, shared)).astype(np.uint16)])


def _held(doc_id, part: int, parts: int) -> bool:
    return not pd.isna(doc_id) and crc32(str(int(doc_id)).encode()) % parts == part


def _vocabulary(buckets: int, held: tuple[int, int]):
    """Counts of the learning texts' words, a packed row for each bucket now and then."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total, pending, n = _Words(), np.zeros(0, np.int64), [], 0

        def add() -> np.ndarray:
            got = np.bincount(np.concatenate(pending), minlength=len(total))
            got[: len(total)] += total
            pending.clear()
            return got

        def rows() -> pd.DataFrame:
            words.settle()
            on = np.flatnonzero(total)
            order = on[np.argsort(words.hashes[on])]
            h, c = words.hashes[order], total[order]
            cut = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            return pd.DataFrame([(b, pack(h[x:y], c[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x], columns=["bucket", "data"])

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                if _held(doc_id, *held):
                    continue
                pending.append(words.of(text))
                n += len(pending[-1])
                if n >= CHUNK_TOKENS:
                    total, n = add(), 0
                    if words.full:
                        yield rows()
                        words.clear()
                        total = np.zeros(0, np.int64)
        if pending:
            total = add()
        if total.any():
            yield rows()
        del words, total
        release()

    return count


def _frequent(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: tokens, words, and the words that may be frequent: at least 1 in CONTEXTS of the bucket."""
    parts = [unpack(d) for d in frame["data"]]
    h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    c = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
    on = c * CONTEXTS >= c.sum()
    del parts, at
    release()
    return pd.DataFrame({"tokens": [int(c.sum())], "words": [len(h)], "hashes": [h[on].view(np.int64).tolist()], "counts": [c[on].tolist()]})


@dataclass
class Frame:
    """What all tasks share: sizes of the corpus, context words and hot words, all of bounded number."""

    tokens: int
    words: int
    own: np.ndarray  # hashes of words with a context of their own, sorted
    hot: np.ndarray  # hashes of words spread over buckets, sorted
    hot_counts: np.ndarray
    buckets: int
    held: tuple[int, int]
    few: int  # entries that a pair of words sends from a chunk at most

    @property
    def width(self) -> int:
        return 1 + len(self.own) + SHARED


def _occurrences(frame_: Frame):
    """Packed occurrences of each chunk of documents by bucket; the chunk's documents in a row of their own."""

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, seq = _Words(frame_.own), TaskContext.get().partitionId(), 0
        ids, texts, n = [], [], 0

        def rows() -> pd.DataFrame:
            words.settle()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            code = np.concatenate(texts)
            before = np.concatenate([[0], code[:-1]])  # a text follows an end, whose code is that of the start
            doc = np.repeat(np.arange(len(texts)), sizes)
            present = np.flatnonzero(np.bincount(code, minlength=len(words.hashes)))
            present = present[np.argsort(words.hashes[present])]
            rank = np.zeros(len(words.hashes), np.uint64)
            rank[present] = np.arange(len(present), dtype=np.uint64)
            key = rank[code] << np.uint64(32) | words.contexts[before].astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64)
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, times = key[first], np.diff(first, append=len(key))
            held = np.array([_held(i, *frame_.held) for i in ids])
            docs = (key & np.uint64(0xFFFF)).astype(np.uint16)
            pair = key >> np.uint64(16)
            start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pair, many = pair[start], np.diff(start, append=len(key))
            learned = np.add.reduceat(np.where(held[docs], 0, times), start)
            # The documents of a pair that many of the chunk hold stay here: only its probability has to come back.
            common = many > frame_.few
            own = np.repeat(common, many)
            stays = (words.hashes[present][(pair[common] >> np.uint64(16)).astype(np.int64)], (pair[common] & np.uint64(0xFFFF)).astype(np.uint16), many[common].astype(np.uint32), docs[own], times[own].astype(np.uint32))
            docs, times, many = docs[~own], times[~own], np.where(common, 0, many)
            start = np.cumsum(many) - many
            h, context = words.hashes[present][(pair >> np.uint64(16)).astype(np.int64)], (pair & np.uint64(0xFFFF)).astype(np.uint16)
            spread = np.isin(h, frame_.hot)
            bucket = _bucket(np.where(spread, (h ^ (context.astype(np.uint64) + np.uint64(1)) * _MIX) * _MIX, h), frame_.buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.repeat(start[order] - (np.cumsum(many[order]) - many[order]), many[order]) + np.arange(len(docs))
            docs, times = docs[at], times[at].astype(np.uint32)
            h, context, many, learned = h[order], context[order], many[order], learned[order].astype(np.uint32)
            cut = np.searchsorted(bucket[order], np.arange(frame_.buckets + 1))
            ends = np.concatenate([[0], np.cumsum(many)])
            name, out = part << 24 | seq, []
            for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                if y > x:
                    turn = np.flatnonzero(np.concatenate([[True], h[x + 1 : y] != h[x : y - 1]]))
                    t = times[ends[x] : ends[y]]
                    data = pack(h[x:y][turn], np.diff(turn, append=y - x).astype(np.uint32), context[x:y], many[x:y].astype(np.uint16), learned[x:y], docs[ends[x] : ends[y]], np.minimum(t, 255).astype(np.uint8), t[t >= 255])
                    out.append((b, name, data, None))
            out.append((-1 - name % frame_.buckets, name, pack(held, sizes, *stays), ids))
            return pd.DataFrame(out, columns=["bucket", "chunk", "data", "ids"])

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(words.of(text))
                n += len(texts[-1])
                if n >= CHUNK_TOKENS or len(texts) >= CHUNK_DOCS:
                    yield rows()
                    ids, texts, n, seq = [], [], 0, seq + 1
                    if words.full:
                        words.clear()
        if texts:
            yield rows()
        del words, texts
        release()

    return chunks


def _merged(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(words' hashes, word and context of each pair, customers of each pair, pair of each chunk's pairs in a row)."""
    names, inner = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    key = np.repeat(inner.astype(np.uint64), np.concatenate([p[1] for p in parts]))
    key <<= np.uint64(16)
    key |= np.concatenate([p[2] for p in parts])
    pairs, at = np.unique(key, return_inverse=True)
    del key
    counts = np.bincount(at, np.concatenate([p[4] for p in parts]), len(pairs)).astype(np.int64)
    return names, (pairs >> np.uint64(16)).astype(np.uint32), (pairs & np.uint64(0xFFFF)).astype(np.uint16), counts, at.astype(np.uint32)


def _gathered(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's rows in one: its seating problem, and the occurrences as they came."""
    bucket = int(frame["bucket"].iloc[0])
    if bucket < 0:
        return pd.DataFrame({"bucket": bucket, "types": None, "chunks": [[c] for c in frame["chunk"]], "data": [[d] for d in frame["data"]], "ids": frame["ids"]})
    frame = frame.sort_values("chunk")
    names, word, context, counts, _ = _merged([unpack(d) for d in frame["data"]])
    on = counts > 0
    types = pack(names, word[on], context[on], counts[on].astype(np.uint32))
    del names, word, context, counts
    release()
    return pd.DataFrame({"bucket": [bucket], "types": [types], "chunks": [frame["chunk"].tolist()], "data": [frame["data"].tolist()], "ids": [None]})


def stirling(n: int, discount: float) -> np.ndarray:
    """log S(c, t) of the generalised Stirling numbers, c and t up to n."""
    out = np.full((n + 1, n + 2), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(n + 1)
    for c in range(n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c, : n + 1] + np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1, : n + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :n]]))
    return out


def draw_tables(rng: np.random.Generator, customers: np.ndarray, others: np.ndarray, base: np.ndarray, theta: float, discount: float, table: np.ndarray) -> np.ndarray:
    """Tables of each dish given its customers, the restaurant's other tables and the dish's probability above."""
    out = np.minimum(customers, 1)
    for c in np.unique(np.minimum(customers[customers > 1], EXACT)):
        rows = np.flatnonzero(customers == c if c < EXACT else customers >= EXACT)
        for a in range(0, len(rows), max(1, 500_000 // int(c))):
            r = rows[a : a + max(1, 500_000 // int(c))]
            t = np.arange(c)
            law = np.cumsum(np.log(theta + discount * (others[r, None] + t)), axis=1) + (t + 1) * np.log(base[r, None]) + table[c, 1 : c + 1]
            out[r] = 1 + (law + rng.gumbel(size=law.shape)).argmax(1)
    big, seated = np.flatnonzero(customers > EXACT), EXACT
    while big.size:
        run = np.minimum(max(8, seated // 4), customers[big] - seated)
        new = (theta + discount * (others[big] + out[big])) * base[big]
        out[big] += rng.binomial(run, new / (new + seated + run / 2 - discount * out[big]))
        seated += max(8, seated // 4)
        big = big[customers[big] > seated]
    return out


@dataclass
class Totals:
    """Of one sweep: tables of each context, root customers and tables of hot words and of all."""

    tables: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray
    customers: float
    root_tables: float


@dataclass
class Shape:
    theta: float
    discount: float
    root_theta: float
    root_discount: float


class _Seating:
    """One bucket's seating, replayed sweep by sweep."""

    def __init__(self, frame: Frame, bucket: int, types: bytes):
        self.frame, self.bucket = frame, bucket
        self.names, word, context, counts = unpack(types)
        self.word, self.context, self.counts = word.astype(np.int64), context.astype(np.int64), counts.astype(np.int64)
        at = np.minimum(np.searchsorted(frame.hot, self.names), max(0, len(frame.hot) - 1))
        self.spread = frame.hot[at] == self.names if len(frame.hot) else np.zeros(len(self.names), bool)
        self.place = at
        self.tables = np.ones(len(self.counts), np.int64)
        self.settle(None)

    def settle(self, rng, shape: Shape | None = None, last: Totals | None = None, table: np.ndarray | None = None) -> None:
        self.root = np.bincount(self.word, self.tables, len(self.names)).astype(np.int64)
        self.root_tables = np.minimum(self.root, 1)
        if last is not None:
            own = ~self.spread & (self.root > 0)
            self.root_tables[own] = draw_tables(rng, self.root[own], np.full(own.sum(), max(0.0, last.root_tables - 1)), np.full(own.sum(), 1 / (self.frame.words + 1)), shape.root_theta, shape.root_discount, table)

    def root_probability(self, shape: Shape, last: Totals) -> np.ndarray:
        c, t = self.root.astype(float), self.root_tables.astype(float)
        if len(last.hot_customers):
            c, t = np.where(self.spread, last.hot_customers[self.place], c), np.where(self.spread, last.hot_tables[self.place], t)
        return (np.maximum(c - shape.root_discount * t, 0) + (shape.root_theta + shape.root_discount * last.root_tables) / (self.frame.words + 1)) / (shape.root_theta + last.customers)

    def sweep(self, k: int, seed: int, shape: Shape, last: Totals, tables: tuple[np.ndarray, np.ndarray]) -> None:
        rng = np.random.default_rng([seed, self.bucket, k])
        base = self.root_probability(shape, last)[self.word]
        others = np.maximum(last.tables[self.context] - self.tables, 0)
        self.tables = draw_tables(rng, self.counts, others, np.maximum(base, 1e-300), shape.theta, shape.discount, tables[0])
        self.settle(rng, shape, last, tables[1])

    def totals(self) -> np.ndarray:
        """The bucket's share of the next totals, with counts of counts behind."""
        own = ~self.spread
        hot = np.zeros(len(self.frame.hot))
        np.add.at(hot, self.place[self.spread], self.root[self.spread])
        return np.concatenate([np.bincount(self.context, self.tables, self.frame.width), np.bincount(self.context, self.counts, self.frame.width), hot, [self.root.sum(), self.root_tables[own].sum(), (self.counts == 1).sum(), (self.counts == 2).sum(), (self.root[own] == 1).sum(), (self.root[own] == 2).sum()]])


def _summed(rows: DataFrame, width: int, parts: int = 8) -> np.ndarray:
    """Sum of packed vectors; a fixed number of tasks adds them up."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for frame in frames:
            for d in frame["sums"]:
                total += unpack(d)[0]
        yield pd.DataFrame({"sums": [pack(total)]})
        release()

    got = rows.repartition(parts).mapInPandas(add, "sums binary").collect()
    return np.sum([unpack(r["sums"])[0] for r in got], axis=0) if got else np.zeros(width)


def score(docs: DataFrame, held: tuple[int, int] = (2, 7), burn: int = BURN, samples: int = SAMPLES, seed: int = 23, few: int = 256) -> DataFrame:
    """docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    held is (remainder, modulus) of the checksum of doc_id: those rows are scored but not learned from.
    """
    text_batches(docs.sparkSession)
    docs, spark = docs.select(F.col("doc_id").cast("long"), "text"), docs.sparkSession
    buckets = max(BUCKETS, -(-input_bytes(docs, "text") // BUCKET_BYTES))
    found = docs.mapInPandas(_vocabulary(buckets, held), "bucket int, data binary").groupBy("bucket").applyInPandas(_frequent, "tokens long, words long, hashes array<bigint>, counts array<bigint>")
    found = stored(found, "vocabulary", "none")
    size = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    # At least one token in CONTEXTS each: at most CONTEXTS rows.
    often = found.select(F.explode(F.arrays_zip("hashes", "counts")).alias("w")).select("w.*").where(F.col("counts") * CONTEXTS >= size[0]).collect()
    often = sorted((int(np.int64(r["hashes"]).view(np.uint64)), r["counts"]) for r in often)
    own = np.array([h for h, _ in often if h], dtype=np.uint64)
    hot = [(h, c) for h, c in often if c * HOT >= size[0]]
    frame = Frame(size[0], size[1], own, np.array([h for h, _ in hot], dtype=np.uint64), np.array([c for _, c in hot], dtype=np.int64), buckets, held, few)
    shared = spark.sparkContext.broadcast(frame)  # bounded by CONTEXTS and HOT

    packed = docs.mapInPandas(_occurrences(frame), "bucket int, chunk long, data binary, ids array<bigint>")
    table = stored(packed.groupBy("bucket").applyInPandas(_gathered, "bucket int, types binary, chunks array<bigint>, data array<binary>, ids array<bigint>"), "occurrences", "none")
    seats, width, k = table.where("bucket >= 0"), 2 * frame.width + len(frame.hot) + 6, len(frame.hot)

    def replay(bucket: int, types: bytes, history: list[Totals], shape: Shape | None) -> _Seating:
        seating = _Seating(shared.value, bucket, types)
        stirlings = (stirling(EXACT, shape.discount), stirling(EXACT, shape.root_discount)) if shape else None
        for i, last in enumerate(history):
            seating.sweep(i, seed, shape, last, stirlings)
        return seating

    def totals(history: list[Totals], shape: Shape | None) -> np.ndarray:
        def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"sums": [pack(replay(int(b), t, history, shape).totals()) for b, t in zip(f["bucket"], f["types"], strict=True)]})
                release()

        with batch_rows(spark, 1):
            return _summed(seats.select("bucket", "types").mapInPandas(share, "sums binary"), width)

    def read(x: np.ndarray, shape: Shape, sweep: int) -> Totals:
        c = x[2 * frame.width : 2 * frame.width + k]
        rest = x[2 * frame.width + k :]
        t = np.minimum(c, 1) if sweep == 0 else draw_tables(np.random.default_rng([seed, sweep]), c.astype(np.int64), np.full(k, max(0.0, rest[1] - 1)), np.full(k, 1 / (frame.words + 1)), shape.root_theta, shape.root_discount, stirling(EXACT, shape.root_discount))
        return Totals(x[: frame.width], c, t, float(rest[0]), float(rest[1] + t.sum()))

    first = totals([], None)
    customers = first[frame.width : 2 * frame.width]
    ones = lambda a, b: float(np.clip(a / max(1.0, a + 2 * b), 0.05, 0.95))  # noqa: E731  the usual estimate of a discount
    shape = Shape(1.0, ones(first[-4], first[-3]), 1.0, ones(first[-2], first[-1]))
    history = [read(first, shape, 0)]
    for i in range(1, burn + samples + 1):
        history.append(read(totals(history, shape), shape, i))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, tables = shared.value, (stirling(EXACT, shape.discount), stirling(EXACT, shape.root_discount))
        for rows in frames:
            for bucket, types, chunks, data in rows.itertuples(index=False):
                seating = _Seating(f, int(bucket), types)
                parts = [unpack(d) for d in data]
                names, word, context, counts, at = _merged(parts)
                parts = [(len(p[2]), *(p[i].copy() for i in (3, 5, 6, 7))) for p in parts]
                del data
                seen = np.flatnonzero(counts > 0)
                p = np.zeros(len(word))
                for i in range(burn + samples):
                    seating.sweep(i, seed, shape, history[i], tables)
                    if i >= burn:
                        now, t = history[i + 1], np.zeros(len(word))
                        t[seen] = seating.tables
                        p += (np.maximum(counts - shape.discount * t, 0) + (shape.theta + shape.discount * now.tables[context]) * seating.root_probability(shape, now)[word]) / (shape.theta + customers[context])
                log_p = np.log10(p / max(1, samples))
                total = np.bincount(word, counts, len(names))
                if len(f.hot):
                    total = np.where(seating.spread, f.hot_counts[seating.place], total)
                base = np.log10(total + 1) - np.log10(f.tokens + f.words + 1)
                known, done = (total > 0).astype(float), 0
                for chunk, (size_, many, docs_, times, more) in zip(chunks, parts, strict=True):
                    own_ = at[done : done + size_]
                    done += size_
                    each, times = np.repeat(own_, many), times.astype(float)
                    times[times == 255] = more
                    names_, inner = np.unique(docs_, return_inverse=True)
                    add = lambda v: np.bincount(inner, v * times, len(names_))  # noqa: E731, B023
                    back = own_[many == 0]
                    at_ = word[back]
                    yield pd.DataFrame({"chunk": [int(chunk)], "data": [pack(names_, add(known[word[each]]).astype(np.uint32), add(base[word[each]]), add(log_p[each]), names[at_], context[back], known[at_], base[at_], log_p[back])], "ids": [None]})
                del seating, parts, names, word, context, counts, at, seen, p, t, log_p
                release()

    with batch_rows(spark, 1):  # a row is a bucket
        sums = stored(seats.select("bucket", "types", "chunks", "data").mapInPandas(scored, "chunk long, data binary, ids array<bigint>"), "sums", "none")
    lists = table.where("bucket < 0").select(F.element_at("chunks", 1).alias("chunk"), F.element_at("data", 1).alias("data"), "ids")

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        named = rows["ids"].notna()
        ids = rows.loc[named, "ids"].iloc[0]
        out_, sizes, h, context, many, docs_, times = unpack(rows.loc[named, "data"].iloc[0])
        place = {p: i for i, p in enumerate(zip(h.tolist(), context.tolist(), strict=True))}
        values = np.zeros((len(h), 3))
        known, base, total = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for d in rows.loc[~named, "data"]:
            at, a, b, c, names, contexts, *back = unpack(d)
            known[at] += a
            base[at] += b
            total[at] += c
            values[[place[p] for p in zip(names.tolist(), contexts.tolist(), strict=True)]] = np.stack(back, axis=1)
        each = np.repeat(np.arange(len(h)), many)
        add = lambda k: np.bincount(docs_, values[each, k] * times, len(ids))
        known, base, total = known + add(0).astype(np.int64), base + add(1), total + add(2)
        release()
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"), "held_out": out_.astype(bool), "n_tokens": sizes, "n_known": known, "train_tokens": frame.tokens, "base_score": base, "score": total, "perplexity": 10 ** np.minimum(300.0, -total / sizes)})

    return sums.unionByName(lists).groupBy("chunk").applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model learned from the other part of the corpus."""
    return score(load(spark, sf_dir, "documents"))
