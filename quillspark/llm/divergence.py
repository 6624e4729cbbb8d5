"""How far the sources of a language part from one another and from the language: a two-pass vocabulary automaton.

1. Document frequencies of all terms are counted exactly; each language keeps the terms of at least ``least`` documents.
2. Kept terms, padded with a space at both ends, go into Aho-Corasick automata of at most ``shard`` terms. One automaton
   is broadcast and reads the documents where they lie; where one does not hold all kept terms, each text's terms are
   dealt to the automaton of their hash, in groups of bounded size. Either way every occurrence is counted.
3. A term's counts in the sources of its language are its posting. A pair of sources differs from two sources without
   terms only at terms of either, so the sum over all kept terms is taken from one histogram of counts a source and
   from the postings: pairs inside one posting are added up in the task that holds it, never written out.

A group is (lang, source). p = 1 + floor(SCALE (count + 1) / (N + V)) with N the group's kept occurrences and V the kept
terms of the language; divergence of p from q is floor((p - q)^2 / q). All arithmetic is exact for N + V below 9 * 10^15.

Defined cases: null text, lang and source are read as ''; a group or language without kept terms keeps its pairs, of
value 0; a language of one source has no pairs; equal values rank by the item's UTF-8 bytes; repeated rows are rows of
their own; other columns are not read; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_rows, load, release, stored

LEAST, TOP, SCALE = 3, 200, 10**9
#: Terms of one automaton (about 300 bytes each in a worker), bytes of padded text that a group of one reads at most
#: about, terms of documents a task keeps before it sends them on, occurrences it keeps (8 bytes each, twice when they
#: are sorted), pairs compared at once, groups of sources that are broadcast.
SHARD, READ, KEEP, WAIT, PAIRS, SMALL = 1_000_000, 16 << 20, 400_000, 4_000_000, 1 << 20, 100_000

#: Bytes: A-Z to a-z, other ASCII that is no letter to a space, the rest as it is.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_PLAIN).split()


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    for part in parts:
        yield part["lang"].to_pylist(), part["source"].to_pylist(), part["text"].cast(pa.binary()).to_pylist()


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, documents) of docs(lang, source, text) without nulls."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(Counter)

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, own in found.items():
                columns = [pa.repeat(pa.scalar(lang), len(own)), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "n"])
            found.clear()

        for langs, _, texts in _batches(parts):
            for lang, text in zip(langs, texts, strict=True):
                found[lang].update(set(terms(text)))
                if sum(map(len, found.values())) > KEEP:
                    yield from emptied()
        yield from emptied()
        release()

    made = docs.mapInArrow(counted, "lang string, term binary, n long")
    return made.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("documents"))


def automaton(kept: list[str]):
    """Finds every kept term of a text whose terms are padded by single spaces."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(kept):
        made.add_word(f" {term} ", i)
    if len(kept):
        made.make_automaton()
    return made


class _Occurrences:
    """What a task found, as whole arrays: keys are the group's number times the terms of the automaton plus the term's."""

    def __init__(self, found, tids: np.ndarray):
        self.found, self.tids, self.groups, self.keys, self.size = found, tids, {}, [], 0

    def read(self, lang: str, source: str, padded: str) -> Iterator[pa.RecordBatch]:
        """Reads a text to its end; sends on what was found whenever WAIT occurrences are kept."""
        if not len(self.found):
            return
        ends = map(itemgetter(1), self.found.iter(padded))
        while len(ids := np.fromiter(islice(ends, WAIT), np.int64)):
            self.keys.append(self.groups.setdefault((lang, source), len(self.groups)) * len(self.tids) + ids)
            self.size += len(ids)
            if self.size >= WAIT:
                yield self.emptied()

    def emptied(self) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(self.keys or [np.zeros(0, np.int64)]), return_counts=True)
        group, term = np.divmod(keys, max(1, len(self.tids)))
        named = list(zip(*self.groups, strict=True)) or [(), ()]
        columns = [pa.array(names, pa.string()).take(pa.array(group)) for names in named]
        self.groups, self.keys, self.size = {}, [], 0
        return pa.RecordBatch.from_arrays([*columns, pa.array(self.tids[term]), pa.array(n.astype(np.int64))], names=["lang", "source", "tid", "n"])


class _Held:
    """One automaton a worker, built when it is first needed."""

    key, made = None, None

    @classmethod
    def of(cls, key: str, packed) -> tuple:
        if cls.key != key:
            cls.made = None
            names = [t for part, _ in packed.value for t in zlib.decompress(part).decode("utf-8", "replace").split(" ")]
            tids = [np.frombuffer(zlib.decompress(part), np.int64) for _, part in packed.value]
            cls.made, cls.key = (automaton(names), np.concatenate(tids or [np.zeros(0, np.int64)])), key
        return cls.made


_OUT = "lang string, source string, tid long, n long"


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's terms and their numbers as two compressed values."""
    made = pa.Table.from_batches(parts) if (parts := [p for p in parts if p.num_rows]) else None
    if made:
        both = " ".join(made["term"].to_pylist()).encode(), made["tid"].to_numpy().tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x)], pa.binary()) for x in both], names=["terms", "tids"])


def _read_whole(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences by one automaton, which goes to every worker: `vocabulary` has at most SHARD terms."""
    # Packed in the tasks: the driver holds a few bytes a term and never its rows.
    packed = [(bytes(r["terms"]), bytes(r["tids"])) for r in vocabulary.mapInArrow(_packed, "terms binary, tids binary").collect()]
    kept, key = docs.sparkSession.sparkContext.broadcast(packed), uuid.uuid4().hex

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Occurrences(*_Held.of(key, kept))
        for langs, sources, texts in _batches(parts):
            for lang, source, text in zip(langs, sources, texts, strict=True):
                yield from found.read(lang, source, f" {b' '.join(terms(text)).decode('utf-8', 'replace')} ")
        yield found.emptied()
        release()

    return docs.mapInArrow(counted, _OUT)


def _read_sharded(docs: DataFrame, vocabulary: DataFrame, shards: int, read: int) -> DataFrame:
    """Occurrences by several automata: the terms of texts are dealt to the automaton of their hash."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    salts = max(1, -(-int(total) // (shards * read)))

    def dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, sources, texts in _batches(parts):
            if not texts:
                continue
            got: dict = defaultdict(list)
            for lang, source, text in zip(langs, sources, texts, strict=True):
                for term in terms(text):
                    got[crc32(term) % shards, lang, source].append(term)
            # A hot term fills its shard alone, so a shard's texts are cut and spread over its salts.
            cut = [(s, lang, source, t[i : i + 4096]) for (s, lang, source), t in got.items() for i in range(0, len(t), 4096)]
            rows = [(s, i % salts, lang, source, b" ".join(t).decode("utf-8", "replace")) for i, (s, lang, source, t) in enumerate(cut, crc32(texts[0]))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["shard", "salt", "lang", "source", "text"])

    texts = docs.mapInArrow(dealt, "shard int, salt int, lang string, source string, text string")
    kept = vocabulary.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "term", "tid")

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _Occurrences(automaton(right["term"].to_pylist()), right["tid"].to_numpy())
        texts = zip(*(left[c].to_pylist() for c in ("lang", "source", "text")), strict=True)
        made = [batch for lang, source, text in texts for batch in found.read(lang, source, f" {text} ")]
        return pa.Table.from_batches([*made, found.emptied()])

    return texts.groupBy("shard", "salt").cogroup(kept.groupBy("shard", "salt")).applyInArrow(counted, _OUT)


def occurrences(docs: DataFrame, kept: DataFrame, shard: int = SHARD, read: int = READ) -> DataFrame:
    """(lang, source, term, n): how often each kept(lang, term) occurs in the groups that hold it."""
    # Terms travel as numbers, which are fixed once the table is written.
    vocabulary = stored(kept.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    shards = max(1, -(-vocabulary.count() // shard))
    made = _read_whole(docs, vocabulary) if shards == 1 else _read_sharded(docs, vocabulary, shards, read)
    # Terms that only another language keeps leave here.
    named = kept.select("lang", "term").join(vocabulary, "term")
    return made.groupBy("lang", "source", "tid").agg(F.sum("n").alias("n")).join(named, ["lang", "tid"]).select("lang", "source", "term", "n")


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / whole) by long division in steps of 1000, so nothing overflows; 0 where whole is 0."""
    whole = np.asarray(whole, np.int64)
    rest, out = np.asarray(count, np.int64) + 1, np.zeros(np.broadcast(count, whole).shape, np.int64)
    by = np.maximum(whole, 1)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // by, rest % by
    return np.where(whole > 0, out + 1, 0)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); 0 where q is 0."""
    return (p - q) * (p - q) // np.maximum(q, 1)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, b)


def _share(count: Column, whole: Column) -> Column:
    """``share`` as a column; whole must not be 0."""
    big = lambda x: F.lit(x).cast("long")
    rest, out = count + big(1), big(0)
    for _ in range(3):
        rest = rest * big(1000)
        out, rest = out * big(1000) + _div(rest, whole), rest % whole
    return out + big(1)


def _groups(docs: DataFrame, kept: DataFrame, found: DataFrame) -> DataFrame:
    """One row a group: gid, N + V of it (whole) and of its language (of_lang), V, its number of terms, p of count 0."""
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("own"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(size, "lang", "left")
    rows = stored(rows.select("lang", "source", none("n"), none("own"), none("v")).withColumn("gid", F.monotonically_increasing_id()), "groups")
    of = rows.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("of_lang"))
    whole = F.col("n") + F.col("v")
    p0 = F.when(whole > 0, _share(F.lit(0).cast("long"), F.greatest(whole, F.lit(1)))).otherwise(F.lit(0).cast("long"))
    return stored(rows.join(of, "lang").select("gid", "lang", "source", "own", "v", whole.alias("whole"), "of_lang", p0.alias("p0")), "groups")


def _both(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value) of the pairs inside postings: what terms of both add to the sums that take them as terms of one."""
    for part in parts:
        ends = part["gid"].offsets.to_numpy()
        gid, p, p0 = (part[c].flatten().to_numpy() for c in ("gid", "p", "p0"))
        size = np.repeat(np.diff(ends), np.diff(ends))
        first = np.repeat(ends[:-1] - ends[0], np.diff(ends))
        # Each entry meets its whole posting; entries are taken in slices of a bounded number of pairs.
        done = np.cumsum(size)
        at = 0
        while at < len(gid):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(at, to), size[at:to])
            b = np.arange(len(a)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to]) + first[a]
            a, b = a[keep := gid[a] != gid[b]], b[keep]
            value = gap(p[a], p[b]) - gap(p[a], p0[b]) - gap(p0[a], p[b]) + gap(p0[a], p0[b])
            order = np.lexsort((gid[b], gid[a]))
            a, b, value = gid[a][order], gid[b][order], value[order]
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
            sums = np.add.reduceat(value, starts) if len(a) else value
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(sums)], names=["a", "b", "value"])
            at = to


def _alone(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value) of each group a with each other of its language, as if they shared no term."""
    for part in parts:
        for row in part.to_pylist():
            p, n = (np.array(row[c] or [], np.int64) for c in ("p", "n"))
            other, q0, own = (np.array(row[c], np.int64) for c in ("others", "others_p0", "others_own"))
            other, q0, own = other[keep := other != row["gid"]], q0[keep], own[keep]
            step = max(1, PAIRS // max(1, len(p)))
            for at in range(0, len(other), step):
                b, q = other[at : at + step], q0[at : at + step]
                a = np.full(len(b), row["gid"])
                left = (gap(p[:, None], q[None, :]) * n[:, None]).sum(0) + (row["v"] - row["own"] - own[at : at + step]) * gap(np.int64(row["p0"]), q)
                right = (gap(q[None, :], p[:, None]) * n[:, None]).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, b]), pa.array(np.r_[b, a]), pa.array(np.r_[left, right])], names=["a", "b", "value"])


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD, read: int = READ) -> DataFrame:
    """docs(lang, source, text): lang, source, part, item, value and rank, as the module says."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    with batch_rows(spark, 500):
        kept = stored(frequencies(docs).where(F.col("documents") >= least), "kept")
        found = stored(occurrences(docs, kept, shard, read), "occurrences")
    groups = _groups(docs, kept, found)
    # One row a group; sent to all executors only where their number is small.
    near = F.broadcast if groups.count() <= SMALL else (lambda df: df)
    rows = found.join(near(groups), ["lang", "source"]).select("lang", "term", "n", "gid", "of_lang", "p0", _share(F.col("n"), F.col("whole")).alias("p"))
    listed = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("e"), F.sum("n").alias("n"), F.any_value("of_lang").alias("of_lang"))
    posting = stored(listed.select("term", "e", _share(F.col("n"), F.col("of_lang")).alias("q")), "postings")
    triple = "a long, b long, value long"
    both = posting.where(F.size("e") > 1).select(F.col("e.gid").alias("gid"), F.col("e.p").alias("p"), F.col("e.p0").alias("p0"))
    steps = rows.groupBy("gid", "p").agg(F.count("*").alias("n")).groupBy("gid").agg(F.collect_list(F.struct("p", "n")).alias("h"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("gid", "p0", "own")).alias("o"))
    alone = groups.join(peers, "lang").join(steps, "gid", "left").select("gid", "p0", "own", "v", F.col("h.p").alias("p"), F.col("h.n").alias("n"), F.col("o.gid").alias("others"), F.col("o.p0").alias("others_p0"), F.col("o.own").alias("others_own"))
    with batch_rows(spark, 1000):
        parts = [both.mapInArrow(_both, triple), alone.mapInArrow(_alone, triple)]
        pairs = stored(parts[0].unionByName(parts[1]).groupBy("a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")), "pairs")
    names = near(groups.select(F.col("gid").alias("a"), "lang", "source"))
    pairs = pairs.join(names, "a").join(near(groups.select(F.col("gid").alias("b"), F.col("source").alias("item"))), "b")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    p, q = F.col("e.p"), F.col("q")
    entry = posting.select("term", "q", F.explode("e").alias("e")).where(p > q)
    entry = entry.select(F.col("e.gid").alias("a"), F.col("term").alias("item"), _div((p - q) * (p - q), q).alias("value"))
    by = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(F.desc("value"), "item"))
    best = entry.withColumn("rank", by("a")).where(F.col("rank") <= top).join(names, "a")
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", by("lang", "source")).unionByName(best)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    return audit(load(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
  translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING COUNT(DISTINCT r) >= 3),
v AS (SELECT lang, COUNT(*) AS v FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, COUNT(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, COALESCE(v.v, 0) AS v, COALESCE((SELECT SUM(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM g LEFT JOIN v ON v.lang = g.lang),
p AS (SELECT s.lang, s.source, k.term, COALESCE(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (COALESCE(c.n, 0) + 1)) // (s.n + s.v) AS HUGEINT) AS p
  FROM s JOIN k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT lang, SUM(n) AS n, MAX(v) AS v FROM s GROUP BY lang),
q AS (SELECT k.lang, k.term, CAST(1 + (1000000000::HUGEINT * (COALESCE(SUM(c.n), 0) + 1)) // (ANY_VALUE(l.n) + ANY_VALUE(l.v)) AS HUGEINT) AS q
  FROM k JOIN l ON l.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.term = k.term GROUP BY k.lang, k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, SUM(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(pv.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
t AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
e AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value, rank FROM e WHERE part = 'pair' OR rank <= 200
"""
