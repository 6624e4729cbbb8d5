"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint holds, bit by bit, the majority over the XXH64 of all word shingles of a text. Fingerprints within
``distance`` bits are linked. Distinct fingerprints are searched so:

1. Bits that correlate on a bounded sample are grouped into parts. If part i is probed within t_i bits and the
   (t_i + 1) add up to distance + 1, every pair within the distance meets in some part.
2. Dynamic programming spreads these thresholds unequally over the parts: it minimises probes plus candidates, both
   estimated from the sample and the number of fingerprints. Every number of parts is tried.
3. Each fingerprint indexes its masked parts and probes all variants within the thresholds: an equi-join on
   (part, masked bits). Candidates are verified by the number of differing bits inside the join.
4. Keys that many fingerprints share are compared in blocks against blocks; a block pair emits one star over each part
   that its links connect, never all pairs, and nothing is left out.
5. Links become components by alternating stars; copies only meet through their one fingerprint.

Defined cases: null or empty texts have fingerprint zero and are linked like others; texts below the shingle's words
are one shingle; rows without a doc_id take the component of their fingerprint, null if all its rows lack one; an empty
table gives no rows. Added columns replace columns of the same names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, load, release, stored, text_batches

WORDS, DISTANCE, SEED = 4, 4, 42
HOT, BLOCK, SAMPLE = 64, 2048, 2048


def _bits(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """Majority fingerprints of consecutive runs of hashes."""
    h = np.array(hashes, dtype="<u8")
    on = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.cumsum(sizes) - sizes
    counts = np.add.reduceat(on, starts, axis=0, dtype=np.int64)
    set_ = counts * 2 > np.asarray(sizes)[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[str | None], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints; a long text is hashed in pieces, so memory stays flat."""
    from xxhash import xxh64_intdigest as xxh

    out = np.zeros(len(texts), dtype="<u8")
    hashes, sizes, rows = [], [], []

    def flush() -> None:
        if rows:
            out[rows] = _bits(hashes, sizes)
            hashes.clear(), sizes.clear(), rows.clear()

    for i, text in enumerate(texts):
        found = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
        if not found:
            continue
        line = b" ".join(found)
        n = max(1, len(found) - words + 1)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        firsts = np.concatenate([[0], ends[: n - 1] + 1])
        lasts = ends[words - 1 :] if len(found) >= words else ends[-1:]
        if n > 400_000:
            counts = np.zeros(64, np.int64)
            for a in range(0, n, 200_000):
                h = np.array([xxh(line[s:e], seed) for s, e in zip(firsts[a : a + 200_000].tolist(), lasts[a : a + 200_000].tolist(), strict=True)], dtype="<u8")
                counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]
            continue
        hashes.extend([xxh(line[s:e], seed) for s, e in zip(firsts.tolist(), lasts.tolist(), strict=True)])
        sizes.append(n)
        rows.append(i)
        if len(hashes) > 200_000:
            flush()
    flush()
    return out


def fingerprint(text, words: int = WORDS, seed: int = SEED):
    """Column of fingerprints, as signed longs."""

    @F.pandas_udf("long")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(fingerprints(list(texts), words, seed).view(np.int64))
        release()

    return made(text)


def grouped_bits(on: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in so many parts of like size, each grown by the bit that correlates most with it."""
    spread = on.std(0)
    z = (on - on.mean(0)) / np.where(spread > 0, spread, 1)
    link = np.abs(z.T @ z / max(1, len(on)))
    np.fill_diagonal(link, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        part = [max(left, key=lambda b: (link[b, list(left)].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (link[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def _near(on: np.ndarray, part: list[int], most: int, differ: np.ndarray) -> np.ndarray:
    """Probability that two fingerprints differ in at most 0, 1, ... bits of the part; differ: where sampled pairs do."""
    apart = np.bitwise_count(differ & np.uint64(sum(1 << b for b in part)))
    law = np.zeros(most + 2)
    law[0] = 1.0
    for b in part:  # independent bits: a floor where the sample is too small to see near pairs
        p = on[:, b].mean() if len(on) else 0.5
        d = min(0.5, max(0.02, 2 * p * (1 - p)))
        law[1:] = law[1:] * (1 - d) + law[:-1] * d
        law[0] *= 1 - d
    seen = np.array([(apart <= t).mean() if len(apart) else 0.0 for t in range(most + 1)])
    return np.maximum(seen, np.cumsum(law)[: most + 1])


def allocate(on: np.ndarray, n: int, distance: int = DISTANCE, verify: float = 0.1, most_parts: int = 5, probes_limit: int = 20_000) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that are probed, at the least estimated cost for n fingerprints."""
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, len(on), (2, 200_000)) if len(on) > 1 else np.zeros((2, 0), int)
    pairs = pairs[:, pairs[0] != pairs[1]]
    # Packed: as floats, the pairs' bits took the driver some 300 MB whatever the input.
    packed = np.packbits(on.astype(bool), axis=1, bitorder="little").view("<u8").ravel()
    differ = packed[pairs[0]] ^ packed[pairs[1]]
    best = (np.inf, [])
    for m in range(1, min(most_parts, distance + 1) + 1):
        parts = grouped_bits(on, m)
        table = {0: (0.0, [])}
        for part in parts:
            near, after = _near(on, part, distance, differ), {}
            for used, (cost, taken) in table.items():
                for t in range(-1, distance - used + 1):
                    probes = sum(comb(len(part), k) for k in range(t + 1))
                    if probes > probes_limit or used + t + 1 > distance + 1:
                        continue
                    price = cost + (0 if t < 0 else n * (1 + probes) + verify * near[t] * n * n)
                    if used + t + 1 not in after or price < after[used + t + 1][0]:
                        after[used + t + 1] = (price, taken + ([(part, t)] if t >= 0 else []))
            table = after
        if distance + 1 in table and table[distance + 1][0] < best[0]:
            best = table[distance + 1]
    return best[1]


def _flips(part: list[int], most: int) -> list[int]:
    out, layer = [0], [(0, -1)]
    for _ in range(most):
        layer = [(x | 1 << b, i) for x, last in layer for i, b in enumerate(part) if i > last]
        out += [x for x, _ in layer]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(linked: np.ndarray) -> np.ndarray:
    """Edges of a star over each connected part of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), bool), []
    for root in np.flatnonzero(linked.any(1)):
        if not left[root]:
            continue
        left[root], edge = False, np.array([root])
        while edge.size:
            edge = np.flatnonzero(linked[edge].any(0) & left)
            left[edge] = False
            out += [(root, x) for x in edge]
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of fingerprints of fps(fp), distinct, that keep all components of the links within distance."""
    n = fps.count()
    sample = fps.orderBy(F.xxhash64(F.lit(7), "fp")).limit(SAMPLE).collect()
    values = np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64)
    on = ((values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float) if len(values) else np.zeros((1, 64))
    plan = allocate(on, n, distance)
    probes = [(i, _signed(sum(1 << b for b in part)), _signed(f)) for i, (part, t) in enumerate(plan) for f in _flips(part, t)]
    # As text, so that the constant stays one literal of the plan.
    constant = lambda rows, names: F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), "array<struct<" + ",".join(f"{k}:bigint" for k in names) + ">>")
    masks = [(i, m) for i, m in dict.fromkeys((i, m) for i, m, _ in probes)]
    index = fps.select("fp", F.explode(constant(masks, ("part", "mask"))).alias("p")).select("fp", F.col("p.part").cast("int").alias("part"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("key"))
    probe = fps.select(F.col("fp").alias("by"), F.explode(constant(probes, ("part", "mask", "flip"))).alias("p")).select("by", F.col("p.part").cast("int").alias("part"), F.col("by").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key"))
    keys = index.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("fp").alias("first"))
    met = stored(probe.join(keys, ["part", "key"]).where("n > 1 or first <> by"), "met")
    close = F.bit_count(F.col("by").bitwiseXOR(F.col("fp"))) <= distance
    single = met.where("n = 1").withColumnRenamed("first", "fp").where(close).select("by", "fp")
    several = met.where(f"n between 2 and {HOT}").select("by", "part", "key")
    several = several.join(index, ["part", "key"]).where(close & (F.col("by") != F.col("fp"))).select("by", "fp")
    hot = met.where(f"n > {HOT}").select("by", "part", "key", "n")
    found = single.unionByName(several).unionByName(_hot_links(hot, index, distance))
    return found.select(F.greatest("by", "fp").alias("a"), F.least("by", "fp").alias("b")).distinct()


def _hot_links(probes: DataFrame, index: DataFrame, distance: int) -> DataFrame:
    """Links under keys of many fingerprints: blocks of probes against blocks of indexed ones."""
    sizes = probes.groupBy("part", "key").agg(F.max("n").alias("n"), F.count("*").alias("m"))
    sizes = sizes.select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"))
    block = lambda c, k: F.pmod(F.xxhash64(F.lit(11), c), F.col(k)).cast("int")
    left = probes.select("part", "key", F.col("by").alias("fp")).join(sizes, ["part", "key"]).select("part", "key", block("fp", "mb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "fp", F.lit(0).alias("side"))
    right = index.join(sizes, ["part", "key"]).select("part", "key", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), block("fp", "nb").alias("j"), "fp", F.lit(1).alias("side"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        values, side = frame["fp"].to_numpy(), frame["side"].to_numpy()
        a, b = values[side == 0], values[side == 1]
        near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= distance
        i, j = np.nonzero(near)
        if len(i) > len(a) + len(b):
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            linked = np.zeros((len(nodes), len(nodes)), bool)
            linked[at[: len(a)][i], at[len(a) :][j]] = True
            pairs = forest(linked | linked.T)
            return pd.DataFrame({"by": nodes[pairs[:, 0]], "fp": nodes[pairs[:, 1]]})
        off = a[i] != b[j]
        return pd.DataFrame({"by": a[i][off], "fp": b[j][off]})

    return left.unionByName(right).groupBy("part", "key", "i", "j").applyInPandas(compare, "by long, fp long")


def _groups(marked: DataFrame, distance: int) -> DataFrame:
    """(fp, rep, component_id) of marked(doc_id, fp): of each distinct fingerprint the smallest doc_id of its own rows
    and of its component, with root, the component's name among fingerprints."""
    named = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    member = components(links(named.select("fp"), distance)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    # Components run on fingerprints; each takes the smallest document of its fingerprints.
    whole = member.join(named, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    of = member.join(whole, "root")
    return named.join(of, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id"))


def cluster(docs: DataFrame, text: str = "text", words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text): one row a document with fp (signed long) and component_id (smallest doc_id reachable)."""
    text_batches(docs.sparkSession)
    marked = stored(docs.select("doc_id", fingerprint(F.col(text), words, seed).alias("fp")), "fingerprints")
    return marked.join(_groups(marked, distance).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, or any of a component without doc_ids.

    Texts move once, by doc_id, so a large group of copies is spread before all but one row go. Only rows that share
    their doc_id with others are told apart by their fingerprints again.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    marked = stored(rows.select("row.doc_id", fingerprint(F.col("row")[text], words, seed).alias("fp")), "fingerprints")
    return first_rows(rows, marked, _groups(marked, distance), fingerprint(F.col("row")[text], words, seed))


def first_rows(rows: DataFrame, marked: DataFrame, groups: DataFrame, mark) -> DataFrame:
    """Of rows(row) one of each root of groups(fp, rep, root): that of the smallest doc_id, or any where there is none.

    marked(doc_id, fp) are the marks of the rows, mark the column that gives them.
    """
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("rep"), F.col("fp").alias("fp"))).alias("first")
    chosen = groups.groupBy("root").agg(first).select(F.col("first.rep").alias("rep"), F.col("first.fp").alias("chosen"))
    shared = marked.groupBy("doc_id").agg((F.count("*") > 1).alias("shared"))
    chosen = stored(chosen.join(shared, chosen["rep"].eqNullSafe(shared["doc_id"])).select("rep", "chosen", (F.col("shared") | F.col("rep").isNull()).alias("shared")), "chosen")
    kept = rows.join(chosen.where("NOT shared"), F.col("row.doc_id") == F.col("rep"), "left_semi")
    if chosen.where("shared").head(1):
        several = rows.join(chosen.where("shared"), F.col("row.doc_id").eqNullSafe(F.col("rep")))
        several = several.where(mark == F.col("chosen")).dropDuplicates(["rep", "chosen"]).select("row")
        kept = kept.unionByName(several)
    return kept.select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = cluster(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
