"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors become one class, so a group of copies is compared once.
2. In each pass every class gets 64 random hyperplane bits, taken around the mean of all vectors; classes are ordered by
   them, lexicographically, and each is compared with the next ``window`` classes of the order. Orders come from range
   partitions; comparing is blockwise. The first round has as many passes as evenly spread vectors need for a pair at
   the threshold to meet in some window with the wanted probability.
3. Verified pairs of all passes are united into components by alternating stars. A block emits a star over each connected part.
   Vectors can be crowded, so the result is measured: a set of ``PROBES`` classes drawn by hash meets all classes, in
   blocks. While more than ``LOST`` of their links lead out of their component, another round doubles the passes; once
   they would cost as much as comparing all blocks with all blocks, that is done instead, and nothing is missed.
4. Links are then counted exactly inside each component, blocks against blocks, so dense groups wider than the window
   lose none: the count needs no pairs and no cap.

Cosines are taken in double precision. Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and stay, those of extreme finite components are compared like any; vectors of other
lengths never link; rows of a repeated vec_id are vectors of
their own; rows without a vec_id count as links but name no component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, load, stored
from .simhash import forest

THRESHOLD, WINDOW, BLOCK, MEET = 0.9, 1024, 2048, 0.98
#: Classes that measure a round, and the share of their links that may stay lost.
PROBES, LOST = 2048, 0.002


def passes(n: int, threshold: float = THRESHOLD, window: int = WINDOW, meet: float = MEET) -> int:
    """Passes after which a pair at the threshold has met with probability `meet`.

    It meets in a pass about when its first log2(n / window) bits agree.
    """
    bits = max(0.0, log2(max(n, 1) / window))
    once = (1 - acos(threshold) / pi) ** bits
    return max(2, ceil(log(1 - meet) / log(1 - min(once, 0.98))))


def _unit(rows: pd.Series | list) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square over- or underflows."""
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    if not len(x):
        return x.reshape(0, 0)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _digest(v) -> str | None:
    if v is None or not len(v):
        return None
    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) + 0.0
    return hashlib.sha256(x.tobytes()).hexdigest() if np.isfinite(x).all() and x.any() else None


def _key(embedding):
    """A digest of each usable vector's values, null for the others."""

    @F.pandas_udf("string")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            yield pd.Series([_digest(v) for v in rows], dtype=object)

    return made(embedding)


def _centres(classes: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of each length. One row a component of a vector reaches the driver."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["embedding"].map(len)):
                yield pd.DataFrame({"dim": np.int32(dim), "at": np.arange(dim, dtype=np.int32), "total": _unit(part["embedding"]).sum(0), "n": len(part)})

    made = classes.select("embedding").mapInPandas(summed, "dim int, at int, total double, n long")
    out: dict[int, list[float]] = {}
    for r in made.groupBy("dim", "at").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("dim", "at").collect():
        out.setdefault(r["dim"], []).append(round(r["mean"], 6))
    return {dim: np.array(mean) for dim, mean in out.items()}


def _orders(classes: DataFrame, first: int, last: int, centres: dict[int, np.ndarray], seed: int) -> DataFrame:
    """(pass, rank, class_id): the classes' places in the passes from first to last."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["embedding"].map(len)):
                x = _unit(part["embedding"]) - centres[int(dim)]
                for p in range(first, last):
                    on = x @ np.random.default_rng([seed, p, int(dim)]).normal(size=(int(dim), 64)) > 0
                    bits = np.packbits(on, axis=1).view(">u8").ravel()
                    yield pd.DataFrame({"pass": np.int32(p), "dim": np.int32(dim), "bits": (bits ^ np.uint64(1 << 63)).view(np.int64), "class_id": part["class_id"].to_numpy()})

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield pd.DataFrame({"pass": frame["pass"], "class_id": frame["class_id"], "part": np.int32(part), "at": np.arange(at, at + len(frame))})
            at += len(frame)

    bits = stored(classes.mapInPandas(hashed, "pass int, dim int, bits long, class_id long"), "bits")
    order = bits.repartitionByRange("pass", "dim", "bits", "class_id").sortWithinPartitions("pass", "dim", "bits", "class_id")
    order = stored(order.mapInPandas(numbered, "pass int, class_id long, part int, at long"), "orders")
    # One row a partition: the offsets of the range partitions, whose number bounds this side.
    sizes = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets += [part, total]
        total += sizes[part]
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for x in offsets]), F.col("part").cast("long")) if offsets else F.lit(0)
    return order.select("pass", (base + F.col("at")).alias("rank"), "class_id")


def _windows(classes: DataFrame, orders: DataFrame, threshold: float, window: int) -> DataFrame:
    """Links (a, b) found in the windows: per block, a star over each part that they connect."""
    step = max(BLOCK, window)
    placed = orders.join(classes.select("class_id", "embedding"), "class_id")
    own = F.floor(F.col("rank") / step)
    # A class belongs to its block, and to the one before if that block's windows reach it.
    blocks = F.when((F.col("rank") % step < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = placed.withColumn("block", F.explode(blocks))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return _stars(frame.sort_values("rank", kind="stable"), threshold, window)

    return placed.groupBy("pass", "block").applyInPandas(compare, "a long, b long").distinct()


def _stars(frame: pd.DataFrame, threshold: float, window: int | None = None) -> pd.DataFrame:
    """(a, b): a star over each part that links of the frame's classes connect, within windows of their ranks if given."""
    ids, out = frame["class_id"].to_numpy(), []
    sizes = frame["embedding"].map(len).to_numpy()
    for dim in np.unique(sizes):
        on = np.flatnonzero(sizes == dim)
        x = _unit(frame["embedding"].iloc[on])
        linked = x @ x.T >= threshold
        if window is not None:
            r = frame["rank"].to_numpy()[on]
            linked &= np.abs(r[:, None] - r[None, :]) <= window
        np.fill_diagonal(linked, False)
        pairs = on[forest(linked)]
        out.append(pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]}))
    return pd.concat(out)


def _everywhere(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links (a, b) as in ``_windows``, of all pairs: each pair of blocks is one group of bounded size."""
    blocks = max(1, ceil(2 * n / BLOCK))
    own, other = F.col("own"), F.col("other")
    placed = classes.select("class_id", "embedding", F.pmod(F.xxhash64(F.lit(13), "class_id"), F.lit(blocks)).alias("own"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.select("class_id", "embedding", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"))
    return placed.groupBy("i", "j").applyInPandas(lambda frame: _stars(frame, threshold), "a long, b long").distinct()


def lost_links(classes: DataFrame, member: DataFrame, threshold: float, probes: int = PROBES, seed: int = 29) -> tuple[int, int]:
    """Links of `probes` classes, drawn by hash, with all classes, and how many of them lead out of their component."""
    placed = classes.select("class_id", "embedding").join(member, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    drawn = placed.orderBy(F.xxhash64(F.lit(seed), "class_id"), "class_id").limit(probes).toPandas()
    sides = {}
    for dim, part in drawn.groupby(drawn["embedding"].map(len)):
        sides[int(dim)] = (_unit(part["embedding"]), part["class_id"].to_numpy(), part["component"].to_numpy())
    held = classes.sparkSession.sparkContext.broadcast(sides)

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["embedding"].map(len)):
                if int(dim) not in held.value:
                    continue
                x, ids, components_ = held.value[int(dim)]
                for at in range(0, len(part), BLOCK):
                    some = part.iloc[at : at + BLOCK]
                    linked = (_unit(some["embedding"]) @ x.T >= threshold) & (some["class_id"].to_numpy()[:, None] != ids[None, :])
                    lost = linked & (some["component"].to_numpy()[:, None] != components_[None, :])
                    yield pd.DataFrame({"links": [int(linked.sum())], "lost": [int(lost.sum())]})

    row = placed.mapInPandas(met, "links long, lost long").agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("lost"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _members(classes: DataFrame, n: int, threshold: float, window: int, meet: float, seed: int) -> DataFrame:
    """(class_id, component) of the linked classes, by rounds of passes until the probes find (nearly) no lost link."""
    centres, edges, done = _centres(classes), None, 0
    last = passes(n, threshold, window, meet)
    while True:
        whole = done > 0 and last * BLOCK >= n
        found = _everywhere(classes, n, threshold) if whole else _windows(classes, _orders(classes, done, last, centres, seed), threshold, window)
        edges = stored(found if edges is None or whole else edges.unionByName(found), "links")
        member = stored(components(edges).select(F.col("node").alias("class_id"), "component"), "members")
        if whole:
            return member
        links, lost = lost_links(classes, member, threshold)
        if lost <= LOST * links:
            return member
        done, last = last, 2 * last


def _counts(classes: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """(class_id, other): vectors of other classes of the component that link with the class."""
    placed = member.join(classes.select("class_id", "n", "embedding"), "class_id")
    sizes = member.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64(F.lit(13), "class_id"), F.col("blocks")).cast("int"))
    # Small components share tasks; each block of a large one meets every block of it once.
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(1 << 20))).otherwise(F.lit(-1))
    placed = placed.withColumns({"group": group, "many": F.when(F.col("blocks") > 1, F.col("component")).otherwise(0)})
    rows = lambda i, j, side: placed.select("group", "many", "component", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "class_id", "n", "embedding")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    both = rows(F.col("block"), every, 0).unionByName(rows(every, F.col("block"), 1))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(["component", frame["embedding"].map(len)]):
            left, right = part[part["side"] == 0], part[part["side"] == 1]
            if len(left) and len(right):
                linked = _unit(left["embedding"]) @ _unit(right["embedding"]).T >= threshold
                linked &= left["class_id"].to_numpy()[:, None] != right["class_id"].to_numpy()[None, :]
                out.append(pd.DataFrame({"class_id": left["class_id"].to_numpy(), "other": linked @ right["n"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"class_id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})

    return both.groupBy("group", "many", "i", "j").applyInPandas(count, "class_id long, other long").groupBy("class_id").agg(F.sum("other").alias("other"))


def cluster(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, meet: float = MEET, seed: int = 19) -> DataFrame:
    """vectors(vec_id, embedding): vec_id, n_links, component_id and kept, one row a vector."""
    keyed = stored(vectors.select("vec_id", "embedding").withColumn("key", _key("embedding")), "vectors")
    whole = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    # Numbered as they are written, so the numbers are distinct and stay; the whole digest tells classes apart.
    whole = stored(whole.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    n = whole.count()
    member = _members(whole, n, threshold, window, meet, seed)
    counts = _counts(whole, member, threshold)
    least = member.join(whole.select("class_id", "rep"), "class_id").groupBy("component").agg(F.min("rep").alias("least"))
    found = whole.select("key", "class_id", "rep", "n").join(member, "class_id", "left").join(least, "component", "left").join(counts, "class_id", "left")
    found = found.select("key", (F.col("n") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = keyed.select("vec_id", "key").join(found, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return cluster(load(spark, sf_dir, "embeddings"))
