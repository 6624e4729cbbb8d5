"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

1. Rows are dealt to virtual partitions by hash and counted (one number a partition reaches the driver).
2. The driver draws how many rows go from each partition to each shard: multivariate hypergeometric rows whose
   column sums are the shard sizes, as a uniform permutation would have them.
3. Every partition orders its rows by a second hash, a local permutation, and cuts the order at the matrix's marks.
4. Inside a shard rows are ordered by a third hash; slots are numbered through counted hash ranges, so no task sorts
   a whole shard.

All row work is DataFrame functions. Equal rows are told apart by their number among equal rows only, so their
places are interchangeable. A null key or text is an ordinary value; an empty table gives no rows; input columns
named shard or slot are replaced.
"""

from __future__ import annotations

import json
from math import exp, lgamma

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

SHARDS, ROWS = 24, 1_000_000


def communication(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """rows[p, s]: rows that partition p sends to shard s; column sums are at most one apart."""
    total, rng = sum(counts), np.random.default_rng(seed)
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        left, free = n, int(room.sum())
        for s in range(shards):  # conditional draws, shard after shard: the multivariate law without its size limits
            rest = free - int(room[s])
            k = left if rest == 0 else 0 if left == 0 or room[s] == 0 else _hypergeometric(rng, int(room[s]), rest, left)
            out[p, s], left, free = k, left - k, rest
        room -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw from the hypergeometric law; numpy's own stops at 10^9."""
    return int(rng.hypergeometric(good, bad, n)) if good + bad < 1_000_000_000 else inverted(rng, good, bad, n)


def inverted(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same law by inversion, outwards from the mode: about as many steps as the standard deviation."""
    low, high = max(0, n - bad), min(n, good)
    right = left = mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    log_choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    up = down = exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    rest = rng.random() - up
    while rest > 0 and (left > low or right < high):
        if right < high:
            up *= (good - right) / (right + 1) * ((n - right) / (bad - n + right + 1))
            right += 1
            rest -= up
            if rest <= 0:
                return right
        if left > low:
            down *= left / (good - left + 1) * ((bad - n + left) / (n - left + 1))
            left -= 1
            rest -= down
            if rest <= 0:
                return left
        if max(up, down) < 1e-300:
            break
    return mode


def shard_rows(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = 29, partitions: int | None = None) -> DataFrame:
    """df with shard (0 to shards - 1, counts at most one apart) and slot (gapless from 0 in a shard).

    partitions bounds the matrix (partitions x shards numbers); each holds an even share, whatever the keys. By default
    there are as many as make shares of about ROWS rows.
    """
    df = df.drop("shard", "slot")
    partitions = partitions or max(256, -(-df.count() // ROWS))
    # Rows of a repeated key differ in another column and so in their hashes; only fully equal rows share them.
    row = [F.col(c) for c in df.columns]
    h = lambda k: F.xxhash64(F.lit(seed * 1000 + k), F.col(key), *row)
    # The row goes on whole, so none of its columns can clash with those added here.
    at = df.select(F.struct(*row).alias("row"), F.pmod(h(1), F.lit(partitions)).cast("int").alias("_p"), h(2).alias("_a"), h(3).alias("_b"))
    counted = {r["_p"]: r["n"] for r in at.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    marks = np.cumsum(communication([counted.get(p, 0) for p in range(partitions)], shards, seed), axis=1)
    cuts = F.from_json(F.lit(json.dumps(marks.tolist())), "array<array<bigint>>")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_a", "_b"))
    at = at.withColumn("_rank", rank)
    at = at.withColumn("shard", F.size(F.filter(F.element_at(cuts, F.col("_p") + 1), lambda x: x < F.col("_rank"))).cast("int"))
    at = at.withColumn("_range", F.shiftrightunsigned(F.col("_b"), 56).cast("int"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("n")
    ranges = at.groupBy("shard", "_range").agg(F.count("*").alias("n")).select("shard", "_range", before.alias("_before"))
    at = at.withColumn("_in", F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_b", "_p", "_rank")))
    # 256 ranges a shard: at most shards * 256 rows, so this side may be broadcast.
    at = at.join(F.broadcast(ranges), ["shard", "_range"])
    return at.withColumn("slot", (F.col("_before") + F.col("_in") - 1).cast("long")).select("row.*", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of equal row counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
