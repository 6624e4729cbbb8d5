"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per source, targets are filled up by weight under a cap of max_repeat times the source, and each
document is emitted floor(rate) times plus once more when its hash falls below the fraction.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; documents of size 0 take
0 words; repeated rows are rows of their own (equal doc_id, equal draw); an empty table gives an empty mix. Columns
that the operator adds are named in ``mix``; columns of the input with those names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load

WEIGHTS = (5, 2, 1)
ADDED = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """(source, source_size) with one row a source -> also its weight and its target.

    The cap of a source binds where the common level passes max_repeat * size / weight. In the order of that ratio
    the capped sources are a prefix: the k-th is capped when the level shared by it and all later ones is above its
    ratio. The windows run over one row a source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    weight = F.array(*[F.lit(int(w)) for w in weights])
    at = sizes.withColumn("weight", F.element_at(weight, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    at = at.withColumns({"_all": F.sum("source_size").over(whole), "_full": F.coalesce(F.sum(F.col("source_size") * max_repeat).over(before), F.lit(0)), "_open": F.sum("weight").over(after)})
    capped = F.col("weight") * (F.col("_all") - F.col("_full")) > F.col("source_size") * max_repeat * F.col("_open")
    at = at.withColumn("_capped", capped)
    free = at.withColumns({"_rest": F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("source_size") * max_repeat)).over(whole), F.lit(0)), "_weights": F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(whole)})
    target = F.when(F.col("_capped"), (F.col("source_size") * max_repeat).cast("double")).otherwise((F.col("weight") * F.col("_rest")).cast("double") / F.col("_weights").cast("double"))
    return free.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, copies and taken for every row."""
    kept = [c for c in docs.columns if c not in ADDED]
    # The row goes on whole, so none of its columns can clash with those added here.
    docs = docs.select(F.struct(*kept).alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # Source and size are summed in each task before the shuffle: a hot source sends one row a task.
    goal = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    goal = goal.select(F.col("source").alias("of"), "source_size", "target")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    out = docs.join(goal, docs["source"].eqNullSafe(goal["of"])).withColumn("copies", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size")).select("row.*", *ADDED)


def emitted(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as its copies say, in the columns of docs."""
    mixed = mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row")), weights, max_repeat, seed)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes from it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
a AS (SELECT *, CAST(SUM(source_size) OVER () AS BIGINT) AS total,
  CAST(COALESCE(SUM(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filled,
  CAST(SUM(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight FROM w),
c AS (SELECT *, weight * (total - filled) > 3 * source_size * open_weight AS capped FROM a),
f AS (SELECT *, total - CAST(COALESCE(SUM(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS BIGINT) AS rest, CAST(SUM(CASE WHEN NOT capped THEN weight END) OVER () AS BIGINT) AS weights FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(weights AS DOUBLE) END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
  CAST(CAST('0x' || substr(md5('17:' || COALESCE(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
