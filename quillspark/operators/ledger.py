"""The ledger: every non-empty source block ends with one status, and reports count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lowest to highest: a higher status hides a lower one.
PRECEDENCE = ("NON_QUESTION_CONTENT", "UNSUPPORTED_CONTENT", "REJECTED_QUESTION", "ACCEPTED_QUESTION")


def rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRECEDENCE)), status) - 1


def status(sources: DataFrame, marks: DataFrame) -> DataFrame:
    """sources(doc_id, source_id) with the highest status that marks(doc_id, source_id, status) give, null if none."""
    best = marks.groupBy("doc_id", "source_id").agg(F.max(rank(F.col("status"))).alias("_r"))
    return sources.select("doc_id", "source_id").distinct().join(best, ["doc_id", "source_id"], "left").withColumn("status", F.get(F.array(*map(F.lit, PRECEDENCE)), F.col("_r").cast("int"))).drop("_r")


def uncovered(sources: DataFrame, marks: DataFrame) -> DataFrame:
    return sources.join(marks, ["doc_id", "source_id"], "left_anti")


def counts(ledger: DataFrame) -> DataFrame:
    """One row a document with a count for every status, zero included."""
    return ledger.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).cast("int").alias(s.lower()) for s in PRECEDENCE], F.bool_and(F.col("status").isNotNull()).alias("complete"))


def deduplicated(records: DataFrame) -> DataFrame:
    """The first record of each (status, set of sources, number, reason, question indexes)."""
    from pyspark.sql import Window

    key = [F.col("doc_id"), F.col("status"), F.array_sort("source_ids"), F.col("original_number"), F.col("reason_code"), F.col("question_indexes")]
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("order"))).where("_n = 1").drop("_n")


def report(blocks: DataFrame, records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Totals of a document: accepted and rejected by record, the rest by source block."""
    size = blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_blocks"), F.sum(F.size("images")).cast("int").alias("image_count"), F.count_distinct("table_pos.table_source_id").cast("int").alias("table_count"))
    made = records.groupBy("doc_id").agg(F.count_if(F.col("status") == "ACCEPTED_QUESTION").cast("int").alias("accepted"), F.count_if(F.col("status") == "REJECTED_QUESTION").cast("int").alias("rejected"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order", "warnings"))), lambda x: x["warnings"]))).alias("warnings"))
    own = counts(ledger).select("doc_id", F.col("non_question_content").alias("non_question"), F.col("unsupported_content").alias("unsupported"), F.col("complete").alias("ledger_complete"))
    out = size.join(made, "doc_id", "left").join(own, "doc_id", "left").fillna(0, ["accepted", "rejected"])
    out = out.withColumn("candidates", F.col("accepted") + F.col("rejected"))
    return out.withColumn("uncertain", (F.col("rejected") > 0) | (F.col("unsupported") > 0) | ~F.col("ledger_complete"))


def balanced(reports: DataFrame) -> DataFrame:
    """The reports, failing where candidates are not accepted plus rejected."""
    ok = F.col("candidates") == F.col("accepted") + F.col("rejected")
    return reports.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("候选题账本不平衡")).cast("boolean")))
