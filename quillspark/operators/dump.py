"""Readable views of documents and segments: one JSON text and one summary line each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, json, summary) of documents; image contents are left out."""
    media = F.transform("media", lambda m: F.struct(F.concat(F.substring(m["media_id"], 1, 12), F.lit("...")).alias("media_id"), m["rel_id"].alias("rel_id"), m["file_name"].alias("file_name"), m["content_type"].alias("content_type")))
    count = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"))
    of = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind))
    line = F.concat_ws(", ", count(of("paragraph"), "paragraphs"), count(of("table"), "tables"), count(F.size("media"), "images"), count(F.size("warnings"), "warnings"))
    return docs.select("doc_id", F.to_json(F.struct("blocks", media.alias("media"), "levels", "warnings")).alias("json"), line.alias("summary"))


def segments(segmented: DataFrame, signals: DataFrame) -> DataFrame:
    """(doc_id, json, summary) of segments and the signals that made them."""
    seen = signals.groupBy("doc_id").agg(F.count("*").alias("signals"), F.array_sort(F.collect_list(F.struct("source_order", "segment", "signal"))).alias("list"))
    made = segmented.groupBy("doc_id").agg(F.count_distinct("segment").alias("segments"), F.array_sort(F.collect_list(F.when(F.col("segment").isNull(), F.struct("source_order", "source_id")))).alias("unassigned"))
    out = made.join(seen, "doc_id", "left")
    line = F.concat_ws(", ", F.concat("segments", F.lit(" segments")), F.when(F.size("unassigned") > 0, F.concat(F.size("unassigned"), F.lit(" unassigned"))), F.concat(F.coalesce("signals", F.lit(0)), F.lit(" signals")))
    return out.select("doc_id", F.to_json(F.struct("list", "unassigned")).alias("json"), line.alias("summary"))


def questions(found: DataFrame) -> DataFrame:
    """Questions as JSON texts."""
    return found.select("doc_id", F.to_json(F.struct(*[c for c in found.columns if c != "doc_id"])).alias("json"))

