"""Source blocks: the ordered facts that recognition works on.

source_blocks(doc_id, source_id, source_order, source_type, raw_text, numbering struct, table_pos struct, images array,
order_start, order_end, unsupported_reason). A paragraph outside tables is a block, every table cell is one (nested
paragraphs joined by line breaks), and every unsupported structure is one, after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources import docx

IMAGE = "struct<media_id:string,relationship_id:string,local_path:string,content_type:string,supported_for_display:boolean,char_offset:int>"
SCHEMA = f"doc_id string, source_id string, source_order int, source_type string, raw_text string, numbering struct<num_id:string,level:int,display_text:string>, table_pos struct<table_source_id:string,row:int,column:int>, images array<{IMAGE}>, order_start int, order_end int, unsupported_reason string"
MAX_LEVEL = 9


def is_non_empty():
    return ~T.is_blank(F.col("raw_text")) | (F.size("images") > 0) | F.col("unsupported_reason").isNotNull()


def non_empty(blocks: DataFrame) -> DataFrame:
    return blocks.where(is_non_empty())


def projected(blocks: DataFrame) -> DataFrame:
    """Paragraphs with their text and the offsets of their inline content: text appended, breaks as line feeds, images
    without width. Runs of text that follow each other are one already."""
    piece = lambda x: F.when(x["kind"] == "lineBreak", F.lit("\n")).otherwise(F.coalesce(x["text"], F.lit("")))
    text = F.array_join(F.transform("inlines", piece), "")
    before = lambda i: F.aggregate(F.slice("inlines", 1, i), F.lit(0), lambda n, x: n + F.length(piece(x)))
    offsets = F.transform("inlines", lambda x, i: F.struct(i.alias("index"), before(i).alias("start"), (before(i) + F.length(piece(x))).alias("end"), x["kind"].alias("type"), x["media_id"].alias("media_id"), x["rel_id"].alias("rel_id")))
    return blocks.withColumns({"text": text, "offsets": offsets})


def clamped_substring(text, start, end):
    """Characters from start to end, both clamped to the text."""
    at = F.greatest(F.least(start, F.length(text)), F.lit(0))
    return F.substring(text, at + 1, F.greatest(F.least(end, F.length(text)), F.lit(0)) - at)


def counters(numbered: DataFrame, levels: DataFrame, depth: int = MAX_LEVEL) -> DataFrame:
    """numbered(doc_id, ordinal, num_id, level) with display_text: list counters rendered into their templates.

    A row's counter counts the rows of its level since the last row of a lower one, in the same list. An ancestor's
    value is its last counter while no lower level came between, else its start. depth bounds the levels that occur.
    """
    # All windows share one order, so that a list is sorted once.
    order = Window.partitionBy("doc_id", "num_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered.withColumns({f"_n{k}": F.count_if(F.col("level") == k).over(order) for k in range(depth)})
    reset = lambda k: F.last(F.when(F.col("level") < k, F.col(f"_n{k}")), ignorenulls=True).over(order)
    rows = rows.select(*numbered.columns, F.array(*[(F.col(f"_n{k}") - F.coalesce(reset(k), F.lit(0))).cast("int") for k in range(depth)]).alias("_seen"))
    wide = levels.groupBy("doc_id", "num_id").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("num_fmt", "lvl_text", F.coalesce("start", F.lit(1)).alias("start"))))).alias("_levels"))
    rows = rows.join(wide, ["doc_id", "num_id"], "left")
    own, values = F.try_element_at("_levels", F.col("level")), []
    for k in range(depth):
        level, seen = F.try_element_at("_levels", F.lit(k)), F.get("_seen", F.lit(k))
        start = F.coalesce(level["start"], F.lit(1))
        # a level deeper than the row's has been reset
        value = F.when((F.col("level") >= k) & (seen > 0), seen + start - 1).otherwise(start)
        values.append(T.rendered_number(value, F.coalesce(level["num_fmt"], F.lit("decimal"))))
    counter = F.get("_seen", F.col("level")) + F.coalesce(own["start"], F.lit(1)) - 1
    return rows.select(*numbered.columns, counter.alias("counter"), T.expanded_template(own["lvl_text"], values).alias("display_text"))


def extract(docs: DataFrame) -> DataFrame:
    """Source blocks of documents read by ``sources.docx``."""
    blocks = projected(docx.blocks(docs))
    paragraphs = blocks.where("kind = 'paragraph'")
    media = docx.media(docs).select("doc_id", F.col("media_id").alias("_media"), "file_name", "content_type", "displayable")
    # Place of a block: its own order outside tables, that of its cell inside.
    cells = blocks.where("kind = 'cell'").select("doc_id", F.col("ordinal").alias("slot"), F.col("source_id").alias("table_id"), "row", "col", "source_order")
    inner = paragraphs.where("table_id IS NOT NULL")
    first = Window.partitionBy("doc_id", "table_id", "row", "col").orderBy("ordinal")
    inner = inner.withColumns({"_shift": F.coalesce(F.sum(F.length("text") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.row_number().over(Window.partitionBy("doc_id", "table_id", "row", "col", F.col("num_id").isNull()).orderBy("ordinal"))})
    # A cell takes the number of its first numbered paragraph only.
    outer = paragraphs.where("table_id IS NULL").withColumns({"_shift": F.lit(0).cast("long"), "_n": F.lit(1)})
    both = outer.unionByName(inner)
    shown = counters(both.where("num_id IS NOT NULL AND _n = 1").select("doc_id", "ordinal", "num_id", "level"), docx.numbering(docs)).select("doc_id", "ordinal", "display_text")
    image = both.select("doc_id", "ordinal", "_shift", F.explode("offsets").alias("o")).where("o.type = 'image'").select("doc_id", "ordinal", F.col("o.index").alias("i"), F.col("o.media_id").alias("media_id"), F.col("o.rel_id").alias("relationship_id"), (F.col("o.start") + F.col("_shift")).cast("int").alias("char_offset"))
    image = image.join(media, (image["doc_id"] == media["doc_id"]) & (image["media_id"] == media["_media"]), "left").drop(media["doc_id"])
    ref = F.struct("media_id", "relationship_id", F.col("file_name").alias("local_path"), "content_type", F.coalesce("displayable", F.lit(False)).alias("supported_for_display"), "char_offset")
    images = image.groupBy("doc_id", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", ref.alias("r")))), lambda x: x["r"]).alias("images"))
    facts = both.join(shown, ["doc_id", "ordinal"], "left").join(images, ["doc_id", "ordinal"], "left")
    facts = facts.withColumns({"images": F.coalesce("images", F.array().cast(f"array<{IMAGE}>")), "numbering": F.when(F.col("num_id").isNotNull(), F.struct("num_id", "level", "display_text"))})
    nothing = F.lit(None).cast("string")
    alone = facts.where("table_id IS NULL").select("doc_id", "source_id", F.col("ordinal").alias("slot"), F.lit("paragraph").alias("source_type"), F.col("text").alias("raw_text"), "numbering", F.lit(None).cast("struct<table_source_id:string,row:int,column:int>").alias("table_pos"), "images", F.col("source_order").alias("order_start"), F.col("source_order").alias("order_end"), nothing.alias("unsupported_reason"))
    joined = facts.where("table_id IS NOT NULL").groupBy("doc_id", "table_id", "row", "col").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("raw_text"),
        F.min_by("numbering", F.when((F.col("_n") == 1) & F.col("num_id").isNotNull(), F.col("ordinal"))).alias("numbering"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "images"))), lambda x: x["images"])).alias("images"), F.min("source_order").alias("low"), F.max("source_order").alias("high"))
    cell = cells.join(joined, ["doc_id", "table_id", "row", "col"], "left").select("doc_id", F.concat("table_id", F.lit(":r"), "row", F.lit("c"), "col").alias("source_id"), "slot", F.lit("tableCell").alias("source_type"), F.coalesce("raw_text", F.lit("")).alias("raw_text"), "numbering", F.struct(F.col("table_id").alias("table_source_id"), "row", F.col("col").alias("column")).alias("table_pos"), F.coalesce("images", F.array().cast(f"array<{IMAGE}>")).alias("images"), F.coalesce("low", "source_order").alias("order_start"), F.coalesce("high", "source_order").alias("order_end"), nothing.alias("unsupported_reason"))
    none = lambda df: df.withColumns({"numbering": F.lit(None).cast("struct<num_id:string,level:int,display_text:string>"), "table_pos": F.lit(None).cast("struct<table_source_id:string,row:int,column:int>"), "images": F.array().cast(f"array<{IMAGE}>"), "source_type": F.lit("unsupported")})
    empty = none(blocks.where("kind = 'table' AND rows = 0 AND table_id IS NULL").select("doc_id", "source_id", F.col("ordinal").alias("slot"), F.lit("").alias("raw_text"), F.col("source_order").alias("order_start"), F.col("source_order").alias("order_end"), F.lit("空表格或无法读取的表格结构").alias("unsupported_reason")))
    said = docx.warnings(docs).where(F.col("message").startswith("[UNSUPPORTED]"))
    said = said.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")) - 1)
    body = T.trim(F.expr("substring(message, 14)"))
    late = none(said.select("doc_id", F.concat(F.lit("unsupported"), "n").alias("source_id"), (F.lit(1 << 30) + F.col("n")).cast("int").alias("slot"), T.trim(F.when(body.contains("\n[RAW]"), F.regexp_replace(body, r"(?s)^.*?\n\[RAW\]", "")).otherwise(F.lit(""))).alias("raw_text"), F.lit(None).cast("int").alias("order_start"), F.lit(None).cast("int").alias("order_end"), T.trim(F.split(body, r"\n\[RAW\]")[0]).alias("unsupported_reason")))
    out = alone.unionByName(cell).unionByName(empty).unionByName(late)
    order = (F.row_number().over(Window.partitionBy("doc_id").orderBy("slot")) - 1).cast("int")
    return out.withColumn("source_order", order).withColumns({"order_start": F.coalesce("order_start", "source_order"), "order_end": F.coalesce("order_end", "source_order")}).select("doc_id", "source_id", "source_order", "source_type", "raw_text", "numbering", "table_pos", "images", "order_start", "order_end", "unsupported_reason")
