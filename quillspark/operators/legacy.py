"""The older recognisers: segments, labels, drafts and plain-text parsing, as DataFrame plans by document.

blocks(doc_id, source_id, source_order, kind, text, level, num_fmt, images array<struct<media_id, rel_id, start,
path>>): top-level blocks; kind is paragraph or table. Offsets are code points.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import options as O
from quillspark.functions import recovery as R
from quillspark.functions import text as T

from .sets import accepted_in_order, containing_owner, failed_checks

# The markers by which blocks are recognised here.
STARTS = (r"^\s*(\d{1,4})\s*[.．]\s*", r"^\s*(\d{1,4})\s*[、]\s*", r"^\s*(\d{1,4})\s*[)）]\s*", r"^\s*[（(]\s*(\d{1,4})\s*[）)]\s*", r"^\s*第\s*(\d{1,4})\s*题\s*")
OPTION_FIRST = r"^\s*([A-Ha-h])\s*[.．、:：)）]"
ANSWER_FIRST = r"^\s*(?:答案|正确答案|参考答案|标准答案)\s*[:：]?"
EXPLANATION_FIRST = r"^\s*(?:解析|解释|题解)\s*[:：]?"
ANSWER_LABEL = r"(?:答案|正确答案|参考答案|标准答案)\s*[:：]"
EXPLANATION_LABEL = r"(?:解析|解释|题解)\s*[:：]"
NUMBER_LABEL = r"^\s*(?:第\s*)?\d{1,4}\s*(?:[.．、)）]|题)\s*"
PLAIN_START = r"^\s*(?:第\s*)?(?:\d{1,4}|[一二三四五六七八九十百]+)\s*(?:题|[.．、)）])\s*"
PLAIN_ANSWER = r"(?:答案|正确答案|参考答案|标准答案)\s*[:：]?\s*([A-Ha-h,\s，、]+|对|错|正确|错误|√|×)"
LABELS = ("STEM", "OPTION", "ANSWER", "EXPLANATION", "TYPE_HINT", "OTHER")
FORBIDDEN = ("question", "questions", "options", "option", "answer", "answers", "explanation", "text", "content", "rewrittenText", "rewritten_text")
ANNOTATION = "struct<source_id:string,source_order:int,label:string,start:int,end:int,option_key:string>"


# Segments -----------------------------------------------------------------------------------------------------------


def signals(blocks: DataFrame) -> DataFrame:
    """blocks with what each shows: number, start, option keys, answer, explanation, and whether it may be a stem."""
    text, paragraph = F.col("text"), F.col("kind") == "paragraph"
    number = F.coalesce(*[T.group(text, p, 1).cast("int") for p in STARTS])
    listed = (F.col("level") == 0) & F.lower("num_fmt").isin("decimal", "decimalzero")
    inline = F.transform(O.matches(text, O.OPTION_MARKER), lambda m: F.upper(F.substring(m["text"], 1, 1)))
    keys = F.when(text.rlike(OPTION_FIRST), F.array(F.upper(T.group(text, OPTION_FIRST, 1)))).when(F.size(inline) >= 2, inline).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    out = blocks.withColumns({"number": F.when(paragraph, number), "start": F.coalesce(paragraph & (number.isNotNull() | listed), F.lit(False)), "keys": F.when(paragraph, keys).otherwise(none), "answers": paragraph & text.rlike(ANSWER_FIRST), "explains": paragraph & text.rlike(EXPLANATION_FIRST)})
    return out.withColumn("may_stem", paragraph & ~T.is_blank(text) & ~F.col("answers") & ~F.col("explains") & (F.size("keys") == 0))


def segments(blocks: DataFrame) -> DataFrame:
    """signals with segment: null for blocks of no question.

    A start opens a segment. Options before the first start open one too; it takes the last possible stem before them.
    """
    doc, option = Window.partitionBy("doc_id"), F.size("keys") > 0
    out = signals(blocks).withColumns({"_s": F.min(F.when(F.col("start"), F.col("source_order"))).over(doc), "_o": F.min(F.when(option & ~F.col("start"), F.col("source_order"))).over(doc)})
    implicit = F.col("_o").isNotNull() & (F.col("_s").isNull() | (F.col("_o") < F.col("_s")))
    out = out.withColumn("_first", F.when(implicit, F.col("_o")).otherwise(F.col("_s")))
    out = out.withColumn("_stem", F.when(implicit, F.max(F.when(F.col("may_stem") & (F.col("source_order") < F.col("_o")), F.col("source_order"))).over(doc)))
    opens = F.col("start") | (F.col("source_order") == F.col("_first"))
    running = F.count_if(opens).over(doc.orderBy("source_order").rowsBetween(Window.unboundedPreceding, 0)) - 1
    at = F.when(F.col("source_order") >= F.col("_first"), running).when(F.col("source_order") == F.col("_stem"), 0)
    return out.withColumn("segment", F.when(at.isNotNull(), F.concat(F.lit("q"), at.cast("string")))).drop("_s", "_o", "_first", "_stem")


def emitted_signals(segmented: DataFrame) -> DataFrame:
    """One row a signal: QuestionStart, OptionMarker, AnswerMarker, ExplanationMarker or UnassignedBlock."""
    inside = F.col("segment").isNotNull()
    kinds = F.array_compact(F.array(F.when(inside & F.col("start"), "QuestionStart"), F.when(inside & (F.size("keys") > 0), "OptionMarker"), F.when(inside & F.col("answers"), "AnswerMarker"), F.when(inside & F.col("explains"), "ExplanationMarker"), F.when(~inside, "UnassignedBlock")))
    return segmented.select("doc_id", "segment", "source_id", "source_order", F.explode(kinds).alias("signal"))


def segment_summary(segmented: DataFrame) -> DataFrame:
    """A row a segment: its blocks in order, number, tables and images, as a label request sends it."""
    rows = F.array_sort(F.collect_list(F.struct("source_order", "source_id", F.col("kind").alias("block_type"), "text", F.size("images").alias("image_count"))))
    out = segmented.where("segment IS NOT NULL").groupBy("doc_id", "segment").agg(F.min_by("number", F.when(F.col("start"), F.col("source_order"))).alias("number"), rows.alias("blocks"), F.count_if(F.col("kind") == "table").cast("int").alias("table_count"), F.sum(F.size("images")).cast("int").alias("image_count"))
    return out.withColumns({"start_order": F.get("blocks", F.lit(0))["source_order"], "end_order": F.element_at("blocks", -1)["source_order"], "source_ids": F.transform("blocks", lambda b: b["source_id"])})


# Labels -------------------------------------------------------------------------------------------------------------


def _tail(text: Column, label: str) -> Column:
    """What stands behind the first label, without colons and space."""
    m = F.get(O.matches(text, label), F.lit(0))
    return T.trim(F.regexp_replace(F.substring(text, m["end"] + 1, F.length(text)), "^:*：*", ""))


def annotations(segmented: DataFrame) -> DataFrame:
    """(doc_id, segment, text, a): labelled ranges of paragraphs, found by their markers."""
    text = F.col("text")
    whole = lambda label, rest: F.array(_annotation(label, F.length(text) - F.length(rest), F.length(text)))
    marks = O.matches(text, O.OPTION_MARKER)
    spans = F.when((F.size(marks) >= 2) | ((F.size(marks) == 1) & (F.get(marks, F.lit(0))["start"] <= 4)), marks)
    stem_at = F.coalesce(F.get(O.matches(text, NUMBER_LABEL), F.lit(0))["end"], F.lit(0))
    first = F.get(spans, F.lit(0))["start"]
    before = T.trim(F.substring(text, 1, first))
    bare = before.rlike(r"^[A-Ha-h]\s*[.．、:：)）]?\s*$")
    end = lambda m, i: F.coalesce(F.get(spans, i + 1)["start"], F.length(text))
    body = lambda m, i: F.length(F.regexp_replace(F.substring(text, m["end"] + 1, end(m, i) - m["end"]), rf"{T.SPACE}+$", ""))
    options = F.filter(F.transform(spans, lambda m, i: _annotation("OPTION", m["end"], m["end"] + body(m, i), F.upper(F.substring(m["text"], 1, 1)))), lambda a: a["end"] > a["start"])
    stem = F.when((stem_at < first) & (before != "") & ~bare, F.array(_annotation("STEM", stem_at, first))).otherwise(F.array().cast(f"array<{ANNOTATION}>"))
    answer, explanation = _tail(text, ANSWER_LABEL), _tail(text, EXPLANATION_LABEL)
    found = F.when(F.coalesce(answer, F.lit("")) != "", whole("ANSWER", answer)).when(F.coalesce(explanation, F.lit("")) != "", whole("EXPLANATION", explanation)).when(spans.isNotNull(), F.concat(stem, options)).when(~T.is_blank(text), F.array(_annotation("STEM", stem_at, F.length(text))))
    rows = segmented.where("segment IS NOT NULL AND kind = 'paragraph'")
    return rows.select("doc_id", "segment", "text", F.explode(found).alias("a"))


def _annotation(label: str, start: Column, end: Column, key: Column | None = None) -> Column:
    return F.struct("source_id", F.col("source_order").cast("int").alias("source_order"), F.lit(label).alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), (key if key is not None else F.lit(None).cast("string")).alias("option_key"))


def labelled(annotated: DataFrame) -> DataFrame:
    """A row a segment: its annotations in order and COMPLETE, AMBIGUOUS or REJECTED."""
    says = ~T.is_blank(F.substring("text", F.col("a.start") + 1, F.col("a.end") - F.col("a.start")))
    is_ = lambda label: F.col("a.label") == label
    out = annotated.groupBy("doc_id", "segment").agg(F.array_sort(F.collect_list(F.struct("a.source_order", "a.start", "a"))).alias("l"), F.collect_list(F.when(is_("OPTION"), F.col("a.option_key"))).alias("k"), F.max(is_("ANSWER") & says).alias("answered"), F.max(is_("STEM") & says).alias("stemmed"))
    distinct = F.size(F.array_distinct("k"))
    status = F.when(F.size("k") == 0, "REJECTED").when((distinct < 2) | (distinct < F.size("k")) | ~F.col("answered") | ~F.col("stemmed"), "AMBIGUOUS").otherwise("COMPLETE")
    return out.select("doc_id", "segment", F.transform("l", lambda x: x["a"]).alias("annotations"), status.alias("status"))


def validated(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """raw(doc_id, segment, n, source_id, label, start, end, option_key) of a model with a reason for each refused.

    The conditions hold in order; overlap is judged last, against what was accepted before in the same source.
    """
    sources = blocks.select("doc_id", "source_id", F.col("segment").alias("_segment"), F.col("source_order").cast("int").alias("source_order"), F.length("text").alias("_length"))
    key = F.upper(T.trim(F.col("option_key")))
    out = raw.join(sources, ["doc_id", "source_id"], "left").withColumn("label_name", F.upper(T.trim(F.col("label"))))
    option = F.col("label_name") == "OPTION"
    out = out.withColumn("_errors", failed_checks([
        ("FORBIDDEN_FIELD_PRESENT", F.col("label").isin(*FORBIDDEN)), ("SOURCE_ID_NOT_IN_SEGMENT", F.col("_segment").isNull() | (F.col("_segment") != F.col("segment"))), ("INVALID_LABEL", ~F.col("label_name").isin(*LABELS)),
        ("START_OFFSET_NEGATIVE", F.col("start") < 0), ("END_OFFSET_PAST_TEXT", F.col("end") > F.col("_length")), ("START_GE_END", F.col("start") >= F.col("end")),
        ("OPTION_KEY_NOT_A_H", option & ~F.coalesce(key.rlike("^[A-H]$"), F.lit(False))), ("NON_OPTION_HAS_KEY", ~option & F.col("option_key").isNotNull())]))
    fine = out.where(F.size("_errors") == 0).groupBy("doc_id", "segment", "source_id").agg(F.array_sort(F.collect_list(F.struct("n", "start", "end"))).alias("_s"))
    kept = fine.select("doc_id", "segment", "source_id", F.transform(accepted_in_order(F.col("_s")), lambda s: s["n"]).alias("_kept"))
    out = out.join(kept, ["doc_id", "segment", "source_id"], "left")
    reason = F.coalesce(F.get("_errors", F.lit(0)), F.when(~F.array_contains("_kept", F.col("n")), "OVERLAPPING_SEMANTIC_RANGE"))
    return out.select("doc_id", "segment", "n", "source_id", "source_order", F.col("label_name").alias("label"), "start", "end", F.when(option, key).alias("option_key"), reason.alias("reason"))


def chosen(deterministic: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Annotations to build from: the found ones of complete segments, a model's of ambiguous ones if there are any."""
    usable = deterministic.where("status <> 'REJECTED'")
    if accepted is None:
        return usable
    bad = accepted.groupBy("doc_id", "segment").agg(F.max(F.col("reason").isNotNull()).alias("refused"), F.transform(F.array_sort(F.collect_list(F.struct("source_order", "start", F.struct("source_id", "source_order", "label", "start", "end", "option_key").alias("a")))), lambda x: x["a"]).alias("model"))
    out = usable.join(bad, ["doc_id", "segment"], "left")
    use = (F.col("status") == "AMBIGUOUS") & F.col("model").isNotNull()
    return out.where(~(use & F.col("refused"))).withColumn("annotations", F.when(use, F.col("model")).otherwise(F.col("annotations"))).drop("refused", "model")


# Drafts -------------------------------------------------------------------------------------------------------------


def drafts(segmented: DataFrame, picked: DataFrame) -> DataFrame:
    """A row a segment: stem, options, answer and explanation cut by the annotations, images with their owners, and
    whether the old question format can hold it."""
    texts = segmented.select("doc_id", "source_id", "text")
    cut = picked.select("doc_id", "segment", "status", F.posexplode("annotations").alias("n", "a")).select("*", F.col("a.source_id").alias("source_id")).join(texts, ["doc_id", "source_id"])
    cut = cut.withColumn("part", F.substring("text", F.col("a.start") + 1, F.col("a.end") - F.col("a.start")))
    is_ = lambda label: F.col("a.label") == label
    parts = lambda label: F.transform(F.array_sort(F.collect_list(F.when(is_(label) & ~T.is_blank(F.col("part")), F.struct("n", "part")))), lambda x: x["part"])
    option = F.transform(F.array_sort(F.collect_list(F.when(is_("OPTION"), F.struct("n", F.coalesce("a.option_key", F.lit("?")).alias("key"), T.trim(F.col("part")).alias("text"))))), lambda x: F.struct(x["key"].alias("key"), x["text"].alias("text")))
    made = cut.groupBy("doc_id", "segment", "status").agg(T.trim(F.array_join(parts("STEM"), "\n")).alias("stem"), option.alias("options"), T.trim(F.array_join(parts("ANSWER"), "\n")).alias("answer"), T.trim(F.array_join(parts("EXPLANATION"), "\n")).alias("explanation"))
    spans = cut.where(F.col("a.label").isin("STEM", "OPTION")).groupBy("doc_id", "segment", "source_id").agg(F.collect_list(F.struct("a.start", "a.end", F.when(is_("STEM"), "stem").otherwise(F.concat(F.lit("option:"), F.col("a.option_key"))).alias("owner"))).alias("spans"))
    inside = segmented.where("segment IS NOT NULL").select("doc_id", "segment", "source_id", "source_order", "kind", F.explode("images").alias("image"))
    empty = F.array().cast("array<struct<start:int,end:int,owner:string>>")
    owner = F.when(F.col("kind") == "table", "cell").otherwise(F.coalesce(containing_owner(F.coalesce("spans", empty), F.col("image.start")), F.lit("unbound")))
    images = inside.join(spans, ["doc_id", "segment", "source_id"], "left").groupBy("doc_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_order", "image.start", owner.alias("owner"), "image.path"))), lambda x: F.struct(x["owner"].alias("owner"), x["path"].alias("path"))).alias("images"))
    heads = segment_summary(segmented).select("doc_id", "segment", "number", "source_ids", "table_count")
    out = made.join(images, ["doc_id", "segment"], "left").join(heads, ["doc_id", "segment"]).withColumn("images", F.coalesce("images", F.array().cast("array<struct<owner:string,path:string>>")))
    of = lambda name: F.filter("images", lambda i: i["owner"] == name)
    return out.withColumn("representable", (F.col("table_count") == 0) & (F.size(of("unbound")) == 0) & (F.size(of("stem")) <= 1))


def checked(draft: DataFrame) -> DataFrame:
    """Drafts with errors, normalised answer and kind; a draft without errors has a kind."""
    keys = F.transform("options", lambda o: o["key"])
    out = draft.withColumn("keys_", F.coalesce(T.normalize_answer(F.col("answer")), F.array().cast("array<string>")))
    n, a = F.size("options"), F.size("keys_")
    guess = F.when(n < 2, None).when(a == 1, "single").when(a >= 2, "multiple")
    errors = failed_checks([
        ("题干为空", F.col("stem") == ""), ("选项 key 重复", F.size(F.array_distinct(keys)) < n), ("选项数量不足", n < 2), ("答案为空", F.col("answer") == ""),
        ("答案标准化后为空", (a == 0) & (F.col("answer") != "")), ("答案不在选项中", F.size(F.array_except("keys_", keys)) > 0), ("无法推断题型", guess.isNull())])
    says = lambda key, words: F.exists("options", lambda o: (o["key"] == key) & o["text"].isin(*words))
    judged = (n == 2) & says("A", T.TRUE_WORDS) & says("B", T.FALSE_WORDS)
    out = out.withColumns({"errors": errors, "_kind": F.when(judged, "truefalse").otherwise(guess)})
    return out.withColumn("question_kind", F.when(F.size("errors") == 0, F.col("_kind"))).drop("_kind")


def converted(valid: DataFrame, lossy: bool = False) -> DataFrame:
    """Questions of drafts without errors; drafts that the old format cannot hold only where lossy is allowed."""
    kept = valid.where((F.size("errors") == 0) & (F.col("representable") | F.lit(lossy)))
    path = lambda owner: F.get(F.filter("images", lambda i: (i["owner"] == owner) & i["path"].isNotNull()), F.lit(0))["path"]
    both = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("text"), F.lit(None).cast("string").alias("image_uri")) for k, v in (("A", "对"), ("B", "错"))])
    options = F.transform("options", lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text"), path(F.concat(F.lit("option:"), o["key"])).alias("image_uri")))
    return kept.select("doc_id", "segment", F.when(F.col("number") > 0, F.col("number")).alias("original_id"), F.col("question_kind").alias("kind"), F.col("stem").alias("question"), F.when(F.col("question_kind") == "truefalse", both).otherwise(options).alias("options"), F.col("keys_").alias("answer"), F.nullif("explanation", F.lit("")).alias("explanation"), path("stem").alias("image_uri"), F.when(F.col("representable"), "CONVERTED").otherwise("CONVERTED_LOSSY").alias("conversion"))


def label_requests(segmented: DataFrame, deterministic: DataFrame, client: Callable) -> DataFrame:
    """raw annotations of a model for the ambiguous segments; a reply that breaks the format gives none.

    client takes the segment as a JSON text and returns the reply's text.
    """
    @F.pandas_udf("string")
    def ask(parts: pd.Series) -> pd.Series:
        return parts.map(client)

    asked = segment_summary(segmented).join(deterministic.where("status = 'AMBIGUOUS'").select("doc_id", "segment"), ["doc_id", "segment"])
    replies = asked.withColumn("reply", ask(F.to_json(F.struct("segment", "number", "blocks", "table_count", "image_count"))))
    found = replies.select("doc_id", "segment", R.labelled(F.col("reply")).alias("rows")).where("rows IS NOT NULL")
    return found.select("doc_id", "segment", F.posexplode("rows").alias("n", "r")).select("doc_id", "segment", "n", "r.*")


def run(blocks: DataFrame, client: Callable | None = None, lossy: bool = False) -> dict[str, DataFrame]:
    """questions, segments, labels and counts of the older pipeline."""
    cut = segments(blocks)
    found = labelled(annotations(cut))
    accepted = validated(label_requests(cut, found, client), cut) if client else None
    done = checked(drafts(cut, chosen(found, accepted)))
    questions = converted(done, lossy)
    size = cut.groupBy("doc_id").agg(F.count_distinct("segment").cast("int").alias("segments"), F.count_if(F.col("segment").isNull()).cast("int").alias("unassigned"))
    seen = found.groupBy("doc_id").agg(F.count_if(F.col("status") == "COMPLETE").cast("int").alias("complete"), F.count_if(F.col("status") == "AMBIGUOUS").cast("int").alias("ambiguous"))
    lost = done.groupBy("doc_id").agg(F.count_if(~F.col("representable")).cast("int").alias("lossy"))
    good = questions.groupBy("doc_id").agg(F.count("*").cast("int").alias("accepted"))
    counts = size.join(seen, "doc_id", "left").join(lost, "doc_id", "left").join(good, "doc_id", "left").fillna(0)
    return {"questions": questions, "segments": cut, "labels": found, "drafts": done, "counts": counts.withColumn("rejected", F.col("segments") - F.col("accepted"))}


# Plain text ---------------------------------------------------------------------------------------------------------


def plain_questions(texts: DataFrame) -> DataFrame:
    """texts(doc_id, text) cut at their question numbers: a row a piece with its question, null where none is whole.

    Lines carry their field on; an answer anywhere in a line makes it an answer line.
    """
    lines = texts.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "line"))
    doc = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("piece", (F.count_if(F.col("line").rlike(PLAIN_START) & (F.col("n") > 0)).over(doc)).cast("int"))
    first = F.row_number().over(Window.partitionBy("doc_id", "piece").orderBy("n")) == 1
    lines = lines.withColumn("raw", F.col("line")).withColumn("line", F.when(first, T.trim(F.regexp_replace("line", PLAIN_START, ""))).otherwise(F.col("line")))
    line, inline = F.col("line"), O.inline_options(F.col("line"))
    cls = F.when(line.rlike(PLAIN_ANSWER), "answer").when(line.rlike(T.EXPLANATION_LINE), "explanation").when(line.rlike(T.KNOWLEDGE_LINE), "knowledge").when(F.col("inline").isNotNull(), "inline").when(line.rlike(T.OPTION_LINE), "option")
    lines = lines.withColumn("inline", inline).withColumn("class", cls)
    before = Window.partitionBy("doc_id", "piece").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    key = F.when(F.col("class") == "inline", F.element_at("inline.options", -1)["key"]).when(F.col("class") == "option", T.option_key(line))
    lines = lines.withColumn("key", key).withColumn("last", F.last(F.when(F.col("class").isNotNull(), F.struct("class", "key")), ignorenulls=True).over(before))
    goes = F.when(F.col("class").isNotNull(), None).when(F.col("last.class") == "explanation", "explanation").when(F.col("last.key").isNotNull(), "option").otherwise("stem")
    lines = lines.withColumn("goes", goes)
    opened = F.when(F.col("class") == "inline", F.transform("inline.options", lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text"), F.lit(True).alias("opens")))).when(F.col("class") == "option", F.array(F.struct(F.col("key").alias("key"), T.option_text(line).alias("text"), F.lit(True).alias("opens")))).when(F.col("goes") == "option", F.array(F.struct(F.col("last.key").alias("key"), line.alias("text"), F.lit(False).alias("opens"))))
    stem = F.when(F.col("class") == "inline", F.col("inline.leading")).when(F.col("goes") == "stem", line)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("n", c.alias("v"))))), lambda x: x["v"])
    last = lambda name, value: F.max_by(value, F.when(F.col("class") == name, F.col("n")))
    value = lambda pattern: T.trim(T.group(line, pattern, 1))
    place = Window.partitionBy("doc_id", "piece").orderBy("n")
    lines = lines.withColumn("_e", F.count_if(F.col("class") == "explanation").over(place)).withColumn("_m", F.max("_e").over(Window.partitionBy("doc_id", "piece")))
    explained = F.when((F.col("_e") == F.col("_m")) & (F.col("class") == "explanation"), value(T.EXPLANATION_LINE)).when((F.col("_e") == F.col("_m")) & (F.col("goes") == "explanation"), line)
    out = lines.groupBy("doc_id", "piece").agg(F.filter(listed(stem), lambda s: s != "").alias("stems"), F.flatten(listed(opened)).alias("parts"), last("answer", T.group(line, PLAIN_ANSWER, 1)).alias("raw"), F.filter(listed(explained), lambda s: s != "").alias("explanations"), last("knowledge", value(T.KNOWLEDGE_LINE)).alias("knowledge"), F.array_join(listed(F.col("raw")), "\n").alias("text"))
    # A key that opens again starts anew: what counts is from its last opening on.
    last_open = lambda k: F.array_max(F.transform("parts", lambda p, i: F.when(p["opens"] & (p["key"] == k), i)))
    keys = F.array_distinct(F.transform("parts", lambda p: p["key"]))
    merged = F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter("parts", lambda p, i: (p["key"] == k) & (i >= last_open(k))), lambda p: p["text"]), "\n").alias("text")))
    out = out.withColumn("options", O.normalized_options(merged))
    compact = F.regexp_replace("text", r"\s", "")
    judged = F.when(compact.contains("答案对") | compact.contains("答案正确"), F.array(F.lit("A"))).when(compact.contains("答案错"), F.array(F.lit("B")))
    out = out.withColumn("answer", F.coalesce(T.normalize_answer(F.col("raw")), judged))
    both = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("text")) for k, v in (("A", "对"), ("B", "错"))])
    out = out.withColumn("options", F.when((F.size("options") == 0) & (F.size("answer") == 1) & F.get("answer", F.lit(0)).isin("A", "B"), both).otherwise(F.col("options")))
    words = F.transform("options", lambda o: o["text"])
    true_false = (F.size("options") == 2) & F.arrays_overlap(words, F.array(F.lit("对"), F.lit("正确"))) & F.arrays_overlap(words, F.array(F.lit("错"), F.lit("错误")))
    question = T.trim(F.array_join("stems", "\n"))
    good = (question != "") & (F.size("options") > 0) & (F.size("answer") > 0) & (F.size(F.array_except("answer", F.transform("options", lambda o: o["key"]))) == 0) & (true_false | (F.size("options") >= 2))
    kind = F.when(true_false, "truefalse").when(F.size("answer") > 1, "multiple").otherwise("single")
    return out.select("doc_id", "piece", "text", F.when(good, F.struct((F.col("piece") + 1).alias("original_id"), kind.alias("kind"), question.alias("question"), "options", "answer", F.nullif(F.array_join("explanations", "\n"), F.lit("")).alias("explanation"), F.nullif("knowledge", F.lit("")).alias("knowledge"))).alias("question"))


def slotted(parsed: DataFrame, repaired: DataFrame) -> DataFrame:
    """All questions by their original number, those without one last."""
    return parsed.unionByName(repaired, allowMissingColumns=True).orderBy(F.col("original_id").asc_nulls_last(), "question")
