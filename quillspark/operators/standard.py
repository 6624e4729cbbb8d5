"""The standard recogniser: source blocks to questions, records and a report, as one DataFrame plan by document.

Blocks are cut into groups at question starts (a running count), lines are classified and their field carried forward
(last value over the lines before), and every group is checked by a list of conditions of which the first that holds
is the reason. Everything is partitioned by doc_id; nothing runs on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import options as O
from quillspark.functions import text as T

from . import ledger
from .blocks import non_empty

ACCEPTED, REJECTED, NON_QUESTION, UNSUPPORTED = "ACCEPTED_QUESTION", "REJECTED_QUESTION", "NON_QUESTION_CONTENT", "UNSUPPORTED_CONTENT"
ERROR = "struct<at:struct<a:int,b:int,c:int>,reason:string,message:string>"
#: What a rejected or reported block says.
SAYS = {
    "unresolved": "Word 自动编号无法还原，请在该题补充可见题号", "type": "题型只支持单选题、多选题和判断题", "merged": "同一题型标签内出现多个括号答案，可能包含多道未分隔题目",
    "before": "选项前存在无法归属的文字", "after": "答案后的文字缺少“解析：”或“知识点：”标识", "image": "图片位于答案或说明字段附近，无法确定归属", "unread": "图片引用存在，但媒体文件无法读取",
    "single": "题型标为单选题，但答案包含多个选项", "multiple": "题型标为多选题，但答案不足两个选项", "title": "题目前的标题或说明文字", "uncovered": "原文没有确定归属", "unsupported": "Word 内容暂不支持",
}


def classified(blocks: DataFrame) -> DataFrame:
    """Non-empty blocks with their lines and their kind: tagged, manual, auto, unsupported, unresolved or other."""
    first = F.get("lines", F.lit(0))
    out = non_empty(blocks).withColumn("lines", T.lines(F.col("raw_text")))
    out = out.withColumns({"tag": T.tagged_type(first), "manual": T.question_number(first), "is_manual": F.coalesce(first.rlike(T.QUESTION_PREFIX), F.lit(False)), "auto": T.automatic_question_number(F.col("numbering.level"), F.col("numbering.display_text")), "auto_option": T.automatic_option_key(F.col("numbering.display_text"))})
    kind = F.when(F.col("source_type") == "unsupported", "unsupported").when(F.col("tag").isNotNull(), "tagged").when(F.col("is_manual"), "manual").when(F.col("auto").isNotNull(), "auto")
    return out.withColumn("kind", kind.when(F.col("numbering").isNotNull() & F.col("numbering.display_text").isNull(), "unresolved").otherwise("other"))


def grouped(rows: DataFrame, order: str = "source_order") -> DataFrame:
    """rows(doc_id, kind) with grp: the order of the block that opened the row's question, null outside questions.

    Starts and unsupported blocks begin an episode. An episode that a start begins is one question; in others an
    unresolved number opens a question for itself and what follows.
    """
    doc = Window.partitionBy("doc_id").orderBy(order)
    starts = F.col("kind").isin("tagged", "manual", "auto")
    out = rows.withColumn("_ep", F.count_if(starts | (F.col("kind") == "unsupported")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    ep = Window.partitionBy("doc_id", "_ep")
    out = out.withColumns({"_k": F.min_by("kind", order).over(ep), "_first": F.min(order).over(ep), "_n0": F.min(F.when(F.col("kind") == "unresolved", F.col(order))).over(ep)})
    grp = F.when(F.col("kind") == "unsupported", None).when(F.col("_k").isin("tagged", "manual", "auto"), F.col("_first")).when(F.col(order) >= F.col("_n0"), F.col("_n0"))
    return out.withColumn("grp", grp).drop("_ep", "_k", "_first", "_n0")


def lines_of(rows: DataFrame) -> DataFrame:
    """Lines of grouped blocks with their class; a start's own first line becomes the stem or the header."""
    keep = rows.where("grp IS NOT NULL AND kind <> 'unresolved'")
    rest = F.when(F.col("kind") == "tagged", F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).otherwise(F.col("lines"))
    rest = F.when((F.size("lines") == 0), F.array().cast("array<string>")).otherwise(rest)
    out = keep.withColumn("tagged", F.max(F.col("kind") == "tagged").over(Window.partitionBy("doc_id", "grp"))).select("doc_id", "grp", "source_order", "source_id", "kind", "tagged", F.when(F.col("kind") == "other", F.col("auto_option")).alias("auto_option"), F.posexplode(rest).alias("n", "line"))
    line = F.col("line")
    stem = (F.col("n") == 0) & F.col("kind").isin("manual", "auto")
    inline, answer = O.inline_options(line), line.rlike(T.TRAILING_ANSWER) & F.col("tagged")
    plain = F.when(stem, "stem").when(line.rlike(T.TYPE_LINE), "type").when(line.rlike(T.ANSWER_LINE), "answer").when(line.rlike(T.EXPLANATION_LINE), "explanation").when(line.rlike(T.KNOWLEDGE_LINE), "knowledge")
    option = F.when(F.col("inline").isNotNull(), "inline").when(line.rlike(T.OPTION_LINE) | F.col("auto_option").isNotNull(), "option")
    out = out.withColumns({"inline": inline, "plain": plain, "trailing": answer}).withColumn("optional", option)
    grp = Window.partitionBy("doc_id", "grp").orderBy("source_order", "n")
    before = grp.rowsBetween(Window.unboundedPreceding, -1)
    sure = F.col("plain").isNull() & ~F.col("trailing") & F.col("optional").isNotNull()
    out = out.withColumn("had_sure", F.coalesce(F.max(sure).over(before), F.lit(False)))
    # A bracketed answer counts before any option, or alone on its line; otherwise the line is read as others are.
    takes = F.col("trailing") & F.col("plain").isNull() & (~F.col("had_sure") | (T.trim(T.group(line, T.TRAILING_ANSWER, 1)) == ""))
    out = out.withColumn("class", F.coalesce("plain", F.when(takes, "trailing"), "optional", F.lit("text")))
    key = F.when(F.col("class") == "inline", F.element_at("inline.options", -1)["key"]).when(F.col("class") == "option", F.coalesce("auto_option", T.option_key(line)))
    field = F.when(F.col("class") == "trailing", "answer").when(F.col("class") == "inline", "option").when(~F.col("class").isin("stem", "text"), F.col("class"))
    out = out.withColumns({"key": key, "field": field})
    out = out.withColumns({"had_option": F.coalesce(F.max(F.col("class").isin("inline", "option")).over(before), F.lit(False)), "had_answer": F.coalesce(F.max(F.col("class").isin("answer", "trailing")).over(before), F.lit(False))})
    out = out.withColumn("last", F.last(F.when(F.col("field").isNotNull(), F.struct("field", "key")), ignorenulls=True).over(before))
    last = F.coalesce(F.col("last.field"), F.when(F.col("tagged"), "type").otherwise("stem"))
    to = F.when(last == "explanation", "explanation").when(last == "knowledge", "knowledge").when((last == "option") & ~F.col("had_answer"), "option").when(~F.col("had_option") & ~F.col("had_answer"), "stem").otherwise("lost")
    return out.withColumn("goes", F.when(F.col("class") == "text", to)).withColumn("last_key", F.when(last == "option", F.col("last.key")))


def _ordered(cond: Column, value: Column) -> Column:
    """Values of the lines that meet a condition, in the order of the lines."""
    return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("source_order", "n", value.alias("v"))))), lambda x: x["v"])


def _error(a: Column, b: Column, c: Column, reason: str, message) -> Column:
    return F.struct(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c")).alias("at"), F.lit(reason).alias("reason"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def _line_facts(lines: DataFrame) -> DataFrame:
    """By group: stem, answer, explanation, knowledge, type, options in the order seen, their sources, and errors."""
    line, cls, goes = F.col("line"), F.col("class"), F.col("goes")
    stem = F.when(cls == "stem", F.when(F.col("kind") == "manual", T.without_question_prefix(line)).otherwise(line)).when(cls == "trailing", T.trim(T.group(line, T.TRAILING_ANSWER, 1))).when((cls == "inline") & ~F.col("had_option"), F.col("inline.leading")).when(goes == "stem", line)
    stem = F.when(stem != "", stem)
    value = lambda pattern: T.trim(T.group(line, pattern, 1))
    label = value(T.TYPE_LINE)
    kind = F.lit(None).cast("string")
    for name, k in T.TYPE_LABELS.items():
        kind = F.when(label == name, k).otherwise(kind)
    at = lambda reason, text: _error(F.col("source_order"), F.lit(0), F.col("n"), reason, text)
    option = F.when(cls == "inline", F.col("inline.options")).when(cls == "option", F.array(F.struct(F.col("key").alias("key"), F.when(F.col("auto_option").isNotNull(), line).otherwise(T.option_text(line)).alias("text"))))
    # Continued lines belong to the option they follow.
    option = F.coalesce(F.transform(option, lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text"), F.lit(True).alias("opens"))), F.when(goes == "option", F.array(F.struct(F.col("last_key").alias("key"), line.alias("text"), F.lit(False).alias("opens")))))
    out = lines.withColumns({"_stem": stem, "_option": option, "_answer": F.when(cls == "answer", value(T.ANSWER_LINE)), "_trailing": F.when(cls == "trailing", T.trim(T.group(line, T.TRAILING_ANSWER, 2))), "_type": F.when(cls == "type", F.struct(kind.alias("kind")))})
    place = Window.partitionBy("doc_id", "grp").orderBy("source_order", "n")
    # What an explanation says is what follows its last heading.
    rank = lambda name: F.count_if(cls == name).over(place)
    whole = Window.partitionBy("doc_id", "grp")
    out = out.withColumns({"_e": rank("explanation"), "_k": rank("knowledge")})
    out = out.withColumns({"_em": F.max("_e").over(whole), "_km": F.max("_k").over(whole), "_trailed": F.count_if(cls.isin("trailing", "answer")).over(place)})
    says = lambda name, pattern, n, m: F.when((cls == name) & (F.col(n) == F.col(m)), value(pattern)).when((goes == name) & (F.col(n) == F.col(m)), line)
    out = out.withColumns({"_explanation": says("explanation", T.EXPLANATION_LINE, "_e", "_em"), "_knowledge": says("knowledge", T.KNOWLEDGE_LINE, "_k", "_km")})
    error = F.filter(F.array(
        F.when((cls == "type") & kind.isNull(), at("INVALID_QUESTION_TYPE", SAYS["type"])), F.when((cls == "trailing") & (F.col("_trailed") > 1), at("MULTIPLE_QUESTIONS_MERGED", SAYS["merged"])),
        F.when((cls == "inline") & F.col("had_option") & (F.col("inline.leading") != ""), at("SOURCE_NOT_COVERED", SAYS["before"])), F.when(goes == "lost", at("SOURCE_NOT_COVERED", SAYS["after"]))), lambda e: e.isNotNull())
    ids = lambda cond: F.array_distinct(_ordered(cond, F.col("source_id")))
    facts = out.groupBy("doc_id", "grp").agg(
        _ordered(F.col("_stem").isNotNull(), F.col("_stem")).alias("stems"), F.coalesce(F.max_by("_answer", F.when(F.col("_answer").isNotNull(), F.struct("source_order", "n"))), F.min_by("_trailing", F.when(F.col("_trailing").isNotNull(), F.struct("source_order", "n")))).alias("raw_answer"),
        F.filter(_ordered(F.col("_explanation").isNotNull(), F.col("_explanation")), lambda x: x != "").alias("explanations"), F.filter(_ordered(F.col("_knowledge").isNotNull(), F.col("_knowledge")), lambda x: x != "").alias("knowledges"),
        F.max_by("_type", F.when(F.col("_type").isNotNull(), F.struct("source_order", "n")))["kind"].alias("line_type"), F.max(F.col("_type").isNotNull()).alias("typed"),
        F.flatten(_ordered(F.col("_option").isNotNull(), F.transform("_option", lambda o, i: F.struct(o["key"].alias("key"), o["text"].alias("text"), o["opens"].alias("opens"), F.col("source_order").alias("so"), F.col("n").alias("n"), i.alias("i"), F.col("source_id").alias("source_id"))))).alias("parts"),
        F.flatten(_ordered(F.size(error) > 0, error)).alias("line_errors"), ids(F.col("_stem").isNotNull() | (cls == "stem")).alias("stem_sources"), ids(cls.isin("answer", "trailing")).alias("answer_sources"),
        ids((cls == "explanation") | (goes == "explanation")).alias("explanation_sources"), ids((cls == "knowledge") | (goes == "knowledge")).alias("knowledge_sources"))
    keys = F.array_distinct(F.transform("parts", lambda p: p["key"]))
    own = lambda k: F.filter("parts", lambda p: p["key"] == k)
    merged = F.transform(keys, lambda k: F.struct(k.alias("key"), T.trim(F.array_join(F.transform(own(k), lambda p: p["text"]), "\n")).alias("text"), F.array_distinct(F.transform(own(k), lambda p: p["source_id"])).alias("sources")))
    again = F.filter("parts", lambda p, i: p["opens"] & F.exists(F.slice("parts", 1, i), lambda q: (q["key"] == p["key"]) & q["opens"]))
    duplicate = F.transform(again, lambda p: F.struct(F.struct(p["so"].cast("int").alias("a"), F.lit(0).alias("b"), p["n"].cast("int").alias("c")).alias("at"), F.lit("DUPLICATE_OPTION").alias("reason"), F.concat(F.lit("选项 "), p["key"], F.lit(" 重复")).alias("message")))
    return facts.withColumns({"options": merged, "line_errors": F.concat(F.col("line_errors"), duplicate)}).drop("parts")


def _image_facts(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """By group: images of the stem and of options, errors and warnings."""
    state = lines.groupBy("doc_id", "grp", "source_order").agg(F.max_by(F.struct("field", "key"), F.when(F.col("field").isNotNull(), F.col("n"))).alias("own"))
    on = rows.where("grp IS NOT NULL AND kind <> 'unresolved'").select("doc_id", "grp", "source_order", "raw_text", "images", "kind").join(state, ["doc_id", "grp", "source_order"], "left")
    upto = Window.partitionBy("doc_id", "grp").orderBy("source_order").rowsBetween(Window.unboundedPreceding, 0)
    on = on.withColumns({"now": F.last(F.when(F.col("own.field").isNotNull(), F.col("own")), ignorenulls=True).over(upto), "tagged": F.max(F.col("kind") == "tagged").over(upto)})
    field = F.coalesce(F.col("now.field"), F.when(F.col("tagged"), "type").otherwise("stem"))
    image = on.where(F.size("images") > 0).withColumns({"field": field, "key": F.col("now.key")}).select("doc_id", "grp", "source_order", "raw_text", "field", "key", F.posexplode("images").alias("i", "image"))
    owner = O.image_owner(F.col("raw_text"), F.col("image.char_offset"))
    by_state = F.when(F.col("field") == "option", F.concat(F.lit("option:"), F.col("key"))).when(F.col("field") == "stem", "stem").otherwise("other")
    image = image.withColumn("owner", F.when(F.col("image.local_path").isNotNull(), F.coalesce(owner, by_state)))
    error = F.filter(F.array(F.when(F.col("owner") == "other", _error(F.col("source_order"), F.lit(1), F.col("i"), "IMAGE_OWNER_UNKNOWN", SAYS["image"])), F.when(F.col("image.local_path").isNull(), _error(F.col("source_order"), F.lit(2), F.lit(0), "IMAGE_OWNER_UNKNOWN", SAYS["unread"]))), lambda e: e.isNotNull())
    paths = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("source_order", "i", F.struct(F.substring("owner", 8, 1).alias("key"), F.col("image.local_path").alias("path")).alias("v"))))), lambda x: x["v"])
    return image.groupBy("doc_id", "grp").agg(paths(F.col("owner") == "stem").alias("stem_images"), paths(F.col("owner").startswith("option:")).alias("option_images"), F.flatten(F.collect_list(error)).alias("image_errors"), F.max(~F.col("image.supported_for_display")).alias("odd_image"))


def finished(groups: DataFrame) -> DataFrame:
    """Groups with their question and their errors: those met on the way, then the final checks in their order."""
    number = F.coalesce(F.col("number").cast("string"), F.lit("?"))
    stem = T.trim(F.array_join("stems", "\n"))
    none = F.array().cast("array<struct<key:string,text:string,sources:array<string>>>")
    raw = F.col("raw_answer")
    out = groups.withColumns({"stem": F.coalesce(stem, F.lit("")), "answer": F.coalesce(T.normalize_answer(raw), F.array().cast("array<string>")), "options": F.coalesce("options", none), "explicit": F.when(F.coalesce("typed", F.lit(False)), F.col("line_type")).otherwise(F.col("tag"))})
    judged = F.coalesce(T.trim(raw).isin(*T.TRUE_WORDS, *T.FALSE_WORDS), F.lit(False))
    out = out.withColumn("judgement", F.coalesce(F.col("explicit") == "truefalse", F.lit(False)) | ((F.size("options") == 0) & judged))
    both = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("text"), F.array().cast("array<string>").alias("sources")) for k, v in (("A", "对"), ("B", "错"))])
    out = out.withColumn("final", F.when(F.col("judgement") & (F.size("options") == 0), both).otherwise(F.col("options")))
    keys = F.transform("final", lambda o: o["key"])
    last = lambda i, cond, reason, text: F.when(cond, _error(F.lit(1 << 30), F.lit(0), F.lit(i), reason, text))
    checks = F.filter(F.array(
        last(1, F.col("stem") == "", "MISSING_STEM", F.concat(F.lit("第"), number, F.lit("题缺少题干"))), last(2, F.size("answer") == 0, "MISSING_ANSWER", F.concat(F.lit("第"), number, F.lit("题缺少明确答案"))),
        last(3, (F.size("final") == 0) | (~F.col("judgement") & (F.size("final") < 2)), "MISSING_OPTIONS", F.concat(F.lit("第"), number, F.lit("题缺少至少两个明确选项"))),
        last(4, F.size(F.array_except("answer", keys)) > 0, "ANSWER_NOT_IN_OPTIONS", F.concat(F.lit("答案 "), F.array_join("answer", ", "), F.lit(" 不在现有选项中"))),
        last(5, (F.col("explicit") == "single") & (F.size("answer") > 1), "INVALID_QUESTION_TYPE", SAYS["single"]), last(6, (F.col("explicit") == "multiple") & (F.size("answer") < 2), "INVALID_QUESTION_TYPE", SAYS["multiple"])), lambda e: e.isNotNull())
    empty = F.array().cast(f"array<{ERROR}>")
    errors = F.array_sort(F.concat(*[F.coalesce(F.col(c), empty) for c in ("line_errors", "image_errors", "block_errors")], checks))
    seen = F.transform(errors, lambda e: F.struct(e["reason"].alias("reason"), e["message"].alias("message")))
    out = out.withColumn("errors", F.array_distinct(seen))
    paths = lambda k: F.array_distinct(F.transform(F.filter(F.coalesce("option_images", F.array().cast("array<struct<key:string,path:string>>")), lambda x: x["key"] == k), lambda x: x["path"]))
    chosen = F.transform("final", lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text"), F.get(paths(o["key"]), F.lit(0)).alias("image_uri"), paths(o["key"]).alias("image_uris")))
    stem_paths = F.array_distinct(F.transform(F.coalesce("stem_images", F.array().cast("array<struct<key:string,path:string>>")), lambda x: x["path"]))
    kind = F.coalesce("explicit", F.when(F.col("judgement"), "truefalse").when(F.size("answer") > 1, "multiple").otherwise("single"))
    said = F.when(F.coalesce("odd_image", F.lit(False)), F.array(F.concat(F.lit("第"), number, F.lit("题包含 EMF、WMF 或未知图片格式，需人工确认")))).otherwise(F.array().cast("array<string>"))
    text = lambda c: F.nullif(F.array_join(F.col(c), "\n"), F.lit(""))
    return out.withColumns({"choices": chosen, "kind": kind, "images": stem_paths, "explanation": text("explanations"), "knowledge": text("knowledges"), "accepted": F.size("errors") == 0, "warnings": F.concat(said, F.when(F.size("errors") > 1, F.transform(F.slice("errors", 2, 1 << 20), lambda e: e["message"])).otherwise(F.array().cast("array<string>")))})


def recognize(blocks: DataFrame) -> dict[str, DataFrame]:
    """questions, records, ledger and report of source blocks."""
    rows = grouped(classified(blocks))
    lines = lines_of(rows)
    inside = rows.where("grp IS NOT NULL")
    start = F.col("source_order") == F.col("grp")
    unread = F.array_distinct(F.collect_list(F.when(F.col("kind") == "unresolved", _error(F.col("source_order"), F.lit(0), F.lit(0), "AUTO_NUMBERING_UNRESOLVED", SAYS["unresolved"]))))
    heads = inside.groupBy("doc_id", "grp").agg(F.max(F.when(start, F.when(F.col("kind") == "manual", F.col("manual")).when(F.col("kind") == "auto", F.col("auto")))).alias("number"), F.max(F.when(start & (F.col("kind") == "tagged"), F.col("tag"))).alias("tag"), F.transform(F.array_sort(F.collect_list(F.struct("source_order", "source_id", "raw_text"))), lambda x: F.struct(x["source_id"].alias("id"), x["raw_text"].alias("text"))).alias("members"), unread.alias("block_errors"))
    groups = heads.join(_line_facts(lines), ["doc_id", "grp"], "left").join(_image_facts(rows, lines), ["doc_id", "grp"], "left")
    done = finished(groups).withColumn("source_ids", F.transform("members", lambda m: m["id"])).withColumn("raw_text", T.trim(F.array_join(F.transform("members", lambda m: m["text"]), "\n")))
    index = (F.row_number().over(Window.partitionBy("doc_id", "accepted").orderBy("grp")) - 1).cast("int")
    done = done.withColumn("index", F.when(F.col("accepted"), index))
    questions = done.where("accepted").select("doc_id", "index", F.col("number").alias("original_id"), "kind", F.col("stem").alias("question"), F.col("choices").alias("options"), "answer", "explanation", "knowledge", "images", "source_ids", "stem_sources", F.map_from_entries(F.transform("options", lambda o: F.struct(o["key"], o["sources"]))).alias("option_sources"), "answer_sources", "explanation_sources", "knowledge_sources")
    reason = F.get("errors", F.lit(0))
    of_groups = done.select("doc_id", F.col("grp").alias("order"), "source_ids", F.col("number").alias("original_number"), "raw_text", F.when(F.col("accepted"), ACCEPTED).otherwise(REJECTED).alias("status"), reason["reason"].alias("reason_code"), reason["message"].alias("reason_message"), F.when(F.col("accepted"), F.array("index")).otherwise(F.array().cast("array<int>")).alias("question_indexes"), "warnings")
    odd = F.col("kind") == "unsupported"
    why = F.when(F.col("unsupported_reason").contains("文本框"), "TEXTBOX_UNSUPPORTED").when(F.col("unsupported_reason").contains("对象"), "EMBEDDED_OBJECT_UNSUPPORTED").otherwise("SOURCE_NOT_COVERED")
    of_blocks = rows.where("grp IS NULL").select("doc_id", F.col("source_order").alias("order"), F.array("source_id").alias("source_ids"), F.lit(None).cast("int").alias("original_number"), "raw_text", F.when(odd, UNSUPPORTED).otherwise(NON_QUESTION).alias("status"), F.when(odd, why).alias("reason_code"), F.when(odd, F.coalesce("unsupported_reason", F.lit(SAYS["unsupported"]))).otherwise(SAYS["title"]).alias("reason_message"), F.array().cast("array<int>").alias("question_indexes"), F.array().cast("array<string>").alias("warnings"))
    records = of_groups.unionByName(of_blocks)
    marks = records.select("doc_id", F.explode("source_ids").alias("source_id"), "status")
    covered = ledger.status(rows.select("doc_id", "source_id"), marks)
    return {"questions": questions, "records": records, "ledger": covered, "report": ledger.report(rows, records, covered)}


def tagged_complete(blocks: DataFrame) -> DataFrame:
    """(doc_id, expected): documents that consist of well-formed tagged groups only, with their number."""
    rows = classified(blocks)
    head = F.col("kind") == "tagged"
    w = Window.partitionBy("doc_id").orderBy("source_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"g": F.count_if(head).over(w), "full": F.when(head, (F.size("lines") > 1)).otherwise(F.size("lines") > 0) | (F.size("images") > 0)})
    groups = rows.groupBy("doc_id", "g").agg(F.max("full").alias("full"), F.max(F.col("source_type") == "unsupported").alias("odd"))
    docs = groups.groupBy("doc_id").agg(F.count("*").cast("int").alias("expected"), F.min((F.col("g") > 0) & F.col("full") & ~F.col("odd")).alias("good"))
    return docs.where("good").select("doc_id", "expected")


def recognize_tagged(blocks: DataFrame) -> dict[str, DataFrame]:
    """recognize, for the documents whose tagged groups are all accepted; the others need a model."""
    found = recognize(blocks)
    gate = tagged_complete(blocks).join(found["report"], "doc_id").where("accepted = expected AND rejected = 0 AND non_question = 0 AND unsupported = 0 AND ledger_complete").select("doc_id")
    return {k: v.join(gate, "doc_id", "left_semi") for k, v in found.items()}
