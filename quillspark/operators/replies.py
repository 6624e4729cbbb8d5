"""What a model answers: replies parsed with VARIANT functions, held against their request, candidates against sources.

Everything is a column expression but compatibility normalisation, which no built-in function offers; that runs once a
source block and once a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import options as O
from quillspark.functions import recovery as R
from quillspark.functions import text as T

# How answers are written in a source, alone and behind a question's number.
ANSWER = r"(?:答案|正确答案|参考答案|标准答案)\s*[:：]?\s*([A-Ha-h,，、\s]+|对|错|正确|错误|√|×)"
KEYED_BEFORE, KEYED_AFTER = r"(?<!\d)", r"\s*(?:题)?(?:\s*[.．、:：)）=\-]\s*|\s+)(?:答案\s*[:：]?\s*)?([A-Ha-h,，、\s]+|对|错|正确|错误|√|×)"
OPTION_OPENING = r"^[A-Ha-h][.．、:：)）]"
QUESTION_OPENING = r"^(?:(?:第)?\d{1,6}(?:题|[.、)）])|[（(]\d{1,6}[）)])"
# Names of question kinds in replies.
KINDS = {"single": "single", "multiple": "multiple", "multi": "multiple", "judge": "truefalse", "truefalse": "truefalse", "true_false": "truefalse", "boolean": "truefalse"}

_IDS = "array<string>"
_none = lambda: F.array().cast(_IDS)


# Parsing --------------------------------------------------------------------------------------------------------------


def stripped(raw: Column) -> Column:
    """A reply without white space and code fences around it."""
    text = T.trim(raw)
    return F.when(text.startswith("```"), T.trim(F.regexp_replace(F.regexp_replace(text, "^```(?:json|JSON)?", ""), "```$", ""))).otherwise(text)


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(f"^({kind})"), F.lit(False))


def _text(value: Column) -> Column:
    """The value of a JSON string; null for anything else."""
    return F.when(_is(value, "STRING"), _at(value, "$", "string"))


def _strings(value: Column) -> Column:
    """The strings of an array, or a string alone."""
    each = F.transform(F.filter(_at(value, "$", "array<variant>"), lambda x: _is(x, "STRING")), lambda x: _at(x, "$", "string"))
    return F.when(_is(value, "ARRAY"), each).when(_is(value, "STRING"), F.array(_at(value, "$", "string"))).otherwise(_none())


def _number(value: Column) -> Column:
    return F.when(_is(value, "BIGINT|DECIMAL|DOUBLE|FLOAT"), _at(value, "$", "double").cast("int"))


def _objects(value: Column) -> Column:
    """The objects of an array; an empty list for anything else."""
    return F.coalesce(F.filter(_at(value, "$", "array<variant>"), lambda x: _is(x, "OBJECT")), F.array().cast("array<variant>"))


def _candidate(x: Column, i: Column) -> Column:
    option = lambda o: F.struct(_text(_at(o, "$.key")).alias("key"), F.coalesce(_text(_at(o, "$.text")), F.lit("")).alias("text"))
    entry = lambda name: F.struct(F.lit(name).alias("name"), _strings(_at(x, f"$.{name}")).alias("ids"))
    by_key = F.coalesce(F.map_entries(_at(x, "$.optionSources", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    sources = F.transform(by_key, lambda e: F.struct(F.concat(F.lit("optionSources."), F.upper(e["key"])).alias("name"), _strings(e["value"]).alias("ids")))
    ids, number = _strings(_at(x, "$.sourceIds")), _number(_at(x, "$.originalQuestionNumber"))
    full = F.struct(
        _text(_at(x, "$.type")).alias("type"), _text(_at(x, "$.question")).alias("question"), F.filter(F.transform(_objects(_at(x, "$.options")), option), lambda o: o["key"].isNotNull()).alias("options"), _strings(_at(x, "$.answer")).alias("answer"),
        _text(_at(x, "$.explanation")).alias("explanation"), _text(_at(x, "$.knowledge")).alias("knowledge"), number.alias("number"), ids.alias("source_ids"),
        F.concat(F.array(entry("questionSource")), sources, F.array(*[entry(k) for k in ("answerSource", "explanationSource", "knowledgeSource")])).alias("fields"),
    )
    return F.struct(F.coalesce(_text(_at(x, "$.tempId")), F.concat(F.lit("q"), i.cast("string"))).alias("temp_id"), ids.alias("source_ids"), number.alias("number"), F.when(full["type"].isNotNull() & full["question"].isNotNull(), full).alias("full"))


def root(raw: Column) -> Column:
    """The VARIANT of a reply, null where it is not JSON. Raw control characters inside strings, which JSON forbids and
    models write, are read as spaces."""
    text = stripped(raw)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, r"[\x00-\x1f]", " ")))


def parsed(root: Column) -> Column:
    """struct(candidates, answer_section, non_question, unsupported, unresolved, error) of a reply's VARIANT.

    Give it a column of its own: the expression names it many times.
    """
    asked = _at(root, "$.questions")
    error = F.when(root.isNull(), "the reply is not JSON").when(~_is(root, "OBJECT"), "the reply is not one JSON object").when(asked.isNotNull() & ~_is(asked, "ARRAY"), "questions is not an array")
    section = F.array_distinct(F.flatten(F.transform(_objects(_at(root, "$.answerSections")), lambda s: _strings(_at(s, "$.sourceIds")))))
    named = {n: _strings(_at(root, f"$.{k}")) for n, k in (("non_question", "nonQuestionSourceIds"), ("unsupported", "unsupportedSourceIds"), ("unresolved", "unresolvedSourceIds"))}
    return F.struct(F.transform(_objects(asked), _candidate).alias("candidates"), section.alias("answer_section"), *[c.alias(n) for n, c in named.items()], error.alias("error"))


def classified(reply: Column) -> Column:
    """All ids that a reply puts somewhere."""
    own = F.flatten(F.transform(reply["candidates"], lambda c: c["source_ids"]))
    return F.array_distinct(F.concat(own, reply["answer_section"], reply["non_question"], reply["unsupported"], reply["unresolved"]))


# Scope ----------------------------------------------------------------------------------------------------------------


def borrowed(full: Column) -> Column:
    """field=id of the ids that a candidate's fields name but the candidate itself does not."""
    return F.array_distinct(F.flatten(F.transform(full["fields"], lambda f: F.transform(F.array_except(f["ids"], full["source_ids"]), lambda i: F.concat(f["name"], F.lit("="), i)))))


def field(full: Column, name: Column | str) -> Column:
    """The ids of a candidate's field; the last one counts where a name comes twice."""
    own = F.filter(full["fields"], lambda f: f["name"] == name)
    return F.coalesce(F.get(own, F.size(own) - 1)["ids"], _none())


def scope_error(reply: Column, allowed: Column, required: Column | None = None) -> Column:
    """What a reply names outside its request or outside a candidate's own sources, in one text; null if nothing.

    With required ids, every candidate and its stem must name one of them.
    """
    outside = lambda label, ids: F.when(F.size(F.array_except(ids, allowed)) > 0, F.concat(label, F.lit(" names ids outside the request: "), F.array_join(F.array_except(ids, allowed), ", ")))
    empty = lambda label, ids: F.when(F.size(ids) == 0, F.concat(label, F.lit(" is empty")))
    misses = lambda label, ids: F.lit(None).cast("string") if required is None else F.when((F.size(required) > 0) & ~F.arrays_overlap(ids, required), F.concat(label, F.lit(" names none of the blocks asked for")))
    lists = [outside(F.lit(k), reply[k]) for k in ("answer_section", "non_question", "unsupported", "unresolved")]

    def of_candidate(c: Column, n: Column) -> Column:
        at, full = F.concat(F.lit("question "), n.cast("string")), c["full"]
        named = F.concat(at, F.lit(" sources"))
        own = [empty(named, c["source_ids"]), outside(named, c["source_ids"]), misses(named, c["source_ids"])]
        stem = F.when(full.isNotNull(), misses(F.concat(at, F.lit(" stem")), field(full, "questionSource")))
        fields = F.transform(full["fields"], lambda f: outside(F.concat(at, F.lit(" "), f["name"]), f["ids"]))
        lent = F.when(F.size(borrowed(full)) > 0, F.concat(at, F.lit(" has fields from blocks that are not its own: "), F.array_join(borrowed(full), ", ")))
        return F.concat(F.array(*own, stem), F.coalesce(fields, _none()), F.array(lent))

    found = F.array_distinct(F.array_compact(F.concat(F.array(*lists), F.flatten(F.transform(reply["candidates"], of_candidate)))))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def covering(reply: Column, wanted: Column) -> Column:
    """True where a reply puts all wanted ids, of which there are some, somewhere."""
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, classified(reply))) == 0)


# Candidates -----------------------------------------------------------------------------------------------------------


def prepared(blocks: DataFrame) -> DataFrame:
    """(doc_id, source_id, block): what candidates are held against, worked out once a block."""
    image = lambda i: F.struct(*[i[k].alias(k) for k in ("media_id", "relationship_id", "local_path", "char_offset", "supported_for_display")], O.image_owner(F.coalesce(F.col("raw_text"), F.lit("")), i["char_offset"]).alias("owner"))
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    keys = F.transform(O.matches(text, O.OWNER_OPTION), lambda m: F.upper(F.regexp_extract(m["text"], "([A-Ha-h])", 1)))
    shown = T.automatic_option_key(F.col("numbering.display_text"))
    return blocks.select("doc_id", "source_id", F.struct(text.alias("text"), R.nfkc(text).alias("plain"), F.array_distinct(F.array_compact(F.array_append(keys, shown))).alias("keys"), F.transform("images", image).alias("images")).alias("block"))


def _of(own: Column, ids: Column) -> Column:
    """The blocks of ids that exist."""
    return F.filter(F.transform(ids, lambda i: F.try_element_at(own, i)), lambda b: b.isNotNull())


def _stands(value: Column, own: Column, ids: Column, opening: str | None = None) -> Column:
    """Whether a normalised value, without its opening marker, is not empty and stands in the blocks of ids."""
    bare = F.regexp_replace(value, opening, "") if opening else value
    return (bare != "") & F.contains(F.array_join(F.transform(_of(own, ids), lambda b: b["plain"]), ""), bare)


def _answered(answer: Column, own: Column, ids: Column, number: Column, section: Column) -> Column:
    """Whether an answer is written in the blocks of ids. In a block that lists many answers only the question's own
    number leads to its answer."""
    text = F.array_join(F.transform(_of(own, ids), lambda b: b["text"]), "\n")
    keys = lambda pattern: F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), T.normalize_answer)))
    within = lambda pattern: F.size(F.array_except(answer, keys(pattern))) == 0
    keyed = F.concat(F.lit(KEYED_BEFORE), number.cast("string"), F.lit(KEYED_AFTER))
    return (~F.arrays_overlap(ids, section) & within(F.lit(ANSWER))) | F.coalesce(number.isNotNull() & within(keyed), F.lit(False))


def _owned(own: Column, ids: Column, owner: Column) -> Column:
    """The distinct images of the blocks of ids that stand in a field, or in none."""
    return F.array_distinct(F.filter(F.flatten(F.transform(_of(own, ids), lambda b: b["images"])), lambda i: i["owner"].isNull() | (i["owner"] == owner)))


def checked(rows: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """rows(*key, doc_id, full, allowed, section) with problem (reason, message; null if none), question and warnings.

    blocks are those of `prepared`. A row meets the blocks that it names and no others.
    """
    named = F.array_distinct(F.concat(F.col("full.source_ids"), F.flatten(F.transform("full.fields", lambda f: f["ids"]))))
    own = rows.select(*key, "doc_id", F.explode(named).alias("source_id")).join(blocks, ["doc_id", "source_id"]).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("source_id", "block"))).alias("own"))
    at = rows.join(own, key, "left").withColumn("own", F.coalesce("own", F.create_map().cast(own.schema["own"].dataType)))
    full = F.col("full")
    values = F.concat(F.array(full["question"], F.coalesce(full["explanation"], F.lit("")), F.coalesce(full["knowledge"], F.lit(""))), F.transform(full["options"], lambda o: o["text"]))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for item in KINDS.items() for x in item]), F.lower(full["type"]))
    options = F.transform(full["options"], lambda o, i: F.struct(F.upper(o["key"]).alias("key"), T.trim(o["text"]).alias("text"), F.get(F.col("plain"), i + 3).alias("plain"), field(full, F.concat(F.lit("optionSources."), F.upper(o["key"]))).alias("ids")))
    at = at.withColumns({"plain": R.nfkc_each(values), "kind": kind, "answer": T.normalize_answers(full["answer"])}).withColumn("options", options)
    at = at.withColumn("keys", F.transform("options", lambda o: o["key"]))
    have, answer, keys = F.col("own"), F.col("answer"), F.col("keys")
    stem, tail = field(full, "questionSource"), field(full, "answerSource")
    missing = F.array_sort(F.array_except(F.flatten(F.transform(_of(have, full["source_ids"]), lambda b: b["keys"])), keys))
    unread = F.filter("options", lambda o: (F.size(o["ids"]) == 0) | ((o["text"] == "") & ~F.exists(_of(have, o["ids"]), lambda b: F.size(b["images"]) > 0)))
    invented = F.filter("options", lambda o: (o["text"] != "") & ~_stands(o["plain"], have, o["ids"], OPTION_OPENING))
    # Options are read one after the other: of two faults the one of the earlier option counts.
    first = lambda xs: F.coalesce(F.array_position(keys, F.get(xs, F.lit(0))["key"]), F.lit(1 << 20))
    names = lambda xs: F.array_join(F.transform(xs, lambda o: o["key"]), ", ")
    ids = F.array_distinct(full["source_ids"])
    conditions = [
        ((F.size(ids) == 0) | (F.size(F.array_except(ids, "allowed")) > 0) | (F.size(F.array_except(ids, F.map_keys(have))) > 0), "SOURCE_NOT_COVERED", "names blocks that do not exist or were not sent"),
        (F.size(borrowed(full)) > 0, "SOURCE_NOT_COVERED", "has fields from blocks that are not its own"),
        (T.is_blank(full["question"]) | (F.size(stem) == 0), "MISSING_STEM", "has no stem, or none that was read anywhere"),
        (~_stands(F.get("plain", F.lit(0)), have, stem, QUESTION_OPENING), "API_HALLUCINATED_CONTENT", "has a stem that its blocks do not hold"),
        (F.col("kind").isNull(), "INVALID_QUESTION_TYPE", "is of an unknown kind"),
        (F.size("options") == 0, "MISSING_OPTIONS", "has no options"),
        (F.size(F.array_distinct(keys)) < F.size(keys), "DUPLICATE_OPTION", "has an option key twice"),
        (~F.forall(keys, lambda k: k.rlike("^[A-H]$")), "MISSING_OPTIONS", "has option keys other than A to H"),
        ((F.col("kind") != "truefalse") & (F.size(keys) < 2), "MISSING_OPTIONS", "has fewer than two options"),
        ((F.col("kind") == "truefalse") & (F.array_sort(keys) != F.array(F.lit("A"), F.lit("B"))), "MISSING_OPTIONS", "is a judgement without exactly the options A and B"),
        (F.size(missing) > 0, "SOURCE_NOT_COVERED", "leaves out options of its blocks"),
        ((F.size(unread) > 0) & (first(unread) <= first(invented)), "MISSING_OPTIONS", "has options that were read nowhere"),
        (F.size(invented) > 0, "API_HALLUCINATED_CONTENT", "has options that their blocks do not hold"),
        ((F.size(answer) == 0) | (F.size(tail) == 0), "MISSING_ANSWER", "has no answer, or none that was read anywhere"),
        (F.size(F.array_except(answer, keys)) > 0, "ANSWER_NOT_IN_OPTIONS", "has an answer that is no option"),
        (~_answered(answer, have, tail, full["number"], F.col("section")), "API_HALLUCINATED_CONTENT", "has an answer that its blocks do not hold"),
        (F.col("kind").isin("single", "truefalse") & (F.size(answer) != 1), "INVALID_QUESTION_TYPE", "has more than one answer"),
        ((F.col("kind") == "multiple") & (F.size(answer) < 2), "INVALID_QUESTION_TYPE", "has fewer than two answers"),
        (~T.is_blank(full["explanation"]) & ~_stands(F.get("plain", F.lit(1)), have, field(full, "explanationSource")), "API_HALLUCINATED_CONTENT", "has an explanation that its blocks do not hold"),
        (~T.is_blank(full["knowledge"]) & ~_stands(F.get("plain", F.lit(2)), have, field(full, "knowledgeSource")), "API_HALLUCINATED_CONTENT", "has a topic that its blocks do not hold"),
    ]
    problem = F.lit(None).cast("struct<reason:string,message:string>")
    for cond, reason, message in reversed(conditions):
        problem = F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(reason).alias("reason"), F.lit(f"the question {message}").alias("message"))).otherwise(problem)
    paths = lambda images: F.array_distinct(F.filter(F.transform(images, lambda i: i["local_path"]), lambda p: F.coalesce(p, F.lit("")) != ""))
    pictures = _owned(have, stem, F.lit("stem"))
    every = F.concat(pictures, F.flatten(F.transform(F.flatten(F.transform("options", lambda o: _of(have, o["ids"]))), lambda b: b["images"])))
    warnings = F.array_compact(F.array(F.when(F.size(every) > 0, "images were not sent to the model: check answers that depend on them"), F.when(F.exists(every, lambda i: ~F.coalesce(i["supported_for_display"], F.lit(False))), "holds images that cannot be shown")))
    tidy = lambda c: F.nullif(T.trim(c), F.lit(""))
    shown = F.transform("options", lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text"), paths(_owned(have, o["ids"], F.concat(F.lit("option:"), o["key"]))).alias("image_uris")))
    question = F.struct(full["number"].alias("original_id"), F.col("kind"), T.trim(full["question"]).alias("question"), shown.alias("options"), answer.alias("answer"), tidy(full["explanation"]).alias("explanation"), tidy(full["knowledge"]).alias("knowledge"), paths(pictures).alias("images"), full["source_ids"].alias("source_ids"), stem.alias("stem_sources"))
    # By this two questions are the same: stem and options in order, neither answer nor kind.
    same = F.concat_ws("|", F.get("plain", F.lit(0)), F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit("="), o["plain"])), "|"))
    return at.select(*rows.columns, problem.alias("problem"), question.alias("question"), warnings.alias("warnings"), same.alias("same"))
