"""What a model is asked: source blocks cut into slices, slices dealt to requests, requests halved and written out.

All plans are DataFrame work. A request is one row with its slices; slices of a request are bounded by their number
and their estimated tokens. Only one array of integers a document (where its requests begin and end) is folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import options as O
from quillspark.functions import text as T

from . import sets

# Limits of requests.
BUDGET, OVERLAP, MOST_SLICES, DEEPEST, LEAST_CHARS = 6_000, 2, 48, 6, 800
# How a slice begins that opens a question.
OPENING = r"^(?:(?:第)?\d{1,6}(?:题|[.、)）])|[（(]\d{1,6}[）)])"
SOFT = "[\n。；;]"

PROMPTS = {
    "BOUNDARY": "Find the questions of the source blocks below. Answer with one JSON object with these keys and no other text: questions (array of objects with tempId, sourceIds and originalQuestionNumber), answerSections (array of objects with sourceIds: blocks that list answers of many questions), nonQuestionSourceIds, unsupportedSourceIds and unresolvedSourceIds (arrays of ids). Name every source_id once at least; one block may hold several questions. Do not return stems, options, answers or other fields yet. Images are placeholders. Input:\n",
    "STRUCTURE": "Write down the questions that the candidate_source_ids below hold. Answer with one JSON object with the keys of the first pass; every entry of questions also has type (single, multiple or truefalse), question, options (array of objects with key and text), answer (array of keys), explanation, knowledge, and where each was read: questionSource, optionSources (object of arrays by key), answerSource, explanationSource and knowledgeSource. Copy text as it stands; leave out only numbers and markers. Where a block lacks an answer, list it in unresolvedSourceIds and guess nothing. Input:\n",
    "REPAIR": "The block below is one question that could not be read. Answer with one JSON object with id, type, question, options, answer, explanation and knowledge, copied from the block, or with null. Input:\n",
    "LABELS": "Label the lines of the source blocks below. Answer with one JSON object with the key annotations: an array of objects with sourceId, label, start, end and, for options, optionKey; start and end are whole character offsets. Do not copy text. Input:\n",
    "CONNECTION": "Answer with the word OK.",
}
# Tokens that a reply may have.
MOST_TOKENS = {"BOUNDARY": 8_192, "STRUCTURE": 8_192, "LABELS": 4_096, "REPAIR": 2_048, "CONNECTION": 2}
MODEL = "chat"


def body(stage: Column | str, content: Column, model: str = MODEL) -> Column:
    """The JSON of a chat request of a stage: one message, deterministic, a JSON object as reply but for connection tests."""
    stage = F.lit(stage) if isinstance(stage, str) else stage
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), stage)
    message = F.struct(F.lit("user").alias("role"), F.concat(of(PROMPTS), F.when(stage == "CONNECTION", "").otherwise(content)).alias("content"))
    form = F.when(stage != "CONNECTION", F.struct(F.lit("json_object").alias("type"))).alias("response_format")
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(False).alias("stream"), F.struct(F.lit("disabled").alias("type")).alias("thinking"), form, F.lit(0.0).alias("temperature"), of(MOST_TOKENS).alias("max_tokens"), F.array(message).alias("messages")))


def repair_requests(blocks: DataFrame, model: str = MODEL) -> DataFrame:
    """A request (key, request) for each of blocks(doc_id, source_id, raw_text): one question to be read again."""
    return blocks.select(F.concat_ws("/", "doc_id", "source_id").alias("key"), body("REPAIR", F.to_json(F.struct("source_id", "raw_text")), model).alias("request"))


def connection_test(spark, model: str = MODEL) -> DataFrame:
    """The one smallest request, which carries no content."""
    return spark.range(1).select(F.lit("connection").alias("key"), body("CONNECTION", F.lit(""), model).alias("request"))


# Slices ---------------------------------------------------------------------------------------------------------------


def slice_ends(text: Column, most: int) -> Column:
    """Where the slices of a text end: each is as long as allowed, or ends behind the last soft place of its second half."""
    n, half = F.length(text), most // 2

    def add(ends: Column, _: Column) -> Column:
        start = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0))
        hard = F.least(start + most, n)
        tail = F.substring(text, start + half + 1, hard - start - half)
        soft = F.length(F.regexp_extract(tail, f"(?s)^.*{SOFT}", 0))
        return F.when(start >= n, ends).otherwise(F.concat(ends, F.array(F.when((n > most) & (soft > 0), start + half + soft).otherwise(hard))))

    tries = F.sequence(F.lit(0), F.floor(n / max(1, half)).cast("int"))
    return F.when(n == 0, F.array(F.lit(0))).when(n <= most, F.array(n)).otherwise(F.aggregate(tries, F.array().cast("array<int>"), add))


def slices(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n, cost, piece) of blocks: their slices in order, with text and places but never image contents."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    ends = blocks.withColumn("_text", text).withColumn("_ends", slice_ends(F.col("_text"), max(500, 2 * budget)))
    spans = F.transform("_ends", lambda e, i: F.struct(F.coalesce(F.get(F.col("_ends"), i - 1), F.lit(0)).alias("a"), e.alias("b")))
    at = ends.select("*", F.posexplode(spans).alias("_cut", "_span"))
    named = F.transform("images", lambda x, i: F.coalesce(F.nullif(x["media_id"], F.lit("")), F.nullif(x["relationship_id"], F.lit("")), F.concat(F.lit("unresolved-"), i.cast("string"))))
    own = F.substring("_text", F.col("_span.a") + 1, F.col("_span.b") - F.col("_span.a"))
    piece = F.struct("source_id", "source_order", "source_type", own.alias("raw_text"), F.col("_span.a").alias("char_start"), F.col("_span.b").alias("char_end"), "numbering", F.col("table_pos").alias("table"), named.alias("images"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("source_order", "source_id", "_cut")) - 1
    return at.select("doc_id", n.alias("n"), T.estimated_tokens(own, F.size("images")).alias("cost"), piece.alias("piece"))


def request_spans(costs: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP, most: int = MOST_SLICES) -> DataFrame:
    """(doc_id, chunk, first, end) of costs(doc_id, n, cost): which slices go together.

    How far a request from any slice would reach is an as-of lookup of its budget among the running totals; the
    requests of a document are the chain of those places from the first slice on.
    """
    order = Window.partitionBy("doc_id").orderBy("n")
    total = F.sum(F.col("cost").cast("long")).over(order)
    at = costs.select("doc_id", "n", total.alias("_total"), (total - F.col("cost") + budget).alias("at"))
    reach = sets.asof(at.select("doc_id", "n", "at"), at.select("doc_id", F.col("_total").alias("at"), F.col("n").alias("reach")), "doc_id", "at", "reach")
    end = F.greatest(F.col("n") + 1, F.least(F.col("n") + max(1, most), F.coalesce("reach", F.lit(-1)) + 1))
    ends = reach.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", end.alias("end")))), lambda x: x["end"]).alias("_ends"))
    span = "array<struct<first:int,end:int>>"

    start = F.struct(F.lit(0).alias("next"), F.array().cast(span).alias("spans"))
    indexed = F.transform("_ends", lambda e, i: F.struct(e.alias("end"), i.alias("i")))
    reached = lambda acc: F.coalesce(F.get(acc["spans"], F.size(acc["spans"]) - 1)["end"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct(F.greatest(x["i"] + 1, x["end"] - max(0, overlap)).alias("next"), F.concat(acc["spans"], F.array(F.struct(x["i"].alias("first"), x["end"].alias("end")))).alias("spans"))
        return F.when((x["i"] == acc["next"]) & (reached(acc) < F.size("_ends")), taken).otherwise(acc)

    return ends.select("doc_id", F.posexplode(F.aggregate(indexed, start, step)["spans"]).alias("chunk", "span")).select("doc_id", "chunk", "span.*")


def dealt(blocks: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, position, cost, piece): the slices of every request of blocks."""
    pieces = slices(blocks, budget)
    spans = request_spans(pieces, budget, overlap)
    places = spans.select("doc_id", "chunk", F.posexplode(F.sequence(F.col("first"), F.col("end") - 1)).alias("position", "n"))
    return places.join(pieces, ["doc_id", "n"]).drop("n")


def chunk_table(blocks: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, position, source_id, char_start, char_end, tokens) of the boundary requests of blocks."""
    return dealt(blocks, budget, overlap).select("doc_id", "chunk", "position", "piece.source_id", "piece.char_start", "piece.char_end", F.col("cost").alias("tokens"))


def opens_question(piece: Column) -> Column:
    text = F.regexp_replace(piece["raw_text"], rf"^{T.SPACE}+", "")
    numbered = (piece["numbering"]["level"] == 0) & T.trim(piece["numbering"]["display_text"]).rlike(T.NUMBERED_DISPLAY)
    return text.rlike(OPENING) | text.rlike(T.TAGGED_HEADER) | F.coalesce(numbered, F.lit(False))


def halves(pieces: Column) -> Column:
    """The two smaller requests (arrays of slices) for one whose reply was cut off, null where it stays as it is.

    Several slices part where a question opens, nearest to the middle; without such a place both halves share the middle
    slice. A single long slice parts at a question number inside it, else with an overlap of a tenth.
    """
    n = F.size(pieces)
    nearest = lambda places, to: F.array_min(F.transform(places, lambda p: F.struct(F.abs(p - to).alias("far"), p.alias("at"))))["at"]
    half = F.floor(n / 2).cast("int")
    opening = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: opens_question(F.get(pieces, i)))
    place = nearest(opening, half)
    several = F.when(place.isNotNull(), F.array(F.slice(pieces, 1, place), F.slice(pieces, place + 1, n))).when(n > 2, F.array(F.slice(pieces, 1, half + 1), F.slice(pieces, half + 1, n)))
    one = F.get(pieces, F.lit(0))
    text, size = one["raw_text"], F.length(one["raw_text"])
    middle, edge = F.floor(size / 2).cast("int"), LEAST_CHARS // 4
    inner = F.filter(F.transform(O.matches(text, O.OWNER_QUESTION), lambda m: m["start"]), lambda p: (p >= edge) & (p <= size - edge))
    at, shared = nearest(inner, middle), F.least(F.lit(400), F.greatest(F.lit(100), F.floor(size / 10).cast("int")))
    part = lambda a, b: F.array(one.withField("raw_text", F.substring(text, a + 1, b - a)).withField("char_start", one["char_start"] + a).withField("char_end", one["char_start"] + b))
    left, right = F.coalesce(at, F.least(middle + shared, size - 1)), F.coalesce(at, F.greatest(middle - shared, F.lit(1)))
    single = F.when(size >= LEAST_CHARS, F.array(part(F.lit(0), left), part(right, size)))
    return F.when(n > 1, several).otherwise(single)
