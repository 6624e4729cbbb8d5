"""Scalar functions on fixed cases, and option markers against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import kinds as K
from quillspark.functions import options as O
from quillspark.functions import recovery as R
from quillspark.functions import text as T

ANSWERS = {"AB": "AB", "A,B": "AB", "a b": "AB", "A、C": "AC", "对": "A", "错误": "B", "√": "A", "×": "B", "X": "", "": "", "APPLE": "A", "AAB": "AB", "A;B": "A", "对,错": "", " b ": "B", "H，g": "GH", "　A　": "A", "ABI": "A"}


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def test_answers(spark):
    rows = column(spark, list(ANSWERS)).select("v", T.normalize_answer(F.col("v")).alias("k")).collect()
    assert {r.v: "".join(r.k) for r in rows} == ANSWERS
    assert {v: "".join(R.normalized_answer(v)) for v in ANSWERS} == ANSWERS


def test_kinds(spark):
    rows = column(spark, ["single", "MULTI", "judge", "boolean", "essay", None]).select(K.kind(F.col("v")).alias("a"), K.kind_strict(F.col("v")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("single", "single"), ("multiple", "multiple"), ("truefalse", "truefalse"), ("truefalse", "truefalse"), ("single", None), ("single", None)]


def test_numbers(spark):
    rows = column(spark, [0, 1, 26, 27, 52, 703, 4, 1994, 5000], "int").select(T.letters(F.col("v")).alias("l"), T.roman(F.col("v")).alias("r")).collect()
    assert [r.l for r in rows][:6] == ["A", "A", "Z", "AA", "AZ", "AAA"] and [r.r for r in rows][6:] == ["IV", "MCMXCIV", "MMMCMXCIX"]


def test_lines_and_prefixes(spark):
    df = column(spark, ["第 3 题 Q", "（12） Q", "7、Q", "1234567. Q", "Q"])
    assert [r[0] for r in df.select(T.question_number(F.col("v"))).collect()] == [3, 12, 7, None, None]
    assert [r[0] for r in column(spark, ["a\r\n b \n\n　\rc", None]).select(T.lines(F.col("v"))).collect()] == [["a", "b", "c"], []]
    assert column(spark, ["&amp;lt; &lt;"]).select(T.unescape_xml(F.col("v"))).first()[0] == "&lt; <"


def test_inline_options_match_the_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["A.", "B、", "C)", " ", "x", "D:", "a．", "。", "E", "b. "]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    rows = column(spark, texts).select("v", O.inline_options(F.col("v")).alias("o")).collect()
    for r in rows:
        assert (r.o and (r.o.leading, [tuple(x) for x in r.o.options])) == R.inline(r.v), r.v


def test_normalized_options(spark):
    given = [[("b", "B. two"), ("A", "one B、three"), ("Z", "x"), ("C", " ")], [("A", "one"), ("A", "again")]]
    rows = column(spark, given, "array<struct<key:string,text:string>>").select(O.normalized_options(F.col("v")).alias("o")).collect()
    assert [[tuple(x) for x in r.o] for r in rows] == [[("A", "one"), ("B", "two")], [("A", "one")]]


@pytest.mark.parametrize(("raw", "count", "partial"), [('[{"question":"q","answer":"A","options":{"A":"x","B":"y"}}]', 1, False), ('```json\n[{"question":"q","answer":["A","B"],"options":["A. x","B. y"]},{"question":"r"}]\n```', 1, False), ('[{"question":"q","answer":"A","options":[{"key":"A","text":"x"},{"key":"B","text":"y"}]},{"que', 1, True), ("none", 0, True), ('[{"question":"q","type":"judge","answer":"对"}]', 1, False), ('[{"question":"q","answer":"C","options":{"A":"x","B":"y"}}]', 0, False)])
def test_recovery(raw, count, partial):
    assert (len(R.parse_questions(raw)[0]), R.parse_questions(raw)[1]) == (count, partial)


def test_repairs_and_truncation():
    good = '{"question":"q","type":"truefalse","answer":"A","options":[{"key":"A","text":"正确"},{"key":"B","text":"错误"}]}'
    assert [o["text"] for o in R.parse_repaired(f"x {good} y")["options"]] == ["对", "错"]
    assert [R.parse_repaired(x) for x in ("null", "", '{"question":"q","type":"essay"}', good.replace("正确", "是"))] == [None] * 4
    assert [R.likely_truncated(x) for x in ('{"a": 1}', '{"a": "b', '[1, {"a": 2}', "text", '{"a": "}"}')] == [False, True, True, False, False]
    assert R.annotations('{"annotations":[{"sourceId":"s","label":"stem","start":1.0,"end":2}]}')[0]["start"] == 1
    assert [R.annotations(x) for x in ('{"annotations":[{"sourceId":"s","label":"stem","start":1.5,"end":2}]}', '{"annotations":[],"question":"x"}', "[]")] == [None] * 3


def test_columns_of_replies(spark):
    body = '{"choices":[{"message":{"content":"c"},"finish_reason":"stop"}],"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3}}'
    assert tuple(column(spark, [body]).select(R.completion(F.col("v")).alias("c")).first().c) == ("c", "stop", 1, 2, 3)
    lines = ['data: {"choices":[{"delta":{"content":"x"}}]}', "data: [DONE]", ": ping"]
    assert [r[0] for r in column(spark, lines).select(R.stream_delta(F.col("v"))).collect()] == ["x", None, None]
    assert [r[0] for r in column(spark, ["Ａ Ｂ，", None]).select(R.nfkc(F.col("v"))).collect()] == ["AB,", None]


def test_images(spark):
    text = "1. Q\nA. x B. y\n答案：A"
    df = spark.createDataFrame([(i, text, o) for i, o in enumerate([0, 3, 6, 11, 15, None])], "i int, t string, o int").orderBy("i")
    assert [r[0] for r in df.select(O.image_owner(F.col("t"), F.col("o"))).collect()] == ["stem", "stem", "option:A", "option:B", "other", None]
