"""The older recognisers."""

import json

from quillspark.operators import legacy as G

SCHEMA = "doc_id string, source_id string, source_order int, kind string, text string, level int, num_fmt string, images array<struct<media_id:string,rel_id:string,start:int,path:string>>"


def blocks(spark, *texts, doc="d", **more):
    return spark.createDataFrame([(doc, f"s{i}", i, "table" if t is None else "paragraph", t or "", None, None, more.get(f"i{i}", [])) for i, t in enumerate(texts)], SCHEMA)


def segments(spark, *texts):
    return [r.segment for r in G.segments(blocks(spark, *texts)).orderBy("source_order").collect()]


def test_segments(spark):
    assert segments(spark, "Title", "1. Q", "A. x", "2、R", "答案：A") == [None, "q0", "q0", "q1", "q1"]
    assert segments(spark, "Title", "Stem", "答案：B", "A. x", "B. y", "3) Q") == [None, "q0", None, "q0", "q0", "q1"]
    assert segments(spark, "Title", "text") == [None, None]
    signals = G.emitted_signals(G.segments(blocks(spark, "Title", "1. Q A. x B. y", "答案：A", "解析：e")))
    assert [(r.source_id, r.signal) for r in signals.orderBy("source_order", "signal").collect()] == [("s0", "UnassignedBlock"), ("s1", "OptionMarker"), ("s1", "QuestionStart"), ("s2", "AnswerMarker"), ("s3", "ExplanationMarker")]


def test_complete_segment_becomes_a_question(spark):
    image = lambda start: [("m", "r", start, f"p{start}.png")]
    out = G.run(blocks(spark, "1. What?", "A. x  ", "B. y", "答案：B", "解析：because", i0=image(4), i2=image(3)))
    q = out["questions"].first()
    assert (q.original_id, q.kind, q.question, [tuple(o) for o in q.options], q.answer, q.explanation, q.image_uri, q.conversion) == (1, "single", "What?", [("A", "x", None), ("B", "y", "p3.png")], ["B"], "because", "p4.png", "CONVERTED")
    counts = out["counts"].first()
    assert (counts.segments, counts.unassigned, counts.complete, counts.accepted, counts.rejected) == (1, 0, 1, 1, 0)


def test_tables_are_lossy(spark):
    rows = blocks(spark, "1. What?", None, "A. x", "B. y", "答案：B")
    assert G.run(rows)["questions"].count() == 0 and G.run(rows, lossy=True)["questions"].first().conversion == "CONVERTED_LOSSY"


def test_status(spark):
    status = lambda *t: [r.status for r in G.labelled(G.annotations(G.segments(blocks(spark, *t)))).collect()]
    assert status("1. Q", "text") == ["REJECTED"] and status("1. Q", "A. x", "B. y") == ["AMBIGUOUS"] and status("1. Q", "A. x", "A. y", "答案：A") == ["AMBIGUOUS"]


def test_model_labels(spark):
    rows = blocks(spark, "1. Q", "A. x", "B. y", "The answer is B")
    give = lambda *a: lambda request: json.dumps({"annotations": [dict(zip(("sourceId", "label", "start", "end", "optionKey"), x)) for x in a]})
    good = [("s0", "STEM", 3, 4), ("s1", "OPTION", 3, 4, "a"), ("s2", "OPTION", 3, 4, "B"), ("s3", "ANSWER", 14, 15)]
    assert G.run(rows, give(*good))["questions"].first().answer == ["B"]
    assert G.run(rows, give(*good, ("s3", "OTHER", 0, 99)))["questions"].count() == 0
    cut = G.segments(rows)
    raw = spark.createDataFrame([("d", "q0", i, *x) for i, x in enumerate([("s0", "STEM", 0, 3, None), ("s0", "STEM", 2, 4, None), ("s9", "STEM", 0, 1, None), ("s0", "question", 0, 1, None), ("s0", "X", 0, 1, None), ("s0", "STEM", -1, 1, None), ("s0", "STEM", 0, 9, None), ("s0", "STEM", 4, 4, None), ("s1", "OPTION", 0, 1, "Z"), ("s1", "STEM", 0, 1, "A")])], "doc_id string, segment string, n int, source_id string, label string, start int, end int, option_key string")
    assert [r.reason for r in G.validated(raw, cut).orderBy("n").collect()] == [None, "OVERLAPPING_SEMANTIC_RANGE", "SOURCE_ID_NOT_IN_SEGMENT", "FORBIDDEN_FIELD_PRESENT", "INVALID_LABEL", "START_OFFSET_NEGATIVE", "END_OFFSET_PAST_TEXT", "START_GE_END", "OPTION_KEY_NOT_A_H", "NON_OPTION_HAS_KEY"]


def test_plain_text(spark):
    text = "1. Q one\nA. x B. y\n答案：A\n解析：e\nmore\n二、 Q two\nA. x\nstill x\nB. y\n正确答案 A,B\n3. Q three\n答案：对\n4. broken\nA. x"
    rows = G.plain_questions(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("piece").collect()
    got = [r.question and (r.question.original_id, r.question.kind, r.question.question, [tuple(o) for o in r.question.options], r.question.answer, r.question.explanation) for r in rows]
    assert got == [(1, "single", "Q one", [("A", "x"), ("B", "y")], ["A"], "e\nmore"), (2, "multiple", "Q two", [("A", "x\nstill x"), ("B", "y")], ["A", "B"], None), (3, "truefalse", "Q three", [("A", "对"), ("B", "错")], ["A"], None), None]


def test_dumps(spark):
    from quillspark.operators import dump

    cut = G.segments(blocks(spark, "Title", "1. Q", "A. x"))
    row = dump.segments(cut, G.emitted_signals(cut)).first()
    assert row.summary == "1 segments, 1 unassigned, 3 signals" and json.loads(row.json)["unassigned"][0]["source_id"] == "s0"
