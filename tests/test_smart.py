"""The model-assisted recogniser with scripted clients."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import recovery as R
from quillspark.operators import blocks as B
from quillspark.operators import replies, requests
from quillspark.operators import smart as S
from quillspark.sources import model
from tests.test_standard import frame, source

ONE = "1. Q\nA. x\nB. y\n答案：A"
TWO = ONE + "\n2. R\nA. x\nB. y\n答案：B"


def question(ids, number=1, **more):
    return {"tempId": f"t{number}", "sourceIds": ids, "originalQuestionNumber": number, "type": "single", "question": "Q", "options": [{"key": "A", "text": "x"}, {"key": "B", "text": "y"}], "answer": ["A"], "questionSource": ids, "optionSources": {"A": ids, "B": ids}, "answerSource": ids} | more


def reply(*questions, **more):
    return json.dumps({"questions": list(questions), "nonQuestionSourceIds": [], **more}, ensure_ascii=False)


def broken(request):
    raise OSError("down")


def halved(request):
    ids = [s["source_id"] for s in request["source_blocks"]]
    return reply(*[question([i]) for i in ids]), "length" if len(ids) > 1 else None


# name: (texts, what the client says, (status, reason, blocks) of the records, chunk ids of the calls)
REJECTED, ACCEPTED, OTHER = "REJECTED_QUESTION", "ACCEPTED_QUESTION", "NON_QUESTION_CONTENT"
SECTION = lambda p, n: reply(question([f"{p}.s0"], n, answerSource=[f"{p}.s1"], sourceIds=[f"{p}.s0", f"{p}.s1"]), answerSections=[{"sourceIds": [f"{p}.s1"]}])
CASES = {
    "title": (["Title", ONE], (reply(question(["title.s1"]), nonQuestionSourceIds=["title.s0"]), "stop"), [(OTHER, None, ["s0"]), (ACCEPTED, None, ["s1"])], ["chunk-0"]),
    "number4": (["4. Q\nA. x\nB. y", "答案汇总：4.A 5.B"], (SECTION("number4", 4), None), [(OTHER, None, ["s1"]), (ACCEPTED, None, ["s0", "s1"])], ["chunk-0"]),
    "number5": (["4. Q\nA. x\nB. y", "答案汇总：4.A 5.B"], (SECTION("number5", 5), None), [(OTHER, None, ["s1"]), (REJECTED, "API_HALLUCINATED_CONTENT", ["s0", "s1"])], ["chunk-0", "structure-t5"]),
    "text": ([ONE], ("not json", None), [(REJECTED, "API_INVALID_JSON", ["s0"])], ["chunk-0"]),
    "null": ([ONE], ("null", None), [(REJECTED, "API_RETURNED_NULL", ["s0"])], ["chunk-0"]),
    "ended": ([ONE], ("x", "content_filter"), [(REJECTED, "API_REQUEST_FAILED", ["s0"])], ["chunk-0"]),
    "down": ([ONE], broken, [(REJECTED, "API_REQUEST_FAILED", ["s0"])], ["chunk-0"]),
    "cutoff": ([ONE], ('{"questions": [', None), [(REJECTED, "API_RESPONSE_TRUNCATED", ["s0"])], ["chunk-0"]),
    "invented": ([ONE], (reply(question(["invented.s0"], question="invented")), None), [(REJECTED, "API_HALLUCINATED_CONTENT", ["s0"])], ["chunk-0", "structure-t1"]),
    "oneoption": ([ONE], (reply(question(["oneoption.s0"], options=[{"key": "A", "text": "x"}], optionSources={"A": ["oneoption.s0"]})), None), [(REJECTED, "MISSING_OPTIONS", ["s0"])], ["chunk-0", "structure-t1"]),
    "leftout": (["1. Q\nA. x\nB. y\nC. z\n答案：A"], (reply(question(["leftout.s0"])), None), [(REJECTED, "SOURCE_NOT_COVERED", ["s0"])], ["chunk-0", "structure-t1"]),
    "outside": ([ONE], (reply(question(["s9"])), None), [(REJECTED, "SOURCE_NOT_COVERED", ["s0"])], ["chunk-0"]),
    "noanswer": ([ONE], (reply(question(["noanswer.s0"], answer=["C"])), None), [(REJECTED, "ANSWER_NOT_IN_OPTIONS", ["s0"])], ["chunk-0", "structure-t1"]),
    "silent": ([ONE], (reply(), None), [(REJECTED, "SOURCE_NOT_COVERED", ["s0"])], ["chunk-0"]),
    "unsure": ([ONE], (reply(unresolvedSourceIds=["unsure.s0"]), None), [(REJECTED, "SOURCE_NOT_COVERED", ["s0"])], ["chunk-0"]),
    "partial": ([TWO], (reply(question(["partial.s0"])), None), [(ACCEPTED, None, ["s0"]), (REJECTED, "MULTIPLE_QUESTIONS_MERGED", ["s0"])], ["chunk-0"]),
    "twice": ([ONE, ONE], (reply(question(["twice.s0"]), question(["twice.s1"])), None), [(ACCEPTED, None, ["s0"]), (REJECTED, "DUPLICATE_QUESTION", ["s1"])], ["chunk-0"]),
    "same": ([ONE], (reply(question(["same.s0"]), question(["same.s0"], explanation=None)), None), [(ACCEPTED, None, ["s0"])], ["chunk-0"]),
    "halves": ([ONE, ONE], halved, [(ACCEPTED, None, ["s0"]), (REJECTED, "DUPLICATE_QUESTION", ["s1"])], ["chunk-0", "chunk-0-a", "chunk-0-b"]),
    "fenced": ([ONE], ("```json\n" + reply(question(["fenced.s0"])) + "\n```", None), [(ACCEPTED, None, ["s0"])], ["chunk-0"]),
    "kind": ([ONE], (reply(question(["kind.s0"], type="essay")), None), [(REJECTED, "INVALID_QUESTION_TYPE", ["s0"])], ["chunk-0", "structure-t1"]),
    "doubled": ([ONE], (reply(question(["doubled.s0"], options=[{"key": "A", "text": "x"}, {"key": "a", "text": "y"}])), None), [(REJECTED, "DUPLICATE_OPTION", ["s0"])], ["chunk-0", "structure-t1"]),
    "bare": ([ONE], (reply({"sourceIds": ["bare.s0"], "tempId": "b"}), None), [(REJECTED, "API_INVALID_JSON", ["s0"])], ["chunk-0", "structure-b"]),
}


def client(request):
    says = CASES[request["source_blocks"][0]["source_id"].split(".")[0]][1]
    return says(request) if callable(says) else says


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, f"{name}.s{i}", *source(i, t, doc=name)[2:]) for name, (texts, *_) in CASES.items() for i, t in enumerate(texts)]
    blocks = frame(spark, rows)
    return blocks, S.recognize(blocks, client, "k")


def test_outcomes(found):
    _, out = found
    records, calls = {}, {}
    for r in out["records"].orderBy("doc_id", "order").collect():
        records.setdefault(r.doc_id, []).append((r.status, r.reason_code, [i.split(".")[1] for i in r.source_ids]))
    for r in out["requests"].orderBy("doc_id", "n").collect():
        calls.setdefault(r.doc_id, []).append(r.chunk_id)
    assert records == {name: case[2] for name, case in CASES.items()}
    assert calls == {name: case[3] for name, case in CASES.items()}
    assert {r.doc_id: (r["index"], r.answer, r.original_id) for r in out["questions"].collect()}["number4"] == (0, ["A"], 4)
    assert all(r.ledger_complete and r.request_count == len(CASES[r.doc_id][3]) for r in out["report"].collect())
    assert all(r.status for r in out["ledger"].collect())


def test_good_replies_are_bought_once(found):
    blocks, out = found
    again = {r.doc_id: r.request_count for r in S.recognize(blocks, client, "k", cache=out["cache"])["report"].collect()}
    assert (again["title"], again["number4"], again["twice"], again["halves"]) == (0, 0, 0, 1) and again["down"] == again["text"] == again["outside"] == again["silent"] == 1


def test_without_a_key(spark):
    out = S.recognize(frame(spark, [source(0, ONE)]), broken, " ")
    assert [(r.status, r.reason_code, r.api_attempted) for r in out["records"].collect()] == [(REJECTED, "API_KEY_MISSING", False)] and out["requests"].count() == out["questions"].count() == 0


# Requests -------------------------------------------------------------------------------------------------------------


def walked(costs, budget, overlap, most):
    """The same requests by a plain walk."""
    out, start = [], 0
    while True:
        end, spent = start, 0
        while end < len(costs) and end - start < most and (end == start or spent + costs[end] <= budget):
            spent, end = spent + costs[end], end + 1
        out.append((start, end))
        if end == len(costs):
            return out
        start = max(start + 1, end - overlap)


def test_requests_are_those_of_a_plain_walk(spark):
    rng = random.Random(2)
    docs = {f"d{k}": [rng.choice([81, 90, 200, 1000, 7000]) for _ in range(rng.randrange(1, 160))] for k in range(40)}
    costs = spark.createDataFrame([(d, n, c) for d, own in docs.items() for n, c in enumerate(own)], "doc_id string, n int, cost int")
    for budget, overlap, most in ((6000, 2, 48), (1000, 2, 5), (500, 0, 3)):
        got = {}
        for r in requests.request_spans(costs, budget, overlap, most).orderBy("doc_id", "chunk").collect():
            got.setdefault(r.doc_id, []).append((r["first"], r.end))
        assert got == {d: walked(own, budget, overlap, most) for d, own in docs.items()}


def test_slices_tile_texts_and_end_softly(spark):
    rng = random.Random(1)
    texts = ["", "a" * 50, "a" * 51, *["".join(rng.choice("ab。\n；c") for _ in range(rng.randrange(1, 400))) for _ in range(150)]]
    for text, ends in spark.createDataFrame([(t,) for t in texts], "t string").select("t", requests.slice_ends(F.col("t"), 50)).collect():
        starts = [0, *ends[:-1]]
        assert ends[-1] == len(text) and all(0 < b - a <= 50 for a, b in zip(starts, ends)) or text == "" and ends == [0]
        if len(text) > 50:
            for a, b in zip(starts, ends):
                soft = [i + 1 for i in range(min(a + 25, len(text)), min(a + 50, len(text))) if text[i] in "\n。；;"]
                assert b == (soft[-1] if soft else min(a + 50, len(text)))


def pieces(spark, *texts):
    blocks = frame(spark, [source(i, t) for i, t in enumerate(texts)])
    rows = requests.slices(blocks, 1 << 20).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]).alias("p"))
    got = rows.select(requests.halves(F.col("p"))).first()[0]
    return got and [[(s.source_id, s.char_start, s.char_end) for s in half] for half in got]


def test_halves(spark):
    assert pieces(spark, "a", "b") is None and pieces(spark, "short") is None
    assert pieces(spark, "a", "2. b") == [[("s0", 0, 1)], [("s1", 0, 4)]]
    assert pieces(spark, "a", "b", "c") == [[("s0", 0, 1), ("s1", 0, 1)], [("s1", 0, 1), ("s2", 0, 1)]]
    assert pieces(spark, "x" * 1000) == [[("s0", 0, 600)], [("s0", 400, 1000)]]
    assert pieces(spark, "y" * 420 + "\n7. z" + "y" * 600) == [[("s0", 0, 420)], [("s0", 420, 1025)]]


def test_bodies(spark):
    one = spark.range(1).select(requests.body("STRUCTURE", F.lit('{"a":1}'), "m").alias("b"), requests.body("CONNECTION", F.lit("secret"), "m").alias("c")).first()
    b, c = json.loads(one.b), json.loads(one.c)
    assert (b["model"], b["max_tokens"], b["temperature"], b["response_format"]) == ("m", 8192, 0.0, {"type": "json_object"}) and b["messages"][0]["content"].endswith('{"a":1}')
    assert c["max_tokens"] == 2 and "secret" not in one.c and "response_format" not in c
    post = lambda request: json.dumps({"choices": [{"message": {"content": json.loads(request)["model"]}, "finish_reason": "stop"}]})
    done = model.completed(requests.connection_test(spark, "m"), model.envelope_client(post)).first()
    assert (done.content, done.finish, done.error) == ("m", "stop", None)


def test_replies_are_parsed_leniently(spark):
    raw = ['{"questions": "x"}', "[1]", '{"questions": [1, {"tempId": 3, "sourceIds": ["a", 2], "originalQuestionNumber": 2.0}], "unresolvedSourceIds": "u"}', '{"nonQuestionSourceIds": ["a\nb"]}', "{", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", replies.root(F.col("r")).alias("v")).select("i", replies.parsed(F.col("v")).alias("p")).orderBy("i").collect()
    assert [bool(g.p.error) for g in got] == [True, True, False, False, True, True]
    c = got[2].p.candidates[0]
    assert (c.temp_id, c.source_ids, c.number, c.full, got[2].p.unresolved, got[3].p.non_question) == ("q0", ["a"], 2, None, ["u"], ["a b"])


def test_cut_json(spark):
    raw = ['{"a": 1}', '{"a": [1', '{"a": "b', '["\\""]', '["\\"]', "plain", '{"a": "}"}', "", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "r string").select(R.truncated(F.col("r"))).collect()]
    assert got == [None if r is None else R.likely_truncated(r) for r in raw] and got[:3] == [False, True, True]


# Retries --------------------------------------------------------------------------------------------------------------


def honest(request):
    """Answers each block that is a whole question."""
    own = {s["source_id"]: s["raw_text"] for s in request["source_blocks"]}
    rest = [i for i, t in own.items() if "答案" not in t]
    made = [question([i], question=t.split("\n")[0][3:], answer=re.findall("答案：(.)", t)) for i, t in own.items() if "答案" in t]
    return json.dumps({"questions": made, "nonQuestionSourceIds": [i for i in rest if "Title" in own[i]], "unresolvedSourceIds": [i for i in rest if "Title" not in own[i]]}), None


def test_documents_in_parallel_and_a_retry(spark):
    rows = [source(o, t, doc=d) for d in ("a", "b") for o, t in enumerate(["Title", ONE, "2. R\nA. x\nB. y"])]
    blocks = spark.createDataFrame(rows, B.SCHEMA)
    found = S.recognize(blocks, honest, "k")
    assert [(r.accepted, r.rejected, r.non_question, r.ledger_complete, r.request_count) for r in found["report"].collect()] == [(1, 1, 1, True, 1)] * 2
    failed = found["records"].where("status = 'REJECTED_QUESTION' AND doc_id = 'a'").select("doc_id", "source_ids")
    after = S.retry(frame(spark, [r if r[1] != "s2" else (*r[:4], r[4] + "\n答案：B", *r[5:]) for r in rows]), found, failed, honest, "k")
    got = {r.doc_id: r for r in after["report"].collect()}
    assert (got["a"].accepted, got["a"].rejected, got["a"].ledger_complete) == (2, 0, True) and (got["b"].accepted, got["b"].rejected) == (1, 1)
    assert sorted((r.doc_id, r["index"], r.question) for r in after["questions"].collect()) == [("a", 0, "Q"), ("a", 1, "R"), ("b", 0, "Q")]
