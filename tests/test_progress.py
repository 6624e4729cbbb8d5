"""Progress arrives while rounds and streams run; submissions count once, also after failed and lost writes."""

import datetime as dt
import time

import pytest

from quillspark.operators import progress
from quillspark.operators import smart as S
from quillspark.streaming import listening, submissions
from tests.test_smart import CASES, client
from tests.test_standard import frame, source

NAMES = ["title", "number5", "text", "down", "halves", "invented", "twice"]


def blocks(spark):
    return frame(spark, [(name, f"{name}.s{i}", *source(i, t, doc=name)[2:]) for name in NAMES for i, t in enumerate(CASES[name][0])])


def slow(request):
    if request["stage"] == "BOUNDARY" and "twice" in request["source_blocks"][0]["source_id"]:
        time.sleep(4)
    return client(request)


def test_rounds_report_while_they_run(spark):
    rows = []
    out = S.recognize(blocks(spark), slow, "k", progress=progress.Tracker(rows.append, every=0.2))
    rounds = {}
    for row in rows:
        rounds.setdefault((row.stage, row.round), []).append(row)
    assert list(rounds) == [("BOUNDARY", 0), ("BOUNDARY", 1), ("STRUCTURE", 0)]
    for own in rounds.values():
        currents = [r.current for r in own]
        assert currents[0] == 0 and currents == sorted(currents) and currents[-1] == own[0].total
        assert [r.failed is None for r in own] == [True] * (len(own) - 1) + [False]
    assert [own[-1].total for own in rounds.values()] == [7, 2, 2] and [own[-1].failed for own in rounds.values()] == [2, 0, 0]
    assert rows[-1].requests == 11 == out["requests"].count()
    # The slow request holds the first round open: the others are told of before it ends.
    first = rounds["BOUNDARY", 0]
    assert any(0 < r.current < r.total and (first[-1].at - r.at).total_seconds() > 1 for r in first)
    assert progress.table(spark, rows).count() == len(rows)


def test_progress_changes_nothing(spark):
    tracker = progress.Tracker(lambda row: 1 / 0)
    rows = lambda out: sorted((r.doc_id, r.status, str(r.reason_code), *r.source_ids) for r in out["records"].collect())
    some = blocks(spark)
    assert rows(S.recognize(some, client, "k", progress=tracker)) == rows(S.recognize(some, client, "k"))
    assert isinstance(tracker.error, ZeroDivisionError)


def test_tasks_that_run_twice_count_once():
    largest = progress._Largest()
    value = largest.zero({})
    for update in ({0: 3}, {1: 2}, {0: 3}, {1: 1}):
        value = largest.addInPlace(value, update)
    assert value == {0: 3, 1: 2}


# Submissions ----------------------------------------------------------------------------------------------------------

AT = lambda m: dt.datetime(2024, 1, 1, 0, m)


def submit(session, question, name, right, minute):
    return (session, question, 7, name, "submit", right, AT(minute))


class Sink:
    def __init__(self):
        self.down, self.rows = False, []

    def __call__(self, batch):
        if self.down:
            raise OSError("down")
        self.rows += [(r.session_id, r.question_id, r.submission_id) for r in batch.collect()]


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, sink, **more):
        spark.createDataFrame(rows, submissions.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(submissions.EVENT).parquet(str(tmp_path / "in"))
        submissions.settled(stream, sink, str(tmp_path / "out"), str(tmp_path / "check"), **more).awaitTermination(60)
        return sorted(map(tuple, submissions.counted(spark, str(tmp_path / "out")).collect()))

    return go


def test_a_submission_counts_once_and_failures_unlock(run):
    sink = Sink()
    first = [submit("s", 1, "a", True, 1), submit("s", 1, "b", False, 2), submit("s", 2, "c", False, 1), submit("t", 1, "d", None, 1), (None, 1, 7, "x", "submit", True, AT(1))]
    assert run(first, sink) == [] and sorted(sink.rows) == [("s", 1, "a"), ("s", 2, "c")]
    sink.down = True  # a's and c's outcomes count now; the write of f fails
    assert run([submit("s", 1, "e", True, 3), submit("t", 1, "f", True, 3)], sink) == [("s", 2, 1)]
    sink.down = False  # f's failure frees its question before g arrives
    assert run([submit("t", 1, "g", False, 20)], sink) == [("s", 2, 1)]
    assert run([submit("t", 1, "h", True, 30), submit("s", 2, "i", True, 30)], sink) == [("s", 2, 1), ("t", 1, 0)]
    assert run([], sink) == [("s", 2, 1), ("t", 1, 0)] and sorted(sink.rows) == [("s", 1, "a"), ("s", 2, "c"), ("t", 1, "g")]


def test_a_lost_outcome_frees_its_lock_and_may_still_come(spark, tmp_path):
    def go(rows):
        spark.createDataFrame(rows, submissions.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = submissions.decided(spark.readStream.schema(submissions.EVENT).parquet(str(tmp_path / "in")), unlock_ms=1)
        got = []
        keep = lambda b, n: got.extend((r.question_id, r.submission_id, r.decision) for r in b.collect())
        submissions.started(spark, stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep)).awaitTermination(60)
        return got

    assert (1, "a", "locked") in go([submit("s", 1, "a", True, 1)])
    time.sleep(0.1)
    # The timer of a's lock fires with the next batch.
    assert (1, "a", "unlocked") in go([submit("s", 2, "other", True, 2)])
    assert (1, "b", "locked") in go([submit("s", 1, "b", False, 3)])
    got = go([("s", 1, 7, "a", "saved", True, AT(4)), ("s", 1, 7, "b", "saved", False, AT(5)), submit("s", 1, "c", True, 6)])
    assert [d for d in got if d[0] == 1] == [(1, "a", "counted"), (1, "b", "ignored"), (1, "c", "ignored")]


def test_streams_report_their_batches(spark, tmp_path):
    rows = []
    with listening.listened(spark, rows.append):
        spark.range(10).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).groupBy("id").count()
        stream.writeStream.queryName("numbers").format("memory").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        until = time.time() + 20
        while time.time() < until and not any(r.event == "ended" for r in rows):
            time.sleep(0.1)
    mine = [r for r in rows if r.query == "numbers"]
    assert mine[0].event == "started" and mine[-1].event == "ended" and mine[-1].error is None
    batch = next(r for r in mine if r.event == "batch" and r.rows)
    assert (batch.rows, batch.state_rows) == (10, 10) and listening.table(spark, rows).count() == len(rows)
