"""The store: imports, practice, deletion with what belongs to it, and rolled back failures."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillspark.operators import practice as P
from quillspark.operators import standard as S
from quillspark.operators import store as K
from quillspark.sources import model
from quillspark.streaming import practice as T
from tests.test_standard import frame, paragraphs


def report(found, name="r1"):
    return found["report"].select(F.lit(name).alias("report_id"), F.lit("f.docx").alias("file_name"), F.lit("standard").alias("import_mode"), "accepted", "rejected", F.lit(5).cast("long").alias("finished_at"))


def records(found, name="r1"):
    return found["records"].withColumn("report_id", F.lit(name))


def test_import_practise_and_delete(spark, tmp_path):
    s = K.Store(spark, str(tmp_path), clock=lambda: 100)
    found = {k: v.cache() for k, v in S.recognize(frame(spark, paragraphs("1. Q", "A. x", "B. y", "答案：A", "2. R", "答案：对", "3. broken"))).items()}
    found["records"] = records(found)
    bank = s.commit_import("b", found, report(found))
    assert [(r.id, r.question) for r in s.table("questions").orderBy("id").collect()] == [(1, "Q"), (2, "R")]
    assert sorted((r.status, tuple(r.question_ids)) for r in s.table("report_records").collect()) == [("ACCEPTED_QUESTION", (1,)), ("ACCEPTED_QUESTION", (2,)), ("REJECTED_QUESTION", ())]
    other = s.create_bank("  ", spark.createDataFrame([(0, "S", ["A"], "p.png")], "index int, question string, answer array<string>, image_uri string"))
    assert (bank, other, s.table("banks").where("id = 2").first().name) == (1, 2, K.NEW_BANK)
    tries = lambda *rows: spark.createDataFrame([(q, b, ["A"], ok, t) for q, b, ok, t in rows], "question_id long, bank_id long, selected array<string>, is_correct boolean, answered_at long")
    s.submit(tries((1, 1, False, 10), (1, 1, True, 11), (2, 1, True, 12)))
    s.submit(tries((1, 1, False, 20)))
    assert [(r.question_id, r.is_correct, r.correct_count, r.wrong_count) for r in s.table("attempts").orderBy("question_id").collect()] == [(1, False, 1, 2), (2, True, 1, 0)]
    assert s.table("banks").where("id = 1").first().last_practiced_at == 20
    s.save_progress(spark.createDataFrame([(1, "sequential", 1, 30), (1, "random", 1, 31), (2, "sequential", -3, 30)], "bank_id long, mode string, current_index int, updated_at long"))
    summary = P.bank_summaries(s.table("banks"), s.table("questions"), s.table("attempts"), s.table("progress")).collect()
    assert [(r.id, r.question_count, r.answered_count, r.accuracy_text, r.action_text) for r in summary] == [(2, 1, 0, "未开始", "顺序"), (1, 2, 2, "50%", "继续 2/2")]
    assert [r.id for r in P.wrong_book(s.table("questions"), s.table("attempts"), 1).collect()] == [1]
    assert s.delete_bank(2).collect() == [("p.png",)]
    s.delete_bank(1)
    assert all(s.table(t).count() == 0 for t in K.TABLES)


def test_a_report_replaces_its_preview(spark, tmp_path):
    s = K.Store(spark, str(tmp_path), clock=lambda: 1)
    found = S.recognize(frame(spark, paragraphs("1. Q", "答案：对")))
    for _ in range(2):
        s.save_report(report(found), records(found))
    assert (s.table("reports").count(), s.table("report_records").count()) == (1, 1)


def test_a_failed_import_leaves_nothing(spark, tmp_path):
    s = K.Store(spark, str(tmp_path), clock=lambda: 1)
    found = S.recognize(frame(spark, paragraphs("1. Q", "答案：对")))
    bad = {**found, "records": found["records"].withColumn("report_id", F.raise_error(F.lit("stop")).cast("string"))}
    with pytest.raises(Exception, match="stop"):
        s.commit_import("b", bad, report(found))
    assert s.table("banks").count() == 0 and s.table("questions").count() == 0


def test_commits_do_not_lose_each_other(spark, tmp_path):
    one, two = K.Store(spark, str(tmp_path), clock=lambda: 1), K.Store(spark, str(tmp_path), clock=lambda: 2)
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "index int, question string")
    one.create_bank("x", rows)
    stale = two.table("banks")
    one.create_bank("y")
    with pytest.raises(K.Conflict):
        two.commit({"banks": stale})
    two._seen.clear()
    assert two.create_bank("z") == 3 and one.table("banks").count() == 3
    ids = {tuple(r) for r in two.append_questions(3, rows).select("id", "index").collect()}
    assert ids == {(4, 0), (5, 1), (6, 2)} and [r.question for r in one.table("questions").orderBy("id").collect()] == ["a", "b", "c"] * 2
    (tmp_path / "manifest" / "000000000099.json").write_text("")  # a writer that was lost
    assert one.table("banks").count() == 3 and one.create_bank("w") == 4


def test_a_slower_older_operation_writes_nothing(spark, tmp_path):
    one, two = K.Store(spark, str(tmp_path), clock=lambda: 1), K.Store(spark, str(tmp_path), clock=lambda: 1)
    older = one.begin("import")
    with one.under(older):
        assert one.create_bank("while it was the newest") == 1
    newer = two.begin("import")
    folders = lambda: sorted(p.name for t in ("banks", "questions") for p in (tmp_path / t).glob("*"))
    before = folders()
    with pytest.raises(K.Stale), one.under(older):
        one.create_bank("late", spark.createDataFrame([(0, "Q")], "index int, question string"))
    assert folders() == before and (older[1], newer[1]) == (1, 2)
    with two.under(newer):
        assert two.create_bank("new") == 2
    # Operations of other names, and changes of no operation, are not held up.
    with one.under(one.begin("retry")):
        assert one.create_bank("other") == 3
    assert one.create_bank("free") == 4
    # An operation that begins between a read and its commit neither hides nor makes a conflict.
    stale = one.table("banks")
    two.begin("import")
    one.commit({"banks": stale.where("id < 4")})
    stale = one.table("banks")
    two.create_bank("between")
    one.begin("import")
    with pytest.raises(K.Conflict):
        one.commit({"banks": stale})


def test_stale_batches_of_a_stream_are_refused(spark, tmp_path):
    s = K.Store(spark, str(tmp_path / "store"), clock=lambda: 1)
    events = "question_id long, bank_id long, selected array<string>, is_correct boolean, answered_at long"
    spark.createDataFrame([(1, 1, ["A"], True, 5)], events).write.parquet(str(tmp_path / "in"))
    fence = s.begin("submit")
    s.begin("submit")

    def write(batch):
        with s.under(fence):
            s.submit(batch)

    query = T.into_store(spark.readStream.schema(events).parquet(str(tmp_path / "in")), write, str(tmp_path / "check"))
    with pytest.raises(StreamingQueryException, match="Stale"):
        query.awaitTermination(60)
    assert s.table("attempts").count() == 0


def test_seed_only_once_and_clear(spark, tmp_path):
    s, rows = K.Store(spark, str(tmp_path), clock=lambda: 1), spark.createDataFrame([(0, "Q")], "index int, question string")
    s.seed(rows)
    s.seed(rows)
    assert s.table("banks").count() == 1
    s.clear()
    assert s.table("banks").count() == 0


def test_stored_lists(spark):
    rows = spark.createDataFrame([('[{"key":"A","imageUri":"o.png"},null]', '["b","a",null]', "[]", "s.png"), ("bad", "bad", "bad", None)], "options_json string, answer_json string, image_uris_json string, image_uri string")
    got = K.question_rows(rows).collect()
    assert (got[0].options[0].image_uris, got[0].answer, got[0].image_uris) == (["o.png"], ["A", "B"], ["s.png"]) and (got[1].options, got[1].answer, got[1].image_uris) == ([], [], [])
    assert [r[0] for r in spark.createDataFrame([("/tmp/in/a.png",), ("/other/a.png",)], "p string").select(K.relocated(F.col("p"), "/tmp/in", "/new")).collect()] == ["/new/a.png", "/other/a.png"]
    assert K.contained("/a/b/c", "/a/b") and not K.contained("/a/b/../c", "/a/b") and not K.contained("/a/bc", "/a/b")


def test_retries():
    waits, calls = [], []

    def fails(status, times):
        def call(request):
            calls.append(request)
            if len(calls) <= times:
                raise model.HttpError(status)
            return "ok"

        calls.clear(), waits.clear()
        return model.with_retries(call, wait=waits.append)

    assert fails(503, 2)({}) == "ok" and waits == [1.0, 2.0]
    for status, times, tried in ((500, 9, 3), (401, 9, 1)):
        with pytest.raises(model.HttpError):
            fails(status, times)({})
        assert len(calls) == tried


def test_requests_as_rows(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, request string")
    done = model.completed(model.uncached(rows, spark.createDataFrame([("a", "x")], "key string, content string")), lambda r: str(1 // (int(r) - 2)))
    assert [(r.key, r.content, "division" in r.error) for r in done.collect()] == [("b", None, True)]


def test_older_questions_keep_their_rows(spark):
    old = spark.createDataFrame([("[]", '["A"]')], "options_json string, answer_json string")
    for version in (1, 2):
        row = K.question_rows(K.migrated_questions(old if version == 1 else old.withColumn("image_uri", F.lit("p")), version)).first()
        assert row.answer == ["A"] and row.image_uris == ([] if version == 1 else ["p"])
