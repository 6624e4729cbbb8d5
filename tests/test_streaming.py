"""Streams give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import practice as P
from quillspark.streaming import practice as T

SCHEMA = "session_id string, question_id long, bank_id long, is_correct boolean, answered_at timestamp"


def rows(spark, path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[("s", 1, 0, True, at(1)), ("s", 1, 0, False, at(2)), ("s", 2, 1, True, at(3))], [("s", 1, 0, True, at(5)), ("t", 2, 1, False, at(1))]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in")), spark.read.schema(SCHEMA).parquet(str(path / "in"))


def finish(stream, name, mode, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_latest_attempts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream, batch = rows(spark, tmp_path)
    out = finish(T.latest_attempts(stream), "attempts", "update", tmp_path)
    last = out.groupBy("question_id").agg(F.max_by(F.struct("is_correct", "answered_at", "correct_count", "wrong_count"), F.col("correct_count") + F.col("wrong_count")).alias("x")).select("question_id", "x.*")
    want = P.latest_attempts(batch).select(*last.columns)
    assert sorted(last.collect()) == sorted(want.collect())


def test_bank_counts_and_single_submissions(spark, tmp_path):
    stream, _ = rows(spark, tmp_path)
    assert sorted((r.bank_id, r.answered, r.accuracy_text) for r in finish(T.bank_counts(stream), "banks", "complete", tmp_path).collect()) == [(0, 3, "66%"), (1, 2, "50%")]
    assert finish(T.submitted_once(stream), "once", "append", tmp_path).count() == 3


def test_batches_are_written_once(spark, tmp_path):
    stream, _ = rows(spark, tmp_path)
    done = []
    for _ in range(2):
        T.into_store(stream, lambda b: done.append(b.count()), str(tmp_path / "c"), lambda: 0, lambda n: None).awaitTermination(120)
    assert len(done) == 1  # batch 0 was in the sink before
