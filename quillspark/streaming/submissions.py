"""Answers that count exactly once: a ledger of submissions as state, with a lock, an unlock after failure and a timer.

A question of a session is free, locked or counted. Submitting locks a free question and asks for a write; nothing else
can be submitted there until the write's outcome arrives. `saved` counts the answer for good; `failed` frees the question
and counts nothing; a lock whose outcome never comes is freed by a processing-time timer. A late `saved` of a freed
lock still counts, once, because the answer was written.

`settled` closes the circle: it writes what was locked and hands the outcomes back to the stream as rows of a folder.
State grows with the (session, question) pairs; `keep` frees it after so long, later repeats then count again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from .live import STORE

#: kind: submit (is_correct: null where nothing was selected), saved or failed (the outcome of a submission's write).
EVENT = "session_id string, question_id long, bank_id long, submission_id string, kind string, is_correct boolean, at timestamp"
#: decision: locked (to be written), ignored, counted, unlocked.
DECISION = "session_id string, question_id long, bank_id long, submission_id string, decision string, is_correct boolean, at timestamp"
_NAMES = [c.split()[0] for c in DECISION.split(", ")]
_EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
_ORDER = {"submit": 0, "failed": 1, "saved": 2}


class SubmissionLedger(StatefulProcessor):
    """By session and question: its phase and whose lock it is."""

    def __init__(self, unlock_ms: int, keep_ms: int | None):
        self.unlock_ms, self.keep_ms = unlock_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "phase string, submission_id string, bank_id long, at timestamp, until long", self.keep_ms)

    def _freed(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        phase, holder, *rest = self.own.get() if self.own.exists() else ("free", None, None, None, None)
        frame = pd.concat(list(rows))
        frame = frame.assign(_o=frame["kind"].map(_ORDER)).sort_values(["at", "_o", "submission_id"], kind="stable")
        out = []
        for row in frame.itertuples(index=False):
            right = None if pd.isna(row.is_correct) else bool(row.is_correct)
            bank = None if pd.isna(row.bank_id) else int(row.bank_id)
            decision = "ignored"
            if row.kind == "submit" and phase == "free" and right is not None:
                until = timerValues.getCurrentProcessingTimeInMs() + self.unlock_ms
                phase, holder, rest, decision = "locked", row.submission_id, [bank, row.at.to_pydatetime(), until], "locked"
                self.handle.registerTimer(until)
            elif row.kind == "saved" and phase != "counted":
                phase, holder, decision = "counted", row.submission_id, "counted"
                self._freed()
            elif row.kind == "failed" and phase == "locked" and holder == row.submission_id:
                phase, holder, decision = "free", None, "unlocked"
                self._freed()
            out.append((*key, bank, row.submission_id, decision, right, row.at))
        self.own.update((phase, holder, *rest))
        yield pd.DataFrame(out, columns=_NAMES).astype({"bank_id": "Int64", "is_correct": "boolean"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.own.exists():
            phase, holder, bank, at, until = self.own.get()
            if phase == "locked" and until == expiredTimerInfo.getExpiryTimeInMs():
                self.own.update(("free", None, None, None, None))
                yield pd.DataFrame([(*key, bank, holder, "unlocked", None, at)], columns=_NAMES).astype({"bank_id": "Int64", "is_correct": "boolean"})

    def close(self) -> None:
        pass


def decided(events: DataFrame, unlock_ms: int = 60_000, keep_ms: int | None = None) -> DataFrame:
    """What the ledger says of each EVENT of a stream, and of each lock that a timer freed (append mode).

    Rows without session, question, submission or time, and of other kinds, are left out. Needs the RocksDB store.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = F.col("kind").isin(*_ORDER)
    for name in ("session_id", "question_id", "submission_id", "at"):
        known = known & F.col(name).isNotNull()
    rows = events.select(*[c.split()[0] for c in EVENT.split(", ")]).where(known)
    return rows.groupBy("session_id", "question_id").transformWithStateInPandas(SubmissionLedger(unlock_ms, keep_ms), DECISION, "Append", "ProcessingTime")


def started(spark: SparkSession, writer: DataStreamWriter, every: str | None = None) -> StreamingQuery:
    """The query of a writer of decisions. Without `every` (such as "5 seconds") it ends when all has been read.

    Processing-time timers ask for batches without rows for ever, so a query that is to end runs none: its timers fire
    with the next rows. With `every` they fire by themselves.
    """
    if every:
        return writer.trigger(processingTime=every).start()
    before = spark.conf.get(_EMPTY)
    spark.conf.set(_EMPTY, "false")  # a query takes the settings at its start
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_EMPTY, before)


def _rows(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The finished outcomes of a batch, if they are there."""
    try:
        return spark.read.schema(EVENT).parquet(f"{path}/batch={batch}")
    except (AnalysisException, Py4JJavaError):
        return None


def settled(submissions: DataFrame, write: Callable[[DataFrame], None], path: str, checkpoint: str, unlock_ms: int = 60_000, keep_ms: int | None = None, every: str | None = None) -> StreamingQuery:
    """Writes each locked answer of a stream of submissions through `write` and keeps all decisions under path/decisions.

    A write that raises unlocks its answers. Outcomes go to path/outcomes, a source of the same query, so the next batch
    (of this run or the next) counts or unlocks. A batch whose outcomes stand is not written again after a restart;
    `write` is repeated only where a run died between the write and its outcomes, so let it upsert by submission_id.
    """
    spark = submissions.sparkSession
    outcomes = f"{path}/outcomes"
    spark.createDataFrame([], EVENT).withColumn("batch", F.lit(-1)).write.mode("ignore").parquet(outcomes)
    back = spark.readStream.schema(f"{EVENT}, batch int").parquet(outcomes).drop("batch")
    events = submissions.select(*back.columns).unionByName(back)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
        locked = spark.read.schema(DECISION).parquet(f"{path}/decisions/batch={number}").where("decision = 'locked'")
        if locked.isEmpty() or _rows(spark, outcomes, number) is not None:
            return
        try:
            write(locked.drop("decision"))
            kind = "saved"
        except Exception:  # any failure of the write frees its questions
            kind = "failed"
        locked.withColumn("kind", F.lit(kind)).select(*back.columns).write.mode("overwrite").parquet(f"{outcomes}/batch={number}")

    out = decided(events, unlock_ms, keep_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return started(spark, out.queryName("submissions").foreachBatch(each), every)


def counted(spark: SparkSession, path: str) -> DataFrame:
    """Answered and right questions by session: what was counted under a path."""
    rows = spark.read.schema(f"{DECISION}, batch int").parquet(f"{path}/decisions").where("decision = 'counted'")
    return rows.groupBy("session_id").agg(F.count("*").alias("answered"), F.count_if("is_correct").alias("correct"))
