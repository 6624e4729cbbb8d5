"""Practice as streams: summaries that follow the attempts, attempts kept by question, submissions that count once.

events: a streaming DataFrame (session_id, question_id, bank_id, is_correct, answered_at timestamp, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quillspark.functions import kinds

STATE = "bank_id long, is_correct boolean, answered_at timestamp, correct_count int, wrong_count int"
ATTEMPT = f"question_id long, {STATE}, was_new boolean, was_correct boolean"


class LatestAttempt(StatefulProcessor):
    """By question: the last attempt and how often it was right and wrong."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.last.get() if self.last.exists() else None
        frame = pd.concat(list(rows)).sort_values("answered_at", kind="stable")
        newest, right = frame.iloc[-1], int(frame["is_correct"].sum())
        bank, correct, at = int(newest["bank_id"]), bool(newest["is_correct"]), newest["answered_at"]
        if old is not None and pd.Timestamp(old[2]) > at:  # a late batch counts but does not become the last attempt
            bank, correct, at = old[0], old[1], pd.Timestamp(old[2])
        now = (bank, correct, at.to_pydatetime(), right + (old[3] if old else 0), len(frame) - right + (old[4] if old else 0))
        self.last.update(now)
        yield pd.DataFrame([(key[0], *now, old is None, old[1] if old else None)], columns=[c.split()[0] for c in ATTEMPT.split(", ")])

    def close(self) -> None:
        pass


def latest_attempts(events: DataFrame) -> DataFrame:
    """The changed attempts of every batch; needs the RocksDB state store."""
    return events.select("question_id", "bank_id", "is_correct", "answered_at").groupBy("question_id").transformWithStateInPandas(LatestAttempt(), ATTEMPT, "Update", "None")


def bank_counts(events: DataFrame) -> DataFrame:
    """Attempts by bank, kept up to date (output mode complete or update)."""
    out = events.groupBy("bank_id").agg(F.count("*").alias("answered"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("wrong"), F.max("answered_at").alias("last_practiced_at"))
    return out.withColumn("accuracy_text", kinds.accuracy_text(F.col("correct"), F.col("answered")))


def submitted_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each question of a session once; repeats within the lateness are dropped, state beyond it is freed."""
    return events.withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["session_id", "question_id"])


def progress(events: DataFrame) -> DataFrame:
    """The last saved place of each bank and sequential mode of a stream (bank_id, mode, current_index, updated_at)."""
    kept = events.where(~F.col("mode").isin("random", "wrong"))
    return kept.groupBy("bank_id", "mode").agg(F.greatest(F.max_by("current_index", "updated_at"), F.lit(0)).alias("current_index"), F.max("updated_at").alias("updated_at"))


def into_store(events: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, seen: Callable[[], int] | None = None, remember: Callable[[int], None] | None = None) -> StreamingQuery:
    """Batches written by `write`; a batch that the sink already holds (by number) is skipped after a restart."""

    def each(batch: DataFrame, number: int) -> None:
        if seen is None or number > seen():
            write(batch)
            if remember:
                remember(number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deltas(lines: DataFrame) -> DataFrame:
    """Text pieces of a server-sent event stream read as lines (value)."""
    from quillspark.functions.recovery import stream_delta

    return lines.select(stream_delta(F.col("value")).alias("delta")).where("delta IS NOT NULL")
