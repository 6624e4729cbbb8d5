"""Bank summaries that follow every change: the rows of `practice.bank_summaries`, kept up to date by a stream.

Changes are rows of one stream (CHANGE): attempts, questions, banks and saved places, each with its time, questions and
banks also with ``removed``. Two stateful operators follow one another:

1. By question: what it adds to its bank now (asked, answered, right) against what it added before. Only the difference
   goes on, so a later answer takes the earlier one back, also from another bank, and a removed question takes its
   attempt with it.
2. By bank: the sums of the differences beside the bank's name, times and place. A changed bank gives one whole row.

State grows with questions and banks, not with attempts; a hot bank sends one signed row a changed question of a batch.
Nothing depends on event time, so no attempt is too late. Within a question the later time wins, then the later row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quillspark.functions import kinds

#: kind: attempt (question_id, bank_id, is_correct), question (question_id, bank_id), bank (bank_id, name, and in at when
#: it was practised last or else changed), progress (bank_id, mode, current_index). at: epoch milliseconds.
CHANGE = "kind string, bank_id long, question_id long, is_correct boolean, at long, name string, mode string, current_index int, practiced boolean, removed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SIGNED = "bank_id long, asked long, answered long, correct long, at long, kind string, name string, mode string, current_index int, practiced boolean, removed boolean"
_SUMMARY = "id long, name string, question_count int, answered_count int, correct_count int, wrong_count int, last_practiced_at long, updated_at long, sequential_index int, removed boolean"


def _null(value: Any) -> bool:
    return value is None or bool(pd.isna(value))


def _value(value: Any, make: Callable) -> Any:
    return None if _null(value) else make(value)


class QuestionTally(StatefulProcessor):
    """By question: the bank that asks it, and its last attempt; gives what changed in the sums of banks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "asked_by long, tried_by long, is_correct boolean, at long")

    @staticmethod
    def _adds(asked_by: Any, tried_by: Any, right: Any) -> dict[int, tuple[int, int, int]]:
        out: dict[int, tuple[int, int, int]] = {}
        for bank, add in ((asked_by, (1, 0, 0)), (tried_by, (0, 1, int(bool(right))))):
            if bank is not None:
                out[bank] = tuple(a + b for a, b in zip(out.get(bank, (0, 0, 0)), add, strict=True))
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.now.get() if self.now.exists() else (None, None, None, None)
        asked_by, tried_by, right, tried_at = old
        practiced: dict[int, int] = {}
        for row in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            at, bank = int(row.at), _value(row.bank_id, int)
            if row.kind == "question":
                asked_by = None if row.removed is True else bank
                if row.removed is True:
                    tried_by = right = tried_at = None
            else:
                practiced[bank] = max(at, practiced.get(bank, at))
                if tried_at is None or at >= tried_at:
                    tried_by, right, tried_at = bank, bool(row.is_correct), at
        self.now.update((asked_by, tried_by, right, tried_at))
        before, after = self._adds(*old[:3]), self._adds(asked_by, tried_by, right)
        out = []
        for bank in sorted({*before, *after, *practiced}):
            signs = [b - a for a, b in zip(before.get(bank, (0, 0, 0)), after.get(bank, (0, 0, 0)), strict=True)]
            out.append((bank, *signs, practiced.get(bank)))
        yield pd.DataFrame(out, columns=["bank_id", "asked", "answered", "correct", "at"]).astype({"at": "Int64"})

    def close(self) -> None:
        pass


class BankTally(StatefulProcessor):
    """By bank: the sums, the name and the place; gives the whole summary of a known bank that changed."""

    def __init__(self, mode: str):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "asked long, answered long, correct long, practiced long, place int, place_at long")
        self.bank = handle.getValueState("bank", "name string, updated long, removed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked, answered, correct, practiced, place, place_at = self.sums.get() if self.sums.exists() else (0, 0, 0, None, None, None)
        name, updated, removed = self.bank.get() if self.bank.exists() else (None, None, None)
        frame = pd.concat(list(rows))
        later = lambda a, b: b if a is None else a if b is None else max(a, b)
        signed = frame[frame["kind"] == "signed"]
        asked, answered, correct = (int(a + signed[c].sum()) for a, c in ((asked, "asked"), (answered, "answered"), (correct, "correct")))
        if signed["at"].notna().any():
            practiced = later(practiced, int(signed["at"].max()))
            updated = later(updated, int(signed["at"].max()))
        for row in frame[frame["kind"] != "signed"].sort_values("at", kind="stable").itertuples(index=False):
            at = int(row.at)
            if row.kind == "progress":
                if row.mode == self.mode and (place_at is None or at >= place_at):
                    place, place_at = (None if row.removed is True else int(row.current_index)), at
            elif row.removed is True:
                removed, practiced, place, place_at = True, None, None, None
            else:
                name, removed = _value(row.name, str), False
                updated = later(updated, at)
                if row.practiced is True:
                    practiced = later(practiced, at)
        self.sums.update((asked, answered, correct, practiced, place, place_at))
        if removed is not None or updated is not None:
            self.bank.update((name, updated, removed))
        if removed is not None:
            out = pd.DataFrame([(key[0], name, asked, answered, correct, answered - correct, practiced, updated, place, removed)], columns=[c.split()[0] for c in _SUMMARY.split(", ")])
            yield out.astype({"last_practiced_at": "Int64", "updated_at": "Int64", "sequential_index": "Int32"})

    def close(self) -> None:
        pass


def summaries(changes: DataFrame, mode: str = "sequential") -> DataFrame:
    """Of a stream of CHANGE rows: the summary of each bank that a batch changed (append mode; needs the RocksDB store)."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    of_questions = changes.where(F.col("kind").isin("attempt", "question") & F.col("question_id").isNotNull() & F.col("bank_id").isNotNull())
    signed = of_questions.groupBy("question_id").transformWithStateInPandas(QuestionTally(), "bank_id long, asked long, answered long, correct long, at long", "Append", "None")
    others = changes.where(F.col("kind").isin("bank", "progress") & F.col("bank_id").isNotNull())
    nothing = lambda names: [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in _SIGNED.split(", ")) if n in names]
    signed = signed.select("*", F.lit("signed").alias("kind"), *nothing(("name", "mode", "current_index", "practiced", "removed")))
    others = others.select("bank_id", *nothing(("asked", "answered", "correct")), "at", "kind", "name", "mode", "current_index", "practiced", "removed")
    both = signed.select(others.columns).unionByName(others)
    return both.groupBy("bank_id").transformWithStateInPandas(BankTally(mode), _SUMMARY, "Append", "None")


def into_table(changes: DataFrame, path: str, checkpoint: str, mode: str = "sequential", every: str | None = None) -> StreamingQuery:
    """Keeps the summaries of a stream of changes under a path; a repeated batch writes its folder again.

    Without `every` (a processing time such as "5 seconds") it ends when all that is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = summaries(changes, mode).writeStream.outputMode("append").option("checkpointLocation", checkpoint).queryName("bank summaries").foreachBatch(write)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def shown(last: DataFrame) -> DataFrame:
    """Summaries as `practice.bank_summaries` shows them: texts added, the bank practised last first."""
    texts: dict[str, Column] = {"accuracy_text": kinds.accuracy_text(F.col("correct_count"), F.col("answered_count")), "action_text": kinds.action_text(F.col("sequential_index"), F.col("question_count"))}
    rows = last.where(~F.col("removed")).withColumns(texts).orderBy(F.coalesce("last_practiced_at", "updated_at").desc(), "id")
    return rows.select("id", "name", "question_count", "answered_count", "correct_count", "wrong_count", "last_practiced_at", "sequential_index", "accuracy_text", "action_text")


def current(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The summaries under a path after the last batch (or after the batch `until`)."""
    rows = spark.read.schema(f"{_SUMMARY}, batch int").parquet(path)
    rows = rows if until is None else rows.where(F.col("batch") <= until)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "batch").alias("r")).select("id", "r.*")
    return shown(last)
