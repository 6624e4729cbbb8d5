"""Progress of rounds of requests: rows that arrive while a round still runs.

Tasks report how many of their requests are answered through one accumulator a round. It keeps the largest number of each
partition, so a task that runs twice counts once, and it grows with the tasks of a round, never with its requests. The
driver looks at it every few seconds and hands a row to `report` whenever it has changed; counts that need all replies
(bought, failed) are observed while these are written.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stage string, round int, current long, total long, requests long, failed long, at timestamp"
#: Requests of a task at most, and tasks of a round that has as many requests.
TOGETHER, TASKS = 64, 16


class Row(NamedTuple):
    """current of total requests of a round are answered; requests: all that were sent since the start; failed: null
    until the round has ended."""

    stage: str
    round: int
    current: int
    total: int
    requests: int
    failed: int | None
    at: dt.datetime


class _Largest(AccumulatorParam):
    """The largest number by partition."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, one: dict, other: dict) -> dict:  # noqa: N802
        for part, n in other.items():
            one[part] = max(n, one.get(part, 0))
        return one


def _counting(client: Callable, answered: Any) -> Callable:
    done = [0]  # a task has its own copy

    def counted(request: Any) -> Any:
        try:
            return client(request)
        finally:
            done[0] += 1
            answered.add({TaskContext.get().partitionId(): done[0]})

    return counted


class Round:
    """One round of requests. Without a tracker it changes nothing."""

    def __init__(self, tracker: Tracker | None, stage: str, number: int):
        self.tracker, self.stage, self.number, self.total, self.answered = tracker, stage, number, None, None
        self.seen = Observation()

    def dealt(self, new: DataFrame) -> DataFrame:
        """The requests that will be sent: counted, and dealt to tasks of at most about TOGETHER."""
        if self.tracker is None:
            return new
        self.total = new.count()
        self.answered = new.sparkSession.sparkContext.accumulator({}, _Largest())
        self.tracker.tell(self, 0)
        return new.repartition(max(1, min(self.total, TASKS), -(-self.total // TOGETHER)), "key")

    def client(self, client: Callable) -> Callable:
        return client if self.tracker is None else _counting(client, self.answered)

    def observed(self, replies: DataFrame) -> DataFrame:
        """replies(state, bought), whose failures are counted while they are written."""
        return replies if self.tracker is None else replies.observe(self.seen, F.count_if(F.col("state") != "ok").alias("failed"))

    def current(self) -> int:
        return sum(self.answered.value.values())


class Tracker:
    """Hands progress rows to report, from the thread that asks and from one that watches.

    An error of report ends neither a round nor the watching; the first one is kept in `error`.
    """

    def __init__(self, report: Callable[[Row], None], every: float = 1.0):
        self.report, self.every, self.requests, self.error, self._lock = report, every, 0, None, threading.Lock()

    def tell(self, of: Round, current: int, failed: int | None = None) -> None:
        with self._lock:
            try:
                self.report(Row(of.stage, of.number, current, of.total, self.requests + current, failed, dt.datetime.now()))
            except Exception as why:  # a listener must not stop what it listens to
                self.error = self.error or why


@contextmanager
def following(tracker: Tracker | None, stage: str, number: int = 0) -> Iterator[Round]:
    """A round; what is written inside is reported while it is."""
    made, ended = Round(tracker, stage, number), threading.Event()
    if tracker is None:
        yield made
        return

    def watch() -> None:
        last = 0
        while not ended.wait(tracker.every):
            if made.answered is not None and (now := made.current()) > last:
                last = now
                tracker.tell(made, now)

    watcher = threading.Thread(target=watch, name=f"progress of {stage}", daemon=True)
    watcher.start()
    try:
        yield made
    finally:
        ended.set()
        watcher.join()
    if made.total is not None:
        # Answers of a task that was lost after it had written are in the table all the same.
        tracker.tell(made, made.total, int(made.seen.get["failed"]))
        tracker.requests += made.total


def table(spark: SparkSession, rows: list[Row]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)
