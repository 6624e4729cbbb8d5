"""Progress of streams as rows: what each batch read, how long it took and what state it keeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, event string, batch long, rows long, millis long, state_rows long, error string"


class Row(NamedTuple):
    """event: started, batch or ended; batch, rows, millis and state_rows of batches only; error of an ended query."""

    query: str
    event: str
    batch: int | None = None
    rows: int | None = None
    millis: int | None = None
    state_rows: int | None = None
    error: str | None = None


class Listener(StreamingQueryListener):
    def __init__(self, report: Callable[[Row], None]):
        self.report, self.names = report, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[event.runId] = event.name or str(event.id)
        self.report(Row(self.names[event.runId], "started"))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        of = event.progress
        kept = sum(s.numRowsTotal for s in of.stateOperators)
        self.report(Row(of.name or str(of.id), "batch", of.batchId, of.numInputRows, of.durationMs.get("triggerExecution"), kept))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.report(Row(self.names.pop(event.runId, str(event.id)), "ended", error=event.exception))


@contextmanager
def listened(spark: SparkSession, report: Callable[[Row], None]) -> Iterator[Listener]:
    """While inside, report hears of all streams of the session. Rows come a moment after what they tell of."""
    listener = Listener(report)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def table(spark: SparkSession, rows: list[Row]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)
