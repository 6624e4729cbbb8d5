"""Clients of a chat model: what the recognisers call, with retries, a scripted stand-in and a wrapper for tables.

No client here opens a connection by itself: `with_retries` takes the function that does.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ATTEMPTS, FIRST_WAIT = 3, 1.0
MOST_TOKENS = {"document": 8_192, "labels": 4_096, "repair": 2_048, "stream": 65_536}
RETRIED = {429, *range(500, 600)}


class HttpError(Exception):
    def __init__(self, status: int, body: str = ""):
        super().__init__(f"HTTP {status}: {body}".rstrip(": "))
        self.status = status


def with_retries(call: Callable[[dict], str], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Callable[[dict], str]:
    """call, tried again after 1, 2, ... seconds on overload, server errors and broken connections only."""

    def tried(request: dict) -> str:
        for n in range(attempts):
            try:
                return call(request)
            except (HttpError, OSError) as why:
                if n + 1 == attempts or (isinstance(why, HttpError) and why.status not in RETRIED):
                    raise
                wait(FIRST_WAIT * 2**n)
        raise AssertionError("no attempts")

    return tried


def scripted(replies: dict[str, str]) -> Callable[[dict], tuple[str, str | None]]:
    """A stand-in that answers by chunk id, for tests and for replies that were bought before."""

    def client(request: dict) -> tuple[str, str | None]:
        if request["chunk_id"] not in replies:
            raise OSError(f"no reply for {request['chunk_id']}")
        return replies[request["chunk_id"]], "stop"

    return client


def completed(requests: DataFrame, client: Callable[[str], str | tuple[str, str | None]]) -> DataFrame:
    """requests(key, request) with content and finish, or error; write the result before using it, calls may cost money.

    A client returns the content, or the content and why it ended there.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, request in zip(frame["key"], frame["request"], strict=True):
                try:
                    said = client(request)
                    rows.append((key, *(said if isinstance(said, tuple) else (said, None)), None))
                except Exception as why:  # a failed call is a row, not a failed job
                    rows.append((key, None, None, str(why) or type(why).__name__))
            yield pd.DataFrame(rows, columns=["key", "content", "finish", "error"])

    return requests.select("key", "request").mapInPandas(ask, "key string, content string, finish string, error string")


def envelope_client(post: Callable[[str], str]) -> Callable[[str], tuple[str, str | None]]:
    """A client of a chat service: post sends a request's JSON and returns the body of the response.

    Wrap post in `with_retries` first. The content and finish reason of the first choice come back.
    """

    def client(request: str) -> tuple[str, str | None]:
        first = (json.loads(post(request)).get("choices") or [{}])[0]
        return (first.get("message") or {}).get("content") or "", first.get("finish_reason")

    return client


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that the cache(key, content) of successful replies does not hold."""
    return requests.join(cache, "key", "left_anti")

