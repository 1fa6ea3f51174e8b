"""Calls to model endpoints: requests, retries with back-off, and where endpoint and model come from.

No call is made here. A caller passes the function that sends one request, and runs it inside a partition; the decisions
are also a DataFrame expression, for logs of calls.
"""

from __future__ import annotations

import base64
import json
import os
import random
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in milliseconds.
FIRST_BACKOFF, MOST_BACKOFF, MOST_RETRY_AFTER, MOST_OVERALL = 50, 5_000, 30_000, 600_000
MOST_DOUBLINGS = 20
DEGENERATE_ATTEMPTS, TEMPERATURE_STEP = 3, 0.2
ENDPOINT_VARIABLE, MODEL_VARIABLE = "PAGELATHE_ENDPOINT", "PAGELATHE_MODEL"


@dataclass(frozen=True)
class Reply:
    """What came back: a status, or None where nothing did, the body, and the Retry-After header."""

    status: int | None
    body: str = ""
    retry_after: str | None = None


class CallFailed(Exception):
    def __init__(self, message: str, attempts: int, status: int | None = None) -> None:
        super().__init__(message)
        self.attempts, self.status = attempts, status


def most_backoff(attempt: int) -> int:
    """The longest wait before the try after attempt, counted from 1."""
    return min(FIRST_BACKOFF << min(max(attempt - 1, 0), MOST_DOUBLINGS), MOST_BACKOFF)


def retry_after(header: str | None) -> int | None:
    """Whole seconds of the header, no longer than MOST_RETRY_AFTER; dates are not read."""
    text = (header or "").strip()
    return min(int(text) * 1000, MOST_RETRY_AFTER) if text.isascii() and text.isdigit() else None


def call(
    send: Callable[[], Reply], max_retries: int = 2, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[int], int] = lambda most: random.randint(0, most), clock: Callable[[], float] = time.monotonic
) -> dict | list:
    """The JSON that send() gets, tried again after server errors, 429, lost connections and answers that are no JSON.

    The wait is drawn from 0 to most_backoff(), or is what the server asks for; all tries together end after MOST_OVERALL.
    """
    began, attempt = clock(), 0
    while True:
        attempt += 1
        try:
            reply = send()
        except OSError as e:
            reply = Reply(None, str(e))
        asked = None
        if reply.status is not None and 200 <= reply.status < 300:
            try:
                return json.loads(reply.body)
            except ValueError:
                problem = "the answer is no JSON"
        elif reply.status is None or reply.status >= 500 or reply.status == 429:
            problem, asked = f"status {reply.status}: {reply.body}", None if reply.status is None else retry_after(reply.retry_after)
        else:
            raise CallFailed(f"status {reply.status}: {reply.body}", attempt, reply.status)
        wait = (asked if asked is not None else jitter(most_backoff(attempt))) / 1000
        if attempt > max_retries or (clock() - began + wait) * 1000 > MOST_OVERALL:
            raise CallFailed(problem, attempt, reply.status)
        sleep(wait)


def steady(attempt: Callable[[float], str], degenerate: Callable[[str], bool], temperature: float = 0.0, most: int = DEGENERATE_ATTEMPTS, step: float = TEMPERATURE_STEP) -> str:
    """The first text of attempt(temperature) that does not run in circles, each try warmer; after most tries the last."""
    text = ""
    for k in range(max(1, most)):
        text = attempt(temperature + k * step)
        if not degenerate(text):
            break
    return text


def with_decision(calls: DataFrame) -> DataFrame:
    """calls (status, valid, attempt, max_retries, retry_after in seconds) with action, done, retry or failed, and most_delay_ms."""
    status, good = F.col("status"), F.col("status").between(200, 299)
    again = status.isNull() | (status >= 500) | (status == 429) | good
    action = F.when(good & F.col("valid"), "done").when(again & (F.col("attempt") <= F.col("max_retries")), "retry").otherwise("failed")
    asked = F.when(F.col("retry_after").isNotNull() & ((status >= 500) | (status == 429)), F.least(F.col("retry_after") * 1000, F.lit(MOST_RETRY_AFTER)))
    return calls.withColumn("action", action).withColumn("most_delay_ms", F.when(F.col("action") == "retry", F.coalesce(asked.cast("long"), most_backoff_of(F.col("attempt")))))


def most_backoff_of(attempt: Column) -> Column:
    return F.least(F.lit(FIRST_BACKOFF) * F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(MOST_DOUBLINGS))), F.lit(MOST_BACKOFF)).cast("long")


def image_url(png: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(png).decode()


def chat_request(model: str, prompt: str, png: bytes | None = None, **sampling: object) -> dict:
    """The body of a chat-completion request; sampling is taken as it is."""
    parts: list[dict] = [{"type": "image_url", "image_url": {"url": image_url(png)}}] if png is not None else []
    return {"model": model, "messages": [{"role": "user", "content": [*parts, {"type": "text", "text": prompt}]}], **sampling}


def config_value(text: str, section: str, key: str) -> str | None:
    """The value of a key in a [section] of a plain configuration text; # and ; begin comments, quotes around a value go."""
    current = ""
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        if line[0] == "[" and line[-1] == "]":
            current = line[1:-1].strip()
            continue
        name, equals, value = line.partition("=")
        if equals and current == section and name.strip() == key:
            value = value.strip()
            return value[1:-1] if len(value) >= 2 and value[0] in "\"'" and value[0] == value[-1] else value
    return None


def resolved(protocol: str, endpoint: str | None, model: str | None, config: str = "", environ: Mapping[str, str] = os.environ) -> tuple[str | None, str | None]:
    """(endpoint, model): as given, else by environment variable, else by the protocol's section of a configuration."""
    own = lambda given, variable, key: given or environ.get(variable, "").strip() or config_value(config, protocol, key)
    return own(endpoint, ENDPOINT_VARIABLE, "endpoint"), own(model, MODEL_VARIABLE, "model")


@dataclass(frozen=True)
class Stage:
    """Where one stage of a protocol of several goes; remote or local."""

    endpoint: str | None = None
    backend: str = "remote"
    timeout: float = 60.0


def overridden(stages: Mapping[str, Stage], changes: Mapping[str, Mapping[str, object]]) -> dict[str, Stage]:
    """stages with the fields that changes names; a stage that is not there is an error."""
    unknown = set(changes) - set(stages)
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    return {name: replace(s, **changes.get(name, {})) for name, s in stages.items()}
