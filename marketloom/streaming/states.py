"""Stateful flows whose state is bounded per key: capped histories with gap sampling, breakers, quotas.

Each is a function on a stream with event time; state lives in Spark's state
store, so a lost executor's keys are recovered from the checkpoint.  Rows of a
batch are put in event-time order per key before they are applied.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Rows that are read and given at a time.
STEP = 10_000


def _ordered(frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows of a key in order, missing values last; they are held as columns of numbers and become tuples STEP at a time."""
    parts = [[f[c].to_numpy() for c in columns] for f in frames]
    held = [np.concatenate(c) for c in zip(*parts, strict=True)]
    del parts
    order = np.lexsort(held[::-1])
    for k in range(0, len(order), STEP):
        part = order[k : k + STEP]
        yield from zip(*[c[part].tolist() for c in held], strict=True)


def _given(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of at most STEP rows, one at least."""
    rows = iter(rows)
    part = list(islice(rows, STEP))
    yield pd.DataFrame(part, columns=columns)
    while part := list(islice(rows, STEP)):
        yield pd.DataFrame(part, columns=columns)


def sampled(stream: DataFrame, key: str, gap: int = 600, most: int = 240) -> DataFrame:
    """(key, ts, value, points) of (key, ts, value) in epoch seconds: a value within ``gap`` seconds of the last kept one replaces it; the last ``most`` are held."""

    def step(k, frames, state: GroupState):
        held = deque((tuple(p) for p in state.get[0]) if state.exists else (), maxlen=most)

        def points():
            for ts, value in _ordered(frames, "ts", "value"):
                if value is None or value != value:
                    continue
                if held and abs(held[-1][0] - ts) < gap:
                    held.pop()
                held.append((ts, value))
                yield k[0], ts, value, len(held)

        yield from _given(points(), [key, "ts", "value", "points"])
        state.update((list(held),))

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts bigint, value double, points int", "held array<struct<ts:bigint,value:double>>", "append", GroupStateTimeout.NoTimeout)


def breaker(stream: DataFrame, key: str, least: int = 2, seconds: int = 600) -> DataFrame:
    """(key, ts, ok, allowed) of (key, ts, ok): after ``least`` failures in a row calls are refused for ``seconds``; a refused call changes nothing."""

    def step(k, frames, state: GroupState):
        failures, until = state.get if state.exists else (0, 0)

        def calls():
            nonlocal failures, until
            for ts, ok in _ordered(frames, "ts", "ok"):
                allowed = ts >= until
                if allowed:
                    failures = 0 if ok else failures + 1
                    if failures >= least:
                        failures, until = 0, ts + seconds
                yield k[0], ts, bool(ok), allowed

        yield from _given(calls(), [key, "ts", "ok", "allowed"])
        state.update((failures, until))

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts bigint, ok boolean, allowed boolean", "failures int, until bigint", "append", GroupStateTimeout.NoTimeout)


def quota(stream: DataFrame, key: str, limit: int, seconds: int = 3600) -> DataFrame:
    """(key, ts, used, allowed): a window opens with the first call after the last one's end; calls beyond ``limit`` are refused."""

    def step(k, frames, state: GroupState):
        opened, used = state.get if state.exists else (None, 0)

        def calls():
            nonlocal opened, used
            for (ts,) in _ordered(frames, "ts"):
                if opened is None or ts - opened >= seconds:
                    opened, used = ts, 0
                used += 1
                yield k[0], ts, used, used <= limit

        yield from _given(calls(), [key, "ts", "used", "allowed"])
        state.update((opened, used))

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts bigint, used int, allowed boolean", "opened bigint, used int", "append", GroupStateTimeout.NoTimeout)
