"""Following runs until they end: keyed state with processing-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postmart.plans.runs import TERMINAL, result_status, status_ladder

OUTPUT_SCHEMA = "run_id string, status string, decided_by string, polls bigint"


def reduced(batches: Iterator[pd.DataFrame]) -> tuple[int, tuple | None, tuple | None]:
    """(number of polls, earliest poll that ended the run, newest poll) of all batches of one run; a poll is (at,
    status, decided_by).  Polls of one time are told apart by status, so that their order does not matter."""
    n, ended, newest = 0, None, None
    for batch in batches:
        n += len(batch)
        polls = list(batch[["at", "status", "decided_by"]].itertuples(index=False, name=None))
        ended = min([p for p in polls if p[1] in TERMINAL] + [ended] * (ended is not None), default=None)
        newest = max(polls + [newest] * (newest is not None), default=None)
    return n, ended, newest


class RunTracker(StatefulProcessor):
    """Keeps the newest evidence of each run and emits one row when the run ends or its time is up.

    Only the decision of each poll enters the state, so the state of a run is a few fields however many polls it
    has, and the time of that poll, so that older evidence that arrives late replaces nothing.  A decided run
    keeps a tombstone for ``memory_ms``: evidence that arrives within that time does not emit again, and after it
    the run takes up no state."""

    def __init__(self, timeout_ms: int, memory_ms: int):
        self.timeout_ms, self.memory_ms = timeout_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "status string, decided_by string, polls bigint, at bigint")
        self.ended = handle.getValueState("ended", "status string", self.memory_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, ended, newest = reduced(rows)
        if self.ended.exists() or newest is None:
            return
        old = self.state.get() if self.state.exists() else None
        polls = n + (old[2] if old is not None else 0)
        if ended is not None:
            yield self._end(key, ended[1], ended[2], polls)
            return
        at, status, decided_by = newest if old is None else max(newest, (old[3], old[0], old[1]))
        if old is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        self.state.update((status, decided_by, polls, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and not self.ended.exists():
            old = self.state.get()
            yield self._end(key, "timeout", old[1], old[2])

    def close(self) -> None:
        pass

    def _end(self, key, status: str, decided_by: str, polls: int) -> pd.DataFrame:
        self.state.clear()
        self.ended.update((status,))
        return pd.DataFrame({"run_id": [key[0]], "status": [status], "decided_by": [decided_by], "polls": [polls]})


def decide_polls(polls: DataFrame) -> DataFrame:
    """Apply the status ladder to each poll: (run_id, core, listed, listed_core, state, has_errors, at)
    to (run_id, status, decided_by, at).  This part stays in the JVM."""
    flag = lambda name: F.coalesce(name, F.lit(False))
    ladder = status_ladder(
        flag("core"), F.col("listed"), flag("listed_core"), result_status(F.col("state")), flag("has_errors")
    )
    return polls.select(
        "run_id", ladder["status"].alias("status"), ladder["decided_by"].alias("decided_by"), F.col("at").cast("bigint").alias("at")
    )


def track_run_status(polls: DataFrame, timeout_ms: int, memory_ms: int = 7 * 86_400_000) -> DataFrame:
    """Streaming polls of runs to one row per ended run: done, failed, cancelled, or timeout when nothing
    ended it within ``timeout_ms`` of its first poll.  An ended run is remembered for ``memory_ms``.  Needs the
    RocksDB state store provider."""
    return (
        decide_polls(polls)
        .where("run_id IS NOT NULL AND at IS NOT NULL")
        .groupBy("run_id")
        .transformWithStateInPandas(
            statefulProcessor=RunTracker(timeout_ms, memory_ms),
            outputStructType=OUTPUT_SCHEMA,
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )
