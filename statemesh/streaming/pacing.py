"""Pacing of calls under a provider's token window, as a stream with state and event-time timers.

A provider's responses say how many tokens are left and when the window resets. A call that may not fit waits for the reset.
State for a provider is that window and the calls that the watermark has not passed yet: calls arrive in any order within
``lateness``, and are taken in the order of their times once no earlier one can come. One timer a provider and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A call fits if more than this many times its tokens are left; microseconds added to a wait, and the longest wait.
ROOM, EXTRA, LONGEST = 2, 250_000, 70_000_000

PACED = "provider string, call_id bigint, waited_us bigint, starts_us bigint"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

Window = tuple["int | None", "int | None", int]


def step(window: Window | None, at: int, needed: int, remaining: int | None, reset: int | None) -> tuple[Window, int, int]:
    """(window after it, microseconds waited for the reset, start) of one call, by the window (tokens left, reset, last start) before it.

    A provider's calls go one after the other, so none starts before the last one did. What a response leaves out stays as it was.
    """
    left, resets, last = window or (None, None, at)
    now, wait = max(at, last), 0
    if left is not None and left <= ROOM * needed and resets is not None and resets > now:
        wait, left = min(resets - now + EXTRA, LONGEST), None
    start = now + wait
    return (left if remaining is None else remaining, resets if reset is None else start + reset, start), wait, start


def _or_none(v) -> int | None:
    return None if v is None or pd.isna(v) else int(v)


class _Pacing(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "remaining bigint, resets bigint, start bigint")
        self.held = handle.getListState("held", "at bigint, call_id bigint, needed bigint, remaining bigint, reset bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            columns = part[["at_us", "call_id", "needed", "remaining", "reset_us"]]
            self.held.appendList([tuple(map(_or_none, r)) for r in columns.itertuples(index=False)])
            last = max(int(part["at_us"].max()), last or 0)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.held.get(), key=lambda c: (c[0], c[1]))
        due = [c for c in held if c[0] <= passed]
        if not due:
            return
        window, out = self.window.get() if self.window.exists() else None, []
        for at, call, needed, remaining, reset in due:
            window, _, start = step(window, at, needed, remaining, reset)
            out.append((key[0], call, start - at, start))
        self.window.update(tuple(window))
        self.held.clear()
        if len(due) < len(held):
            self.held.put([tuple(c) for c in held[len(due) :]])
        yield pd.DataFrame(out, columns=["provider", "call_id", "waited_us", "starts_us"])

    def close(self) -> None:
        pass


def paced(calls: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """PACED rows of a stream of calls(provider, call_id, at, needed, remaining, reset_us): what each waits from its arrival, and when it starts.

    needed: its tokens; remaining, reset_us: what its response states, null if nothing. Calls without provider or time are left out.
    Calls of one instant go by call_id. To be started within ``with_state_store``.
    """
    known = calls.where("provider is not null and at is not null").withWatermark("at", lateness)
    rows = known.select("at", F.col("provider").cast("string").alias("provider"), "call_id", F.unix_micros("at").alias("at_us"), "needed", "remaining", "reset_us")
    return rows.groupBy("provider").transformWithStateInPandas(statefulProcessor=_Pacing(), outputStructType=PACED, outputMode="Append", timeMode="EventTime")


class with_state_store:
    """Streams that are started within it keep their state in RocksDB, which timers need."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, spark.conf.get(_PROVIDER)

    def __enter__(self) -> None:
        self.spark.conf.set(_PROVIDER, _ROCKS)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_PROVIDER, self.before)
