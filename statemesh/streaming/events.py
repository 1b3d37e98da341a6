"""Operators over event streams; each gives the same rows for a table and for a stream over the same rows.

As streams their state is bounded by a watermark: ``lateness`` says for how long after the latest event rows may still come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, lateness: str, at: str = "ts") -> DataFrame:
    """events with a timestamp that a stream can be held against."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, lateness) if events.isStreaming else timed


def first_deliveries(events: DataFrame, ids: list[str], lateness: str = "1 hour") -> DataFrame:
    """events(ts, ...) without those that were delivered before: a stream forgets an id once no repetition can be within lateness."""
    marked = _marked(events, lateness)
    return marked.dropDuplicatesWithinWatermark(ids) if events.isStreaming else marked.dropDuplicates(ids)


def sessions(events: DataFrame, by: list[str], gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(by..., start, end, n, total): runs of events(ts, value, ...) with less than ``gap`` between neighbours; a session ends a
    gap after its last event."""
    grouped = _marked(events, lateness).groupBy(*by, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sliding_counts(events: DataFrame, by: list[str], window: str = "1 day", slide: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """(by..., start, n): events in windows that overlap."""
    grouped = _marked(events, lateness).groupBy(*by, F.window("ts", window, slide).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def followed(first: DataFrame, then: DataFrame, by: list[str], within: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Pairs (by..., first_id, first_ts, then_id, then_ts) of events(event_id, ts, by...): the second after the first, or with it, and no later than
    ``within``. As streams both sides keep only what the other's watermark can still meet."""
    name = lambda df, side: _marked(df.select(*by, F.col("event_id").alias(f"{side}_id"), F.col("ts").alias(f"{side}_ts")), lateness, f"{side}_ts")
    a, b = name(first, "first"), name(then, "then")
    return a.join(b, by).where(F.col("then_ts").between(F.col("first_ts"), F.col("first_ts") + F.expr(f"interval {within}")))
