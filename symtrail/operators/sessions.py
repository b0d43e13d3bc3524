"""Quiet-period batching of change events, and last write wins, without sorting a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from symtrail.operators.keyed import as_of


def hour(c: Column) -> Column:
    return F.floor(F.unix_timestamp(c) / 3600)


def quiet_periods(events: DataFrame, keys: list[str], ts: str, gap_seconds: float, bucket=hour) -> DataFrame:
    """Adds `flush_start`: the first event of the burst an event belongs to.

    A burst ends when nothing follows for longer than the gap.  The event before each event and the
    last burst start before it are as-of joins, so a busy key is spread over time buckets."""
    marks = events.select(*keys, F.col(ts).alias("_ts")).distinct()
    before = as_of(marks, marks, keys, "_ts", "_ts", [], bucket, strict=True)
    silent = F.col("matched_at").isNull() | (
        F.col("_ts") - F.col("matched_at") > F.make_dt_interval(secs=F.lit(gap_seconds)))
    starts = before.filter(silent).select(*keys, "_ts")
    out = as_of(events, starts, keys, ts, "_ts", [], bucket)
    return out.withColumnRenamed("matched_at", "flush_start")


def flushes(events: DataFrame, keys: list[str], path: str, ts: str, order: str, gap_seconds: float) -> DataFrame:
    """One row per (burst, path): the last write of the path in the burst (`order` settles ties)."""
    rows = quiet_periods(events, keys, ts, gap_seconds)
    rest = [c for c in events.columns if c not in (*keys, path)]
    last = rows.groupBy(*keys, "flush_start", path).agg(
        F.max_by(F.struct(*rest), F.struct(ts, order)).alias("w"), F.count(F.lit(1)).alias("writes"))
    return last.select(*keys, "flush_start", path, "writes", *[F.col(f"w.{c}").alias(c) for c in rest])
