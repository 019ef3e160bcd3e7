"""Ordered (frame- or time-wise) operators that survive one hot key.

A window partitioned by a key puts the whole key into one task. Here the order axis is cut into buckets: the window
runs inside (key, bucket), and what a bucket needs from the past comes from a per-bucket summary (one row per key and
bucket, aggregated map-side) carried forward over the earlier buckets. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME_BUCKET = 128  # frames; what a bucket holds of a key is as many frames' rows
TIME_BUCKET_S = 3600.0


def frame_bucket(frame: Column, width: int = FRAME_BUCKET) -> Column:
    return F.floor(frame / width).cast("bigint")


def time_bucket(seconds: Column, width: float = TIME_BUCKET_S) -> Column:
    return F.floor(seconds / F.lit(width)).cast("bigint")


def carry_in(
    df: DataFrame, keys: list[str], bucket: str, parts: dict[str, tuple[Column, Callable[[Column], Column]]]
) -> DataFrame:
    """Add, for every row, what earlier buckets of its key amount to.

    ``parts`` maps a new column to (aggregate per bucket, function merging the aggregates of earlier buckets).
    """
    summary = df.groupBy(*keys, bucket).agg(*[agg.alias(name) for name, (agg, _) in parts.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, bucket, *[merge(F.col(name)).over(before).alias(name) for name, (_, merge) in parts.items()]
    )
    return df.join(carried, [*keys, bucket], "left")


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def split_lag(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column, name: str) -> DataFrame:
    """``lag(value)`` over (keys, order); ``value`` must not be NULL."""
    work = df.withColumn("_lag_value", value)
    work = carry_in(work, keys, bucket, {"_lag_carry": (F.max_by("_lag_value", F.struct(*order)), _last)})
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return work.withColumn(name, F.coalesce(F.lag("_lag_value").over(inside), F.col("_lag_carry"))).drop(
        "_lag_value", "_lag_carry"
    )


_RUNNING = {
    "min": (F.min, lambda inside, carry: F.least(inside, carry)),
    "max": (F.max, lambda inside, carry: F.greatest(inside, carry)),
    "sum": (F.sum, lambda inside, carry: inside + F.coalesce(carry, F.lit(0))),
}


def split_running(
    df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column, how: str, name: str
) -> DataFrame:
    """Running min, max or sum of ``value`` up to and including the current row (and its order peers)."""
    aggregate, merge = _RUNNING[how]
    work = df.withColumn("_run_value", value)
    work = carry_in(work, keys, bucket, {"_run_carry": (aggregate("_run_value"), aggregate)})
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return work.withColumn(name, merge(aggregate("_run_value").over(inside), F.col("_run_carry"))).drop(
        "_run_value", "_run_carry"
    )


def split_ordinal(df: DataFrame, keys: list[str], order: list[str], bucket: str, name: str) -> DataFrame:
    """0-based position of each row within its keys (rows must be unique in ``order``)."""
    work = carry_in(df, keys, bucket, {"_before": (F.count(F.lit(1)), F.sum)})
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return work.withColumn(
        name, (F.row_number().over(inside) - 1 + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint")
    ).drop("_before")


def frame_ordinals(frames: DataFrame, keys: list[str], width: int = FRAME_BUCKET) -> DataFrame:
    """Dense ordinal ``ord`` of every distinct processed frame of a run."""
    spine = frames.select(*keys, "frame").distinct().withColumn("_b", frame_bucket(F.col("frame"), width))
    return split_ordinal(spine, keys, ["frame"], "_b", "ord").select(*keys, "frame", "ord")


def gap_sessions(
    df: DataFrame, keys: list[str], time: str, gap: float, start: str = "session_start", width: float = TIME_BUCKET_S
) -> DataFrame:
    """Label rows with the start time of their session: a new one begins when the gap exceeds ``gap`` seconds."""
    work = df.withColumn("_b", time_bucket(F.col(time), width))
    work = split_lag(work, keys, [time], "_b", F.col(time), "_prev")
    opens = F.when(F.col("_prev").isNull() | (F.col(time) - F.col("_prev") > F.lit(gap)), F.col(time))
    return split_running(work, keys, [time], "_b", opens, "max", start).drop("_b", "_prev")


def interval_islands(df: DataFrame, keys: list[str], start: str, end: str, width: float = TIME_BUCKET_S) -> DataFrame:
    """``island``: start of the stretch of overlapping (or touching) intervals a row belongs to."""
    work = df.withColumn("_b", time_bucket(F.col(start), width))
    work = carry_in(work, keys, "_b", {"_reach_carry": (F.max(end), F.max)})
    inside = Window.partitionBy(*keys, "_b").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max(end).over(inside), F.col("_reach_carry"))
    work = work.withColumn("_reached", reached)
    opens = F.when(F.col("_reached").isNull() | (F.col(start) > F.col("_reached")), F.col(start))
    return split_running(work.drop("_reach_carry"), keys, [start], "_b", opens, "max", "island").drop("_b", "_reached")
