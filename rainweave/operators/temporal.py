"""Bucketing, dense time axes, gap filling and alignment on time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.functions.time import bucket_end, bucket_start, epoch_seconds, slot_of, slot_time
from rainweave.operators.partitioned import nearest_known, next_row, row_position

SLOTS_PER_CHUNK = 1024


def bucket_first(df: DataFrame, keys: Sequence[str], time: str, value: str, minutes: int) -> DataFrame:
    """First non-NULL value per key and bucket, by time; left-closed, left label."""
    order = F.when(F.col(value).isNotNull(), F.col(time))
    return df.groupBy(*keys, bucket_start(F.col(time), minutes).alias("bucket")).agg(
        F.min_by(value, order).alias(value)
    )


def bucket_stats(
    df: DataFrame, keys: Sequence[str], time: str, aggregates: Sequence[Column], minutes: int, label: str = "left"
) -> DataFrame:
    """Any aggregates per key and bucket, labelled by the left or right edge."""
    edge = {"left": bucket_start, "right": bucket_end}[label]
    return df.groupBy(*keys, edge(F.col(time), minutes).alias("bucket")).agg(*aggregates)


def dense_slots(df: DataFrame, keys: Sequence[str], time: str, minutes: int) -> DataFrame:
    """Every key with every bucket between the overall first and last time."""
    slots = df.agg(F.min(slot_of(F.col(time), minutes)).alias("lo"), F.max(slot_of(F.col(time), minutes)).alias("hi"))
    return df.select(*keys).distinct().withColumn(
        "slot", F.explode(F.sequence(slots.select("lo").scalar(), slots.select("hi").scalar()))
    )


def fill_gaps(
    points: DataFrame, keys: Sequence[str], slot: str, value: str, low: Column, high: Column
) -> DataFrame:
    """Dense series over ``low..high``: linear between known points, flat before and after.

    Works from the known points alone: each point emits the slots up to the next one, so no
    dense grid is joined and no window runs over empty slots. ``(keys, slot)`` must be unique.
    """
    known = points.where(F.col(value).isNotNull()).select(*keys, slot, value)
    linked = next_row(
        known, keys, F.floor(F.col(slot) / SLOTS_PER_CHUNK), slot, F.struct(F.col(slot), F.col(value)), "_next"
    )
    last = F.coalesce(F.col(f"_next.{slot}") - 1, high)
    at = F.explode(F.sequence(F.col(slot), last)).alias("_at")
    step = (F.col(f"_next.{value}") - F.col(value)) / (F.col(f"_next.{slot}") - F.col(slot))
    forward = linked.select(*keys, slot, value, F.coalesce(step, F.lit(0.0)).alias("_step"), at).select(
        *keys,
        F.col("_at").alias(slot),
        (F.col(value) + F.col("_step") * (F.col("_at") - F.col(slot))).alias(value),
    )
    leading = (
        known.groupBy(*keys)
        .agg(F.min(slot).alias("_first"), F.min_by(value, slot).alias(value))
        .where(F.col("_first") > low)
        .select(*keys, F.explode(F.sequence(low, F.col("_first") - 1)).alias(slot), value)
    )
    return forward.unionByName(leading)


def resample_filled(df: DataFrame, keys: Sequence[str], time: str, value: str, minutes: int) -> DataFrame:
    """First value per bucket, on the dense axis, with gaps filled. Columns: keys, slot, bucket, value."""
    points = (
        bucket_first(df, keys, time, value, minutes)
        .withColumn("slot", slot_of(F.col("bucket"), minutes))
        .drop("bucket")
    )
    slots = df.agg(F.min(slot_of(F.col(time), minutes)).alias("lo"), F.max(slot_of(F.col(time), minutes)).alias("hi"))
    filled = fill_gaps(
        points, keys, "slot", value, slots.select("lo").scalar(), slots.select("hi").scalar()
    )
    return filled.withColumn("bucket", slot_time(F.col("slot"), minutes))


def times_with_rain(df: DataFrame, time: str, value: str, at_least: int) -> DataFrame:
    """Rows of timestamps at which at least N stations report a positive value."""
    if at_least <= 0:
        return df
    enough = (
        df.groupBy(time).agg(F.count_if(F.col(value) > 0).alias("_n")).where(F.col("_n") >= at_least).select(time)
    )
    return df.join(enough, time, "left_semi")


def numbered_times(df: DataFrame, time: str, out: str = "time_idx") -> DataFrame:
    """Distinct times with their 0-based number; days are numbered separately and offset."""
    return row_position(df.select(time).distinct(), [], F.to_date(F.col(time)), [time], out)


def time_slice(df: DataFrame, time: str, start: int, stop: int) -> DataFrame:
    """Rows of the half-open range ``start:stop`` of distinct times in order."""
    wanted = numbered_times(df, time, "_n").where((F.col("_n") >= start) & (F.col("_n") < stop)).select(time)
    return df.join(wanted, time, "left_semi")


def assign_to_index(values: DataFrame, index: DataFrame, time: str, label: str) -> DataFrame:
    """Give each row its target time on an irregular index, as column ``target``.

    ``right``: the first index time at or after the row; ``left``: the last at or before it.
    Both sides are first cut to their common period; rows without a target stay NULL.
    The distinct times of both sides form one line, cut into blocks of equal size; the nearest mark is carried inside
    the blocks and, by one row per block, over their borders. No pair of a value and a mark is looked at.
    """
    if label not in ("left", "right"):
        raise ValueError("label must be 'left' or 'right'")
    v = values.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    i = index.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    low = F.greatest(v.select("lo").scalar(), i.select("lo").scalar())
    high = F.least(v.select("hi").scalar(), i.select("hi").scalar())
    inside = F.col(time).between(low, high)
    kept = values.where(inside)
    marks = index.where(inside).select(time, F.col(time).alias("_mark"))
    line = kept.select(time, F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark")).unionByName(marks)
    line = line.groupBy(time).agg(F.max("_mark").alias("_mark"))
    nearest = nearest_known(line, time, "_mark", "_carried", ahead=label == "right")
    targets = nearest.select(time, F.coalesce("_mark", "_carried").alias("target"))
    return kept.join(targets, time, "left").select(*values.columns, "target")
