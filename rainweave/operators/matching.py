"""Joins of sources on time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.operators.partitioned import salted_join


def fuse_on_time(frames: Sequence[DataFrame], time: str = "time_sgt") -> DataFrame:
    """Inner join of several sources on equal times."""
    fused = frames[0]
    for other in frames[1:]:
        fused = fused.join(other, time)
    return fused


@dataclass
class TimeMatch:
    matched: DataFrame
    radar_only: DataFrame
    weather_only: DataFrame
    stats: DataFrame


def match_times(radar: DataFrame, weather: DataFrame, time: str = "time_sgt") -> TimeMatch:
    """Radar files against weather times: matches, both remainders, and counts.

    The rate is matched rows per weather row in percent, NULL without weather rows; several
    files at one time multiply rows, so it may exceed 100.
    """
    per_time = radar.groupBy(time).agg(F.count(F.lit(1)).alias("_r"))
    counted = weather.groupBy(time).agg(F.count(F.lit(1)).alias("_w")).join(per_time, time, "full")
    r, w = F.coalesce("_r", F.lit(0)), F.coalesce("_w", F.lit(0))
    stats = counted.agg(
        F.coalesce(F.sum(r), F.lit(0)).alias("radar"),
        F.coalesce(F.sum(w), F.lit(0)).alias("weather"),
        F.coalesce(F.sum(r * w), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(w == 0, r)), F.lit(0)).alias("radar_only"),
        F.coalesce(F.sum(F.when(r == 0, w)), F.lit(0)).alias("weather_only"),
    ).withColumn("match_rate", F.try_divide(F.col("matched") * 100.0, F.col("weather")))
    return TimeMatch(
        matched=radar.join(weather, time),
        radar_only=radar.join(weather.select(time).distinct(), time, "left_anti"),
        weather_only=weather.join(per_time.select(time), time, "left_anti"),
        stats=stats,
    )


def nearest_time(left: DataFrame, right: DataFrame, time: str = "time_sgt", tolerance_seconds: int = 900,
                 out: str = "frame_time") -> DataFrame:
    """Nearest right time within the tolerance (inclusive) for every left row, else NULL.

    On a tie the earlier time wins. Only distinct times are compared: both are keyed by a
    bucket as long as the tolerance, so each time meets the three buckets around it.
    """
    width = tolerance_seconds * 1_000_000

    def micros(c: str):
        return F.unix_micros(F.col(c).cast("timestamp"))

    bucket = F.floor(micros(time) / F.lit(width))
    asked = left.select(time).distinct().withColumn("_b", F.explode(F.sequence(bucket - 1, bucket + 1)))
    known = right.select(F.col(time).alias("_t")).distinct().withColumn("_b", F.floor(micros("_t") / F.lit(width)))
    gap = F.abs(micros(time) - micros("_t"))
    nearest = (
        asked.join(known, "_b")
        .where(gap <= width)
        .groupBy(time)
        .agg(F.min(F.struct(gap.alias("gap"), F.col("_t").alias("t"))).alias("_best"))
        .select(time, F.col("_best.t").alias(out))
    )
    return salted_join(left, nearest, [time], "left")


def align_radar(times: DataFrame, frames: DataFrame, time: str = "time_sgt", tolerance_seconds: int = 900) -> DataFrame:
    """One frame per time: the nearest, or a frame of zeros of the same shape."""
    unique = frames.groupBy(time).agg(F.min_by("data", F.to_json(F.struct("data"))).alias("data"))
    shape = frames.agg(F.max(F.size("data")).alias("h"), F.max(F.size(F.col("data")[0])).alias("w"))
    zeros = F.array_repeat(
        F.array_repeat(F.lit(0.0), shape.select("w").scalar()), shape.select("h").scalar()
    )
    return (
        nearest_time(times, frames, time, tolerance_seconds)
        .join(unique.withColumnRenamed(time, "frame_time"), "frame_time", "left")
        .select(time, "frame_time", F.coalesce("data", zeros).alias("data"))
    )


def min_max_normalised(df: DataFrame, value: str, out: str) -> DataFrame:
    """(x - min) / (max - min) over all rows; NULL when all values are equal."""
    limits = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    low, high = limits.select("lo").scalar(), limits.select("hi").scalar()
    return df.withColumn(out, F.try_divide(F.col(value) - low, high - low))
