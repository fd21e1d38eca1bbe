"""Queries that send a table through a stream; their twins are those of the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweave.plans import links as link_plans
from rainweave.plans import radar as radar_plans
from rainweave.plans.common import rounded
from rainweave.plans.registry import SQL, query
from rainweave.sources import views
from rainweave.streaming import links, matching, replay

SLICES = 3
START = 1704067200  # 2024-01-01: watermarks begin at 1970, and rows at or before it count as late


def _slices(df, time, minutes_late=1):
    """Number of the time slice of each row, and the lateness in minutes that covers a slice."""
    low, high = df.agg(F.min(F.unix_seconds(time)), F.max(F.unix_seconds(time))).first()
    if low is None:
        return F.lit(0), 1, None
    length = (high - low) // SLICES + 1
    return F.floor((F.unix_seconds(time) - low) / length), length // 60 + minutes_late, high


@query("e2_stream_link_rain", SQL["w9_link_rain"])
def e2_stream_link_rain(spark, folder):
    """W9 on a stream: all link samples in slices of time, averaged over 15 minutes."""
    rows = views.link_series(spark, folder).select("link_id", F.timestamp_seconds(F.col("t") * 60 + START).alias("time"), "trsl")
    slice_of, late, last = _slices(rows, "time")
    # a link that does not exist ends the stream
    end = spark.range(1).select(F.lit(-1).alias("link_id"), F.timestamp_seconds(F.lit((last or 0) + 60 * (2 * late + 3000))).alias("time"), F.lit(0.0).alias("trsl"))
    stream = replay.read_slices(spark, replay.written_slices(rows, slice_of, SLICES, end), rows.schema)
    rain = links.link_rain_stream(
        stream, views.links(spark, folder), late=f"{late} minutes", close_after_minutes=late + 1440, threshold=link_plans.THRESHOLD)
    done = replay.collected(rain)
    bucket = (F.floor((F.unix_seconds("time") - START) / 900) + 1) * 15
    return done.groupBy("link_id", bucket.alias("bucket_end")).agg(rounded(F.avg("rain_rate")).alias("rain_rate"), F.count(F.lit(1)).alias("n"))


@query("e3_stream_match_parts", SQL["j2_match_parts"])
def e3_stream_match_parts(spark, folder):
    """J2 on two streams: radar files and weather times in slices of time."""
    files = radar_plans.s5_radar_catalogue(spark, folder).select("path", F.col("time_sgt").cast("timestamp").alias("time_sgt"))
    weather = radar_plans._gauge_times(spark, folder).select(F.col("time_sgt").cast("timestamp").alias("time_sgt"), "gauges")
    slice_of, late, last = _slices(files.select("time_sgt").union(weather.select("time_sgt")), "time_sgt")
    sides = []
    for place, side in enumerate((files, weather)):
        far = F.timestamp_seconds(F.lit((last or 0) + 60 * (2 * late + 60 + place)))  # a last row on each side that matches nothing
        end = spark.range(1).select(far.alias("time_sgt"), *[F.lit(None).alias(c) for c in side.columns if c != "time_sgt"])
        sides.append(replay.read_slices(spark, replay.written_slices(side, slice_of, SLICES, end.select(*side.columns)), side.schema))
    parts = replay.collected(matching.match_streams(*sides, late=f"{late} minutes"))
    return parts.select("part", F.col("time_sgt").cast("timestamp_ntz").alias("time_sgt"), "path")
