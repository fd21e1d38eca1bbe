"""Time columns. All times are naive local times (TIMESTAMP_NTZ); sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: station files write local time with this literal suffix and whole minutes.
STATION_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:'00+08:00'"


def parse_station_time(text: Column, strict: bool = True) -> Column:
    """Strict parse of station time strings; the offset text is required and dropped.

    ``strict`` raises on any other text; otherwise such rows give NULL for a quarantine.
    """
    if strict:
        return F.to_timestamp_ntz(text, F.lit(STATION_TIME_FORMAT))
    # the shape test keeps a lenient result for malformed text out of the parser
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:00\+08:00$")
    return F.when(shaped, F.try_to_timestamp(F.substring(text, 1, 16), F.lit("yyyy-MM-dd'T'HH:mm"))).cast(
        "timestamp_ntz"
    )


def bucket_start(time: Column, minutes: int) -> Column:
    """Start of the left-closed bucket that holds ``time``."""
    return F.window(time, f"{minutes} minutes").getField("start")


def bucket_end(time: Column, minutes: int) -> Column:
    """Right edge of the left-closed bucket that holds ``time`` (right label)."""
    return F.window(time, f"{minutes} minutes").getField("end")


def epoch_seconds(time: Column) -> Column:
    """Seconds since 1970 as a double, from a naive time."""
    return F.unix_micros(time.cast("timestamp")) / F.lit(1e6)


def slot_of(time: Column, minutes: int) -> Column:
    """Number of the bucket since 1970."""
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(minutes * 60_000_000)).cast("long")


def slot_time(slot: Column, minutes: int) -> Column:
    """Start time of a numbered bucket."""
    return F.timestamp_seconds(slot * F.lit(minutes * 60)).cast("timestamp_ntz")
