"""Resampling of a stream of observations, with the batch aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample_stream(stream: DataFrame, keys: Sequence[str], time: str, aggregates: Sequence[Column], minutes: int = 15,
                    late: str = "30 minutes") -> DataFrame:
    """Aggregates per key and bucket of a stream; a bucket closes once the watermark passes its end.

    ``time`` must be a TIMESTAMP, which watermarks need.
    """
    bucketed = stream.withWatermark(time, late).groupBy(*keys, F.window(time, f"{minutes} minutes").alias("_w"))
    return bucketed.agg(*aggregates).withColumn("bucket", F.col("_w.start")).drop("_w")


def first_per_bucket_stream(stream: DataFrame, keys: Sequence[str], time: str, value: str, minutes: int = 15,
                            late: str = "30 minutes") -> DataFrame:
    """First non-NULL value per key and bucket, as ``bucket_first`` for batch tables.

    Groups by the window itself, so that the watermark closes buckets and removes their state.
    """
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(time))).alias(value)
    return resample_stream(stream, keys, time, [first], minutes, late)
