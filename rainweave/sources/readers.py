"""Readers with explicit schemas. NaN becomes NULL here, so later steps only know NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainweave.functions.time import parse_station_time
from rainweave.operators.temporal import times_with_rain

STATION_VARIABLES = ("rain_rate", "wind_speed", "wind_direction", "temperature", "humidity")


def nan_to_null(df: DataFrame) -> DataFrame:
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(field.name, F.when(~F.isnan(field.name), F.col(field.name)))
    return df


def _csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    schema = T.StructType([T.StructField(name, kind) for name, kind in columns])
    return spark.read.schema(schema).option("enforceSchema", "false").option("nanValue", "NaN").csv(path, header=True)


def read_weather_stations(
    spark: SparkSession, path: str | Sequence[str], variables: Sequence[str] = STATION_VARIABLES, strict: bool = True
) -> DataFrame:
    """Weather-station observations: time_sgt, gid and one column per variable."""
    columns = [("timestamp", T.StringType()), ("station_id", T.StringType())]
    raw = _csv(spark, path, columns + [(v, T.DoubleType()) for v in variables])
    return nan_to_null(
        raw.withColumn("time_sgt", parse_station_time(F.col("timestamp"), strict))
        .withColumnRenamed("station_id", "gid")
        .select("time_sgt", "gid", *variables)
    )


def read_rain_gauges(spark: SparkSession, path: str | Sequence[str], at_least: int = 0, strict: bool = True) -> DataFrame:
    """Gauge rain, long form, restricted to times with at least N positive stations."""
    raw = _csv(spark, path, [("time_sgt", T.StringType()), ("gid", T.StringType()), ("rain_rate", T.DoubleType())])
    rows = nan_to_null(raw.withColumn("time_sgt", parse_station_time(F.col("time_sgt"), strict)))
    return times_with_rain(rows, "time_sgt", "rain_rate", at_least)


def read_station_positions(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Station positions in file order; the last entry of a station wins."""
    columns = [("gid", T.StringType()), ("latitude", T.DoubleType()), ("longitude", T.DoubleType())]
    raw = _csv(spark, path, columns)
    # order of the rows in the files: file, block offset, row within the block
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return last_known_position(raw.withColumn("_order", order), "_order")


def last_known_position(entries: DataFrame, order: str) -> DataFrame:
    return entries.groupBy("gid").agg(
        F.max_by("latitude", order).alias("latitude"), F.max_by("longitude", order).alias("longitude")
    )


def read_links(spark: SparkSession, facts: str, dimension: str) -> DataFrame:
    """Link signal rows with their link attributes as one flat table (Parquet)."""
    return nan_to_null(spark.read.parquet(facts)).join(nan_to_null(spark.read.parquet(dimension)), "link_id")
