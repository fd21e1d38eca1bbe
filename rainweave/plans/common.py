"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.sources import views


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for comparison; turns a negative zero into zero."""
    return F.round(value, digits)


def rain(spark: SparkSession, folder: str) -> DataFrame:
    """Rain observations only: gid, time_sgt, value."""
    return views.observations(spark, folder).where(F.col("variable") == "rain_rate").drop("variable")
