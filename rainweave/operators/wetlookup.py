"""Wet-antenna attenuation from observed attenuation, through a lookup table per link."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.functions.attenuation import rain_rate
from rainweave.operators.partitioned import salted_join

# Table points per link and the decades of rain attenuation they span.
LUT_POINTS, LUT_FIRST, LUT_LAST = 100, -10.0, 3.0
BLOCK_SEGMENTS = 12  # segments between two entries of the coarse index


def lookup_table(links: DataFrame, antenna: Callable[[Column], Column]) -> DataFrame:
    """Points (link_id, n, a_obs, waa) for links with length, a and b; ``antenna`` maps R to WAA."""
    n = F.explode(F.sequence(F.lit(0), F.lit(LUT_POINTS - 1))).alias("n")
    exponent = F.lit(LUT_FIRST) + F.lit(LUT_LAST - LUT_FIRST) * F.col("n") / F.lit(float(LUT_POINTS - 1))
    points = links.select("*", n).withColumn(
        "_rain_loss", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), exponent))
    )
    rated = points.withColumn("_r", rain_rate(F.col("_rain_loss"), F.col("length"), F.col("a"), F.col("b"), 0.0))
    wetted = rated.withColumn("waa", antenna(F.col("_r")))
    return wetted.select("link_id", "n", (F.col("_rain_loss") + F.col("waa")).alias("a_obs"), "waa")


def antenna_from_observed(df: DataFrame, table: DataFrame, a_obs: str, out: str = "waa", strict: bool = True) -> DataFrame:
    """Linear interpolation of WAA at the observed attenuation, per link.

    Negative or too large values raise when ``strict``, else give NULL. A link's segments come as one row of
    sorted arrays; a coarse index of every twelfth segment leads to the few that are looked at. The tables are never
    broadcast: Spark sizes them by the links they stem from, which they exceed a hundred times and more.
    """
    line = Window.partitionBy("link_id").orderBy("n")
    segments = table.select(
        "link_id", "n", F.col("a_obs").alias("_lo"), F.col("waa").alias("_w0"),
        F.lead("a_obs").over(line).alias("_hi"), F.lead("waa").over(line).alias("_w1"),
    ).where(F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    parts = ("_lo", "_hi", "_w0", "_w1")
    sorted_segments = segments.groupBy("link_id").agg(F.sort_array(F.collect_list(F.struct("_lo", "n", "_hi", "_w0", "_w1"))).alias("_s"))
    packed = sorted_segments.select("link_id", *[F.col(f"_s.{c}").alias(c) for c in parts], F.array_max("_s._hi").alias("_limit")).withColumn(
        "_coarse", F.filter("_lo", lambda lo, i: i % BLOCK_SEGMENTS == 0)
    )
    value = F.col(a_obs)
    joined = salted_join(df, packed.hint("merge"), ["link_id"], "left")
    block = (F.size(F.filter("_coarse", lambda lo: lo <= value)) - 1) * BLOCK_SEGMENTS
    inside = F.size(F.filter(F.slice("_lo", block + 1, BLOCK_SEGMENTS), lambda lo: lo <= value))
    found = joined.withColumn("_at", F.when((value >= F.get("_lo", F.lit(0))) & (value <= F.col("_limit")), block + inside - 1))
    at = found.select(*df.columns, *[F.get(c, F.col("_at")).alias(c) for c in parts], "_at")
    waa = F.col("_w0") + (F.col("_w1") - F.col("_w0")) * (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    if strict:
        waa = (
            F.when(value < 0, F.raise_error(F.lit("negative observed attenuation")).cast("double"))
            .when(value.isNotNull() & F.col("_at").isNull(), F.raise_error(F.lit("observed attenuation beyond the table")).cast("double"))
            .otherwise(waa)
        )
    return at.withColumn(out, waa).select(*df.columns, out)
