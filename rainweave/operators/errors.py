"""Error tables and classes by station, cluster and fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.operators.partitioned import exact_quantiles
from rainweave.session import checkpointed


def with_errors(predictions: DataFrame) -> DataFrame:
    """Absolute error and the false-zero flag (rain observed, prediction within 0..2)."""
    return predictions.withColumn("abs_error", F.abs(F.col("true_value") - F.col("pred_value"))).withColumn(
        "is_false_zero", (F.col("true_value") > 0) & F.col("pred_value").between(0.0, 2.0)
    )


def station_errors(predictions: DataFrame, keys: Sequence[str] = ("fold", "station_id")) -> DataFrame:
    """Mean, median, max and sample std of the absolute error, mean truth and prediction, bias."""
    rows = with_errors(predictions).where(F.col("abs_error").isNotNull())
    plain = rows.groupBy(*keys).agg(
        F.avg("abs_error").alias("mean_abs_error"),
        F.max("abs_error").alias("max_abs_error"),
        F.stddev_samp("abs_error").alias("std_abs_error"),
        F.avg("true_value").alias("mean_true"),
        F.avg("pred_value").alias("mean_pred"),
        (F.avg("pred_value") - F.avg("true_value")).alias("bias"),
    )
    medians = exact_quantiles(rows, keys, "abs_error", {"median_abs_error": 0.5})
    return plain.join(medians, list(keys))


def across_folds(errors: DataFrame, station: str = "station_id") -> DataFrame:
    """One row per station: means of the fold values, maximum of the maxima."""
    return errors.groupBy(station).agg(
        F.avg("mean_abs_error").alias("mean_of_mean"),
        F.avg("median_abs_error").alias("mean_of_median"),
        F.max("max_abs_error").alias("max_of_max"),
        F.avg("std_abs_error").alias("mean_of_std"),
        F.avg("bias").alias("mean_of_bias"),
        F.count(F.lit(1)).alias("folds"),
    )


def flag_high(errors: DataFrame, value: str, percentile: float = 0.75, out: str = "is_high") -> DataFrame:
    errors = checkpointed(errors)  # a table per station, read for the limit and for the flags
    limit = exact_quantiles(errors, [], value, {"q": percentile})
    return errors.withColumn(out, F.col(value) >= limit.scalar())


def error_tertiles(errors: DataFrame, value: str, out: str = "error_class") -> DataFrame:
    """Low / Medium / High, cut at the quantiles .33 and .67, upper edge included."""
    errors = checkpointed(errors)
    cuts = checkpointed(exact_quantiles(errors, [], value, {"low": 0.33, "high": 0.67}))
    v = F.col(value)
    return errors.withColumn(
        out,
        F.when(v <= cuts.select("low").scalar(), "Low")
        .when(v <= cuts.select("high").scalar(), "Medium")
        .when(v.isNotNull(), "High"),
    )


def bias_class(bias: Column) -> Column:
    return F.when(bias > 1, "over").when(bias < -1, "under").when(bias.isNotNull(), "neutral")


def is_extreme_bias(bias: Column) -> Column:
    return F.abs(bias) > 2


def cluster_errors(errors: DataFrame, cluster: str = "cluster") -> DataFrame:
    return errors.groupBy(cluster).agg(
        F.round(F.avg("mean_abs_error"), 3).alias("mean_error"),
        F.round(F.max("mean_abs_error"), 3).alias("max_error"),
        F.round(F.avg("bias"), 3).alias("mean_bias"),
        F.count(F.lit(1)).alias("stations"),
    )


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max per key."""
    plain = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    if not keys:
        quartiles = checkpointed(quartiles)  # one row
    if keys:
        return plain.join(quartiles, list(keys), "left")
    return plain.select(
        "*", *[quartiles.select(c).scalar().alias(c) for c in ("q25", "q50", "q75")]
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over min..max, last bin closed; empty bins are kept with 0."""
    limits = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    low, high = limits.select("lo").scalar(), limits.select("hi").scalar()
    width = (high - low) / F.lit(bins)
    number = F.when(width > 0, F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.where(F.col(value).isNotNull()).groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (low + width * F.col("bin")).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def histogram_by(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """``histogram`` for each key, over the key's own min..max; a key without a value gives no rows. Keys are not NULL."""
    known = df.where(F.col(value).isNotNull())
    limits = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    number = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = known.join(limits, list(keys)).groupBy(*keys, number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_lo") + width * F.col("bin")).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def worst(errors: DataFrame, by: Column, station: str, n: int) -> DataFrame:
    return errors.orderBy(by.desc(), F.col(station)).limit(n)


def worst_per_key(errors: DataFrame, keys: Sequence[str], by: Column, station: str, n: int) -> DataFrame:
    """Top n per key; Spark trims each partition to n rows per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(by.desc(), F.col(station)))
    return errors.withColumn("rank", rank).where(F.col("rank") <= n)
