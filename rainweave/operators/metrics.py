"""Scores over (time, truth, prediction) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.operators.partitioned import average_ranks, salted_join


def per_time_mse(df: DataFrame, time: Sequence[str], true: str, pred: str) -> DataFrame:
    """Mean squared error per time over rows with truth; ``n`` counts them (0 keeps the time)."""
    error = F.col(true) - F.col(pred)
    return df.groupBy(*time).agg(F.avg(error * error).alias("mse"), F.count(error).alias("n"))


def average_rmse(df: DataFrame, time: Sequence[str], true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over times of the per-time RMSE, with both denominators, and the mean MSE.

    ``*_all`` divides by all times (a time without truth adds 0), ``*_valid`` by times with truth.
    """
    scored = per_time_mse(df, [*keys, *[t for t in time if t not in keys]], true, pred)
    root = F.sum(F.sqrt("mse"))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("times"),
        F.count("mse").alias("valid_times"),
        (root / F.count(F.lit(1))).alias("rmse_all"),
        (root / F.nullif(F.count("mse"), F.lit(0))).alias("rmse_valid"),
        (F.sum("mse") / F.count(F.lit(1))).alias("mse_all"),
    )


def pearson(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    pairs = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull())
    return pairs.groupBy(*keys).agg(F.corr(true, pred).alias("pearson"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Rank correlation with average ranks, over pre-aggregated distinct pairs."""
    pairs = (
        df.where(F.col(true).isNotNull() & F.col(pred).isNotNull())
        .groupBy(F.col(true).cast("double").alias("_t"), F.col(pred).cast("double").alias("_p"))
        .agg(F.count(F.lit(1)).cast("double").alias("_w"))
    )
    rows = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull())
    # a common value (no rain) may hold a large part of the pairs, so both rank joins are salted
    ranked = salted_join(pairs, average_ranks(rows, true, "_rt").withColumnRenamed(true, "_t"), ["_t"])
    ranked = salted_join(ranked, average_ranks(rows, pred, "_rp").withColumnRenamed(pred, "_p"), ["_p"])
    w, t, p = F.col("_w"), F.col("_rt"), F.col("_rp")
    means = ranked.agg((F.sum(w * t) / F.sum(w)).alias("mt"), (F.sum(w * p) / F.sum(w)).alias("mp"))
    dt, dp = t - means.select("mt").scalar(), p - means.select("mp").scalar()
    return ranked.agg(
        (F.sum(w * dt * dp) / F.sqrt(F.sum(w * dt * dt) * F.sum(w * dp * dp))).alias("spearman"),
        F.sum(w).cast("long").alias("n"),
    )


def batch_loss(df: DataFrame, batch: str, node_type: str, true: str, pred: str) -> DataFrame:
    """Per batch: sum of the per-type MSE, and the pooled MSE."""
    error = F.col(true) - F.col(pred)
    typed = df.groupBy(batch, node_type).agg(F.sum(error * error).alias("_s"), F.count(error).alias("_n"))
    return typed.groupBy(batch).agg(
        F.sum(F.col("_s") / F.col("_n")).alias("summed_mse"), (F.sum("_s") / F.sum("_n")).alias("pooled_mse")
    )


def event_mse(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    error = F.col(true) - F.col(pred)
    return df.groupBy(*keys).agg(F.avg(error * error).alias("event_mse"))
