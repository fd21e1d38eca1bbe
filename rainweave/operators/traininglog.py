"""Analysis of training-log records: running best, early stop, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def analyse_training(epochs: DataFrame, keys: Sequence[str], patience: int = 3) -> DataFrame:
    """Per epoch: best loss so far, strict new best, epochs since the last loss at or under the best.

    ``stop`` is true from the first epoch whose counter reaches the patience. A run has at most
    some hundred epochs, so one window per run is small.
    """
    upto = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.min("val_loss").over(before)
    marked = epochs.withColumns(
        {
            "best_val_so_far": F.min("val_loss").over(upto),
            "new_best": F.coalesce(F.col("val_loss") < best_before, F.lit(True)),
        }
    )
    reset = F.when(F.col("val_loss") <= F.col("best_val_so_far"), F.col("epoch"))
    counted = marked.withColumn("stale", F.col("epoch") - F.max(reset).over(upto))
    return counted.withColumn("stop", F.max((F.col("stale") >= patience).cast("int")).over(upto) == 1)


def summarise_training(analysed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Epochs run, best loss and its epoch, and where the run stopped (NULL: it did not)."""
    first_stop = analysed.where("stop").groupBy(*keys).agg(F.min("epoch").alias("stop_epoch"))
    ran = analysed.join(first_stop, list(keys), "left").where(
        F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))
    )
    return ran.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.min("val_loss").alias("best_val_loss"),
        F.max(F.when(F.col("new_best"), F.col("epoch"))).alias("best_epoch"),
        F.max("stop_epoch").alias("stop_epoch"),
    )
