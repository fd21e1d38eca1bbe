"""Writers: result tables and experiment records. Every task writes its own part files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the record kinds of an experiment log share one merged schema
LOG_SCHEMA = (
    "timestamp string, type string, epoch long, train_loss double, val_loss double, best_val_so_far double, "
    "new_best boolean, config string, total_training_time_sec double, best_validation_loss double, "
    "epochs_completed long, rmse double, pearson_r double, radar_grid_nodes long, grid_shape array<long>, "
    "radar_to_general_edges long, radar_to_rain_edges long, station_connection_radius_km double, "
    "grid_connection_radius_km double, _unreadable string"
)


def write_csv(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV with a header line per part file; partition columns become folders."""
    df.write.mode(mode).partitionBy(*partitions).csv(path, header=True)


def write_parquet(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, one folder per partition value (fold, date), so later reads can skip folders."""
    writer = df.repartition(*partitions) if partitions else df
    writer.write.mode(mode).partitionBy(*partitions).parquet(path)


def append_record(spark: SparkSession, path: str, record: Mapping) -> None:
    """Append one experiment record as a JSON line."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("append").text(path)


def append_records(df: DataFrame, path: str) -> None:
    """Append a table of records as JSON lines."""
    df.write.mode("append").json(path)


def read_experiment_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log; lines that are no JSON stay as ``_unreadable`` text."""
    return (
        spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_unreadable").json(path)
    )


def epoch_records(log: DataFrame) -> DataFrame:
    return log.where(F.col("epoch").isNotNull()).select("timestamp", "epoch", "train_loss", "val_loss", "best_val_so_far", "new_best")


def records_of(log: DataFrame, kind: str) -> DataFrame:
    """Records of a kind: model_config, training_summary or test_metrics."""
    return log.where(F.col("type") == kind)


def write_match(match, folder: str) -> None:
    """The remainders of a radar/weather match as CSV tables."""
    write_csv(match.radar_only, f"{folder}/unmatched_radar")
    write_csv(match.weather_only, f"{folder}/unmatched_weather")


def write_predictions(scored: DataFrame, folder: str) -> None:
    """Predictions by fold, and their false zeros."""
    write_csv(scored, f"{folder}/predictions", ["fold"])
    write_csv(scored.where("is_false_zero"), f"{folder}/false_zeros", ["fold"])
