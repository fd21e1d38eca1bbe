"""A table as a stream: its rows, cut along time, as files that a file stream reads in that order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.session import checkpoint_folder

FILES = 4  # of a slice, and of a micro-batch


def written_slices(df: DataFrame, slice_of: Column, slices: int, end: DataFrame) -> str:
    """Folder with the rows of slice 0, 1, ... and then those of ``end``, which lets the watermark pass all others.

    The rows of one slice may reach the stream in any order, so the stream must allow for the length of a slice.
    """
    folder = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/replay-{uuid.uuid4().hex}"
    for number in range(slices):
        df.where(slice_of == number).repartition(FILES).write.mode("append").parquet(folder)
    end.select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes]).coalesce(1).write.mode("append").parquet(folder)
    return folder


def read_slices(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def collected(stream: DataFrame) -> DataFrame:
    """Runs a stream in append mode over all that is there and returns what it wrote."""
    folder = f"{checkpoint_folder(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
