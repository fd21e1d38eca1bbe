"""Session construction and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "rainweave", **conf) -> SparkSession:
    """Session with the settings the operators rely on.

    No broadcast threshold is raised: small sides are broadcast by Spark only when their
    measured size is under ``spark.sql.autoBroadcastJoinThreshold``; adaptive execution does
    the same at run time and splits skewed join partitions otherwise.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A folder is made here only for a local master without that setting; on a cluster the
    setting is required, since a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="rainweave-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame, **options) -> DataFrame:
    """Write the table to the checkpoint folder and go on from there.

    For results that are read several times or in a loop: the lineage is cut, lost executors
    cost no recomputation, and later reads prune columns. One pass, unlike ``checkpoint()``,
    which runs the last stage twice. ``options`` go to the writer.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/rainweave-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
