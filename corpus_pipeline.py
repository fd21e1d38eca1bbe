"""From raw documents to a weighted mix: quality rules, near duplicates, benchmark passages, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage as Parquet below ``spark.checkpoint.dir`` and goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.llm import decontamination, mixing, ngram_join, quality_rules, secrets
from rainweave.session import checkpointed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    judged = quality_rules.apply_rules(docs)
    return judged.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; documents without words stay,
    and so do rows without an id. Equal rows become one; only rows whose id repeats are compared whole."""
    found = ngram_join.ngram_components(docs).where("component_id != doc_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id", F.lit(True).alias("_again"))
    marked = kept.join(checkpointed(repeated), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    single, several = (marked.where(c).select(*docs.columns) for c in ("_again is null", "_again"))
    return single.unionByName(several.dropDuplicates())


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return _counted(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return _counted(secrets.redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with how many words of each it takes (``taken``); those that it leaves out go."""
    return mixing.mix_rows(docs).where("taken > 0")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("secret_scan", secret_spans),
    ("source_mix", mixture),
]

# components of near copies need a recursion over all pairs; tests compare run() with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
