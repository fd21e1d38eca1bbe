"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.llm import centroids, chat, collocations, compression, decontamination, html_text, licenses, mixing, ngram_join, pii, quality_rules, secrets
from rainweave.llm import sql as twins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def span_text(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, folder, "documents"))


@query("op2_contextual_pii")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    base = pii.span_text("spans")
    return found.select(
        "doc_id", *[count(k) for k in range(len(pii.KINDS))],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, pii.span_text("found", "context_")), ",").alias("spans"),
    )


@query("op3_secret_scan", twins.SECRETS)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    basic = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(k) for k in base],
        F.sha2(span_text(basic), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


@query("op4_quality_classifier")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return compression.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return compression.identify_language(table(spark, folder, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    words = F.transform("places", lambda p: p["word"])
    return licenses.scan_licenses(table(spark, folder, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"), F.array_max(words).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query("op7_source_mix", twins.MIX)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_chat_windows")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


@query("op9_decontamination", twins.DECONTAMINATION)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hits = decontamination.hit_words()
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("words").cast("long").alias("n_words"),
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


@query("op10_quality_rules", twins.QUALITY)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, folder, "documents"))
    base = F.arrays_overlap("failed_rules", F.array(*[F.lit(n) for n in quality_rules.BASE]))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept",
    )


@query("op11_phrase_collocations", twins.COLLOCATIONS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query("op12_centroid_clusters", twins.CENTROIDS)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings")).drop("centroid")


@query("op13_main_text")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))
