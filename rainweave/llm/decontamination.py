"""Benchmark decontamination: a broadcast hash set of item n-grams probed by document windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.llm.text import lettered_words, row_key, settled
from rainweave.session import checkpointed

WINDOW = 10
BROADCAST_BYTES = 64 << 20  # of the hash set, 16 bytes a window; a larger one is joined by shuffle


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``h``, ``length``, ``gram``, ``items``: every distinct window of the items with the items that have it.

    An item with fewer words than ``window``, but not none, is one window. NULL texts have no windows.
    """
    words = benchmark.select(F.col(item_column).alias("item_id"), lettered_words(F.col(text_column)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    grams = words.select("item_id", F.explode(runs).alias("gram"))
    return grams.groupBy("gram").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(
        F.xxhash64("gram").alias("h"), F.size("gram").alias("length"), "gram", "items")


def window_hits(keyed: DataFrame, windows: DataFrame) -> DataFrame:
    """``key``, ``hits``: positions (from 1) of document windows whose hash is in the set, with the item's words."""
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most one per window length
    if not lengths:
        return windows.select(F.col("h").alias("key"), F.lit(None).cast("array<struct<pos:int,length:int,gram:array<string>,items:array<bigint>>>").alias("hits")).limit(0)
    known = windows.select("h").distinct()
    if 16 * known.count() <= BROADCAST_BYTES:
        known = F.broadcast(known)

    def hashes(length: int) -> Column:
        places = F.sequence(F.lit(1), F.size("words") - (length - 1))
        return F.when(F.size("words") >= length, F.transform(places, lambda i: F.xxhash64(F.slice("words", i, length)))).otherwise(F.array().cast("array<bigint>"))

    # all lengths in one pass: the places of the shorter windows come first, so the length of a hit tells its place
    probes = keyed.select("key", F.size("words").alias("n"), F.posexplode(F.concat(*map(hashes, lengths))).alias("at", "h"))
    found = probes.join(known, "h").distinct()
    shorter = sum((F.when(F.col("length") > k, F.greatest(F.col("n") - (k - 1), F.lit(0))).otherwise(0) for k in lengths), F.lit(0))
    placed = found.join(windows, "h").withColumn("pos", F.col("at") - shorter + 1).where("pos between 1 and n - length + 1")
    return placed.groupBy("key").agg(F.collect_list(F.struct("pos", "length", "gram", "items")).alias("hits"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text",
         item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``words``, ``spans`` and ``items``.

    ``spans`` are the verified windows as (begin, end) in words from 0, end exclusive, merged and in
    order; ``items`` the distinct ids of items with an occurring window. Hash hits are compared word
    by word before they count. Repeated rows are each reported; items with a NULL id make hits but
    have no id to list. A benchmark without words makes no hits.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"))
    keyed = rows.select("row", row_key(*[F.col(f"row.`{c}`").cast("string") for c in docs.columns]).alias("key"))
    text = F.col(f"row.`{text_column}`").cast("string")
    windows = checkpointed(item_windows(benchmark, window, item_column, item_text_column))
    hits = window_hits(keyed.select("key", lettered_words(text).alias("words")), windows)
    joined = keyed.join(hits.withColumnRenamed("key", "hit_key"), F.col("key") == F.col("hit_key"), "left").select(
        "row", lettered_words(text).alias("words"), F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"))
    real = joined.select("row", "words", F.sort_array(F.filter("hits", lambda x: F.slice("words", x["pos"], x["length"]) == x["gram"])).alias("hits"))
    merged = F.aggregate(
        "hits",
        F.array().cast("array<struct<begin:int,end:int>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["pos"] - 1),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["begin"].alias("begin"), F.greatest(F.element_at(out, -1)["end"], x["pos"] - 1 + x["length"]).alias("end"))),
            ),
        ).otherwise(F.concat(out, F.array(F.struct((x["pos"] - 1).alias("begin"), (x["pos"] - 1 + x["length"]).alias("end"))))),
    )
    items = F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))
    return real.select("row", "words", merged.alias("spans"), items.alias("items"))


def hit_words(spans: str | Column = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def cleaned_text(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans``; all other characters stay."""
    piece = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word before lower-casing
    words, gaps = F.regexp_extract_all(text, F.lit(piece), 0), F.split(text, piece, -1)
    kept = F.transform(words, lambda w, i: F.when(F.exists(spans, lambda s: (s["begin"] <= i) & (i < s["end"])), F.lit("")).otherwise(w))
    return F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, window: int = WINDOW, text_column: str = "text") -> DataFrame:
    """``docs`` without benchmark passages: hit words are cut out, and a document of which more than
    ``drop_share`` of the words are hit goes. Clean documents stay as they are."""
    found = scan(docs, benchmark, window, text_column)
    text = F.col(f"row.`{text_column}`")
    kept = settled(found, "kept", hit_words() <= drop_share * F.size("words")).where("kept").select("row", "spans")
    return kept.select(*[
        (F.when(F.size("spans") > 0, cleaned_text(text, F.col("spans"))).otherwise(text) if c == text_column else F.col(f"row.`{c}`")).alias(c)
        for c in docs.columns
    ])
