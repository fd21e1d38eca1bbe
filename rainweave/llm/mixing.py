"""Mixing sources to target weights: hash thresholds from nested histograms, without a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.llm.text import count_spaced_words
from rainweave.operators.partitioned import row_position
from rainweave.session import checkpointed

HASH_BITS = 60
LEVEL_BITS = 10  # buckets per source and level: 1024
WEIGHTS = (3, 1, 2)  # repeating over the sources in order
SHARE = 1.5  # of all sizes
MOST = 2  # times a document may be taken


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``name`` and ``missing`` (the source, NULL apart), ``size`` in words, ``h`` (60-bit hash of the id), and the columns to ``keep``."""
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return docs.select(
        *keep, F.col(id_column).alias("doc_id"),
        F.coalesce(source_column, F.lit("")).alias("name"), F.col(source_column).isNull().alias("missing"),
        count_spaced_words(F.col(text_column)).alias("size"),
        F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``name``, ``missing``, ``source_size``, ``target``: the budget dealt by weight, each source at most ``most`` times its size.

    Sources in code point order, NULL last, take the weights in turn. What a full source can't
    take is dealt to the others by weight again; each round sums one small row.
    """
    sources = sized.groupBy("name", "missing").agg(F.sum("size").alias("source_size"))
    ranked = row_position(sources, [], F.struct("missing", F.substring("name", 1, 4).alias("head")), ["missing", "name"], "rank")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    ranked = checkpointed(ranked.select("name", "missing", "source_size", weight.alias("weight")))
    total, weight_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, full, level, state = share * (total or 0), F.lit(False), 0.0, (0, weight_sum or 1)
    while True:
        level = (budget - state[0]) / state[1]
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
        found = ranked.agg(F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if found[1] is None or tuple(found) == state:
            break
        state = tuple(found)
    target = F.when(full, most * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("name", "missing", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole passes, and where the hash order is cut for one more pass.

    A histogram of tokens by hash bucket gives the bucket in which the budget ends; only the documents
    of that bucket are counted again with the next bits. ``prefix`` (of ``bits`` bits) is the last
    boundary bucket, ``below`` the tokens before it, ``inside`` its tokens, ``members`` its documents.
    """
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    state = checkpointed(goals.select(
        "*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.col("source_size").alias("inside"), F.lit(2).cast("long").alias("members")))
    bits = 0
    while bits < HASH_BITS and state.where("members > 1").limit(1).count():
        shift = HASH_BITS - bits
        bits += LEVEL_BITS
        bucket = F.shiftrightunsigned("h", HASH_BITS - bits)
        edge = sized.join(state, ["name", "missing"]).where(F.shiftrightunsigned("h", shift) == F.col("prefix") if shift < 64 else F.lit(True))
        counted = edge.groupBy("name", "missing", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs"))
        upto = F.sum("tokens").over(Window.partitionBy("name", "missing").orderBy("bucket"))
        ends = (
            counted.withColumn("upto", upto).join(state.select("name", "missing", "below", "rest"), ["name", "missing"])
            .where(F.col("below") + F.col("upto") > F.col("rest"))
            .groupBy("name", "missing").agg(F.min(F.struct("bucket", "upto", "tokens", "docs")).alias("end"))
        )
        state = checkpointed(
            state.join(ends, ["name", "missing"], "left").select(
                "name", "missing", "source_size", "target", "passes", "rest",
                F.coalesce("end.bucket", F.lit(-1)).alias("prefix"),
                (F.col("below") + F.coalesce(F.col("end.upto") - F.col("end.tokens"), F.lit(0))).alias("below"),
                F.coalesce("end.tokens", F.lit(0)).alias("inside"), F.coalesce("end.docs", F.lit(0)).alias("members"),
            ))
    return state.withColumn("bits", F.lit(bits))


def taken_words() -> Column:
    """Words taken of a row of ``sizes`` joined with its source's ``thresholds``."""
    bucket = F.expr(f"shiftrightunsigned(h, {HASH_BITS} - bits)")
    gap = F.col("rest") - F.col("below")
    on_cut = (
        F.when(F.col("members") == 1, F.when(F.col("inside") - gap < gap, F.col("size")).otherwise(0))
        .when(F.col("inside") > 0, F.floor(F.col("size") * gap / F.col("inside"))).otherwise(0)
    )
    more = F.when(F.col("prefix") < 0, F.col("size")).when(bucket < F.col("prefix"), F.col("size")).when(bucket == F.col("prefix"), on_cut).otherwise(0)
    return (F.col("passes") * F.col("size") + F.when(F.col("rest") > 0, more).otherwise(0)).cast("long")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` for every row of ``docs``.

    Documents with a hash before the cut are taken once more than the whole passes. The document on the cut
    is taken if that brings the source nearer to its target. Where several rows share the hash on the
    cut (equal ids), each gives the same share of its words. A NULL text has size 0, a NULL source is
    a source of its own. Equal input gives equal output however it is partitioned.
    """
    sized = checkpointed(sizes(docs, id_column, text_column, source_column))
    cuts = thresholds(sized, targets(sized, weights, share, most))
    return sized.join(cuts, ["name", "missing"]).select(
        "doc_id", F.when(~F.col("missing"), F.col("name")).alias("source"), "size", "source_size", "target", taken_words().alias("taken"))


def mix_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``source_size``, ``target``, ``taken`` as ``mix`` has them.

    A row knows from its hash and its source's threshold alone how much of it is taken: texts are filtered in place,
    without a sort or a join of documents. A column of ``docs`` with the name of a new one is replaced.
    """
    sized = checkpointed(sizes(docs, id_column, text_column, source_column))
    cuts = thresholds(sized, targets(sized, weights, share, most))
    own = sizes(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[
        F.col(f"`{c}`").alias(n) for c, n in ((id_column, "_id"), (text_column, "_text"), (source_column, "_source"))]), "_id", "_text", "_source", keep=["row"])
    new = ["size", "source_size", "target"]
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (*new, "taken")]
    return own.join(cuts, ["name", "missing"]).select(*rest, *new, taken_words().alias("taken"))
