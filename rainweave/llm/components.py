"""Connected components of links between integer ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.session import checkpointed

HUBS = 1000  # a node with more than this part of all rows is a hub, so there are fewer hubs than this
SPREAD = 64  # tasks over which the rows of one hub are dealt


def with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (v, u) with ``low``, the least u of each v; ``total`` is at least their number.

    Hubs get theirs from a broadcast of fewer than ``HUBS`` rows and are dealt over many keys of the join that
    serves the others, so no task gathers the rows of a hub and no row is copied.
    """
    least = rows.groupBy("v").agg(F.min("u").alias("low"), F.count(F.lit(1)).alias("n"))
    limit = max(2, total // HUBS)
    hubs = least.where(F.col("n") > limit).select("v", F.col("low").alias("hub_low"))
    # 0 in every row, but no literal: Spark would turn that into a condition and deal all rows by v alone
    others = least.where(F.col("n") <= limit).select("v", (F.col("n") > limit).cast("int").alias("part"), "low")
    dealt = F.when(F.col("hub_low").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("u"), F.lit(SPREAD)).cast("int"))
    marked = rows.join(F.broadcast(hubs), "v", "left").withColumn("part", dealt)
    return marked.join(others, ["v", "part"], "left").select("v", "u", F.coalesce("hub_low", "low").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): every linked id with the smallest id it reaches.

    ``links`` has two BIGINT columns ``a`` and ``b``. Each round hangs the larger neighbours of a
    node, then the smaller ones, below its smallest neighbour, until the links are stars around the
    smallest ids. Rounds grow with the logarithm of the longest chain. A hub's neighbours are never
    gathered: its minimum is an aggregate, and the join with it is split (``with_least``).
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    links, seen = checkpointed(links), None
    total = links.count()
    while True:
        both = links.select("v", "u").union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = with_least(both, 2 * total).where("u > v").select(F.col("u").alias("v"), F.least("low", "v").alias("u")).distinct()
        small = (
            with_least(large, total)
            .select(F.when(F.col("u") == F.col("low"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("low").alias("u"))
            .distinct()
        )
        links = checkpointed(small)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, total = state, state[0]
    roots = links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
