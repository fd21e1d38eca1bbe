"""Ordered computations that never need one whole series in one task.

One key (a link, a station, a timestamp) may hold a large part of all rows, so a plain
``Window.partitionBy(key).orderBy(time)`` can end up as a single huge task. The helpers here
work in two levels instead: rows are windowed inside bounded slices of a key, each slice is
reduced to one summary row, the summaries are scanned in order, and the result is joined back.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.session import checkpointed


def ranged_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """``df`` with ``_block``: the order cut into runs of about equal size, one task each.

    Written once: the cuts come from samples, and a recomputed task must not find others. Rows of equal order stay together.
    """
    count = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(count, *order).withColumn("_block", F.spark_partition_id()))


_ALL_BEFORE = (Window.unboundedPreceding, -1)


def _sum_before(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of a table of summaries.

    With keys the summaries of one key are scanned in one go. Without, there is a third level: they are cut into blocks,
    and only the sums of the blocks are scanned in one task.
    """
    if keys:
        so_far = F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*_ALL_BEFORE))
        return df.withColumn(out, F.coalesce(so_far, F.lit(0)))
    blocked = ranged_blocks(df, [order])
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    sums = sums.select("_block", F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(*_ALL_BEFORE)).alias("_earlier"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(*_ALL_BEFORE))
    joined = blocked.withColumn("_inside", inside).join(sums, "_block")
    return joined.withColumn(out, F.coalesce("_earlier", F.lit(0)) + F.coalesce("_inside", F.lit(0))).drop("_block", "_inside", "_earlier")


def _last_before(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, ahead: bool = False) -> DataFrame:
    """Last non-NULL ``value`` of the rows before each row of a table of summaries; the next one behind it with ``ahead``."""

    def by(c: str) -> Column:
        return F.col(c).desc() if ahead else F.col(c)

    def last(c: str, part: Sequence[str], along: str) -> Column:
        return F.last(c, ignorenulls=True).over(Window.partitionBy(*part).orderBy(by(along)).rowsBetween(*_ALL_BEFORE))

    if keys:
        return df.withColumn(out, last(value, keys, order))
    blocked = ranged_blocks(df, [order]).withColumn("_lit", F.lit(0))
    known = F.when(F.col(value).isNotNull(), F.col(order))
    ends = blocked.groupBy("_block", "_lit").agg((F.min_by if ahead else F.max_by)(value, known).alias("_end"))
    ends = ends.select("_block", last("_end", ["_lit"], "_block").alias("_far"))
    joined = blocked.withColumn("_near", last(value, ["_block"], order)).join(ends, "_block")
    return joined.withColumn(out, F.coalesce("_near", "_far")).drop("_block", "_lit", "_near", "_far")


def nearest_known(df: DataFrame, order: str, value: str, out: str, ahead: bool = False) -> DataFrame:
    """Last non-NULL ``value`` before each row of one line of unique ``order``; the next one behind it with ``ahead``."""
    return _last_before(df, [], order, value, out, ahead)


def row_position(
    df: DataFrame, keys: Sequence[str], coarse: Column, order: Sequence, out: str = "pos"
) -> DataFrame:
    """0-based position of every row in its key's order.

    ``coarse`` must be non-decreasing along ``order`` (a date, a leading part of the sort key);
    only rows of one (key, coarse) slice are sorted together. Keys must not be NULL.
    """
    part = [*keys, "_coarse"]
    sliced = df.withColumn("_coarse", coarse)
    offsets = _sum_before(sliced.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")), keys, "_coarse", "_n", "_offset").drop("_n")
    inner = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    return (
        sliced.withColumn("_inner", inner)
        .join(offsets, part)
        .withColumn(out, (F.col("_offset") + F.col("_inner")).cast("long"))
        .drop("_coarse", "_inner", "_offset")
    )


def carry_last(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: str, value: Column, out: str
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row (forward fill), across chunk borders.

    ``chunk`` must be non-decreasing along ``order``.
    """
    part = [*keys, "_chunk"]
    marked = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inside = F.last("_value", ignorenulls=True).over(
        Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    tails = marked.groupBy(*part).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_tail"))
    carried = _last_before(tails, keys, "_chunk", "_tail", "_carried").drop("_tail")
    return (
        marked.withColumn("_inside", inside)
        .join(carried, part)
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_chunk", "_value", "_inside", "_carried")
    )


def next_row(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: str, payload: Column, out: str, previous: str | None = None
) -> DataFrame:
    """``payload`` of the following row of the same key, NULL on the last row.

    With ``previous`` also the payload of the row before, under that name.
    """
    part = [*keys, "_chunk"]
    marked = df.withColumn("_chunk", chunk).withColumn("_payload", payload)
    line = Window.partitionBy(*part).orderBy(order)
    # wrapped, so that an unknown payload is not taken for a missing row
    ends = marked.groupBy(*part).agg(*[F.struct(f("_payload", order).alias("v")).alias(c) for c, f in (("_head", F.min_by), ("_tail", F.max_by))])
    around = _last_before(ends, keys, "_chunk", "_head", "_next_head", ahead=True)
    if previous is not None:
        around = _last_before(around, keys, "_chunk", "_tail", "_last_tail")
    else:
        around = around.withColumn("_last_tail", F.lit(None).cast(around.schema["_tail"].dataType))
    around = around.select(*part, F.col("_next_head.v").alias("_follow"), F.col("_last_tail.v").alias("_lead_in"))
    joined = marked.withColumns({"_lead": F.lead("_payload").over(line), "_lag": F.lag("_payload").over(line)}).join(around, part)
    joined = joined.withColumn(out, F.coalesce("_lead", "_follow"))
    if previous is not None:
        joined = joined.withColumn(previous, F.coalesce("_lag", "_lead_in"))
    return joined.drop("_chunk", "_payload", "_lead", "_lag", "_follow", "_lead_in")


def with_halo(
    df: DataFrame, position: str, length: int, before: int, after: int, chunk: str = "chunk"
) -> DataFrame:
    """Give every row its chunk, plus copies of border rows to the neighbour chunks.

    A frame ``rowsBetween(-before, after)`` evaluated inside (key, chunk) is then complete on
    the rows where ``core`` is true. Positions must be contiguous per key.
    """
    if length < max(before, after):
        raise ValueError("chunk length must cover the frame")
    own = F.floor(F.col(position) / F.lit(length))
    offset = F.col(position) - own * length
    chunks = F.array_compact(
        F.array(
            own,
            F.when(offset < after, own - 1),
            F.when(F.lit(length) - offset <= before, own + 1),
        )
    )
    return df.withColumn(chunk, F.explode(chunks)).withColumn("core", F.col(chunk) == own)


def ordered_code(value: Column) -> Column:
    """BIGINT in the order of the doubles: exponent and fraction as they stand in the number, negative for negative ones.

    Different finite numbers have different codes; both zeros have the code 0, infinities lie outside all others.
    """
    size = F.abs(value)
    power = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))), F.lit(-1022)).cast("double")

    def two_to(exponent: Column) -> Column:
        return F.pow(F.lit(2.0), exponent)

    # the logarithm may miss a power of two by its last bit
    power = F.when((size < two_to(power)) & (power > -1022), power - 1).when((power < 1023) & (size >= two_to(power + 1)), power + 1).otherwise(power)
    fraction = ((size / two_to(power) - 1.0) * float(1 << 52)).cast("long")
    code = (power + 1023).cast("long") * F.lit(1 << 52) + fraction
    code = F.when(size == float("inf"), F.lit(2047 << 52)).when(size == 0, F.lit(0).cast("long")).otherwise(code)
    return F.when(value < 0, -code).otherwise(code)


RADIX = (48, 36, 24, 12, 0)  # bits left below the digits of each pass: 16 bits first, then 12 more each time
FEW = 1 << 16  # distinct values of a bucket that are sorted in one task


def _counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values ``_v`` per key with their counts ``_c``; NULL and NaN are missing."""
    number = F.col(value).cast("double")
    return df.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys, number.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per key; NULL and NaN are missing.

    Radix selection over the ordered bits of the values: counts by the leading bits tell in which bucket a rank lies, and only the
    values of such buckets are looked at again, with 12 more bits, until a bucket has few distinct values. No
    pass scans more than 2^16 buckets of a key in one task, however close together the values lie.
    """
    counts = checkpointed(_counted(df, keys, value).withColumn("_code", ordered_code(F.col("_v"))))
    asked = [rank for p in probs.values() for rank in (F.floor((F.col("_total") - 1) * F.lit(float(p))), F.ceil((F.col("_total") - 1) * F.lit(float(p))))]
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), r.cast("long").alias("_rank")) for i, r in enumerate(asked)])
    state = counts.groupBy(*keys).agg(F.sum("_c").alias("_total")).where("_total > 0").select(*keys, "_total", F.inline(ranks), F.lit(0).cast("long").alias("_p"))
    part, shift = [*keys, "_p"], None
    for left in RADIX:
        parent = F.lit(0).cast("long") if shift is None else F.shiftright("_code", shift)
        scope = counts.withColumn("_p", parent)
        if shift is not None:
            scope = scope.join(state.select(*part).distinct(), part, "left_semi")
        buckets = scope.groupBy(*part, F.shiftright("_code", left).alias("_b")).agg(F.sum("_c").alias("_m"), F.count(F.lit(1)).alias("_d"))
        upto = F.sum("_m").over(Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        before = F.col("_upto") - F.col("_m")
        state = checkpointed(
            state.join(buckets.withColumn("_upto", upto), part).where((F.col("_rank") >= before) & (F.col("_rank") < F.col("_upto")))
            .select(*keys, "_total", "_i", (F.col("_rank") - before).alias("_rank"), F.col("_b").alias("_p"), "_d")
        )
        shift = left
        if (state.agg(F.max("_d")).first()[0] or 0) <= FEW:
            break
        state = state.drop("_d")
    fine = counts.withColumn("_p", F.shiftright("_code", shift)).join(state.select(*part).distinct(), part, "left_semi")
    end = F.sum("_c").over(Window.partitionBy(*part).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = state.join(fine.withColumn("_end", end), part).where((F.col("_rank") >= F.col("_end") - F.col("_c")) & (F.col("_rank") < F.col("_end")))
    picked = found.groupBy(*keys).agg(F.max("_total").alias("_total"), *[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_q{i}") for i in range(len(asked))])
    columns = []
    for k, (name, p) in enumerate(probs.items()):
        place = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_q{2 * k}"), F.col(f"_q{2 * k + 1}")
        columns.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*keys, *columns)


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Distinct values of a column with their average rank among all rows (ties share); NULL and NaN are missing."""
    ranked = _sum_before(_counted(df, [], value), [], "_v", "_c", "_start")
    return ranked.select(F.col("_v").alias(value), (F.col("_start") + (F.col("_c") + 1) / 2).alias(out))


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 8
) -> DataFrame:
    """Equi-join that spreads a hot key of ``big`` over ``salts`` tasks.

    ``small`` holds one row per key and is copied ``salts`` times.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def decay_horizon(factor: float, precision: float = 1e-17) -> int:
    """Number of steps after which ``factor**steps`` is below double precision."""
    if factor <= 0:
        return 1
    return max(1, math.ceil(math.log(precision) / math.log(factor)))
