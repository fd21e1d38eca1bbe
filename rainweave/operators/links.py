"""Microwave-link series: wet/dry flags, baselines, wet-antenna attenuation, rain.

Series are keyed rows with contiguous integer positions from 0. A link may hold a large part
of all rows, so every ordered step works in chunks of positions: frames that reach over a chunk
border use copied border rows, carried values go through per-chunk summaries, and recursions
use the fact that their memory decays below double precision after a known number of steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.functions.attenuation import link_polarisation, rain_rate, with_power_law
from rainweave.functions.rain import clamp_negative
from rainweave.operators.partitioned import carry_last, decay_horizon, next_row, row_position, with_halo
from rainweave.session import checkpointed

CHUNK = 4096
RUNS_PER_BLOCK = 2048


def _chunk(position: str) -> Column:
    return F.floor(F.col(position) / CHUNK)


def flag_wet(df: DataFrame, keys: Sequence[str], position: str, value: str, window: int = 60,
             threshold: float = 0.8, out: str = "wet") -> DataFrame:
    """Wet where the centred rolling population std exceeds the threshold.

    The frame is ``window`` rows, half before the row; incomplete frames and NULLs give False.
    """
    before, after = window // 2, window - window // 2 - 1
    frame = Window.partitionBy(*keys, "chunk").orderBy(position).rowsBetween(-before, after)
    spread = with_halo(df, position, max(CHUNK, window), before, after)
    full = F.count(value).over(frame) == window
    flagged = spread.withColumn(out, F.coalesce(full & (F.stddev_pop(value).over(frame) > threshold), F.lit(False)))
    return flagged.where("core").drop("chunk", "core")


def wet_borders(df: DataFrame, keys: Sequence[str], position: str, wet: str) -> DataFrame:
    """Flags on the dry rows around wet runs: ``is_start`` (next is wet), ``is_end`` (previous is wet)."""
    spread = with_halo(df, position, CHUNK, 1, 1)
    line = Window.partitionBy(*keys, "chunk").orderBy(position)
    dry = ~F.col(wet)
    marked = spread.withColumns(
        {
            "is_start": F.coalesce(F.lead(wet).over(line) & dry, F.lit(False)),
            "is_end": F.coalesce(F.lag(wet).over(line) & dry, F.lit(False)),
        }
    )
    return marked.where("core").drop("chunk", "core")


def wet_events(df: DataFrame, keys: Sequence[str], position: str, wet: str) -> DataFrame:
    """One row per wet run: first and last wet position and the number of samples."""
    spread = with_halo(df.select(*keys, position, wet), position, CHUNK, 1, 1)
    line = Window.partitionBy(*keys, "chunk").orderBy(position)
    first = F.col(wet) & ~F.coalesce(F.lag(wet).over(line), F.lit(False))
    last = F.col(wet) & ~F.coalesce(F.lead(wet).over(line), F.lit(False))
    edges = (
        spread.withColumns({"_first": first, "_last": last})
        .where("core")
        .select(
            *keys, position,
            F.explode(F.array_compact(F.array(F.when(F.col("_first"), 0), F.when(F.col("_last"), 1)))).alias("_kind"),
        )
        .withColumn("_order", F.col(position) * 2 + F.col("_kind"))
    )
    paired = next_row(edges, keys, F.floor(F.col("_order") / (2 * CHUNK)), "_order", F.col(position), "end_pos")
    return paired.where(F.col("_kind") == 0).select(
        *keys, F.col(position).alias("start_pos"), "end_pos", (F.col("end_pos") - F.col(position) + 1).alias("samples")
    )


def apply_in_blocks(df: DataFrame, keys: Sequence[str], position: str, fn: Callable[[pd.DataFrame], pd.DataFrame],
                    schema: str, block: int, lookback: int = 0) -> DataFrame:
    """Run a 1-D function over ordered series, block by block.

    ``fn`` gets rows sorted by position: up to ``lookback`` rows of context (``core`` false),
    then the block. Its result must keep ``position``; rows of the context are dropped.
    A function with unlimited memory needs its own carried state and does not fit here.
    """
    spread = with_halo(df, position, max(block, lookback), lookback, 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(position, ignore_index=True)
        result = fn(ordered)
        return result[result[position].isin(ordered.loc[ordered["core"], position])]

    return spread.groupBy(*keys, "chunk").applyInPandas(run, schema)


def baseline_constant(df: DataFrame, keys: Sequence[str], position: str, value: str, wet: str, n: int = 1,
                      wet_null: str = "wet", out: str = "baseline") -> DataFrame:
    """Dry rows keep their value; a wet run holds the mean of the ``n`` baseline values before it.

    The first n rows are raw. NULL wet counts as wet; ``wet_null='null'`` also blanks those rows.
    """
    if wet_null not in ("wet", "null"):
        raise ValueError("wet_null must be 'wet' or 'null'")
    is_wet = F.coalesce(F.col(wet), F.lit(True))
    raw = ~is_wet | (F.col(position) < n)
    if n > 1:
        df = checkpointed(df)  # read three times below
    # a struct keeps a NULL level apart from "no new level here"
    rows = df.withColumn("_level", F.when(raw, F.struct(F.col(value).alias("v"))))
    if n > 1:
        rows = rows.withColumn("_order", F.col(position) * 2 + 1).withColumn("_row", F.lit(True))
        starts = checkpointed(_run_levels(df, keys, position, value, is_wet, n)).select(
            *keys, F.col(position), (F.col(position) * 2).alias("_order"), F.struct(F.col("level").alias("v")).alias("_level")
        )
        rows = rows.unionByName(starts, allowMissingColumns=True)
    else:
        rows = rows.withColumn("_order", F.col(position)).withColumn("_row", F.lit(True))
    held = carry_last(rows, keys, _chunk(position), "_order", F.col("_level"), "_held").where("_row")
    level = F.col("_held.v")
    if wet_null == "null":
        level = F.when(F.col(wet).isNotNull(), level)
    return held.withColumn(out, level).select(*df.columns, out)


def _run_levels(df: DataFrame, keys: Sequence[str], position: str, value: str, is_wet: Column, n: int) -> DataFrame:
    """Level of every wet run at its first row, columns keys, position, level.

    Runs closer than n samples depend on the runs before them; the dependence shrinks by at
    least (n-1)/n per n samples, so blocks of runs with a bounded look-back are exact. An unknown
    level does not shrink: it is carried along the chain of dependent runs, however long.
    """
    spread = with_halo(
        df.select(*keys, position, F.col(value).alias("_v"), is_wet.alias("_wet")), position, CHUNK, n, 0
    )
    line = Window.partitionBy(*keys, "chunk").orderBy(position)
    previous_wet = F.lag("_wet").over(line)
    starts_here = F.col("_wet") & (F.col(position) >= n) & (~previous_wet | (F.col(position) == n))
    lags = {f"_v{j}": F.lag("_v", j).over(line) for j in range(1, n + 1)}
    holds = {f"_h{j}": F.lag("_wet", j).over(line) & (F.col(position) - j >= n) for j in range(1, n + 1)}
    # going back from a run, every stretch of held rows belongs to the next run further back
    back, own, refs = F.lit(0), F.lit(0.0), []
    for j in range(1, n + 1):
        hold, raw = F.col(f"_h{j}"), F.col(f"_v{j}")
        begins = hold if j == 1 else hold & ~F.col(f"_h{j - 1}")
        back = back + begins.cast("int")
        own = own + F.when(hold, F.lit(0.0)).otherwise(raw)
        refs.append(F.when(hold, back))
    # a run that crosses row n keeps the last raw row
    crossing = F.col("_crossing")
    runs = (
        spread.withColumns({"_start": starts_here, "_crossing": previous_wet, **lags, **holds})
        .where("core and _start")
        .select(
            *keys, position, F.col("_v1").alias("_guess"),
            F.when(crossing, F.col("_v1") * n).otherwise(own).alias("_own"),
            F.when(crossing, F.array().cast("array<int>")).otherwise(F.array_compact(F.array(*refs))).alias("_refs"),
        )
    )
    # a NULL or NaN in the frame makes a level unknown
    runs = runs.withColumn("_own", F.nanvl("_own", F.lit(None).cast("double")))
    numbered = row_position(checkpointed(runs), keys, _chunk(position), [position], "_number")
    # a run that depends on an earlier one depends on the run right before it, so unknown lasts until a run stands alone
    turn = F.when(F.col("_own").isNull(), True).when(F.size("_refs") == 0, False)
    numbered = carry_last(numbered, keys, F.floor(F.col("_number") / RUNS_PER_BLOCK), "_number", turn, "_unknown")
    lookback = -(-n // 2) * decay_horizon((n - 1) / n)
    block = with_halo(numbered, "_number", max(RUNS_PER_BLOCK, lookback), lookback, 0)
    ordered = block.groupBy(*keys, "chunk").agg(
        F.sort_array(F.collect_list(F.struct("_number", position, "core", "_own", "_guess", "_refs", "_unknown"))).alias("_runs")
    )

    def level_of(levels: Column, run: Column) -> Column:
        # before the look-back any finite level will do, and so it does in a chain that is unknown
        held = F.aggregate(
            run["_refs"], F.lit(0.0), lambda s, b: s + F.coalesce(F.get(levels, F.size(levels) - b), F.nanvl(run["_guess"], F.lit(0.0)), F.lit(0.0))
        )
        return F.coalesce((run["_own"] + held) / F.lit(float(n)), F.lit(0.0))

    levels = F.aggregate(
        "_runs", F.array().cast("array<double>"), lambda levels, run: F.concat(levels, F.array(level_of(levels, run)))
    )
    solved = ordered.select(*keys, F.explode(F.arrays_zip(F.col("_runs").alias("run"), levels.alias("level"))).alias("_r"))
    return solved.where("_r.run.core").select(
        *keys, F.col(f"_r.run.{position}").alias(position), F.when(~F.coalesce("_r.run._unknown", F.lit(False)), F.col("_r.level")).alias("level")
    )


def baseline_linear(df: DataFrame, keys: Sequence[str], position: str, value: str, wet: str,
                    ignore_null: bool = False, out: str = "baseline") -> DataFrame:
    """Straight line between the dry rows around each wet run.

    Row 0 is always an anchor. A wet run without a dry row after it stays 0. A NULL flag counts
    as wet and blanks its run with both anchors (the next run sets its left anchor again);
    with ``ignore_null`` it continues the state before it instead.
    """
    df = checkpointed(df)
    if ignore_null:
        known = F.when(F.col(position) == 0, F.lit(False)).otherwise(F.col(wet))
        flags = carry_last(df, keys, _chunk(position), position, known, "_state")
    else:
        flags = df.withColumn("_state", F.coalesce(F.col(wet), F.lit(True)))
    anchors = flags.where(~F.col("_state") | (F.col(position) == 0)).select(*keys, position, F.col(value).alias("_v"))
    if ignore_null:
        tainted = anchors.limit(0).select(*keys, position).withColumn("_taint", F.lit(True))
    else:
        opened = F.when(~F.col("_state") | (F.col(position) == 0), F.col(position))
        tainted = (
            carry_last(flags, keys, _chunk(position), position, opened, "_anchor")
            .where(F.col(wet).isNull() & (F.col(position) > 0))
            .select(*keys, F.col("_anchor").alias(position)).distinct().withColumn("_taint", F.lit(True))
        )
    marked = anchors.join(tainted, [*keys, position], "left").withColumn("_taint", F.coalesce("_taint", F.lit(False)))
    linked = next_row(
        marked, keys, _chunk(position), position,
        F.struct(F.col(position).alias("at"), F.col("_v").alias("v"), F.col("_taint").alias("taint")), "_next", "_before",
    )
    gap = F.col("_next.at") - F.col(position)
    rows = linked.withColumn(
        "_at", F.explode(F.sequence(F.col(position), F.coalesce(F.col("_next.at") - 1, F.col(position))))
    )
    line = F.col("_v") + (F.col("_next.v") - F.col("_v")) * (F.col("_at") - F.col(position)) / gap
    is_anchor = F.col("_at") == F.col(position)
    own_segment = F.coalesce(gap > 1, F.lit(False))
    level = (
        # what the segment before says about an anchor holds unless a run follows it
        F.when(own_segment & F.col("_taint"), F.lit(None).cast("double"))
        .when(is_anchor & ~own_segment & F.coalesce(F.col("_before.taint"), F.lit(False)), F.lit(None).cast("double"))
        # a line with an unknown end is unknown as a whole, also on its known anchor
        .when(is_anchor & ~own_segment, F.col("_v"))
        .otherwise(line)
    )
    lines = rows.select(*keys, F.col("_at").alias(position), F.struct(level.alias("v")).alias("_set"))
    return df.join(lines, [*keys, position], "left").select(
        *df.columns, F.when(F.col("_set").isNull(), F.lit(0.0)).otherwise(F.col("_set.v")).alias(out)
    )


def wet_antenna_schleiss(df: DataFrame, keys: Sequence[str], position: str, value: str, baseline: str, wet: str,
                         waa_max: float = 2.2, delta_t: float = 1.0, tau: float = 15.0, out: str = "waa") -> DataFrame:
    """Wet-antenna attenuation that rises towards ``waa_max`` while wet.

    The recursion ``w = min(A, M, w' + (M - w') 3 dt / tau)`` is a running minimum in closed
    form: ``w_i = M + min over the wet run of (c_k - M) factor**(i - k)``. The factor makes rows
    further back than the horizon vanish in double precision, so chunks with a halo are exact.
    A NULL attenuation gives NULL and the next row starts anew.
    """
    factor = 1.0 - 3.0 * delta_t / tau
    if not 0.0 <= factor < 1.0:
        raise ValueError("3 * delta_t / tau must be above 0 and at most 1")
    top = F.lit(float(waa_max))
    if factor == 0.0:
        horizon, length, power = 1, CHUNK, 1.0
    else:
        horizon = decay_horizon(factor)
        # keep factor**(-length - horizon) well inside the double range
        length = max(horizon, min(CHUNK, int(250 / -math.log10(factor)) - horizon))
        power = factor
    attenuation = F.col(value) - F.col(baseline)
    capped = F.when(F.col(position) == 0, F.lit(0.0)).otherwise(F.when(attenuation.isNotNull(), F.least(attenuation, top)))
    spread = with_halo(df.withColumn("_c", capped), position, length, horizon, 0)
    line = Window.partitionBy(*keys, "chunk").orderBy(position)
    anew = (
        (F.col(position) == 0) | ~F.coalesce(F.col(wet), F.lit(False)) | F.col("_c").isNull() | F.lag("_c").over(line).isNull()
    )
    runs = spread.withColumn("_anew", anew).withColumn(
        "_run", F.sum(F.col("_anew").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    if factor == 0.0:
        level = F.col("_c")
    else:
        step = (F.col(position) - F.col("chunk") * length).cast("double")
        scaled = (F.col("_c") - top) * F.pow(F.lit(power), -step)
        so_far = Window.partitionBy(*keys, "chunk", "_run").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        level = top + F.pow(F.lit(power), step) * F.min(scaled).over(so_far)
        # a run of one row is its own value, without the detour
        level = F.when(F.col("_anew"), F.col("_c")).otherwise(level)
    return (
        runs.withColumn(out, F.when(F.col("_c").isNotNull(), level)).where("core").select(*df.columns, out)
    )


def wet_fraction(df: DataFrame, link: str, time: str, wet: str) -> DataFrame:
    """Wet rows per distinct time; rows of both stations count, so it can reach 2."""
    per_time = df.groupBy(link, time).agg(F.count_if(F.col(wet)).alias("_w"))
    return per_time.groupBy(link).agg((F.sum("_w") / F.count(F.lit(1))).alias("wet_fraction"))


def link_rain(series: DataFrame, links: DataFrame, keys: Sequence[str], position: str, value: str, window: int = 60,
              threshold: float = 0.8, n: int = 5, waa_max: float = 2.2, delta_t: float = 1.0, tau: float = 15.0) -> DataFrame:
    """Signal loss to rain rate: wet flag, baseline, wet antenna, attenuation, power law.

    Adds wet, baseline, waa, attenuation and rain_rate.
    """
    flagged = flag_wet(series, keys, position, value, window, threshold)
    based = baseline_constant(flagged, keys, position, value, "wet", n)
    wetted = wet_antenna_schleiss(based, keys, position, value, "baseline", "wet", waa_max, delta_t, tau)
    return rain_from_levels(wetted, links, value)


def rain_from_levels(levels: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """Adds attenuation and rain_rate to rows with link_id, the level ``value``, baseline and waa."""
    loss = clamp_negative(F.col(value) - F.col("baseline") - F.col("waa"))
    law = with_power_law(
        links.withColumn("polarization", link_polarisation(F.col("polarization")))
    ).select("link_id", "length", "a", "b")
    return (
        levels.withColumn("attenuation", loss)
        .join(law, "link_id")
        .withColumn("rain_rate", rain_rate(F.col("attenuation"), F.col("length"), F.col("a"), F.col("b")))
        .drop("length", "a", "b")
    )
