"""The microwave-link chain on a stream: wet flags, baselines and wet-antenna attenuation per link.

The state of a link holds the rows that still wait for the watermark, those that wait for the second half of
their window, as many values before them as the first half has, the last ``n`` baselines, and the last wet-antenna
value: its size follows the window and the allowed lateness, not the length of the series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from rainweave.operators.links import rain_from_levels

STATE = (
    "position long, before array<double>, times array<long>, levels array<double>, held_times array<long>, held_levels array<double>, "
    "baselines array<double>, wet boolean, waa double, known boolean"
)


def _flags(values: np.ndarray, context: int, rows: int, before: int, after: int, threshold: float) -> np.ndarray:
    """Wet flags of ``rows`` values after ``context`` ones; a window that is cut off or has gaps is not wet."""
    flags = np.zeros(rows, dtype=bool)
    size = before + after + 1
    if len(values) >= size:
        with np.errstate(invalid="ignore"):
            wide = np.lib.stride_tricks.sliding_window_view(values, size).std(axis=1) > threshold
        centre = np.arange(len(wide)) + before - context
        inside = (centre >= 0) & (centre < rows)
        flags[centre[inside]] = wide[inside]
    return flags


def wet_chain_stream(stream: DataFrame, key: str, time: str, value: str, late: str = "30 minutes", close_after_minutes: int = 1440,
                     window: int = 60, threshold: float = 0.8, n: int = 5, waa_max: float = 2.2, delta_t: float = 1.0, tau: float = 15.0) -> DataFrame:
    """``key``, ``time``, ``position``, ``value``, ``wet``, ``baseline``, ``waa`` of a stream of link samples, in append mode.

    Equal to ``flag_wet``, ``baseline_constant`` and ``wet_antenna_schleiss`` on whole series, however it is cut into
    micro-batches. A row is taken once the watermark (``late`` behind the newest time) has passed it, in order of time, and given out
    when its window is complete. More than ``close_after_minutes`` without a row end a series: its last
    rows come out with incomplete windows, its state goes, and the next row of the link starts a new series. Rows behind the
    watermark are dropped, and so are times up to 1970, where watermarks begin. Equal times are ordered by value. NaN and NULL values are missing; rows without a time or key are dropped.
    One link's rows of a micro-batch are in memory at once; bound them with ``maxFilesPerTrigger``.
    """
    factor = 1.0 - 3.0 * delta_t / tau
    if not 0.0 <= factor < 1.0:
        raise ValueError("3 * delta_t / tau must be above 0 and at most 1")
    before, after = window // 2, window - window // 2 - 1
    close_us = close_after_minutes * 60_000_000
    if window < 3:
        raise ValueError("a window needs rows on both sides")
    kind = stream.schema[key]
    out = StructType([StructField(key, kind.dataType)]).add("_us", "long").add("position", "long").add(value, "double").add("wet", "boolean").add("baseline", "double").add("waa", "double")

    def chain(position: int, levels: np.ndarray, flags: np.ndarray, line: list[float], wet_before: bool, waa: float, known: bool):
        """Baselines and wet-antenna values of rows in order; NaN is unknown."""
        bases, antennas = np.empty(len(levels)), np.empty(len(levels))
        for k, (level, wet) in enumerate(zip(levels.tolist(), flags.tolist())):
            at = position + k
            if at < n or not wet:
                base = level
            else:
                base = line[-1] if wet_before else sum(line) / n
            line = [*line, base][-n:]
            top = 0.0 if at == 0 else min(level - base, waa_max) if level - base == level - base else float("nan")
            if at == 0 or not wet or top != top or not known:
                waa = top
            else:
                waa = min(top, waa_max + (waa - waa_max) * factor)
            known, wet_before = top == top, wet
            bases[k], antennas[k] = base, waa
        return bases, antennas, line, wet_before, waa, known

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            position, context, times, levels, held_times, held_levels, line, wet, waa, known = state.get
        else:
            position, context, times, levels, held_times, held_levels, line, wet, waa, known = 0, [], [], [], [], [], [], False, 0.0, False
        passed = max(0, state.getCurrentWatermarkMs())
        parts = [(np.asarray(held_times, dtype=np.int64), np.asarray(held_levels, dtype=float))]
        parts += [(b["_us"].to_numpy(np.int64), b[value].to_numpy(float)) for b in batches]
        us, fresh = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((fresh, us))
        us, fresh = us[order], fresh[order]
        ready = us <= passed * 1000
        times = np.concatenate([np.asarray(times, dtype=np.int64), us[ready]])
        levels = np.concatenate([np.asarray(levels, dtype=float), fresh[ready]])
        us, fresh = us[~ready], fresh[~ready]
        over = bool(len(times)) and passed * 1000 > times[-1] + close_us and (not len(us) or us[0] > times[-1] + close_us)
        series = np.split(np.arange(len(times)), np.flatnonzero(np.diff(times) > close_us) + 1)
        for number, own in enumerate(series):
            ended = over or number + 1 < len(series)
            rows = len(own) if ended else max(0, len(own) - after)
            values = np.concatenate([np.asarray(context, dtype=float), levels[own]])
            flags = _flags(values, len(context), rows, before, after, threshold)
            bases, antennas, line, wet, waa, known = chain(position, levels[own[:rows]], flags, list(line), bool(wet), waa, bool(known))
            if rows:
                yield pd.DataFrame({key: [name[0]] * rows, "_us": times[own[:rows]], "position": np.arange(position, position + rows), value: levels[own[:rows]],
                                    "wet": flags, "baseline": bases, "waa": antennas}).astype({key: "object"})
            position, context = position + rows, values[:len(context) + rows][max(0, len(context) + rows - before):].tolist()
            times_left, levels_left = times[own[rows:]], levels[own[rows:]]
            if ended:
                position, context, line, wet, waa, known = 0, [], [], False, 0.0, False
        if over and not len(us):
            state.remove()
            return
        state.update((position, context, times_left.tolist(), levels_left.tolist(), us.tolist(), fresh.tolist(), line, wet, float(waa), known))
        due = int(us[0]) if len(us) else int(times_left[-1]) + close_us
        state.setTimeoutTimestamp(max(due // 1000, passed + 1))

    sized = stream.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late)
    sized = sized.select(key, time, F.unix_micros(time).alias("_us"), F.col(value).cast("double").alias(value))
    done = sized.groupBy(key).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def missing(c: str):
        return F.nanvl(c, F.lit(None).cast("double")).alias(c)

    return done.select(key, F.timestamp_micros("_us").alias(time), "position", missing(value), "wet", missing("baseline"), missing("waa"))


def link_rain_stream(stream: DataFrame, links: DataFrame, key: str = "link_id", time: str = "time", value: str = "trsl", **settings) -> DataFrame:
    """Rain rate of a stream of link samples: the chain above, then the columns of ``link_rain`` by a join with the links.

    The join is a sort-merge join: Spark has no size for what leaves the state, takes it for tiny, and would
    broadcast all rows of a micro-batch through the driver.
    """
    return rain_from_levels(wet_chain_stream(stream, key, time, value, **settings).hint("merge"), links, value)
