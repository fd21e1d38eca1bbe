"""Matching of two streams on time, with the remainders of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_streams(radar: DataFrame, weather: DataFrame, time: str = "time_sgt", keys: Sequence[str] = (),
                  late: str = "30 minutes", tolerance: str | None = None) -> DataFrame:
    """Matched rows of both streams and what remains of each, as ``match_times`` gives for batch tables.

    Result: ``part`` (``matched``, ``radar_only``, ``weather_only``), ``keys``, the time, and the other columns of both sides
    (NULL on the missing side; names must differ). Without ``tolerance`` times are equal; with it, equal ``keys``
    (at least one) and times that lie no further apart, and the weather time comes as ``weather_<time>``.

    Both sides have a watermark of ``late``; the slower one counts. A row without a partner is given out, once, when
    the watermark has passed the last time at which a partner could come, and leaves the state then, as matched rows do.
    Rows behind the watermark are dropped, and so are rows without a time or key, which no watermark could
    ever release. Several rows at one time multiply, as in the batch form.
    """
    if tolerance is not None and not keys:
        raise ValueError("a tolerance needs keys to join on")
    other = f"weather_{time}"
    known: Column = F.col(time).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    left = radar.where(known).withWatermark(time, late)
    right = weather.where(known).withWatermark(time, late).withColumnsRenamed({time: other, **{k: f"_weather_{k}" for k in keys}})
    on = F.lit(True) if keys else F.col(time) == F.col(other)
    for key in keys:
        on = on & (F.col(key) == F.col(f"_weather_{key}"))
    if keys and tolerance is None:
        on = on & (F.col(time) == F.col(other))
    elif tolerance is not None:
        reach = F.expr(f"interval {tolerance}")
        on = on & (F.col(other) >= F.col(time) - reach) & (F.col(other) <= F.col(time) + reach)
    joined = left.join(right, on, "fullOuter")
    part = F.when(F.col(time).isNull(), "weather_only").when(F.col(other).isNull(), "radar_only").otherwise("matched")
    named = [F.coalesce(k, f"_weather_{k}").alias(k) for k in keys]
    times = [F.coalesce(time, other).alias(time)] if tolerance is None else [F.col(time), F.col(other)]
    rest = [c for c in joined.columns if c not in {time, other, *keys, *(f"_weather_{k}" for k in keys)}]
    return joined.select(part.alias("part"), *named, *times, *rest)
