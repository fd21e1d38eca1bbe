"""Rain rates and classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class edges in mm/h.
RAIN_CLASS_EDGES = (0.1, 0.2, 0.5, 1, 2, 4, 7, 10, 20)

# The four rate conventions. 5-minute sums times 12, 15-minute sums times 4.
RATE_FACTORS = {"first": 12.0, "mean": 12.0, "sum": 4.0, "raw": 12.0}


def to_hourly_rate(value: Column, mode: str) -> Column:
    """mm/h from the aggregate of a bucket (``first``/``mean``/``sum``) or a 5-minute value (``raw``)."""
    return value * F.lit(RATE_FACTORS[mode])


def rain_class(value: Column, edges: Sequence[float] = RAIN_CLASS_EDGES) -> Column:
    """Class number 0 (below the first edge) .. len(edges); an edge belongs to the upper class."""
    passed = F.lit(0)
    for edge in edges:
        passed = passed + F.when(value >= F.lit(float(edge)), 1).otherwise(0)
    return F.when(value.isNotNull(), passed)


def mask_no_rain(value: Column) -> Column:
    return F.when(value > 0, value)


def clamp_negative(value: Column) -> Column:
    """Negative to 0, NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
