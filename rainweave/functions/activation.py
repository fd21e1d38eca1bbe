"""Activation functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published erfc approximation (Numerical Recipes), relative error below 1.2e-7.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
         -0.82215223, 0.17087277)


def _normal_cdf(x: Column) -> Column:
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + z / 2)
    series = F.lit(0.0)
    for c in reversed(_ERFC):
        series = series * t + F.lit(c)
    tail = t * F.exp(-z * z + series) / 2
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def activation(x: Column, name: str) -> Column:
    zero = F.lit(0.0)
    if name == "relu":
        return F.when(x.isNotNull(), F.greatest(x, zero))
    if name == "leaky_relu":
        return F.when(x >= 0, x).otherwise(x * 0.1)
    if name == "elu":
        return F.when(x >= 0, x).otherwise(F.exp(x) - 1.0)
    if name == "gelu":
        return x * _normal_cdf(x)
    if name == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    if name == "tanh":
        return F.tanh(x)
    if name == "identity":
        return x
    raise ValueError(f"unknown activation {name}")
