"""Baseline learner on masked examples, per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def example_table(examples: DataFrame, target: str = "rain", keys: Sequence[str] = ("time_sgt", "example")) -> DataFrame:
    """One row per example: count, mean and inverse-distance mean of the neighbours' target feature."""
    neighbour = F.col("node") != F.col("example")
    weight = F.when(neighbour & (F.col("dist") > 0), F.lit(1.0) / F.col("dist"))
    return examples.groupBy(*keys).agg(
        F.max("y").alias("y"),
        F.count_if(neighbour).cast("double").alias("neighbours"),
        F.coalesce(F.avg(F.when(neighbour, F.col(target))), F.lit(0.0)).alias("mean_rain"),
        F.coalesce(F.sum(weight * F.col(target)) / F.sum(weight), F.lit(0.0)).alias("near_rain"),
    )


INPUTS = ("neighbours", "mean_rain", "near_rain")


def _solved(matrix: list[list[Column]], right: list[Column]) -> list[Column]:
    """Solution of three equations by determinants."""

    def determinant(m: list[list[Column]]) -> Column:
        return sum((m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3)), F.lit(0.0))

    whole = determinant(matrix)
    replaced = [[[right[r] if c == k else matrix[r][c] for c in range(3)] for r in range(3)] for k in range(3)]
    return [determinant(m) / whole for m in replaced]


def ridge_coefficients(train: DataFrame, by: Sequence[str], target: str = "y", inputs: Sequence[str] = INPUTS, penalty: float = 0.1) -> DataFrame:
    """Linear regression of three inputs per group: ``by``, ``intercept`` and ``b0``, ``b1``, ``b2``.

    Minimises the mean square error plus ``penalty`` times the squares of the slopes, each in units of the standard deviation of its
    input. The normal equations are covariances, all groups in one aggregation, solved in columns; an input
    without spread gets the slope 0. Groups without rows have no row.
    """
    if len(inputs) != 3:
        raise ValueError("three inputs are needed")
    sums = [F.avg(target).alias("_my"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(inputs)]]
    sums += [F.covar_pop(a, b).alias(f"_c{i}{j}") for i, a in enumerate(inputs) for j, b in enumerate(inputs) if i <= j]
    sums += [F.covar_pop(c, target).alias(f"_y{i}") for i, c in enumerate(inputs)]
    moments = train.where(F.col(target).isNotNull()).groupBy(*by).agg(*sums)
    matrix = [[F.col(f"_c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    for i in range(3):
        spread = F.col(f"_c{i}{i}")
        matrix[i][i] = F.when(spread > 0, spread * (1 + penalty)).otherwise(1.0)
    slopes = _solved(matrix, [F.col(f"_y{i}") for i in range(3)])
    solved = moments.select(*by, "_my", "_m0", "_m1", "_m2", *[b.alias(f"b{i}") for i, b in enumerate(slopes)])
    level = F.col("_my") - sum((F.col(f"b{i}") * F.col(f"_m{i}") for i in range(3)), F.lit(0.0))
    return solved.select(*by, level.alias("intercept"), "b0", "b1", "b2")


def fit_folds(examples: DataFrame, by: Sequence[str] = ("fold",), penalty: float = 0.1) -> DataFrame:
    """Fit on the training examples of each group and predict its validation examples, as column ``prediction``.

    ``examples`` has the group columns and ``role``. All groups are fitted in one plan; their coefficients, one row each, are joined.
    """
    lines = ridge_coefficients(examples.where(F.col("role") == "train"), by, penalty=penalty)
    asked = examples.where(F.col("role") == "validation").join(lines, list(by))
    value = F.col("intercept") + sum((F.col(f"b{i}") * F.col(c) for i, c in enumerate(INPUTS)), F.lit(0.0))
    return asked.withColumn("prediction", value).drop("intercept", "b0", "b1", "b2")
