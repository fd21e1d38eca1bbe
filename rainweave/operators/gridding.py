"""Point-to-grid estimation: inverse distance, nearest value, variogram, scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.operators.spatial import nearest_neighbours
from rainweave.session import checkpointed

BLOCK_POINTS = 256


def inverse_distance(targets: DataFrame, points: DataFrame, target_id: Sequence[str], point_id: str, value: str,
                     k: int | None = None, power: float = 2.0, smoothing: float = 0.0, by: Sequence[str] = ("time_sgt",),
                     max_distance: float | None = None, hit_distance: float = 0.0, x: str = "longitude",
                     y: str = "latitude", out: str = "z") -> DataFrame:
    """Inverse-distance estimate at every target, per group of ``by`` (a time).

    ``k`` nearest points, or all with None. Points without a value are left out first. A point
    at or within ``hit_distance`` gives its own value. A target without any point in reach
    keeps a NULL.
    """
    if k is not None and max_distance is not None and k < 2:
        raise ValueError("k must be greater than 1")
    by, target_id = list(by), list(target_id)
    known = points.where(F.col(value).isNotNull())
    if k is None:
        estimates = _all_points(targets, known, target_id, point_id, value, power, smoothing, by, hit_distance, x, y, max_distance)
    else:
        pairs = nearest_neighbours(
            targets, known, k, target_id, point_id, by, x, y, [value], max_distance=max_distance
        )
        weight = F.lit(1.0) / F.pow(F.col("dist") + F.lit(float(smoothing)), F.lit(float(power)))
        # weights are only used when no point is hit, so a zero distance must not divide
        weight = F.when(F.col("dist") > hit_distance, weight)
        estimates = pairs.groupBy(*by, *target_id).agg(
            F.min(F.struct("dist", point_id, value)).alias("_nearest"),
            (F.sum(weight * F.col(value)) / F.sum(weight)).alias("_mean"),
        ).select(
            *by, *target_id,
            F.when(F.col("_nearest.dist") <= hit_distance, F.col(f"_nearest.{value}")).otherwise(F.col("_mean")).alias(out),
        )
    estimates = estimates.withColumnRenamed("_z", out)
    return targets.join(estimates, [*by, *target_id], "left")


def _all_points(targets, known, target_id, point_id, value, power, smoothing, by, hit_distance, x, y, max_distance) -> DataFrame:
    """Sums over all points, block by block: points meet a target as arrays of bounded size."""
    blocks = known.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK_POINTS).alias("_blocks"))
    packed = (
        known.join(blocks, by)
        .groupBy(*by, F.pmod(F.xxhash64(point_id), F.col("_blocks")).alias("_block"))
        .agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(point_id).alias("id"), F.col(value).alias("z"))).alias("_points"))
    )
    tx, ty = F.col(x), F.col(y)
    met = targets.select(*by, *target_id, x, y).join(packed, by)

    def distance(p):
        return F.sqrt((tx - p["x"]) * (tx - p["x"]) + (ty - p["y"]) * (ty - p["y"]))

    measured = F.transform(
        "_points", lambda p: F.struct(distance(p).alias("d"), p["id"].alias("id"), p["z"].alias("z"))
    )
    if max_distance is not None:
        measured = F.filter(measured, lambda p: p["d"] < max_distance)
    met = met.select(*by, *target_id, measured.alias("_m"))

    def weight(p):
        w = F.lit(1.0) / F.pow(p["d"] + F.lit(float(smoothing)), F.lit(float(power)))
        return F.when(p["d"] > hit_distance, w).otherwise(F.lit(0.0))

    partial = met.select(
        *by, *target_id, F.array_min("_m").alias("_nearest"),
        F.aggregate("_m", F.lit(0.0), lambda s, p: s + weight(p)).alias("_w"),
        F.aggregate("_m", F.lit(0.0), lambda s, p: s + weight(p) * p["z"]).alias("_wz"),
    )
    return partial.groupBy(*by, *target_id).agg(
        F.min("_nearest").alias("_nearest"), F.sum("_w").alias("_w"), F.sum("_wz").alias("_wz")
    ).select(
        *by, *target_id,
        F.when(F.col("_nearest.d") <= hit_distance, F.col("_nearest.z"))
        .otherwise(F.col("_wz") / F.nullif(F.col("_w"), F.lit(0.0))).alias("_z"),
    )


def nearest_value(targets: DataFrame, points: DataFrame, target_id: Sequence[str], point_id: str, value: str,
                  by: Sequence[str] = ("time_sgt",), x: str = "longitude", y: str = "latitude", out: str = "z") -> DataFrame:
    """Value of the nearest point; a target without any gets 0."""
    pairs = nearest_neighbours(
        targets, points.where(F.col(value).isNotNull()), 1, target_id, point_id, by, x, y, [value]
    ).select(*by, *target_id, F.col(value).alias(out))
    return targets.join(pairs, [*by, *target_id], "left").na.fill(0.0, [out])


SITE_BLOCK = 512  # places in one block: a pair of blocks holds a few matrices of 2 MB
TIMES_PER_SLOT = 32  # times that one pass over the pairs of places serves
PAIRS_PER_TASK = 64  # pairs of blocks in one task, up to MAX_TASKS of them
MAX_TASKS = 4096
MAX_GROUPS = 32  # per square; blocks of two squares meet in up to 32 * 32 tasks

# half of the squares of side max_lag / 2 around one, so that every pair of squares meets once
_AHEAD = tuple((dx, dy) for dx in range(3) for dy in range(-2, 3) if dx > 0 or dy >= 0)


def _dense(sizes: np.ndarray, at: np.ndarray, z: np.ndarray, width: int) -> list[np.ndarray]:
    """Number, sum and sum of squares of the values per place and time."""
    cell = np.repeat(np.arange(len(sizes)), sizes) * width + at
    return [np.bincount(cell, w, len(sizes) * width).reshape(len(sizes), width) for w in (np.ones_like(z), z, z * z)]


def _binned(row, lag: float, far: float) -> pd.DataFrame:
    """Pairs, summed distance and summed half squared difference per bin, of two blocks of places with their values.

    A distance serves all times at which both places have values: with the number ``p``, the sum ``s`` and the sum of squares
    ``q`` per time, the half squared differences are the sums over the times of ``(q p' + p q') / 2 - s s'``.
    """
    x1, y1, n1, t1, z1, x2, y2, n2, t2, z2 = (np.asarray(v) for v in row[1:])
    times = np.intersect1d(t1, t2)
    sides = []
    for n, t, z in ((n1, t1, z1), (n2, t2, z2)):
        common = np.isin(t, times)
        sizes = np.bincount(np.repeat(np.arange(len(n)), n)[common], minlength=len(n))
        sides.append(_dense(sizes, np.searchsorted(times, t[common]), z[common].astype(float), len(times)))
    (p1, s1, q1), (p2, s2, q2) = sides
    pairs = p1 @ p2.T
    half = np.hstack([0.5 * q1, 0.5 * p1, -s1]) @ np.hstack([p2, q2, s2]).T
    d = np.sqrt((x1[:, None] - x2[None, :]) ** 2 + (y1[:, None] - y2[None, :]) ** 2)
    if row[0]:
        # every pair once; a place has pairs with itself only where it has several values at a time
        own = (np.einsum("ij,ij->i", p1, p1) - p1.sum(axis=1)) / 2
        pairs, half = np.triu(pairs, 1), np.triu(half, 1)
        np.fill_diagonal(pairs, own)
        np.fill_diagonal(half, np.where(own > 0, np.einsum("ij,ij->i", p1, q1) / 2 - np.einsum("ij,ij->i", s1, s1) / 2, 0.0))
    near = (pairs > 0) & (d < far)
    if near.mean() < 0.7:
        d, pairs, half = d[near], pairs[near], half[near]
    else:
        d, pairs, half = (np.where(near, v, 0.0).ravel() for v in (d, pairs, half))
    bins = np.floor(d / lag).astype(np.int64)
    if len(bins) and bins.max() < 4 * SITE_BLOCK:
        number, where = np.arange(bins.max() + 1), bins
    else:
        number, where = np.unique(bins, return_inverse=True)
    n, total, g = (np.bincount(where, w, len(number)) for w in (pairs, pairs * d, half))
    return pd.DataFrame({"lag_bin": number, "n": n.astype(np.int64), "d": total, "g": g})[n > 0]


def empirical_variogram(points: DataFrame, value: str, lag: float, by: Sequence[str] = ("time_sgt",),
                        point_id: str = "gid", x: str = "longitude", y: str = "latitude", max_lag: float | None = None) -> DataFrame:
    """Mean semivariance and pair count per distance bin of width ``lag``, pairs within a group.

    Places are packed in blocks of bounded size, each with its values at up to 32 times, and blocks are paired; a pair of blocks is
    reduced to a few sums at once, so single pairs are never rows and a distance is measured once for all its times. Where most
    places lack most times, each time is paired on its own. With ``max_lag`` only pairs nearer than that count:
    places are keyed by squares of half that side and only squares in reach meet, so the work grows with
    the crowd in a square and not with the square of all points. Without it all pairs of a group are measured. The blocks of two
    squares are dealt over many tasks. Values that are not finite make the bins of their blocks NaN.
    """
    if not lag > 0 or (max_lag is not None and not max_lag >= lag):
        raise ValueError("lag must be above 0, and max_lag at least as much")
    by = list(by)
    far = max_lag if max_lag is not None else float("inf")
    # a little wider than half, for rounding at the borders
    square = [F.floor(F.col(c) / F.lit(max_lag / 2 * (1 + 1e-9))) if max_lag is not None else F.lit(0).cast("long") for c in (x, y)]
    known = checkpointed(points.where(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.xxhash64(point_id).alias("_id"), *by, *[F.col(c).cast("double").alias(n) for c, n in ((x, "_x"), (y, "_y"), (value, "_z"))],
        square[0].alias("_sx"), square[1].alias("_sy")))
    times = checkpointed(known.select(*by).distinct().withColumn("_t", F.monotonically_increasing_id()))
    n_times = times.count()
    rows, places, level = known.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("_id", "_x", "_y")), F.avg("_z")).first()
    # only how the work is cut depends on these figures
    slots = math.ceil(n_times / TIMES_PER_SLOT) if rows >= 0.15 * places * n_times else n_times
    times = times.withColumn("_slot", F.pmod(F.xxhash64("_t"), F.lit(max(slots, 1))) if slots < n_times else F.col("_t"))
    # differences do not depend on the level, but sums of squares around it are more exact
    centred = F.col("_z") - F.lit(level if level is not None and math.isfinite(level) else 0.0)
    area = ["_slot", "_sx", "_sy"]
    sites = known.join(times, by).groupBy(*area, "_id", "_x", "_y").agg(F.collect_list(F.struct("_t", centred.alias("_z"))).alias("_v"))
    counts = sites.groupBy(*area).agg(F.ceil(F.count(F.lit(1)) / SITE_BLOCK).alias("_blocks"))
    packed = checkpointed(
        sites.join(counts, area)
        .groupBy(*area, "_blocks", F.pmod(F.xxhash64("_id", "_x", "_y"), F.col("_blocks")).alias("_block"))
        .agg(F.collect_list(F.struct("_x", "_y", F.size("_v").alias("_n"), F.col("_v._t").alias("_t"), F.col("_v._z").alias("_z"))).alias("_p"))
        .select(*area, "_blocks", "_block", *[F.col(f"_p.{c}").alias(c) for c in ("_x", "_y", "_n")], *[F.flatten(f"_p.{c}").alias(c) for c in ("_t", "_z")])
    )
    steps = _AHEAD if max_lag is not None else ((0, 0),)
    most, met = packed.agg(F.max("_blocks"), F.sum("_blocks")).first()  # a square with n blocks adds n * n
    groups = min(math.ceil((most or 1) / 8), MAX_GROUPS)
    tasks = min(math.ceil((met or 1) * len(steps) / PAIRS_PER_TASK), MAX_TASKS)
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    own_group = F.pmod("_block", F.lit(groups)).cast("int")
    columns = ["_block", "_x", "_y", "_n", "_t", "_z"]
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])).alias("_step")
    other = packed.select("_slot", "_sx", "_sy", step, *[F.col(c).alias(c + "2") for c in columns], own_group.alias("_g2"))
    other = other.withColumns({"_sx": F.col("_sx") - F.col("_step.dx"), "_sy": F.col("_sy") - F.col("_step.dy")}).withColumn("_g1", every)
    one = packed.select(*area, *columns, own_group.alias("_g1")).withColumn("_g2", every)
    here = (F.col("_step.dx") == 0) & (F.col("_step.dy") == 0)
    # dealt by number, both sides, and never broadcast: the pairs are many more than the blocks
    key = [*area, "_g1", "_g2"]
    block_pairs = one.repartition(tasks, *key).hint("merge").join(other.repartition(tasks, *key), key).where(~here | (F.col("_block") <= F.col("_block2"))).select(
        (here & (F.col("_block") == F.col("_block2"))).alias("same"), *columns[1:], *[c + "2" for c in columns[1:]]
    )

    def reduce_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield _binned(row, lag, far)

    sums = block_pairs.mapInPandas(reduce_pairs, "lag_bin long, n long, d double, g double")
    return sums.groupBy("lag_bin").agg(
        F.sum("n").alias("pairs"), (F.sum("d") / F.sum("n")).alias("mean_distance"), (F.sum("g") / F.sum("n")).alias("semivariance")
    )
