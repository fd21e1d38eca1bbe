"""Clusters, stratified splits and k-fold roles.

Order inside a cluster is the order of ``md5(seed:gid)``: repeatable, and the same in any engine.
Its leading digits cut every cluster into even slices, so a large cluster is not ordered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.operators.partitioned import row_position
from rainweave.session import checkpointed


def hash_order(seed: Column | int, gid: Column) -> Column:
    return F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(seed), gid))


def _ordered(df: DataFrame, keys: Sequence[str], seed: Column | int, gid: str, out: str) -> DataFrame:
    hashed = df.withColumn("_hash", hash_order(seed, F.col(gid).cast("string")))
    return row_position(hashed, keys, F.substring("_hash", 1, 2), ["_hash", gid], out).drop("_hash")


def share_size(n: Column, percent: float, minimum: int) -> Column:
    """``max(1, int(n * percent / 100))``, or 0 unless n exceeds ``minimum``."""
    share = F.floor(n.cast("double") * F.lit(float(percent)) / F.lit(100.0))
    return F.when(n > minimum, F.greatest(F.lit(1).cast("long"), share)).otherwise(F.lit(0).cast("long"))


UNITS = 1e9  # of a degree: sums of whole numbers do not depend on the order of the rows


DRAWN = 4  # places drawn per centroid of a start


def _spread(places: list[tuple[float, float]], k: int, seed: int) -> list[tuple[float, float]]:
    """``k`` of some drawn places, each next one as far as possible from those before it."""
    places = sorted(set(places))
    chosen = [places[seed % len(places)]]
    while len(chosen) < min(k, len(places)):
        chosen.append(max(places, key=lambda p: min((p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 for c in chosen)))
    return chosen


def _sums_of_starts(batches: Iterator[pd.DataFrame], starts: list[tuple[int, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Number, sums of whole coordinates and sum of squared distances by start and nearest centroid of one task."""
    totals = {t: [np.zeros(len(own), dtype=np.int64) for _ in range(3)] + [np.zeros(len(own))] for t, own in starts}
    for batch in batches:
        whole = batch["_x"].to_numpy(np.int64), batch["_y"].to_numpy(np.int64)
        x, y = (c.astype(float) for c in whole)
        for t, own in starts:
            apart = (x[None, :] - own[:, :1]) ** 2 + (y[None, :] - own[:, 1:]) ** 2
            near = apart.argmin(axis=0)
            least = apart[near, np.arange(len(near))]
            count, sum_x, sum_y, cost = totals[t]
            for i in np.unique(near):
                mine = near == i
                count[i] += mine.sum()
                sum_x[i] += whole[0][mine].sum()
                sum_y[i] += whole[1][mine].sum()
                cost[i] += least[mine].sum()
    for t, (count, sum_x, sum_y, cost) in totals.items():
        yield pd.DataFrame({"_try": t, "i": np.arange(len(count)), "n": count, "x": sum_x, "y": sum_y, "d": cost})[count > 0]


def spatial_clusters(stations: DataFrame, k: int = 8, seed: int = 123, tries: int = 10, rounds: int = 300) -> DataFrame:
    """K-means on (longitude, latitude), best of several starts, labels ordered by centroid.

    Each start draws places by hash and begins with ``k`` of them that lie far apart. All starts go on together: a round gives every station the nearest centroid of
    each start that still moves and sums by (start, centroid) in the tasks, so only ``tries * k`` rows a task are shuffled. It ends when no centroid
    moves (at the latest after ``rounds``); a centroid without stations stays where it is. Equally near: the smaller number;
    equally good starts: the first. Stations without a place have a NULL cluster.
    """
    placed = checkpointed(stations.withColumns({"_x": F.round(F.col("longitude") * UNITS).cast("long"), "_y": F.round(F.col("latitude") * UNITS).cast("long")}))
    known = placed.where("_x is not null and _y is not null")
    drawn = known.select("_x", "_y", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_try"))
    drawn = drawn.withColumn("_h", F.xxhash64(F.lit(seed) + F.col("_try"), "_x", "_y"))
    first = drawn.groupBy("_try", F.pmod("_h", F.lit(DRAWN * k)).alias("_part")).agg(F.min(F.struct("_h", "_x", "_y")).alias("_c")).select("_try", "_part", "_c._x", "_c._y").collect()
    if not first:
        return stations.withColumn("cluster", F.lit(None).cast("int"))
    centres = {t: _spread(sorted((float(r["_x"]), float(r["_y"])) for r in sorted(first) if r["_try"] == t), k, seed + t) for t in range(tries)}

    def beside(rows: DataFrame, own: list[tuple[float, float]]) -> DataFrame:
        """Rows with ``_near``: squared distance and number of the nearest centroid."""
        apart = [F.struct((F.pow(F.col("_x") - x, F.lit(2.0)) + F.pow(F.col("_y") - y, F.lit(2.0))).alias("d"), F.lit(i).alias("i")) for i, (x, y) in enumerate(own)]
        return rows.withColumn("_near", F.array_min(F.array(*apart)))

    schema = "_try int, i int, n long, x long, y long, d double"
    sums: dict[int, list] = {}
    moving = list(range(tries))
    for _ in range(rounds):
        # a settled start gives the same sums again
        starts = [(t, np.array(centres[t])) for t in moving]
        parts = known.select("_x", "_y").mapInPandas(lambda batches, starts=starts: _sums_of_starts(batches, starts), schema)
        found = parts.groupBy("_try", "i").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "d")]).collect()
        for t in list(moving):
            sums[t] = [r for r in found if r["_try"] == t]
            moved = list(centres[t])
            for r in sums[t]:
                moved[r["i"]] = (r["x"] / r["n"], r["y"] / r["n"])
            if moved == centres[t]:
                moving.remove(t)
            centres[t] = moved
        if not moving:
            break
    costs = [math.fsum(r["d"] for r in sums[t]) for t in range(tries)]
    best = sorted(centres[min(range(tries), key=lambda t: (costs[t], t))])
    found = beside(placed, best)
    return found.withColumn("cluster", F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), F.col("_near.i"))).select(*stations.columns, "cluster")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("stations"), F.avg("longitude").alias("longitude"), F.avg("latitude").alias("latitude")
    )


def _check(test_percent: float, validation_percent: float) -> None:
    if test_percent + validation_percent >= 100:
        raise ValueError("test and validation percent must leave room for training")


def stratified_split(clustered: DataFrame, test_percent: float = 10, validation_percent: float = 20,
                     seed: int = 123, gid: str = "gid") -> DataFrame:
    """Per cluster: a shared test set, the rest statistical training, and of the rest an ML validation part.

    Adds ``statistical_role`` and ``ml_role``. Validation is a share of what is left after test.
    """
    _check(test_percent, validation_percent)
    stations = clustered.select(gid, "cluster")
    sizes = stations.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    placed = _ordered(stations, ["cluster"], seed, gid, "_at").join(sizes, "cluster").withColumn(
        "_n_test", share_size(F.col("_n"), test_percent, 2)
    )
    roles = placed.withColumn("statistical_role", F.when(F.col("_at") < F.col("_n_test"), "test").otherwise("train"))
    rest = roles.where(F.col("statistical_role") == "train").select(
        gid, "cluster", (F.col("_n") - F.col("_n_test")).alias("_m")
    )
    within = validation_percent / (100 - test_percent) * 100
    chosen = _ordered(rest, ["cluster"], seed + 100, gid, "_at2").select(
        gid, F.when(F.col("_at2") < share_size(F.col("_m"), within, 1), "validation").otherwise("train").alias("_ml")
    )
    return roles.join(chosen, gid, "left").select(
        gid, "cluster", "statistical_role", F.coalesce("_ml", F.lit("test")).alias("ml_role")
    )


def stratified_folds(clustered: DataFrame, folds: int = 5, validation_percent: float = 20, seed: int = 123,
                     gid: str = "gid") -> DataFrame:
    """Per fold and station its roles: the j-th station of a cluster tests in fold j, later ones never.

    Validation is a share of the cluster's training pool of that fold.
    """
    stations = clustered.select(gid, "cluster")
    placed = _ordered(stations, ["cluster"], seed, gid, "_at")
    spread = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn(
        "statistical_role", F.when(F.col("_at") == F.col("fold"), "test").otherwise("train")
    )
    train = spread.where(F.col("statistical_role") == "train").select("fold", "cluster", gid)
    sizes = train.groupBy("fold", "cluster").agg(F.count(F.lit(1)).alias("_m"))
    drawn = _ordered(train, ["fold", "cluster"], F.lit(seed + 100) + F.col("fold"), gid, "_at2").join(sizes, ["fold", "cluster"])
    chosen = drawn.select(
        "fold", gid, F.when(F.col("_at2") < share_size(F.col("_m"), validation_percent, 1), "validation").otherwise("train").alias("_ml")
    )
    return spread.join(chosen, ["fold", gid], "left").select(
        "fold", gid, "cluster", "statistical_role", F.coalesce("_ml", F.lit("test")).alias("ml_role")
    )


def small_clusters(clustered: DataFrame, folds: int) -> DataFrame:
    """Clusters with fewer stations than folds: not every fold gets a test station from them."""
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("stations")).where(F.col("stations") < folds)


def random_split(stations: DataFrame, ratio: float = 0.7, seed: int = 111, gid: str = "gid") -> DataFrame:
    total = stations.agg(F.count(F.lit(1))).scalar()
    placed = _ordered(stations.select(gid), [], seed, gid, "_at")
    train = F.col("_at") < F.floor(total * F.lit(float(ratio)))
    return placed.select(gid, F.when(train, "train").otherwise("validation").alias("role"))


def fold_checks(folds: DataFrame, gid: str = "gid") -> DataFrame:
    """One row: test rows, distinct test stations, overlaps, and the expected distinct count."""
    n_folds = folds.select("fold").distinct().agg(F.count(F.lit(1))).scalar()
    n_clusters = folds.select("cluster").distinct().agg(F.count(F.lit(1))).scalar()
    n_stations = folds.select(gid).distinct().agg(F.count(F.lit(1))).scalar()
    tests = folds.where(F.col("statistical_role") == "test").groupBy(gid).agg(F.count(F.lit(1)).alias("_times"))
    return tests.agg(
        F.coalesce(F.sum("_times"), F.lit(0)).alias("test_rows"),
        F.count(F.lit(1)).alias("test_stations"),
        F.count_if(F.col("_times") > 1).alias("overlapping"),
    ).withColumn("expected_at_most", F.least(n_folds * n_clusters, n_stations))


def role_shares(split: DataFrame, role: str, keys: Sequence[str] = ()) -> DataFrame:
    counts = split.groupBy(*keys, role).agg(F.count(F.lit(1)).alias("stations"))
    totals = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    if keys:
        return counts.join(totals, list(keys)).withColumn("percent", F.col("stations") * 100.0 / F.col("_all")).drop("_all")
    return counts.withColumn("percent", F.col("stations") * 100.0 / totals.scalar())


def split_report(split: DataFrame, role: str, coarse: Column, gid: str = "gid") -> DataFrame:
    """Role, its size, and its station ids in order, one numbered row each.

    ``coarse`` must be non-decreasing in the id: a quotient for numbers, leading letters for text.
    """
    sizes = split.groupBy(role).agg(F.count(F.lit(1)).alias("stations"))
    listed = row_position(split.select(role, gid, coarse.alias("_c")), [role], F.col("_c"), [gid], "position")
    return listed.join(sizes, role).select(role, "stations", "position", gid)
