"""Kriging of times with many gauges: one Cholesky factor per time, in square tiles that are dealt over tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.session import checkpointed

TILE = 2048  # a side of a tile: 32 MB, a task holds a handful
SAME_PLACE = 1e-10
TREND = -1  # the block row of trend and values; targets are -2, -3, ..., gauges 0, 1, ...
# a file's writer looks at its memory after every tile, not after a hundred
WRITE = {"parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


@contextmanager
def _one_tile_at_a_time(spark):
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
    before = {key: spark.conf.get(key) for key in own}
    for key, number in own.items():
        spark.conf.set(key, number)
    try:
        yield
    finally:
        for key, number in before.items():
            spark.conf.set(key, number)


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data).reshape(rows, -1)


def krige_tiled(known: DataFrame, targets: DataFrame, target_id: str, value: str, gamma: Callable, ceiling: float, time: str,
                trends: Sequence[str], x: str, y: str, tile: int = TILE) -> DataFrame:
    """(time, target_id, z, variance) from all gauges of every time, without a bound on their number.

    ``gamma`` maps distances to semivariances; ``ceiling`` less these are covariances, 0 stands for a variogram that is 0
    everywhere. ``trends`` are columns of both sides beside the constant. The rows of trend, values and targets go through the
    same elimination as the gauges, tile column by tile column; what is left are the small systems of generalised least squares and the
    variances. Gauges at one place count once with their mean, which gives the same estimates. Work grows with the
    third power of the gauges of a time and what is written with their square, but a task holds a few tiles only. Covariances
    that are not positive definite in double precision (gauges all but at one place) raise.
    """
    m, flat = 1 + len(trends), ceiling == 0
    extra = [c for c in trends if c not in (x, y)]
    if not flat:
        known = known.groupBy(time, x, y, *extra).agg(F.avg(value).alias(value))
    known = checkpointed(known.select(time, x, y, value, *extra))
    sizes = known.groupBy(time).agg(F.ceil(F.count(F.lit(1)) / tile).alias("_n"), *[F.avg(c).alias(f"_mid_{c}") for c in trends])

    def numbers(*columns):
        # trend relative to its mean: the same estimates from a better conditioned system
        about = [F.col(c) - F.col(f"_mid_{c}") for c in trends]
        return F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in (*columns, *about)])

    gauges = known.join(sizes, time).groupBy(time, F.pmod(F.xxhash64(x, y), F.col("_n")).cast("int").alias("i")).agg(
        F.flatten(F.sort_array(F.collect_list(numbers(F.col(x), F.col(y), F.col(value))))).alias("own"))
    parts = targets.groupBy(time).agg(F.ceil(F.count(F.lit(1)) / tile).alias("_t")).join(sizes, time)
    wanted = targets.join(parts, time).groupBy(time, (-2 - F.pmod(F.xxhash64(target_id), F.col("_t"))).cast("int").alias("i")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(target_id).alias("id"), numbers(F.col(x), F.col(y)).alias("own")))).alias("_rows"))
    # written once: the order within a block must be the same in every tile
    wanted = checkpointed(wanted.select(F.col(time).alias("_time"), "i", "_rows.id", F.flatten("_rows.own").alias("own")))
    trend = sizes.select(F.col(time).alias("_time"), F.lit(TREND).alias("i"), F.array().cast("array<double>").alias("own"))
    blocks = checkpointed(gauges.withColumnRenamed(time, "_time").unionByName(trend).unionByName(wanted.drop("id")))
    kind = dict(blocks.dtypes)["_time"]
    tiles = f"_time {kind}, i int, rows int, tile binary"

    def covariances(i: int, k: int, own, column) -> np.ndarray:
        """A block row against the gauges of a tile column, before elimination."""
        c = np.asarray(column, float).reshape(-1, 2 + m)
        if i == TREND:
            return np.vstack([np.ones(len(c)), c[:, 3:].T, c[:, 2]])
        r = np.asarray(own, float).reshape(-1, 2 + m if i >= 0 else 1 + m)
        if flat:
            return np.eye(len(r)) if i == k else np.zeros((len(r), len(c)))
        return ceiling - gamma(np.hypot(r[:, :1] - c[:, 0], r[:, 1:2] - c[:, 1]))

    def products(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                made = _matrix(r.tile, r.rows) @ _matrix(r.other, r.other_rows).T
                yield pd.DataFrame({"_time": [r[0]], "i": [r.i], "rows": [r.rows], "tile": [made.tobytes()]})

    def eliminate(k: int):
        """Rows come block row by block row: the covariances, then what the columns before take off."""
        def finish(head, left):
            if head.i == k:
                try:
                    left = np.linalg.inv(np.linalg.cholesky(left))
                except np.linalg.LinAlgError as e:
                    raise ValueError(f"covariances at {head[0]} are not positive definite: gauges too near each other for this variogram") from e
            else:
                left = left @ _matrix(head.tile, head.rows).T
            return pd.DataFrame({"_time": [head[0]], "i": [head.i], "rows": [len(left)], "tile": [left.tobytes()]})

        def run(batches):
            head = left = None
            for batch in batches:
                for r in batch.itertuples(index=False):
                    if not r.head:
                        left -= _matrix(r.tile, r.rows)
                        continue
                    if head is not None:
                        yield finish(head, left)
                    head, left = r, covariances(r.i, k, r.own, r.column)
            if head is not None:
                yield finish(head, left)

        return run

    def left_over(heads, done, k):
        """The heads' block rows in column k, after the columns before it."""
        rows = heads.withColumn("head", F.lit(True))
        if done is not None:
            pivot = done.where(F.col("i") == k).select("_time", "j", F.col("rows").alias("other_rows"), F.col("tile").alias("other"))
            own = done.join(heads.select("_time", "i"), ["_time", "i"], "left_semi")
            taken = own.join(pivot, ["_time", "j"]).select("_time", "i", "rows", "tile", "other_rows", "other").mapInPandas(products, tiles)
            rows = rows.unionByName(taken.withColumn("head", F.lit(False)), allowMissingColumns=True)
        rows = rows.repartition("_time", "i").sortWithinPartitions("_time", "i", F.desc("head"))
        return checkpointed(rows.mapInPandas(eliminate(k), tiles), **WRITE)

    done, nothing = None, [F.lit(None).cast("int").alias("rows"), F.lit(None).cast("binary").alias("tile")]
    columns = blocks.agg(F.max("i")).first()[0] + 1
    with _one_tile_at_a_time(known.sparkSession):
        for k in range(columns):
            column = blocks.where(F.col("i") == k).select("_time", F.col("own").alias("column"))
            heads = blocks.where((F.col("i") < 0) | (F.col("i") >= k)).join(column, "_time")
            pivot = left_over(heads.where(F.col("i") == k).select("*", *nothing), done, k)
            below = heads.where(F.col("i") != k).join(pivot.drop("i"), "_time")
            made = left_over(below, done, k).withColumn("j", F.lit(k))
            done = made if done is None else done.unionByName(made)

        def reduced(batches):
            for batch in batches:
                for r in batch.itertuples(index=False):
                    u, s = _matrix(r.tile, r.rows), _matrix(r.other, r.other_rows)
                    part = np.column_stack([u @ s.T, np.sum(u * u, axis=1)])
                    yield pd.DataFrame({"_time": [r[0]], "i": [r.i], "part": [part.ravel()]})

        ends = done.where(F.col("i") < 0)
        lines = ends.where(F.col("i") == TREND).select("_time", "j", F.col("rows").alias("other_rows"), F.col("tile").alias("other"))
        sums = checkpointed(ends.join(lines, ["_time", "j"]).select("_time", "i", "rows", "tile", "other_rows", "other").mapInPandas(
            reduced, f"_time {kind}, i int, part array<double>"))

    # few numbers per target are left: added up over the tile columns in one array per block
    totals = sums.select("_time", "i", F.posexplode("part").alias("at", "v")).groupBy("_time", "i", "at").agg(F.sum("v").alias("v"))
    totals = totals.groupBy("_time", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s.v).alias("part"))
    whole = totals.where(F.col("i") == TREND).select("_time", F.col("part").alias("whole"))
    asked = wanted.join(totals, ["_time", "i"]).join(whole, "_time")
    types = dict(targets.dtypes)

    def solve(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                all_ = np.asarray(r.whole, float).reshape(m + 1, m + 2)
                part = np.asarray(r.part, float).reshape(-1, m + 2)
                trend_t = np.column_stack([np.ones(len(part)), np.asarray(r.own, float).reshape(-1, 1 + m)[:, 2:]])
                inverse = np.linalg.pinv(all_[:m, :m])
                off = trend_t - part[:, :m]
                z = part[:, m] + off @ (inverse @ all_[:m, m])
                variance = (0.0 if flat else 1.0) * (ceiling - part[:, m + 1] + np.sum(off @ inverse * off, axis=1))
                yield pd.DataFrame({time: [r[0]] * len(z), target_id: list(r.id), "z": z, "variance": variance})

    return asked.select("_time", "id", "own", "part", "whole").mapInPandas(solve, f"`{time}` {types[time]}, `{target_id}` {types[target_id]}, z double, variance double")
