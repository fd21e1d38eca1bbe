"""Centroid clustering in integers, with an equal-average equal-variance search for the nearest centroid.

Centroids stand in the order of their component means. A vector starts at the place of its own mean and scans
outward on both sides. With ``S`` the sum and ``V`` the length of the deviation from the mean (times the root of the
dimension ``k``), ``k d^2 >= (S_x - S_c)^2 + (V_x - V_c)^2``: where the first term alone passes the best distance, the
side is done, since means only get farther; where both together pass it, the centroid is skipped. What is left is
measured in integers. Rejections compare strictly, with a margin for the roots, so ties reach the exact measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.session import checkpointed

DIMENSION = 64
CLUSTERS = 8
ROUNDS = 10
STEPS = 1024  # integers per unit
SEED = 3
SLICE_ROWS = 4096


def _fits(largest: float, dimension: int) -> bool:
    """Whether all measures of components up to this size stay below 2^63; larger ones are taken as Python integers."""
    return largest * dimension <= 1 << 30


def _integers(column: pa.Array) -> np.ndarray:
    """Vectors of one batch as a matrix of exact integers."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    floors = np.floor(flat * STEPS)
    if len(floors) and not _fits(np.abs(floors).max(), len(floors) // len(column)):
        return np.array([int(x) for x in floors], dtype=object).reshape(len(column), -1)
    return floors.astype(np.int64).reshape(len(column), -1)


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the number of its nearest centroid (the smallest of equally near ones), its squared
    distance, and how many distances were measured in all."""
    count, dimension = vectors.shape
    sums, own = centroids.sum(axis=1), vectors.sum(axis=1)

    def spread(rows: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.sqrt((dimension * (rows * rows).sum(axis=1) - total * total).astype(np.float64))

    order = np.lexsort((np.arange(len(sums)), sums.astype(np.float64)))
    sums, numbers = sums[order], order
    widths, own_width = spread(centroids[order], sums), spread(vectors, own)
    right = np.searchsorted(sums.astype(np.float64), own.astype(np.float64))
    left = right - 1
    best = np.zeros(count, dtype=vectors.dtype)
    number = np.full(count, -1, dtype=np.int64)
    open_rows, measured = np.arange(count), 0
    while len(open_rows):
        i, j, x = left[open_rows], right[open_rows], own[open_rows]
        far_left = np.where(i >= 0, x - sums[np.maximum(i, 0)], 0)
        far_right = np.where(j < len(sums), sums[np.minimum(j, len(sums) - 1)] - x, 0)
        go_left = (i >= 0) & ((j >= len(sums)) | (far_left <= far_right))
        at, gap = np.where(go_left, i, j), np.where(go_left, far_left, far_right)
        left[open_rows] -= go_left
        right[open_rows] += ~go_left
        seen = number[open_rows] >= 0
        limit = dimension * best[open_rows]
        # the nearer side is out of reach, and so is the other; a margin of a few units of the last place for the order by doubles
        away = seen & ((gap * gap).astype(np.float64) > limit.astype(np.float64) * (1 + 1e-9) + 1)
        slack = np.abs(own_width[open_rows] - widths[at])
        skip = seen & ((gap * gap).astype(np.float64) + slack * slack > limit.astype(np.float64) * (1 + 1e-9) + 1e-9 * (own_width[open_rows] + widths[at]) ** 2 + 1)
        tried = np.flatnonzero(~away & ~skip)
        rows, chosen = open_rows[tried], numbers[at[tried]]
        difference = vectors[rows] - centroids[chosen]
        distance = (difference * difference).sum(axis=1)
        measured += len(rows)
        better = (number[rows] < 0) | (distance < best[rows]) | ((distance == best[rows]) & (chosen < number[rows]))
        best[rows[better]], number[rows[better]] = distance[better], chosen[better]
        open_rows = open_rows[~away & ((left[open_rows] >= 0) | (right[open_rows] < len(sums)))]
    return number, best, measured


def _matrix(centroids: list[list[int]]) -> np.ndarray:
    fits = all(_fits(abs(x), len(c)) for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if fits else object)


def _assigned(vectors: np.ndarray, centroids: np.ndarray):
    for at in range(0, len(vectors), SLICE_ROWS):
        part = vectors[at:at + SLICE_ROWS]
        if part.dtype != centroids.dtype:
            part, own = part.astype(object), centroids.astype(object)
        else:
            own = centroids
        yield part, *nearest_centroids(part, own)[:2]


def _sums(centroids: np.ndarray):
    """Per batch and cluster: the number of its vectors and their componentwise sums, as decimal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list] = {}
            for part, number, _ in _assigned(_integers(batch.column(0)), centroids):
                for c in np.unique(number):
                    rows = part[number == c]
                    count, total = held.get(c, (0, 0))
                    held[c] = count + len(rows), total + rows.sum(axis=0).astype(object)
            yield pa.record_batch([
                pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()),
                pa.array([[str(x) for x in t] for _, t in held.values()], pa.list_(pa.string())),
            ], ["cluster", "count", "sums"])

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(number, best) for _, number, best in _assigned(_integers(batch.column(1)), centroids)]
            number = np.concatenate([n for n, _ in found]) if found else np.zeros(0, np.int64)
            distance = [str(x) for _, best in found for x in best]
            yield pa.record_batch([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.string())], ["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
            clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, seed: int = SEED) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``centroid`` per kept vector.

    Kept are vectors of exactly ``dimension`` components, none NULL, NaN or infinite; a component ``x`` becomes the integer
    ``floor(1024 x)``. The first centroids are the vectors with the smallest ``sha256('seed:id')`` in hash order; of vectors
    with one id, the smaller components come first, and equal rows may both be centroids. A round assigns every vector and
    moves every centroid that has vectors to ``floor(sum / count)``. Only the centroids pass the driver. A NULL id hashes as ``null``. Fewer vectors
    than clusters give fewer centroids; no vector, no row. Repeated rows count again, ties go to the smaller
    number, other columns are ignored. A distance or inertia beyond a BIGINT is NULL; sums beyond 38 digits raise.
    """
    typed = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = checkpointed(typed.where((F.size("vec") == dimension) & whole))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = kept.select(name.alias("h"), "vec").orderBy("h", "vec").limit(clusters).collect()
    if not first:
        return kept.select(
            F.col("id").alias(id_column), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"), F.array().cast("array<string>").alias("centroid"))
    places = [[int(np.floor(x * STEPS)) for x in r.vec] for r in first]

    only = kept.select("vec")
    for _ in range(rounds):
        sums = only.mapInArrow(_sums(_matrix(places)), "cluster int, count long, sums array<string>")
        counts = sums.groupBy("cluster").agg(F.sum("count").alias("count"), *[F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimension)])
        for row in counts.collect():  # one row per centroid
            places[row["cluster"]] = [int(row[f"s{i}"]) // row["count"] for i in range(dimension)]

    found = kept.mapInArrow(_distances(_matrix(places)), kept.select("id").withColumns({"cluster": F.lit(0), "distance": F.lit("")}).schema)
    found = checkpointed(found.withColumn("distance", F.col("distance").cast("decimal(38,0)")))
    totals = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per centroid
    inertia = {r["cluster"]: int(r["cluster_inertia"]) for r in totals}
    ends = kept.sparkSession.createDataFrame(
        [(c, str(n), str(sum(inertia.values())), [str(x) for x in places[c]]) for c, n in inertia.items()],
        "cluster int, cluster_inertia string, inertia string, centroid array<string>")
    return found.join(F.broadcast(ends), "cluster").select(
        F.col("id").alias(id_column), "cluster", *[F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"), "centroid")
