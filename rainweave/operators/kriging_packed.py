"""Kriging of a time with some ten thousand gauges in one task: a Cholesky factor whose tiles are kept as products of thin matrices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.session import checkpointed

LEAF = 512  # gauges of a tile
TARGETS_AT_ONCE = 256
TARGETS_PER_BLOCK = 4096  # a block of targets factors anew, so it has as many targets as gauges, or these
MOST_TASKS = 2000
STEP = 24  # ranks tried at once
ROUNDING = 4 * np.finfo(float).eps


def _cells(x: np.ndarray, y: np.ndarray, n: int) -> list[np.ndarray]:
    """Row numbers in ``n`` equal parts, halved across the longer side."""
    def cut(rows, n):
        if n == 1:
            return [rows]
        side = x[rows] if np.ptp(x[rows]) >= np.ptp(y[rows]) else y[rows]
        at = len(rows) * (n // 2) // n
        rows = rows[np.argpartition(side, at)]
        return cut(rows[:at], n // 2) + cut(rows[at:], n - n // 2)

    return cut(np.arange(len(x)), n)


def _apart(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    d, e = ax[:, None] - bx, ay[:, None] - by
    d *= d
    e *= e
    d += e
    return np.sqrt(d, out=d)


def _thin(a: np.ndarray, most: float, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``u`` and ``v`` of least rank with a Frobenius norm of ``a - u @ v.T`` up to ``most``; ``a`` is used up."""
    q, b = [], []
    for at in range(0, min(a.shape), STEP):
        if np.vdot(a, a) <= most * most / 2:
            break
        made = a @ draws[:a.shape[1], at:at + STEP]
        if q:  # what rounding brought back of the directions before
            found = np.hstack(q)
            made -= found @ (found.T @ made)
        made = np.linalg.qr(made)[0]
        b.append(made.T @ a)
        a -= made @ b[-1]
        q.append(made)
    if not q:
        return np.zeros((a.shape[0], 0)), np.zeros((a.shape[1], 0))
    right, small = np.linalg.qr(np.vstack(b).T)
    u, s, v = np.linalg.svd(small.T)
    rank = int(np.sum(np.cumsum((s * s)[::-1])[::-1] > most * most / 2))
    return np.hstack(q) @ u[:, :rank], right @ (v[:rank].T * s[:rank])


class _Factor:
    """``l`` of ``l @ l.T``: below the diagonal tile (i, j) is ``left[i][:, part] @ right[j][:, part].T``, ``inverse`` has the inverted tiles on it.

    ``row[i][j]`` and ``column[j][i]`` are the parts. What a tile leaves out is, in the mean square of its numbers, four units of rounding of
    the variance: what the sums of a dense factor lose as well.
    """

    def __init__(self, places: Sequence[tuple[np.ndarray, np.ndarray]], covariance: Callable, ceiling: float):
        n = len(places)
        self.left, self.right, self.inverse = [[] for _ in range(n)], [None] * n, []
        self.row, self.column = ([[] for _ in range(n)] for _ in range(2))
        widest = max(len(x) for x, _ in places)
        draws = np.random.default_rng(0).standard_normal((widest, widest + STEP))
        for k in range(n):
            # right[j] of row i and right[j] of row k, for all rows from k on
            between = [self.right[j][:, self.column[j][k].start:].T @ self.right[j][:, self.column[j][k]] for j in range(k)]
            made = []
            for i in range(k, n):
                a = covariance(_apart(*places[i], *places[k]))
                ours, theirs = [], []
                for j in range(k):
                    own, start = self.column[j][i], self.column[j][k].start
                    middle = between[j][own.start - start:own.stop - start]
                    if 0 < middle.shape[0] < middle.shape[1]:  # across the fewer ranks
                        ours.append(self.left[i][j])
                        theirs.append(self.left[k][j] @ middle.T)
                    elif middle.size:
                        ours.append(self.left[i][j] @ middle)
                        theirs.append(self.left[k][j])
                if ours:
                    a -= np.hstack(ours) @ np.hstack(theirs).T
                if i == k:
                    self.inverse.append(np.linalg.inv(np.linalg.cholesky(a)))
                    continue
                u, v = _thin(a, ROUNDING * ceiling * np.sqrt(a.size), draws)
                begin = self.row[i][-1].stop if self.row[i] else 0
                self.row[i].append(slice(begin, begin + u.shape[1]))
                self.left[i].append(u)
                made.append(self.inverse[k] @ v)
            ends = np.cumsum([0] * (k + 2) + [v.shape[1] for v in made])[1:]
            self.column[k] = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends)]
            self.right[k] = np.hstack(made) if made else np.zeros((len(places[k][0]), 0))
            if k:
                self.left[k] = np.hstack(self.left[k])

    def solved(self, sides: Callable):
        """The block rows of the solution, one after the other; ``sides`` gives a block row of right sides."""
        taken = [None] * len(self.inverse)
        for k, inverse in enumerate(self.inverse):
            side = sides(k)
            if k:
                side = side - self.left[k] @ taken[k]
                taken[k] = None
            y = inverse @ side
            yield y
            across = self.right[k].T @ y
            for i in range(k + 1, len(taken)):
                if taken[i] is None:
                    taken[i] = np.empty((self.row[i][-1].stop, y.shape[1]))
                taken[i][self.row[i][k]] = across[self.column[k][i]]


def solve(gx: np.ndarray, gy: np.ndarray, z: np.ndarray, trend_g: np.ndarray, tx: np.ndarray, ty: np.ndarray, trend_t: np.ndarray,
          covariance: Callable, ceiling: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and variances at the targets from all gauges; ``covariance`` maps distances to covariances, ``ceiling`` is the variance."""
    known = np.column_stack([trend_g, z])
    if ceiling == 0:  # the same value everywhere but for the trend
        return trend_t @ np.linalg.lstsq(trend_g, z)[0], np.where(np.isnan(trend_t).any(axis=1), np.nan, 0.0)
    cells = _cells(gx, gy, -(-len(gx) // leaf))
    places = [(gx[c], gy[c]) for c in cells]
    factor = _Factor(places, covariance, ceiling)
    own = list(factor.solved(lambda k: known[cells[k]]))
    inner = sum(f.T @ f for f in own)
    m = trend_g.shape[1]
    inverse = np.linalg.pinv(inner[:m, :m])
    out = np.empty(len(tx)), np.empty(len(tx))
    for c in _cells(tx, ty, -(-len(tx) // TARGETS_AT_ONCE)):
        part, squares = np.zeros((len(c), m + 1)), np.zeros(len(c))
        for k, y in enumerate(factor.solved(lambda k: covariance(_apart(*places[k], tx[c], ty[c])))):
            part += y.T @ own[k]
            squares += np.einsum("ij,ij->j", y, y)
        off = trend_t[c] - part[:, :m]
        out[0][c] = part[:, m] + off @ (inverse @ inner[:m, m])
        out[1][c] = ceiling - squares + np.sum(off @ inverse * off, axis=1)
    return out


def krige_packed(known: DataFrame, targets: DataFrame, target_id: str, value: str, covariances: Callable, time: str,
                 trends: Sequence[str], x: str, y: str, leaf: int = LEAF) -> DataFrame:
    """(time, target_id, z, variance) from all gauges of every time, in a task per time and block of targets.

    ``covariances`` gives, from the coordinates of the gauges of a time, the function from distances to covariances and the variance.
    ``trends`` are columns of both sides beside the constant. Gauges are put into cells of equal number; the tile of two cells is smooth but near
    their border, so that it is a product of thin matrices up to the rounding of doubles, and so is that of the factor.
    The factor stays in the memory of its task; nothing is written but the rows of a time and the estimates. Gauges at one place count once with their mean, which gives the same
    estimates. Covariances that are not positive definite in double precision raise.
    """
    extra = [c for c in trends if c not in (x, y)]
    places = known.groupBy(time, x, y, *extra).agg(F.avg(value).alias(value))

    def numbers(*columns):
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])

    gauges = places.groupBy(time).agg(
        F.count(F.lit(1)).alias("_n"), F.flatten(F.sort_array(F.collect_list(numbers(x, y, value, *extra)))).alias("_gauges"))
    parts = targets.groupBy(time).agg(F.count(F.lit(1)).alias("_asked")).join(gauges.select(time, "_n"), time).select(
        time, F.ceil(F.col("_asked") / F.greatest(F.col("_n"), F.lit(TARGETS_PER_BLOCK))).alias("_t"))
    wanted = targets.join(parts, time).groupBy(time, F.pmod(F.xxhash64(target_id), F.col("_t")).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(target_id).alias("id"), numbers(x, y, *extra).alias("own")))).alias("_rows"))
    rows = checkpointed(wanted.join(gauges, time).select(F.col(time).alias("_time"), "_block", "_gauges", "_rows.id", F.flatten("_rows.own").alias("own")))
    types = dict(targets.dtypes)

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                g, t = (np.asarray(a, float).reshape(-1, w + len(extra)) for a, w in ((r[2], 3), (r.own, 2)))
                gx, gy, z, tx, ty = g[:, 0], g[:, 1], g[:, 2], t[:, 0], t[:, 1]
                covariance, ceiling = covariances(gx, gy)
                trend_g, trend_t = [np.ones(len(g))], [np.ones(len(t))]
                for a, b in [{x: (gx, tx), y: (gy, ty)}[c] if c in (x, y) else (g[:, 3 + extra.index(c)], t[:, 2 + extra.index(c)]) for c in trends]:
                    # relative to the mean: the same estimates from a better conditioned system
                    trend_g.append(a - a.mean())
                    trend_t.append(b - a.mean())
                try:
                    estimate, variance = solve(gx, gy, z, np.column_stack(trend_g), tx, ty, np.column_stack(trend_t), covariance, ceiling, leaf)
                except np.linalg.LinAlgError as e:
                    raise ValueError(f"covariances at {r[0]} are not positive definite: gauges too near each other for this variogram") from e
                yield pd.DataFrame({time: [r[0]] * len(t), target_id: list(r.id), "z": estimate, "variance": variance})

    # a task per row: the rows are few and small, their work is not
    tasks = min(max(rows.count(), 1), MOST_TASKS)
    estimates = rows.repartitionByRange(tasks, "_time", "_block").mapInPandas(
        run, f"`{time}` {types[time]}, `{target_id}` {types[target_id]}, z double, variance double")
    # written, since scores read the estimates more than once
    return checkpointed(estimates)
