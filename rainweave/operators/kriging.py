"""Kriging per timestamp: ordinary, with a linear trend, or with an external drift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.operators.kriging_packed import krige_packed
from rainweave.operators.kriging_tiles import SAME_PLACE, TILE, krige_tiled
from rainweave.operators.spatial import nearest_neighbours
from rainweave.session import checkpointed

# One dense solve holds all gauges of its time: n**2 doubles, 32 MB at this bound; beyond it a time is a factor of thin matrices in the memory
# of one task, and beyond the second bound one in tiles that are written.
DENSE_GAUGES = 2048
PACKED_GAUGES = 65536
TARGETS_PER_BLOCK = 4096


def semivariance(d: np.ndarray, model: str, sill: float, span: float, nugget: float) -> np.ndarray:
    """Variogram models; ``span`` is the practical range, or the slope for ``linear``."""
    if model == "linear":
        return nugget + span * d
    if model == "exponential":
        return nugget + sill * (1 - np.exp(-3 * d / span))
    if model == "gaussian":
        return nugget + sill * (1 - np.exp(-((7 * d / (4 * span)) ** 2)))
    if model == "spherical":
        r = np.minimum(d / span, 1.0)
        return nugget + sill * (1.5 * r - 0.5 * r**3)
    raise ValueError("model must be linear, exponential, gaussian or spherical")


MODELS = ("linear", "exponential", "gaussian", "spherical")
SPANS, NUGGETS = 40, 11


def _shape(model: str, d: Column, span: Column) -> Column:
    """A model without nugget and with sill 1, or slope 1."""
    if model == "linear":
        return d
    if model == "exponential":
        return 1 - F.exp(-3 * d / span)
    if model == "gaussian":
        return 1 - F.exp(-F.pow(7 * d / (4 * span), F.lit(2.0)))
    r = F.least(d / span, F.lit(1.0))
    return 1.5 * r - 0.5 * r * r * r


def fit_variograms(bins: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """One row per model: ``model``, ``sill``, ``span``, ``nugget`` and ``loss``, the weighted mean square of what is left.

    ``bins`` has ``pairs``, ``mean_distance``, ``semivariance``; bins weigh by their pairs. All of 40 spans up to twice the largest
    distance and 11 nuggets up to the smallest semivariance are tried, and for each the best sill that is not
    negative is known in closed form. Equal losses (to six decimals): the smaller span,
    then the smaller nugget. For ``linear`` the span is the slope and the sill 0. No bins, no rows.
    """
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    bins = checkpointed(bins)  # a few rows that may stand for much work
    limits = bins.agg(F.max("mean_distance").alias("far"), F.greatest(F.min("semivariance"), F.lit(0.0)).alias("low"), F.sum("pairs").alias("all"))
    far, low, pairs = (limits.select(c).scalar() for c in ("far", "low", "all"))
    tried = bins.select(
        (F.col("pairs") / pairs).alias("w"), F.col("mean_distance").alias("d"), F.col("semivariance").alias("g"),
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), F.sequence(F.lit(1), F.lit(SPANS)).alias("steps"))
    tried = tried.withColumn("step", F.explode(F.when(F.col("model") == "linear", F.array(F.lit(1))).otherwise(F.col("steps"))))
    span = F.when(F.col("model") == "linear", F.lit(1.0)).otherwise(F.col("step") * F.lit(2.0 / SPANS) * far)
    shape = F.lit(None).cast("double")
    for m in models:
        shape = F.when(F.col("model") == m, _shape(m, F.col("d"), F.col("span"))).otherwise(shape)
    shaped = tried.withColumn("span", span).withColumn("s", shape)
    w, s, g, n, sill = (F.col(c) for c in ("w", "s", "g", "nugget", "sill"))
    noised = shaped.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(NUGGETS - 1)))).withColumn("nugget", F.col("_k") * low / F.lit(float(NUGGETS - 1)))
    trial = Window.partitionBy("model", "step", "_k")
    rated = noised.withColumn("sill", F.greatest(F.try_divide(F.sum(w * s * (g - n)).over(trial), F.sum(w * s * s).over(trial)), F.lit(0.0)))
    # summed bin by bin: from the sums of squares the loss would come out of cancellations, and equal losses as different ones
    lost = rated.groupBy("model", "step", "_k").agg(
        *[F.max(c).alias(c) for c in ("span", "nugget", "sill")], F.sum(w * F.pow(n + sill * s - g, F.lit(2.0))).alias("loss"))
    best = lost.groupBy("model").agg(F.min(F.struct(F.round("loss", 6).alias("rounded"), "span", "nugget", "sill", "loss")).alias("b"))
    line = F.col("model") == "linear"
    return best.select(
        "model", F.when(line, 0.0).otherwise(F.col("b.sill")).alias("sill"), F.when(line, F.col("b.sill")).otherwise(F.col("b.span")).alias("span"),
        F.col("b.nugget").alias("nugget"), F.col("b.loss").alias("loss"))


def fit_variogram(bins: DataFrame, model: str = "exponential") -> dict:
    """The fitted row of one model, as the kriging functions take it."""
    row = fit_variograms(bins, [model]).first()
    if row is None:
        raise ValueError("no pairs to fit a variogram to")
    return {k: row[k] for k in ("model", "sill", "span", "nugget")}


def krige(points: DataFrame, targets: DataFrame, target_id: str, value: str, variogram: dict, time: str = "time_sgt",
          drift: str | Sequence[str] | None = None, x: str = "longitude", y: str = "latitude",
          max_gauges: int | None = None, dense_gauges: int = DENSE_GAUGES, tile: int = TILE, packed_gauges: int = PACKED_GAUGES) -> DataFrame:
    """Estimate ``z`` and ``variance`` at each (time, target); columns time, target_id, z, variance.

    ``drift``: None (ordinary), ``"linear"`` (trend in the coordinates), or names of columns
    present on both sides (external drift). A time without gauges, or with zeros only, gives no
    rows. A gauge without drift is left out, a target without drift has a NULL estimate. A time of up to ``dense_gauges`` is one dense
    solve per block of targets; one of up to ``packed_gauges`` is one factor of thin matrices per block of targets (``krige_packed``), and one with more
    is solved in tiles (``krige_tiled``), from all its gauges too. More gauges at one time than ``max_gauges``, where given, raise an error.
    """
    names = [] if drift is None or drift == "linear" else [drift] if isinstance(drift, str) else list(drift)
    known = points.where(F.col(value).isNotNull()).dropna(subset=names or None, how="any" if names else "all").select(time, x, y, value, *names)
    counts = known.groupBy(time).agg(F.count(F.lit(1)).alias("_gauges"), F.max(F.col(value) != 0).alias("_rainy"))
    crowded = checkpointed(counts.where(F.col("_rainy") & (F.col("_gauges") > dense_gauges)).select(time, "_gauges"))
    fewest, most = crowded.agg(F.min("_gauges"), F.max("_gauges")).first()
    if most is None:
        return _krige_dense(known, targets, target_id, value, variogram, time, drift, names, x, y, max_gauges)
    if max_gauges is not None and most > max_gauges:
        raise ValueError(f"{most} gauges at one time, more than max_gauges={max_gauges}")

    known, targets = checkpointed(known), checkpointed(targets)  # read by each kind of solve

    def share(times, how="left_semi"):
        return [df.join(times.select(time), time, how) for df in (known, targets)]

    made = _krige_dense(*share(crowded, "left_anti"), target_id, value, variogram, time, drift, names, x, y, max_gauges)
    trends = [x, y] if drift == "linear" else names
    if fewest <= packed_gauges:
        packed = share(crowded.where(F.col("_gauges") <= packed_gauges))
        made = made.unionByName(krige_packed(*packed, target_id, value, lambda gx, gy: _covariances(variogram, np.hypot(np.ptp(gx), np.ptp(gy))), time, trends, x, y))
    if most > packed_gauges:
        many = share(crowded.where(F.col("_gauges") > packed_gauges))
        box = many[0].agg(*[F.max(c) - F.min(c) for c in (x, y)]).first() if variogram["model"] == "linear" else (0.0, 0.0)
        made = made.unionByName(krige_tiled(
            *many, target_id, value, lambda d: _gamma(d, variogram), _ceiling(variogram, float(np.hypot(*box))), time, trends, x, y, tile))
    return made


def _ceiling(variogram: dict, reach: float) -> float:
    """The variance. ``linear`` has no sill: twice what the box of the gauges, ``reach`` from corner to corner, allows keeps the covariances positive definite."""
    return variogram["nugget"] + (2 * variogram["span"] * reach if variogram["model"] == "linear" else variogram["sill"])


def _covariances(variogram: dict, reach: float):
    """The function from distances to covariances, and the variance: what ``_gamma`` leaves of the variance, without the rounding of a large nugget."""
    model, sill, span = (variogram[k] for k in ("model", "sill", "span"))
    ceiling = _ceiling(variogram, reach or 1.0)

    def covariance(d: np.ndarray) -> np.ndarray:
        if model == "exponential":
            c = np.exp(d * (-3 / span))
        elif model == "gaussian":
            c = np.exp(-((7 * d / (4 * span)) ** 2))
        elif model == "linear":
            c = d * -span
            c += ceiling - variogram["nugget"]
        else:
            c = 1 - semivariance(d, model, 1.0, span, 0.0)
        if model != "linear":
            c *= sill
        c[d <= SAME_PLACE] = ceiling
        return c

    return covariance, ceiling


def _gamma(d: np.ndarray, variogram: dict) -> np.ndarray:
    return np.where(d <= SAME_PLACE, 0.0, semivariance(d, *[variogram[k] for k in ("model", "sill", "span", "nugget")]))


def _krige_dense(known: DataFrame, targets: DataFrame, target_id: str, value: str, variogram: dict, time: str, drift, names: Sequence[str],
                 x: str, y: str, max_gauges: int | None) -> DataFrame:
    blocks = targets.groupBy(time).agg(F.ceil(F.count(F.lit(1)) / TARGETS_PER_BLOCK).alias("_n"))
    asked = targets.join(blocks, time).select(
        time, F.pmod(F.xxhash64(target_id), F.col("_n")).alias("_block"), target_id, x, y, *names
    )
    copies = known.join(blocks, time).select(
        time, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_block"), x, y, value, *names
    )
    # fresh column identities, since both sides may stem from one table
    gauges = copies.select(*[F.col(c).alias(c) for c in copies.columns]).groupBy(time, "_block")
    types = dict(targets.dtypes)
    schema = f"`{time}` {types[time]}, `{target_id}` {types[target_id]}, z double, variance double"

    def solve(gauge: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({time: [], target_id: [], "z": [], "variance": []})
        if len(target) == 0 or len(gauge) == 0 or not (gauge[value] != 0).any():
            return target[[time, target_id]].iloc[:0].assign(z=0.0, variance=0.0) if len(target) else empty
        if max_gauges is not None and len(gauge) > max_gauges:
            raise ValueError(f"{len(gauge)} gauges at one time, more than max_gauges={max_gauges}")
        gx, gy, z = (gauge[c].to_numpy(float) for c in (x, y, value))
        tx, ty = target[x].to_numpy(float), target[y].to_numpy(float)
        n = len(z)
        trend_g, trend_t = [np.ones(n)], [np.ones(len(tx))]
        if drift == "linear":
            trend_g += [gx, gy]
            trend_t += [tx, ty]
        for name in names:
            trend_g.append(gauge[name].to_numpy(float))
            trend_t.append(target[name].to_numpy(float))
        m = len(trend_g)
        left = np.zeros((n + m, n + m))
        left[:n, :n] = _gamma(np.hypot(gx[:, None] - gx, gy[:, None] - gy), variogram)
        left[:n, n:] = np.array(trend_g).T
        left[n:, :n] = np.array(trend_g)
        right = np.vstack([_gamma(np.hypot(gx[:, None] - tx, gy[:, None] - ty), variogram), np.array(trend_t)])
        weights = np.linalg.pinv(left) @ right
        return pd.DataFrame({
            time: target[time].to_numpy(), target_id: target[target_id].to_numpy(),
            "z": z @ weights[:n], "variance": np.sum(weights * right, axis=0),
        })

    return gauges.cogroup(asked.groupBy(time, "_block")).applyInPandas(solve, schema)


STACK_VALUES = 2_000_000  # numbers in the matrices that are solved at once, 16 MB


def _stacks(batch: pd.DataFrame, sizes: pd.Series, extra: int):
    """(size, rows) of systems of one size, cut so that their matrices stay small."""
    for k, rows in batch.groupby(sizes):
        step = max(1, STACK_VALUES // (k + extra) ** 2)
        for at in range(0, len(rows), step):
            yield k, rows.iloc[at:at + step]


def krige_nearest(points: DataFrame, targets: DataFrame, target_id: str, value: str, variogram: dict, n_closest: int, point_id: str = "gid",
                  time: str = "time_sgt", drift: str | Sequence[str] | None = None, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """``krige`` with the ``n_closest`` gauges of each target, so any number of gauges at one time will do.

    Ties of distance go to the smaller gauge id. Every target is a small system of its own, solved
    in stacks; neighbours are found by the tree of squares, not from all pairs. Columns and the treatment of
    missing drift and of times with zeros only are those of ``krige``; with fewer gauges all are used.
    """
    names = [] if drift is None or drift == "linear" else [drift] if isinstance(drift, str) else list(drift)
    known = points.where(F.col(value).isNotNull()).dropna(subset=names or None, how="any" if names else "all")
    rainy = known.where(F.col(value) != 0).select(time).distinct()
    copies = {"_gx": x, "_gy": y, "_gz": value, **{f"_g_{n}": n for n in names}}
    carried = list(copies)
    known = known.join(rainy, time, "left_semi").withColumns({c: F.col(own) for c, own in copies.items()})
    near = nearest_neighbours(targets, known, n_closest, [target_id], point_id, by=[time], x=x, y=y, payload=carried)
    gathered = near.groupBy(time, target_id).agg(F.sort_array(F.collect_list(F.struct("rank", *carried))).alias("_near"))
    asked = targets.select(time, target_id, x, y, *names).join(gathered, [time, target_id]).select(
        time, target_id, F.array(*[F.col(c).cast("double") for c in (x, y, *names)]).alias("_own"),
        *[F.col(f"_near.{c}").cast("array<double>").alias(c) for c in carried],
    )
    types = dict(targets.dtypes)
    # semivariances near 1 beside the trend: the same weights from a better conditioned system
    unit = variogram["nugget"] + variogram["span" if variogram["model"] == "linear" else "sill"] or 1.0

    def solve(batches):
        for batch in batches:
            parts = [batch.iloc[:0][[time, target_id]].assign(z=0.0, variance=0.0)]
            for k, rows in _stacks(batch, batch["_gx"].map(len), 1 + len(names) + (2 if drift == "linear" else 0)):
                column = {c: np.array(rows[c].tolist(), dtype=float).reshape(len(rows), k) for c in carried}
                own = np.array(rows["_own"].tolist(), dtype=float).reshape(len(rows), 2 + len(names))
                gx, gy = column["_gx"], column["_gy"]
                trend_g, trend_t = [np.ones_like(gx)], [np.ones(len(rows))]
                if drift == "linear":
                    # relative to the target, the same estimate and a better conditioned system
                    trend_g += [gx - own[:, :1], gy - own[:, 1:2]]
                    trend_t += [np.zeros(len(rows)), np.zeros(len(rows))]
                for j, name in enumerate(names):
                    trend_g.append(column[f"_g_{name}"])
                    trend_t.append(own[:, 2 + j])
                trend_g, trend_t = np.stack(trend_g, axis=1), np.stack(trend_t, axis=1)
                m = trend_g.shape[1]
                between = np.hypot(gx[:, :, None] - gx[:, None, :], gy[:, :, None] - gy[:, None, :])
                apart = np.hypot(gx - own[:, :1], gy - own[:, 1:2])
                gamma_g, gamma_t = (np.where(d <= SAME_PLACE, 0.0, semivariance(d, **variogram) / unit) for d in (between, apart))
                left = np.zeros((len(rows), k + m, k + m))
                left[:, :k, :k], left[:, :k, k:], left[:, k:, :k] = gamma_g, trend_g.transpose(0, 2, 1), trend_g
                right = np.concatenate([gamma_t, trend_t], axis=1)
                weights = (np.linalg.pinv(left) @ right[:, :, None])[:, :, 0]
                parts.append(rows[[time, target_id]].assign(
                    z=np.sum(weights[:, :k] * column["_gz"], axis=1), variance=unit * np.sum(weights * right, axis=1)))
            yield pd.concat(parts, ignore_index=True)

    return asked.mapInPandas(solve, f"`{time}` {types[time]}, `{target_id}` {types[target_id]}, z double, variance double")


def interpolate(points: DataFrame, targets: DataFrame, target_id: str, value: str, method: str = "idw", neighbours: int | None = None, **options) -> DataFrame:
    """One entry for all estimators: idw, nearest, ordinary, universal, external_drift.

    With ``neighbours`` the kriging methods solve a small system per target from that many gauges (``krige_nearest``), without a
    bound on the gauges of a time; without it one dense system per time.
    """
    from rainweave.operators.gridding import inverse_distance, nearest_value

    if method == "idw":
        return inverse_distance(targets, points, [target_id], options.pop("point_id"), value, **options)
    if method == "nearest":
        return nearest_value(targets, points, [target_id], options.pop("point_id"), value, **options)
    if method not in ("ordinary", "universal", "external_drift"):
        raise ValueError("method must be idw, nearest, ordinary, universal or external_drift")
    if method == "universal":
        options["drift"] = "linear"
    variogram = options.pop("variogram")
    if neighbours is not None:
        return krige_nearest(points, targets, target_id, value, variogram, neighbours, **options)
    return krige(points, targets, target_id, value, variogram, **options)
