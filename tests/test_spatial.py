import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainweave.functions.geo import KM_PER_DEGREE
from rainweave.operators import gridding, kriging, kriging_packed, spatial
from rainweave.session import checkpoint_folder


def crowd(n, seed, groups=1):
    """Points of which a third share one place and another third crowd in a tiny square."""
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(103.6, 104.1, n), rng.uniform(1.188, 1.5, n)
    third = n // 3
    x[:third], y[:third] = 103.8, 1.3
    x[third:2 * third] = 103.9 + rng.random(third) * 1e-4
    y[third:2 * third] = 1.4 + rng.random(third) * 1e-4
    return pd.DataFrame({"id": np.arange(n), "longitude": x, "latitude": y, "g": rng.integers(0, groups, n), "z": rng.random(n) * 10})


def distances(a, b):
    return np.sqrt((a["longitude"].to_numpy()[:, None] - b["longitude"].to_numpy()) ** 2
                   + (a["latitude"].to_numpy()[:, None] - b["latitude"].to_numpy()) ** 2)


def brute_knn(sources, targets, k, by=None, without_self=False, limit=None):
    want = {}
    groups = [None] if by is None else sorted(set(sources[by]))
    for g in groups:
        s = sources if g is None else sources[sources[by] == g]
        t = targets if g is None else targets[targets[by] == g]
        if not len(t):
            continue
        d = distances(s, t)
        ids = t["id"].to_numpy()
        for i, sid in enumerate(s["id"]):
            rows = sorted(zip(d[i], ids))
            rows = [(v, j) for v, j in rows if not (without_self and j == sid) and (limit is None or v < limit)]
            want[sid] = [j for _, j in rows[:k]]
    return {s: v for s, v in want.items() if v}


@pytest.mark.parametrize("n, k, groups, without_self, limit", [
    (20, 3, 1, True, None), (900, 4, 1, True, None), (900, 15, 1, False, None), (900, 4, 3, False, None), (900, 5, 1, False, 0.01),
    (3, 4, 1, True, None), (1, 4, 1, True, None),
])
def test_nearest_neighbours(spark, n, k, groups, without_self, limit):
    data = crowd(n, 5, groups)
    by = ["g"] if groups > 1 else []
    s = spark.createDataFrame(data).withColumnRenamed("id", "src")
    t = spark.createDataFrame(data).withColumnRenamed("id", "dst")
    got = spatial.nearest_neighbours(s, t, k, ["src"], "dst", by, payload=["z"], without_self=without_self, max_distance=limit).toPandas()
    found = {i: g.sort_values("rank")["dst"].tolist() for i, g in got.groupby("src")}
    assert found == brute_knn(data, data, k, "g" if by else None, without_self, limit)
    if len(got):
        assert np.allclose(got["z"], data.set_index("id").loc[got["dst"], "z"])


def test_a_crowded_square_is_cut_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SQUARE_ROWS", 16, raising=False)
    rows = [(k, 103.7 + 1e-5 * k, 1.3) for k in range(200)]
    s = spark.createDataFrame(rows, "gid long, longitude double, latitude double")
    got = spatial.radius_join(s, s, 4.0, "gid", "gid", without_self=True)
    assert got.count() == got.distinct().count() == 200 * 199
    assert got.groupBy(F.spark_partition_id()).count().count() > 4


def test_neighbour_tasks_follow_the_number_of_sources(spark, monkeypatch):
    # sources are few bytes and grow to many rows, so a cut by bytes left all of them in one task
    monkeypatch.setattr(spatial, "SOURCES_PER_TASK", 16, raising=False)
    data = crowd(300, 5, 1)
    s = spark.createDataFrame(data).withColumnRenamed("id", "src")
    got = spatial.nearest_neighbours(s, spark.createDataFrame(data).withColumnRenamed("id", "dst"), 3, ["src"], "dst")
    sizes = got.groupBy(F.spark_partition_id()).agg(F.countDistinct("src").alias("n")).toPandas()["n"]
    assert sizes.sum() == len(data) and sizes.max() <= 64


@pytest.mark.parametrize("groups", [1, 2])
def test_neighbour_tasks_stay_dealt_after_a_join_by_square(spark, monkeypatch, groups):
    # with many squares a level is joined by a shuffle, after which adaptive execution merged the sources by their few bytes
    for name, value in (("SOURCES_PER_TASK", 16), ("FEW_SQUARES", 16), ("LEAF_SITES", 2)):
        monkeypatch.setattr(spatial, name, value, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        data = crowd(700, 5, groups)
        by = ["g"] if groups > 1 else []
        s = spark.createDataFrame(data).withColumnRenamed("id", "src")
        got = spatial.nearest_neighbours(s, spark.createDataFrame(data).withColumnRenamed("id", "dst"), 3, ["src"], "dst", by)
        rows = got.withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sizes = rows.groupby("task")["src"].nunique()
    assert sizes.sum() == len(data) and sizes.max() <= 64
    found = {i: g.sort_values("rank")["dst"].tolist() for i, g in rows.groupby("src")}
    assert found == brute_knn(data, data, 3, "g" if by else None, False, None)


def test_small_leaves_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF_SITES", 2)
    data = crowd(300, 8)
    s = spark.createDataFrame(data).withColumnRenamed("id", "src")
    t = spark.createDataFrame(data).withColumnRenamed("id", "dst")
    got = spatial.nearest_neighbours(s, t, 3, ["src"], "dst", without_self=True).toPandas()
    assert {i: g.sort_values("rank")["dst"].tolist() for i, g in got.groupby("src")} == brute_knn(data, data, 3, None, True)


def test_radius_join(spark):
    a, b = crowd(200, 1), crowd(150, 2)
    got = spatial.radius_join(spark.createDataFrame(a), spark.createDataFrame(b), 2.0, "id", "id").toPandas()
    d = distances(a, b)
    want = {(i, j) for i, j in zip(*np.where(d <= 2.0 / KM_PER_DEGREE))}
    assert set(zip(got["src"], got["dst"])) == want and len(got) == len(want)
    assert np.allclose(got["dist"], [d[i, j] * KM_PER_DEGREE for i, j in zip(got["src"], got["dst"])])


def test_radius_join_without_any_pair(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id int, longitude double, latitude double")
    b = spark.createDataFrame([(2, 9.0, 9.0)], "id int, longitude double, latitude double")
    got = spatial.radius_join(a, b, 1.0, "id", "id")
    assert got.columns == ["src", "dst", "dist"] and got.count() == 0


def test_grid(spark):
    grid = spatial.make_grid(spark, (103.605, 104.1, 0.01), (1.145, 1.51, 0.01)).toPandas()
    assert len(grid) == 50 * 37
    assert grid.sort_values(["row", "col"])["y"].iloc[0] == pytest.approx(1.505)
    with pytest.raises(ValueError):
        spatial.grid_around(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y", 0)


def test_coverage_has_round_caps(spark):
    link = [(0.0, 0.0, 1.0, 0.0)]
    links = spark.createDataFrame(link, "site_a_longitude double, site_a_latitude double, site_b_longitude double, site_b_latitude double")
    cells = spark.createDataFrame([(1, 0.5, 0.09), (2, 1.08, 0.0), (3, 1.08, 0.08), (4, -0.11, 0.0), (5, 0.5, 0.11)], "id int, x double, y double")
    got = {r.id: r.covered for r in spatial.covered_cells(cells, links, 0.1, ["id"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


@pytest.fixture(scope="module")
def gauges():
    rng = np.random.default_rng(4)
    rows = []
    for t, n in (("t0", 700), ("t1", 40), ("t2", 3)):
        p = crowd(n, n)
        rows.append(p.assign(time_sgt=t, z=np.where(rng.random(n) < 0.1, np.nan, p["z"])))
    return pd.concat(rows, ignore_index=True).rename(columns={"id": "gid"}).drop(columns="g")


def idw(d, z, k):
    order = np.argsort(d, kind="stable")[:k]
    d, z = d[order], z[order]
    return z[0] if d[0] == 0 else np.sum(z / d**2) / np.sum(1 / d**2)


@pytest.mark.parametrize("k", [15, None])
def test_inverse_distance(spark, gauges, k):
    cells = pd.DataFrame({"cell": np.arange(12), "longitude": np.linspace(103.61, 104.05, 12), "latitude": np.linspace(1.45, 1.2, 12)})
    cells.loc[0, ["longitude", "latitude"]] = [103.8, 1.3]
    targets = pd.concat([cells.assign(time_sgt=t) for t in ("t0", "t1", "t2")], ignore_index=True)
    points = spark.createDataFrame(gauges).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    got = gridding.inverse_distance(spark.createDataFrame(targets), points, ["cell"], "gid", "z", k=k).toPandas()
    assert len(got) == len(targets)
    for row in got.itertuples():
        part = gauges[(gauges["time_sgt"] == row.time_sgt) & gauges["z"].notna()]
        d = np.sqrt((part["longitude"] - row.longitude) ** 2 + (part["latitude"] - row.latitude) ** 2).to_numpy()
        assert row.z == pytest.approx(idw(d, part["z"].to_numpy(), k or len(part)))


def test_inverse_distance_needs_two(spark, gauges):
    df = spark.createDataFrame(gauges)
    with pytest.raises(ValueError):
        gridding.inverse_distance(df, df, ["gid"], "gid", "z", k=1, max_distance=0.1)


def test_variogram(spark, gauges):
    points = gauges[gauges["z"].notna()]
    bins = gridding.empirical_variogram(spark.createDataFrame(points), "z", 0.05)
    got = bins.toPandas().set_index("lag_bin").sort_index()
    want = {}
    for _, part in points.groupby("time_sgt"):
        d, z = distances(part, part), part["z"].to_numpy()
        i, j = np.triu_indices(len(part), 1)
        for b, g in zip((d[i, j] // 0.05).astype(int), 0.5 * (z[i] - z[j]) ** 2):
            want.setdefault(b, []).append(g)
    assert got.index.tolist() == sorted(want)
    assert got["pairs"].tolist() == [len(want[b]) for b in sorted(want)]
    assert np.allclose(got["semivariance"], [np.mean(want[b]) for b in sorted(want)])
    near = gridding.empirical_variogram(spark.createDataFrame(points), "z", 0.05, max_lag=0.15).toPandas().set_index("lag_bin").sort_index()
    for b in range(3):  # squares see the same pairs
        assert near["pairs"][b] == len(want[b]) and near["semivariance"][b] == pytest.approx(np.mean(want[b]))
    assert list(near.index) == [0, 1, 2]
    with pytest.raises(ValueError):
        gridding.empirical_variogram(bins, "z", 0.5, max_lag=0.1)


def test_variogram_of_rows_in_changing_order(spark):
    # every computation of the points gives another order of rows, as after a shuffle
    n = 200
    rows = [(i, t, (i * 37 % 101) * 0.004, (i * 53 % 97) * 0.003, float(i * t % 7)) for i in range(n) for t in (1, 2)]
    points = spark.createDataFrame(rows, "gid long, time_sgt int, longitude double, latitude double, z double").coalesce(1)
    mixed = points.mapInPandas(lambda batches: (b.sample(frac=1) for b in batches), points.schema)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        bins = gridding.empirical_variogram(mixed, "z", 0.05).toPandas().set_index("lag_bin").sort_index()
        near = gridding.empirical_variogram(mixed, "z", 0.05, max_lag=0.1).toPandas().set_index("lag_bin").sort_index()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = {}
    for t in (1, 2):
        own = [r for r in rows if r[1] == t]
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                d = float(np.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2))
                want.setdefault(int(d // 0.05), []).append((d, 0.5 * (a[4] - b[4]) ** 2))
    assert bins["pairs"].to_dict() == {b: len(v) for b, v in want.items()}
    for name, k in (("mean_distance", 0), ("semivariance", 1)):
        assert bins[name].to_dict() == pytest.approx({b: np.mean([p[k] for p in v]) for b, v in want.items()})
        assert near[name].to_dict() == pytest.approx({b: bins[name][b] for b in (0, 1)})


@pytest.mark.parametrize("model", kriging.MODELS)
def test_fit_finds_the_model_it_was_made_from(spark, model):
    d = np.arange(1, 41) * 0.025
    made = kriging.semivariance(d, model, 7.0, 0.5 if model != "linear" else 3.0, 0.0)
    rows = [(int(k), int(5 + k % 7), float(x), float(g)) for k, (x, g) in enumerate(zip(d, made))]
    bins = spark.createDataFrame(rows, "lag_bin long, pairs long, mean_distance double, semivariance double")
    fitted = kriging.fit_variogram(bins, model)
    want = {"sill": 0.0 if model == "linear" else 7.0, "span": 3.0 if model == "linear" else 0.5, "nugget": 0.0}
    assert {k: fitted[k] for k in want} == pytest.approx(want, abs=1e-6) and fitted["model"] == model
    # the loss of every trial, by numpy
    row = kriging.fit_variograms(bins.withColumn("semivariance", F.col("semivariance") + F.col("lag_bin") % 3), [model]).first()
    noisy, w = made + np.arange(40) % 3, np.array([r[1] for r in rows], float) / sum(r[1] for r in rows)
    best = min(
        (np.sum(w * (nugget + sill * shape - noisy) ** 2) for span in ([1.0] if model == "linear" else np.arange(1, 41) * 0.05 * d.max()) for nugget in np.linspace(0, noisy.min(), 11)
         for shape in [kriging.semivariance(d, model, 1.0, span, 0.0)] for sill in [max(0.0, np.sum(w * shape * (noisy - nugget)) / np.sum(w * shape * shape))]))
    assert row.loss == pytest.approx(best)
    assert kriging.fit_variograms(bins.limit(0)).count() == 0
    with pytest.raises(ValueError):
        kriging.fit_variogram(bins.limit(0))


def test_interpolate_reaches_small_systems(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, float(rng.random()), float(rng.random()), float(rng.random())) for i in range(30)]
    p = spark.createDataFrame(rows, "time_sgt string, gid long, longitude double, latitude double, z double")
    t = spark.createDataFrame([("a", 1, 0.4, 0.6)], "time_sgt string, cell long, longitude double, latitude double")
    whole = kriging.interpolate(p, t, "cell", "z", "ordinary", variogram=SHAPE).first().z
    assert kriging.interpolate(p, t, "cell", "z", "ordinary", neighbours=30, variogram=SHAPE).first().z == pytest.approx(whole)
    assert kriging.interpolate(p, t, "cell", "z", "ordinary", neighbours=3, variogram=SHAPE).first().z != pytest.approx(whole, abs=1e-9)


SHAPE = {"model": "exponential", "sill": 8.0, "span": 0.3, "nugget": 0.0}


def kriged(spark, points, targets, **options):
    schema = "time_sgt string, gid long, longitude double, latitude double, z double"
    p = spark.createDataFrame(points, schema)
    t = spark.createDataFrame(targets, "time_sgt string, cell long, longitude double, latitude double")
    return kriging.krige(p, t, "cell", "z", SHAPE, **options).toPandas()


PLANE = [("a", i, 103.6 + 0.05 * (i % 5), 1.2 + 0.06 * (i // 5), 3.0 + 2 * (i % 5) - (i // 5)) for i in range(20)]


def test_equal_losses_go_to_the_smaller_nugget(spark):
    # a span before the first bin makes nugget and sill one sum, so all nuggets fit alike; the rest is large beside the sixth decimal
    g = [217310.5, 216999.0, 214020.75, 213000.25, 215123.5, 214876.25, 215432.0, 213987.5, 216012.75, 215001.0]
    rows = [(k, 1000 + 137 * k, 0.0136 + 0.02 * k, v) for k, v in enumerate(g)]
    bins = spark.createDataFrame(rows, "lag_bin long, pairs long, mean_distance double, semivariance double")
    row = kriging.fit_variograms(bins, ["spherical"]).first()
    w = np.array([r[1] for r in rows], float) / sum(r[1] for r in rows)
    assert row.nugget == 0.0 and row.span == pytest.approx(0.05 * rows[-1][2]) and row.sill == pytest.approx(np.sum(w * g))
    assert row.loss == pytest.approx(np.sum(w * (np.array(g) - np.sum(w * g)) ** 2), abs=1e-6)


@pytest.mark.parametrize("drift", [None, "linear"])
def test_kriging_is_exact_at_gauges(spark, drift):
    targets = [("a", r[1], r[2], r[3]) for r in PLANE]
    got = kriged(spark, PLANE, targets, drift=drift).set_index("cell").sort_index()
    assert np.allclose(got["z"], [r[4] for r in PLANE], atol=1e-6)
    assert np.allclose(got["variance"], 0, atol=1e-6)


def test_universal_kriging_follows_a_plane(spark):
    got = kriged(spark, PLANE, [("a", 1, 103.6 + 0.05 * 1.5, 1.2 + 0.06 * 0.5)], drift="linear")
    assert got["z"].iloc[0] == pytest.approx(3.0 + 3.0 - 0.5, abs=1e-6)
    assert got["variance"].iloc[0] > 0


def test_constant_field_and_skipped_times(spark):
    points = [(t, i, 103.6 + 0.1 * i, 1.2 + 0.03 * i * i, v) for t, v in (("a", 5.0), ("b", 0.0)) for i in range(5)]
    got = kriged(spark, points, [(t, 1, 103.77, 1.3) for t in ("a", "b", "c")])
    assert got["time_sgt"].tolist() == ["a"] and got["z"].iloc[0] == pytest.approx(5.0)


def test_kriging_refuses_what_it_cannot_hold(spark):
    with pytest.raises(Exception, match="max_gauges"):
        kriged(spark, PLANE, [("a", 1, 103.7, 1.3)], max_gauges=10)


@pytest.mark.parametrize("drift", [None, "linear"])
def test_nearest_kriging_with_all_gauges_is_kriging(spark, drift):
    p = spark.createDataFrame(PLANE + [("b", 1, 103.7, 1.3, 0.0)], "time_sgt string, gid long, longitude double, latitude double, z double")
    t = spark.createDataFrame([("a", 1, 103.71, 1.29), ("a", 2, 103.6, 1.2), ("b", 3, 103.7, 1.3), ("c", 4, 103.7, 1.3)],
                              "time_sgt string, cell long, longitude double, latitude double")
    whole = kriging.krige(p, t, "cell", "z", SHAPE, drift=drift).toPandas().sort_values("cell")
    near = kriging.krige_nearest(p, t, "cell", "z", SHAPE, 20, drift=drift).toPandas().sort_values("cell")
    assert near["cell"].tolist() == whole["cell"].tolist() == [1, 2]
    assert np.allclose(near[["z", "variance"]], whole[["z", "variance"]], atol=1e-6)
    few = kriging.krige_nearest(p, t, "cell", "z", SHAPE, 3).toPandas().set_index("cell")["z"]
    assert few[2] == pytest.approx(3.0) and 0 < few[1] < 12
    assert kriging.krige_nearest(p, t.limit(0), "cell", "z", SHAPE, 3).count() == 0


def test_external_drift(spark):
    # truth is twice the drift: external drift kriging recovers it away from the gauges
    rng = np.random.default_rng(0)
    drift = rng.random(20)
    rows = [(*r[:4], float(2 * d + 1), float(d)) for r, d in zip(PLANE, drift)]
    p = spark.createDataFrame(rows, "time_sgt string, gid long, longitude double, latitude double, z double, radar double")
    t = spark.createDataFrame([("a", 7, 103.72, 1.29, 0.4)], "time_sgt string, cell long, longitude double, latitude double, radar double")
    got = kriging.interpolate(p, t, "cell", "z", "external_drift", variogram=SHAPE, drift="radar").collect()
    assert got[0].z == pytest.approx(1.8, abs=1e-6)
    with pytest.raises(ValueError):
        kriging.interpolate(p, t, "cell", "z", "delaunay")


def test_interpolate_dispatch(spark):
    p = spark.createDataFrame(PLANE, "time_sgt string, gid long, longitude double, latitude double, z double")
    t = spark.createDataFrame([("a", 7, 103.6, 1.2)], "time_sgt string, cell long, longitude double, latitude double")
    for method, options in (("idw", {"point_id": "gid", "k": 3}), ("nearest", {"point_id": "gid"}), ("ordinary", {"variogram": SHAPE}),
                            ("universal", {"variogram": SHAPE})):
        assert kriging.interpolate(p, t, "cell", "z", method, **options).collect()[0].z == pytest.approx(3.0)


@pytest.mark.parametrize("name", ["i5_nearest_universal_grid", "i6_nearest_external_drift_grid"])
def test_grid_kriging_with_a_trend_equals_a_plain_solve(spark, name):
    from rainweave.plans import spatial as plans

    folder = "/root/testdata/sf0.001"
    points = plans.gauge_rain(spark, folder, 1440)
    cells = plans._grid_times(spark, folder, points)
    radar = name.startswith("i6")
    p, t = ((plans._with_drift(spark, folder, df) if radar else df).toPandas() for df in (points, cells))
    got = plans.__dict__[name](spark, folder).toPandas().set_index(["time_sgt", "cell_id"])
    assert len(got) > 100
    v, checked = plans.fitted_variogram(spark, folder, points), 0
    for day, own in p.dropna().groupby("time_sgt"):
        for cell in t[(t.time_sgt == day) & (t.cell_id % 9 == 4)].itertuples():
            if not (own.z != 0).any():
                assert (day, cell.cell_id) not in got.index
                continue
            far = np.hypot(own.longitude - cell.longitude, own.latitude - cell.latitude)
            near = own.assign(far=far).sort_values(["far", "gid"]).head(8)
            xy = near[["longitude", "latitude"]].to_numpy()
            trend, target = ([near.radar], [cell.radar]) if radar else ([*(xy - [cell.longitude, cell.latitude]).T], [0.0, 0.0])
            trend, target, n = np.array([np.ones(len(near)), *trend]), np.array([1.0, *target]), len(near)

            def gamma(d):
                # in units of the sill: the weights do not change
                return np.where(d <= 1e-10, 0.0, v["nugget"] / v["sill"] + 1 - np.exp(-3 * d / v["span"]))

            left = np.block([[gamma(np.hypot(*(xy[:, None] - xy).transpose(2, 0, 1))), trend.T], [trend, np.zeros((len(trend),) * 2)]])
            w = np.linalg.pinv(left) @ np.concatenate([gamma(near.far.to_numpy()), target])
            assert got.loc[(day, cell.cell_id), "z"] == pytest.approx(w[:n] @ near.z.to_numpy(), rel=1e-6, abs=1e-6, nan_ok=True)
            checked += 1
    assert checked > 10


def test_squares_of_a_link_grow_with_its_length(spark):
    def squares(rows, reach=0.01):
        links = spark.createDataFrame(rows, "site_a_longitude double, site_a_latitude double, site_b_longitude double, site_b_latitude double")
        return spatial.link_squares(links, reach).count()

    for dx, dy in ((1, 1), (0, 1), (1, 0), (1, 0.03), (-0.4, 1)):
        short, long = squares([(0.0, 0.0, 1.0 * dx, 1.0 * dy)]), squares([(0.0, 0.0, 8.0 * dx, 8.0 * dy)])
        assert long < 9 * short


@pytest.mark.parametrize("reach", [0.05, 0.011, 0.0])
def test_coverage_equals_all_distances(spark, reach):
    rng = np.random.default_rng(8)
    links = [tuple(map(float, r)) for r in rng.uniform(-1, 1, (25, 4))] + [(0.1, -0.9, 0.1, 0.9), (-0.9, 0.2, 0.9, 0.2), (0.3, 0.3, 0.3, 0.3)]
    cells = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1.1, 1.1, (1500, 2)))] + [(9000, 0.3, 0.3), (9001, 0.1, 0.0)]
    got = spatial.covered_cells(spark.createDataFrame(cells, "cell int, x double, y double"), spark.createDataFrame(
        links, "site_a_longitude double, site_a_latitude double, site_b_longitude double, site_b_latitude double"), reach, ["cell"])
    want = {}
    for i, px, py in cells:
        best = np.inf
        for ax, ay, bx, by in links:
            size = (bx - ax) ** 2 + (by - ay) ** 2
            u = min(1, max(0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / size)) if size else 0
            best = min(best, np.hypot(px - ax - u * (bx - ax), py - ay - u * (by - ay)))
        want[i] = best <= reach
    assert {r.cell: r.covered for r in got.collect()} == want and any(want.values())
    with pytest.raises(ValueError):
        spatial.link_squares(got, -1.0)


@pytest.mark.parametrize("model, drift", [("exponential", None), ("linear", "linear"), ("spherical", "radar")])
def test_many_gauges_are_solved_in_tiles(spark, model, drift):
    # gauges of a time beyond one dense solve; two of them at one place, a time of zeros, a small time, targets without drift
    rng = np.random.default_rng(3)
    shape = {"model": model, "sill": 0.0 if model == "linear" else 4.0, "span": 0.3, "nugget": 0.2}
    xy, radar = rng.random((45, 2)), rng.random(45)
    xy[7], radar[7] = xy[3], radar[3]
    rows = [(t, i, *map(float, xy[i]), 0.0 if t == "b" else float(3 * xy[i, 0] + rng.random()), float(radar[i])) for t, n in (("a", 45), ("b", 45), ("c", 12)) for i in range(n)]
    p = spark.createDataFrame(rows, "time_sgt string, gid long, longitude double, latitude double, z double, radar double")
    places = [*map(tuple, rng.random((16, 2))), tuple(xy[3])]
    t = spark.createDataFrame([(d, k, float(a), float(b), None if k == 5 else float(k) / 20) for d in "abcd" for k, (a, b) in enumerate(places)],
                              "time_sgt string, cell long, longitude double, latitude double, radar double")

    def got(**options):
        return kriging.krige(p, t, "cell", "z", shape, drift=drift, **options).toPandas().sort_values(["time_sgt", "cell"], ignore_index=True)

    whole, tiled = got(), got(dense_gauges=20, tile=16)
    assert tiled[["time_sgt", "cell"]].equals(whole[["time_sgt", "cell"]]) and set(tiled.time_sgt) == {"a", "c"}
    assert np.allclose(tiled[["z", "variance"]], whole[["z", "variance"]], atol=1e-8, equal_nan=True)
    assert tiled.z.isna().sum() == (2 if drift == "radar" else 0)


def test_a_flat_variogram_in_tiles_gives_the_mean(spark):
    got = kriging.krige(*[spark.createDataFrame(PLANE, f"time_sgt string, {c} long, longitude double, latitude double, z double") for c in ("gid", "cell")],
                        "cell", "z", SHAPE | {"sill": 0.0}, dense_gauges=5, tile=6).toPandas()
    assert len(got) == 20 and np.allclose(got["z"], np.mean([r[4] for r in PLANE])) and np.allclose(got["variance"], 0)


def plain_kriging(shape, gauges, targets, trend_g=(), trend_t=()):
    """One dense solve by numpy; gauges (x, y, z), targets (x, y), all at places of their own."""
    (gx, gy, z), (tx, ty) = (np.asarray(a, float).T for a in (gauges, targets))

    def gamma(x, y):
        d = np.hypot(gx[:, None] - x, gy[:, None] - y)
        return np.where(d <= 1e-10, 0.0, kriging.semivariance(d, *[shape[k] for k in ("model", "sill", "span", "nugget")]))

    f, g = (np.column_stack([np.ones(n), *t]) for n, t in ((len(gx), trend_g), (len(tx), trend_t)))
    left = np.block([[gamma(gx, gy), f], [f.T, np.zeros((f.shape[1],) * 2)]])
    right = np.vstack([gamma(tx, ty), g.T])
    w = np.linalg.solve(left, right)
    return z @ w[:len(z)], np.sum(w * right, axis=0)


@pytest.mark.parametrize("trend", [False, True])
@pytest.mark.parametrize("model, nugget", [("exponential", 0.0), ("exponential", 900.0), ("spherical", 0.5), ("linear", 0.1), ("gaussian", 0.5)])
def test_a_packed_factor_equals_a_plain_solve(model, nugget, trend):
    rng = np.random.default_rng(5)
    shape = {"model": model, "sill": 0.0 if model == "linear" else 4.0, "span": 0.4, "nugget": nugget}
    xyz, to = rng.random((350, 3)), np.vstack([rng.random((600, 2)), [[3.0, 2.0]]])
    xyz[:, 2] += 3 * xyz[:, 0]
    to[0] = xyz[4, :2]  # at a gauge
    sides = [(list(a[:, :2].T) if trend else []) for a in (xyz, to)]
    found = kriging_packed.solve(*xyz.T, np.column_stack([np.ones(350), *sides[0]]), *to.T, np.column_stack([np.ones(601), *sides[1]]),
                                 *kriging._covariances(shape, 2.0), leaf=24)
    want = plain_kriging(shape, xyz, to, *sides)
    assert np.allclose(found[0], want[0], atol=1e-9) and np.allclose(found[1], want[1], atol=1e-9 * (1 + nugget))
    assert found[0][0] == pytest.approx(xyz[4, 2]) and found[1][0] == pytest.approx(0, abs=1e-9 * (1 + nugget))


def written(spark):
    """Bytes in the folder of tables that are written once."""
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(checkpoint_folder(spark).removeprefix("file:")) for f in names)


@pytest.mark.parametrize("drift", [None, "linear", "radar"])
def test_the_factor_of_many_gauges_is_not_written(spark, drift):
    # 2300 gauges of one time; two more rows at places of others, a time of zeros, a small time, a target without drift
    rng = np.random.default_rng(11)
    xy, radar, n = rng.random((2300, 2)), rng.random(2300), 2300
    z = 3 * xy[:, 0] + rng.random(n)
    rows = [("a", *map(float, (*xy[i], z[i], radar[i]))) for i in range(n)]
    rows += [("a", *map(float, (*xy[i], z[i] + 1, radar[i]))) for i in (3, 8)]
    rows += [("b", *r[1:3], 0.0, r[4]) for r in rows] + [("c", *r[1:]) for r in rows[:12]]
    p = spark.createDataFrame(rows, "time_sgt string, longitude double, latitude double, z double, radar double")
    to = [(t, k, float(a), float(b), None if k == 5 else k / 20) for t in "abcd" for k, (a, b) in enumerate(rng.random((30, 2)))]
    before = written(spark)
    got = kriging.krige(p, spark.createDataFrame(to, "time_sgt string, cell long, longitude double, latitude double, radar double"),
                        "cell", "z", SHAPE | {"nugget": 0.2}, drift=drift).toPandas().set_index(["time_sgt", "cell"]).sort_index()
    assert written(spark) - before < 2_000_000  # as doubles, half of the matrix is 21 MB
    assert sorted(got.index) == [(t, k) for t in "ac" for k in range(30)]
    z[[3, 8]] += 0.5
    whole = [r for r in to if r[0] == "a" and (drift != "radar" or r[1] != 5)]
    sides = {None: ([], []), "linear": (list(xy.T), list(np.array([r[2:4] for r in whole]).T)), "radar": ([radar], [[r[4] for r in whole]])}[drift]
    want = plain_kriging(SHAPE | {"nugget": 0.2}, np.column_stack([xy, z]), [r[2:4] for r in whole], *sides)
    for name, values in zip(("z", "variance"), want):
        assert np.allclose(got.loc[[r[:2] for r in whole], name], values, atol=1e-8)
    assert got.z.isna().sum() == got.variance.isna().sum() == (2 if drift == "radar" else 0)


def test_times_are_solved_by_their_number_of_gauges(spark):
    # dense, packed and in tiles side by side
    rng = np.random.default_rng(6)
    rows = [(t, i, *map(float, rng.random(3))) for t, n in (("a", 45), ("b", 30), ("c", 12)) for i in range(n)]
    p = spark.createDataFrame(rows, "time_sgt string, gid long, longitude double, latitude double, z double")
    t = spark.createDataFrame([(d, k, *map(float, rng.random(2))) for d in "abc" for k in range(9)], "time_sgt string, cell long, longitude double, latitude double")
    for drift, shape in ((None, SHAPE), ("linear", {"model": "linear", "sill": 0.0, "span": 0.5, "nugget": 0.1})):
        whole, split = (kriging.krige(p, t, "cell", "z", shape, drift=drift, **options).toPandas().sort_values(["time_sgt", "cell"], ignore_index=True)
                        for options in ({}, {"dense_gauges": 20, "packed_gauges": 40, "tile": 16}))
        assert len(whole) == 27 and split[["time_sgt", "cell"]].equals(whole[["time_sgt", "cell"]])
        assert np.allclose(split[["z", "variance"]], whole[["z", "variance"]], atol=1e-8)


def test_gauges_too_near_each_other_raise(spark):
    rows = [("a", i, 0.1 * (i // 2), 1e-9 * (i % 2), float(i)) for i in range(30)]
    p, t = (spark.createDataFrame(rows, f"time_sgt string, {c} long, longitude double, latitude double, z double") for c in ("gid", "cell"))
    with pytest.raises(Exception, match="not positive definite"):
        kriging.krige(p, t, "cell", "z", SHAPE | {"model": "gaussian"}, dense_gauges=20).collect()


def test_the_benchmark_of_many_gauges_writes_no_factor(spark, tmp_path):
    from datetime import datetime

    from rainweave.plans import spatial as plans

    # a day of 2600 stations, of which the training ones are more than one dense solve takes, and a day of few
    rng = np.random.default_rng(2)
    rows = [(u, datetime(2024, 1, d, 5), u, "purchase", float(v), "{}") for d, n in ((1, 2600), (2, 40)) for u, v in enumerate(rng.random(n) * 90)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    before = written(spark)
    got = plans.i9_kriging_benchmark(spark, str(tmp_path)).collect()
    assert len(got) == 1 and written(spark) - before < 2_000_000
    train, test = plans._train_test(spark, str(tmp_path), 1440)
    v, mse, pairs = plans.fitted_variogram(spark, str(tmp_path), train), [], []
    train, test = train.toPandas(), test.toPandas()
    assert sorted(train.groupby("time_sgt").size())[1] > kriging.DENSE_GAUGES
    for day, own in test.groupby("time_sgt"):
        z = plain_kriging(v, train[train.time_sgt == day][["longitude", "latitude", "z"]], own[["longitude", "latitude"]])[0]
        mse.append(np.mean((own.truth - z) ** 2))
        pairs += zip(own.truth, z)
    assert got[0].rmse_all == pytest.approx(np.mean(np.sqrt(mse))) and got[0].pearson == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1], abs=1e-9)


def test_packed_estimates_are_solved_once(spark):
    # scores read them for the errors and for the correlation
    p, t = (spark.createDataFrame(PLANE, f"time_sgt string, {c} long, longitude double, latitude double, z double") for c in ("gid", "cell"))
    made = kriging_packed.krige_packed(p, t, "cell", "z", lambda x, y: kriging._covariances(SHAPE, 1.0), "time_sgt", [], "longitude", "latitude", leaf=6)
    assert "MapInPandas" not in made._jdf.queryExecution().toString() and np.allclose(made.toPandas().sort_values("cell")["z"], [r[4] for r in PLANE])
