"""Spatial join, gridding and interpolation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweave.functions import geo
from rainweave.functions.time import bucket_start, slot_time
from rainweave.operators import gridding, kriging, metrics, spatial, temporal
from rainweave.plans.common import rain, rounded
from rainweave.plans.registry import query
from rainweave.plans.sampling import ROLE_SQL, station_roles
from rainweave.sources import views

_D = "sqrt((a.longitude - b.longitude) * (a.longitude - b.longitude) + (a.latitude - b.latitude) * (a.latitude - b.latitude))"

# cell centres of the 8 x 8 radar grid over the study box
CELL_SQL = """,
cell as (select r * 8 + c as cell_id, 103.6e0 + (c + 0.5e0) * 0.0625e0 as longitude, 1.5e0 - (r + 0.5e0) * 0.039e0 as latitude
         from (select unnest(generate_series(0, 7)) as r) cross join (select unnest(generate_series(0, 7)) as c))"""


def radar_grid(spark):
    """Centres of the radar cells as (cell_id, longitude, latitude)."""
    cells = spatial.make_grid(spark, (0, 8, 1), (0, 8, 1), y_descending=False)
    return cells.select(
        (F.col("row") * 8 + F.col("col")).cast("long").alias("cell_id"),
        (103.6 + (F.col("col") + 0.5) * 0.0625).alias("longitude"), (1.5 - (F.col("row") + 0.5) * 0.039).alias("latitude"),
    )


@query(
    "f1_haversine",
    views.with_views("cml_link") + """
select link_id, round(2 * 6371 * asin(sqrt(h)), 6) as km_asin, round(2 * 6367 * atan2(sqrt(h), sqrt(1 - h)), 6) as km_atan
from (select link_id, pow(sin(radians(site_b_latitude - site_a_latitude) / 2), 2) + cos(radians(site_a_latitude))
             * cos(radians(site_b_latitude)) * pow(sin(radians(site_b_longitude - site_a_longitude) / 2), 2) as h from cml_link)""",
)
def f1_haversine(spark, folder):
    a = F.col("site_a_latitude"), F.col("site_a_longitude")
    b = F.col("site_b_latitude"), F.col("site_b_longitude")
    return views.links(spark, folder).select(
        "link_id", rounded(geo.haversine_asin(*a, *b)).alias("km_asin"),
        rounded(geo.haversine_atan(a[1], a[0], b[1], b[0])).alias("km_atan"),
    )


@query(
    "f2_f3_degrees",
    views.with_views("cml_link") + """
select link_id, round(sqrt(pow(site_a_longitude - site_b_longitude, 2) + pow(site_a_latitude - site_b_latitude, 2)), 9) as degrees,
       round(length / 111e0, 9) as length_degrees,
       round((length / 111e0 + length / (111e0 * cos(radians(1.3e0)))) / 2, 9) as averaged_degrees from cml_link""",
)
def f2_f3_degrees(spark, folder):
    d = geo.straight_distance(*[F.col(f"site_{s}_{c}") for s in "ab" for c in ("longitude", "latitude")])
    length = F.col("length")
    return views.links(spark, folder).select(
        "link_id", rounded(d, 9).alias("degrees"), rounded(geo.km_to_degrees(length), 9).alias("length_degrees"),
        rounded(geo.km_to_degrees_averaged(length), 9).alias("averaged_degrees"),
    )


@query(
    "f11_pixel_coordinates",
    views.with_views("stations") + """
select gid, cast(floor((longitude - 103.6e0) / 0.01e0) as bigint) as col, cast(floor((1.5e0 - latitude) / 0.01e0) as bigint) as row,
       round(103.605e0 + floor((longitude - 103.6e0) / 0.01e0) * 0.01e0, 6) as centre_x,
       round(1.495e0 - floor((1.5e0 - latitude) / 0.01e0) * 0.01e0, 6) as centre_y from stations""",
)
def f11_pixel_coordinates(spark, folder):
    """Pixel of every station and the pixel-centre coordinate, 0.01 degree drift grid."""
    placed = views.stations(spark, folder).withColumns(
        {
            "col": geo.cell_index(F.col("longitude"), 103.6, 0.01),
            "row": geo.cell_index(F.col("latitude"), 1.5, 0.01, downward=True),
        }
    )
    return placed.select(
        "gid", "col", "row", rounded(103.605 + F.col("col") * 0.01).alias("centre_x"),
        rounded(1.495 - F.col("row") * 0.01).alias("centre_y"),
    )


@query(
    "j6_radius_join",
    views.with_views("stations") + CELL_SQL + f"""
select a.gid as src, b.cell_id as dst, round({_D} * 111e0, 6) as dist from stations a join cell b on {_D} <= 3e0 / 111e0""",
)
def j6_radius_join(spark, folder):
    pairs = spatial.radius_join(views.stations(spark, folder), radar_grid(spark), 3.0, "gid", "cell_id")
    return pairs.withColumn("dist", rounded(F.col("dist")))


@query(
    "j7_same_set_radius",
    views.with_views("stations") + f"""
select a.gid as src, b.gid as dst, round({_D}, 9) as dist from stations a join stations b on a.gid <> b.gid and {_D} <= 4e0 / 111e0""",
)
def j7_same_set_radius(spark, folder):
    s = views.stations(spark, folder)
    pairs = spatial.radius_join(s, s, 4.0, "gid", "gid", unit="degrees", without_self=True)
    return pairs.withColumn("dist", rounded(F.col("dist"), 9))


KNN_SQL = f""",
knn as (select src, dst, dist, rank from (
          select a.gid as src, b.gid as dst, {_D} as dist, cast(row_number() over (partition by a.gid order by {_D}, b.gid) as int) as rank
          from stations a join stations b on a.gid <> b.gid) where rank <= 4)"""


def station_knn(spark, folder, k=4):
    s = views.stations(spark, folder)
    pairs = spatial.nearest_neighbours(
        s.withColumnRenamed("gid", "src"), s.withColumnRenamed("gid", "dst"), k, ["src"], "dst", without_self=True
    )
    return pairs.select("src", "dst", "dist", "rank")


@query("j8_nearest_stations", views.with_views("stations") + KNN_SQL + "select src, dst, round(dist, 9) as dist, rank from knn")
def j8_nearest_stations(spark, folder):
    return station_knn(spark, folder).withColumn("dist", rounded(F.col("dist"), 9))


@query(
    "j10_coverage",
    views.with_views("cml_link") + CELL_SQL + """,
s as (select link_id, cell_id, longitude as px, latitude as py, site_a_longitude as ax, site_a_latitude as ay,
             site_b_longitude - site_a_longitude as dx, site_b_latitude - site_a_latitude as dy from cell cross join cml_link),
d as (select *, least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) as u from s)
select cell_id, bool_or(sqrt(pow(px - ax - u * dx, 2) + pow(py - ay - u * dy, 2)) <= 0.004e0) as covered from d group by cell_id""",
)
def j10_coverage(spark, folder):
    covered = spatial.covered_cells(radar_grid(spark), views.links(spark, folder), 0.004, ["cell_id"], "longitude", "latitude")
    return covered.select("cell_id", "covered")


@query(
    "i1_station_grid",
    views.with_views("stations") + """,
box as (select min(longitude) - 0.05e0 as x0, max(longitude) + 0.05e0 as x1, min(latitude) - 0.05e0 as y0, max(latitude) + 0.05e0 as y1 from stations),
n as (select *, cast(ceil((x1 - x0) / 0.05e0 - 1e-9) as int) as nx, cast(ceil((y1 - y0) / 0.05e0 - 1e-9) as int) as ny from box)
select cast(r as int) as row, cast(c as int) as col, round(x0 + c * 0.05e0, 6) as x, round(y0 + (ny - 1 - r) * 0.05e0, 6) as y
from n, (select unnest(generate_series(0, 99)) as r) a, (select unnest(generate_series(0, 99)) as c) b where r < ny and c < nx""",
)
def i1_station_grid(spark, folder):
    """Grid over the bounding box of the stations, y descending."""
    grid = spatial.grid_around(views.stations(spark, folder), "longitude", "latitude", 0.05)
    return grid.withColumns({"x": rounded(F.col("x")), "y": rounded(F.col("y"))})


# station rain per bucket with coordinates
def _gauge_sql(width: str) -> str:
    return f""",
g as (select gid, time_bucket(interval '{width}', time_sgt) as time_sgt, avg(value) * 12 as z from obs
      where variable = 'rain_rate' group by 1, 2),
p as (select g.*, latitude, longitude from g join stations using (gid))"""


def gauge_rain(spark, folder, minutes):
    means = rain(spark, folder).groupBy("gid", bucket_start(F.col("time_sgt"), minutes).alias("time_sgt")).agg(
        (F.avg("value") * 12.0).alias("z")
    )
    return means.join(views.stations(spark, folder), "gid")


def _grid_times(spark, folder, points):
    """Every cell at every time of the points: the dense output of a gridding."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("n")
    return points.select("time_sgt").distinct().select("time_sgt", cells).select(
        "time_sgt", F.col("n").cast("long").alias("cell_id"),
        (103.6 + (F.col("n") % 8 + 0.5) * 0.0625).alias("longitude"),
        (1.5 - (F.floor(F.col("n") / 8) + 0.5) * 0.039).alias("latitude"),
    )


def _pairs_sql(limit: str) -> str:
    return CELL_SQL + f""",
t as (select distinct time_sgt from p),
pairs as (select t.time_sgt, a.cell_id, b.gid, b.z, {_D} as d from t cross join cell a join p b on b.time_sgt = t.time_sgt),
near as (select *, row_number() over (partition by time_sgt, cell_id order by d, gid) as rn from pairs {limit})"""


_IDW_SQL = """
select time_sgt, cell_id, round(case when min(d) = 0 then arg_min(z, d) else sum(z / (d * d)) / sum(1 / (d * d)) end, 6) as z
from near {where} group by time_sgt, cell_id"""


@query(
    "i2_idw_nearest",
    views.with_views("obs", "stations") + _gauge_sql("1 day") + _pairs_sql("") + _IDW_SQL.format(where="where rn <= 15"),
)
def i2_idw_nearest(spark, folder):
    """Daily rain on the radar grid from the 15 nearest gauges of that day."""
    points = gauge_rain(spark, folder, 1440)
    grid = gridding.inverse_distance(_grid_times(spark, folder, points), points, ["cell_id"], "gid", "z", k=15)
    return grid.select("time_sgt", "cell_id", rounded(F.col("z")).alias("z"))


@query(
    "i2_idw_all",
    views.with_views("obs", "stations") + _gauge_sql("1 day") + _pairs_sql("") + _IDW_SQL.format(where=""),
)
def i2_idw_all(spark, folder):
    points = gauge_rain(spark, folder, 1440)
    grid = gridding.inverse_distance(_grid_times(spark, folder, points), points, ["cell_id"], "gid", "z")
    return grid.select("time_sgt", "cell_id", rounded(F.col("z")).alias("z"))


@query(
    "i3_idw_within_distance",
    views.with_views("obs", "stations") + _gauge_sql("1 day") + _pairs_sql("where d < 0.05e0") + """
select t.time_sgt, a.cell_id, round(n.z, 6) as z from t cross join cell a left join (
  select time_sgt, cell_id, case when min(d) < 1e-10 then arg_min(z, d) else sum(z / (d * d)) / sum(1 / (d * d)) end as z
  from near where rn <= 8 group by time_sgt, cell_id) n on n.time_sgt = t.time_sgt and n.cell_id = a.cell_id""",
)
def i3_idw_within_distance(spark, folder):
    """Eight nearest within 0.05 degrees; a cell without gauges stays NULL."""
    points = gauge_rain(spark, folder, 1440)
    grid = gridding.inverse_distance(
        _grid_times(spark, folder, points), points, ["cell_id"], "gid", "z", k=8, max_distance=0.05, hit_distance=1e-10
    )
    return grid.select("time_sgt", "cell_id", rounded(F.col("z")).alias("z"))


@query(
    "i8_nearest_value",
    views.with_views("obs", "stations") + _gauge_sql("1 day") + _pairs_sql("") + """
select time_sgt, cell_id, round(z, 6) as z from near where rn = 1""",
)
def i8_nearest_value(spark, folder):
    points = gauge_rain(spark, folder, 1440)
    grid = gridding.nearest_value(_grid_times(spark, folder, points), points, ["cell_id"], "gid", "z")
    return grid.select("time_sgt", "cell_id", rounded(F.col("z")).alias("z"))


@query(
    "i7_variogram_bins",
    views.with_views("obs", "stations") + _gauge_sql("1 day") + f""",
v as (select cast(floor({_D} / 0.05e0) as bigint) as lag_bin, {_D} as d, 0.5e0 * (a.z - b.z) * (a.z - b.z) as g
      from p a join p b on a.time_sgt = b.time_sgt and a.gid < b.gid)
select lag_bin, count(*) as pairs, round(avg(d), 6) as mean_distance, round(avg(g), 4) as semivariance from v group by lag_bin""",
)
def i7_variogram_bins(spark, folder):
    bins = gridding.empirical_variogram(gauge_rain(spark, folder, 1440), "z", 0.05)
    return bins.select(
        "lag_bin", "pairs", rounded(F.col("mean_distance")).alias("mean_distance"), rounded(F.col("semivariance"), 4).alias("semivariance")
    )


MAX_LAG = 0.2
_SHAPE_SQL = """case model when 'linear' then d when 'exponential' then 1 - exp(-3 * d / span) when 'gaussian' then 1 - exp(-pow(7 * d / (4 * span), 2))
                 else 1.5e0 * least(d / span, 1) - 0.5e0 * pow(least(d / span, 1), 3) end"""


def near_variogram(spark, folder, points=None):
    bins = gridding.empirical_variogram(gauge_rain(spark, folder, 1440) if points is None else points, "z", 0.02, max_lag=MAX_LAG)
    return bins.select("lag_bin", "pairs", rounded(F.col("mean_distance")).alias("mean_distance"), rounded(F.col("semivariance"), 2).alias("semivariance"))


_NEAR_SQL = views.with_views("obs", "stations") + _gauge_sql("1 day") + f""",
v as (select cast(floor({_D} / 0.02e0) as bigint) as lag_bin, {_D} as d, 0.5e0 * (a.z - b.z) * (a.z - b.z) as g
      from p a join p b on a.time_sgt = b.time_sgt and a.gid < b.gid where {_D} < {MAX_LAG}e0),
bins as materialized (select lag_bin, count(*) as pairs, round(avg(d), 6) as mean_distance, round(avg(g), 2) as semivariance from v group by lag_bin)"""


@query("i7_near_variogram_bins", _NEAR_SQL + "select * from bins")
def i7_near_variogram_bins(spark, folder):
    """Pairs up to a largest distance, through squares."""
    return near_variogram(spark, folder)


@query("i7_variogram_fit", _NEAR_SQL + f""",
u as (select pairs / sum(pairs) over ()::double as w, mean_distance as d, semivariance as g, max(mean_distance) over () as far, greatest(min(semivariance) over (), 0) as low from bins),
trial as (select * from (select unnest(['linear', 'exponential', 'gaussian', 'spherical']) as model),
          (select unnest(range(1, 41)) as step), (select unnest(range(0, 11)) as k) where model <> 'linear' or step = 1),
shaped as (select model, step, k, w, d, g, case when model = 'linear' then 1 else step * 0.05e0 * far end as span, k * low / 10e0 as nugget from u, trial),
valued as (select *, {_SHAPE_SQL} as s from shaped),
silled as (select model, step, k, any_value(span) as span, any_value(nugget) as nugget,
                  greatest(sum(w * s * (g - nugget)) / sum(w * s * s), 0) as sill from valued group by all),
lost as (select model, step, k, span, nugget, sill, sum(w * pow(nugget + sill * s - g, 2)) as loss
         from valued join silled using (model, step, k, span, nugget) group by all)
select model, round(case when model = 'linear' then 0 else sill end, 4) as sill, round(case when model = 'linear' then sill else span end, 6) as span,
       round(nugget, 4) as nugget, round(loss, 2) as loss
from lost qualify row_number() over (partition by model order by round(loss, 6), span, nugget) = 1""")
def i7_variogram_fit(spark, folder):
    """All four models fitted to the near bins; the twin evaluates the loss bin by bin."""
    fitted = kriging.fit_variograms(near_variogram(spark, folder))
    return fitted.select("model", *[rounded(F.col(c), d).alias(c) for c, d in (("sill", 4), ("span", 6), ("nugget", 4), ("loss", 2))])


def fitted_variogram(spark, folder, points=None):
    """Parameters for the kriging queries: the exponential model fitted to near pairs of gauges."""
    return kriging.fit_variogram(near_variogram(spark, folder, points), "exponential")


# scoring: train stations give points, test stations are the targets
def _train_test(spark, folder, minutes):
    points = gauge_rain(spark, folder, minutes)
    roles = station_roles(spark, folder).select("gid", "statistical_role")
    split = points.join(roles, "gid")
    train = split.where(F.col("statistical_role") == "train").drop("statistical_role")
    test = split.where(F.col("statistical_role") == "test").drop("statistical_role")
    return train, test.withColumnRenamed("z", "truth").withColumnRenamed("gid", "target")


def _all_times(spark, folder):
    return gauge_rain(spark, folder, 1440).select("time_sgt").distinct()


@query(
    "i9_idw_benchmark",
    views.with_views("obs", "stations") + _gauge_sql("1 day") + ROLE_SQL + f""",
tr as (select p.* from p join roles using (gid) where statistical_role = 'train'),
te as (select p.* from p join roles using (gid) where statistical_role = 'test'),
pairs as (select a.time_sgt, a.gid as target, a.z as truth, b.gid, b.z, {_D} as d from te a join tr b on a.time_sgt = b.time_sgt),
near as (select *, row_number() over (partition by time_sgt, target order by d, gid) as rn from pairs),
e as (select time_sgt, target, any_value(truth) as truth,
             case when min(d) = 0 then arg_min(z, d) else sum(z / (d * d)) / sum(1 / (d * d)) end as z
      from near where rn <= 15 group by time_sgt, target),
s as (select time_sgt, avg((truth - z) ** 2) as mse from (select distinct time_sgt from p) left join e using (time_sgt) group by time_sgt)
select count(*) as times, round(sum(sqrt(mse)) / count(*), 6) as average_rmse, round(sum(mse) / count(*), 4) as average_mse,
       (select round(corr(truth, z), 6) from e) as pearson from s""",
)
def i9_idw_benchmark(spark, folder):
    """IDW from training stations scored at test stations; a time without truth or estimate counts as 0 in the mean."""
    train, test = _train_test(spark, folder, 1440)
    estimated = gridding.inverse_distance(test, train, ["target"], "gid", "z", k=15, out="estimate")
    scored = _all_times(spark, folder).join(estimated, "time_sgt", "left")
    totals = metrics.average_rmse(scored, ["time_sgt"], "truth", "estimate")
    r = metrics.pearson(scored, "truth", "estimate").select("pearson").scalar()
    return totals.select(
        "times", rounded(F.col("rmse_all")).alias("average_rmse"), rounded(F.col("mse_all"), 4).alias("average_mse"),
        rounded(r).alias("pearson"),
    )


@query("i4_ordinary_kriging")
def i4_ordinary_kriging(spark, folder):
    """Daily ordinary kriging at the test stations; a dense solve per day, so no SQL twin."""
    train, test = _train_test(spark, folder, 1440)
    return kriging.krige(train, test, "target", "z", fitted_variogram(spark, folder, train))


@query(
    "i4_nearest_kriging_at_gauges",
    views.with_views("obs", "stations") + _gauge_sql("1 day") + """
select time_sgt, gid as target, round(z, 3) as z from p where time_sgt in (select time_sgt from p where z <> 0)""",
)
def i4_nearest_kriging_at_gauges(spark, folder):
    """Kriging from the eight nearest gauges, asked for at the gauges: it gives back what they measured."""
    points = gauge_rain(spark, folder, 1440)
    targets = points.withColumn("target", F.col("gid")).drop("gid", "z")
    found = kriging.krige_nearest(points, targets, "target", "z", fitted_variogram(spark, folder, points), 8)
    return found.select("time_sgt", "target", rounded(F.col("z"), 3).alias("z"))


@query("i4_nearest_kriging_grid")
def i4_nearest_kriging_grid(spark, folder):
    """Daily rain on the radar grid, kriged from the eight nearest gauges of that day; small solves, so no SQL twin."""
    points = gauge_rain(spark, folder, 1440)
    return kriging.krige_nearest(points, _grid_times(spark, folder, points), "cell_id", "z", fitted_variogram(spark, folder, points), 8)


def _with_drift(spark, folder, df):
    drift = views.radar_cells(spark, folder).groupBy(
        F.date_trunc("day", "time_sgt").alias("time_sgt"), "row", "col").agg(F.avg("value").alias("radar"))
    row = geo.cell_index(F.col("latitude"), 1.5, 0.039, downward=True).cast("int")
    col = geo.cell_index(F.col("longitude"), 103.6, 0.0625).cast("int")
    return df.withColumns({"row": row, "col": col}).join(drift, ["time_sgt", "row", "col"], "left").drop("row", "col")


@query("i5_nearest_universal_grid")
def i5_nearest_universal_grid(spark, folder):
    """``i4_nearest_kriging_grid`` with a linear trend; any number of gauges."""
    points = gauge_rain(spark, folder, 1440)
    return kriging.krige_nearest(points, _grid_times(spark, folder, points), "cell_id", "z", fitted_variogram(spark, folder, points), 8, drift="linear")


@query("i6_nearest_external_drift_grid")
def i6_nearest_external_drift_grid(spark, folder):
    """``i4_nearest_kriging_grid`` with the day's mean radar value of the cell as drift; days without frames give no rows."""
    points = gauge_rain(spark, folder, 1440)
    gauges, cells = (_with_drift(spark, folder, df) for df in (points, _grid_times(spark, folder, points)))
    return kriging.krige_nearest(gauges, cells, "cell_id", "z", fitted_variogram(spark, folder, points), 8, drift="radar")


@query("i9_nearest_kriging_benchmark")
def i9_nearest_kriging_benchmark(spark, folder):
    """``i9_kriging_benchmark`` from the eight nearest training gauges of each target; any number of gauges."""
    train, test = _train_test(spark, folder, 1440)
    return _kriging_scores(spark, folder, test, kriging.krige_nearest(train, test, "target", "z", fitted_variogram(spark, folder, train), 8))


@query("i5_universal_kriging")
def i5_universal_kriging(spark, folder):
    train, test = _train_test(spark, folder, 1440)
    return kriging.krige(train, test, "target", "z", fitted_variogram(spark, folder, train), drift="linear")


@query("i6_external_drift_kriging")
def i6_external_drift_kriging(spark, folder):
    """Mean radar value of the cell on the same day as external drift at gauges and targets; without a cell, no estimate."""
    train, test = _train_test(spark, folder, 1440)
    return kriging.krige(_with_drift(spark, folder, train), _with_drift(spark, folder, test), "target", "z", fitted_variogram(spark, folder, train), drift="radar")


@query("i9_kriging_benchmark")
def i9_kriging_benchmark(spark, folder):
    """Kriging scored at test stations; times without an estimate count as 0 in the first mean."""
    train, test = _train_test(spark, folder, 1440)
    return _kriging_scores(spark, folder, test, kriging.krige(train, test, "target", "z", fitted_variogram(spark, folder, train)))


def _kriging_scores(spark, folder, test, estimates):
    scored = _all_times(spark, folder).join(test.join(estimates, ["time_sgt", "target"], "left"), "time_sgt", "left")
    totals = metrics.average_rmse(scored, ["time_sgt"], "truth", "z")
    return totals.withColumn("pearson", metrics.pearson(scored, "truth", "z").select("pearson").scalar())


@query(
    "j3_three_source_fusion",
    views.with_views("obs", "radar_cell", "cml") + """,
g as (select time_bucket(interval '20 minutes', time_sgt) as time_sgt, round(avg(value), 6) as gauge from obs where variable = 'rain_rate' group by 1),
r as (select time_sgt, round(avg(value), 6) as radar from radar_cell group by 1),
c as (select timestamp '2024-01-01' + to_minutes(20 * (t // 20)) as time_sgt, round(avg(trsl), 9) as link from cml group by 1)
select * from g join r using (time_sgt) join c using (time_sgt)""",
)
def j3_three_source_fusion(spark, folder):
    """Gauge, radar and link means on equal 20-minute times."""
    from rainweave.operators.matching import fuse_on_time

    gauge = temporal.bucket_stats(rain(spark, folder), [], "time_sgt", [rounded(F.avg("value")).alias("gauge")], 20)
    radar = views.radar_cells(spark, folder).groupBy("time_sgt").agg(rounded(F.avg("value")).alias("radar"))
    # link minute 0 is 2024-01-01, day 19723 since 1970, with 72 slots of 20 minutes a day
    first = F.lit(19723 * 72)
    link = views.link_series(spark, folder).groupBy(
        slot_time(first + F.floor(F.col("t") / 20), 20).alias("time_sgt")
    ).agg(rounded(F.avg("trsl"), 9).alias("link"))
    return fuse_on_time([gauge.withColumnRenamed("bucket", "time_sgt"), radar, link])
