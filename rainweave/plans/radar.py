"""Radar catalogue, frame and time-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweave.functions.geo import cell_index
from rainweave.functions.rain import mask_no_rain
from rainweave.functions.time import bucket_start
from rainweave.operators import matching
from rainweave.operators.temporal import numbered_times
from rainweave.plans.common import rain, rounded
from rainweave.plans.registry import query
from rainweave.sources import radar, views

_FILES_SQL = """
with recursive files as (
select '/radar/' || strftime(timestamp '2024-01-01' + to_minutes(20*vec_id), '%Y%m%d') || '/spacesync_99_' ||
       case when vec_id % 11 = 0 then 'notime' else strftime(timestamp '2024-01-01' + to_minutes(20*vec_id), '%Y%m%d%H%M') end
       || '_area_23.tif' as path from embeddings),
cat as (select path, strptime(split_part(path, '_', 3), '%Y%m%d%H%M') as time_sgt
        from files where split_part(path, '_', 3) <> 'notime')"""


def _files(spark, folder):
    time = views.frame_time(F.col("vec_id"))
    stamp = F.when(F.col("vec_id") % 11 == 0, "notime").otherwise(F.date_format(time, "yyyyMMddHHmm"))
    return views.table(spark, folder, "embeddings").select(
        F.concat(F.lit("/radar/"), F.date_format(time, "yyyyMMdd"), F.lit("/spacesync_99_"), stamp, F.lit("_area_23.tif")).alias("path")
    )


@query("s5_radar_catalogue", _FILES_SQL + "select path, time_sgt from cat")
def s5_radar_catalogue(spark, folder):
    """File names to times; names without a time are left out."""
    return radar.catalogue(_files(spark, folder))


@query(
    "f10_cropped_name_time",
    _FILES_SQL + """
select replace(path, 'spacesync', 'cropped_spacesync') as path, time_sgt from cat""",
)
def f10_cropped_name_time(spark, folder):
    cropped = _files(spark, folder).select(F.regexp_replace("path", "spacesync", "cropped_spacesync").alias("path"))
    return radar.catalogue(cropped, cropped=True)


@query(
    "s6_cells_ascending",
    views.with_views("radar_cell") + """
select time_sgt, row, col, round(1.188e0 + row * (1.5e0 - 1.188e0) / 7, 9) as lat,
       round(103.6e0 + col * (104.1e0 - 103.6e0) / 7, 9) as lon, value from radar_cell""",
)
def s6_cells_ascending(spark, folder):
    cells = radar.frames_to_cells(views.radar_frames(spark, folder), "ascending")
    return cells.withColumns({"lat": rounded(F.col("lat"), 9), "lon": rounded(F.col("lon"), 9)})


@query(
    "s6_cells_north_up",
    views.with_views("radar_cell") + """
select time_sgt, row, col, round(1.5e0 - (row + 0.5e0) * (1.5e0 - 1.188e0) / 8, 9) as lat,
       round(103.6e0 + (col + 0.5e0) * (104.1e0 - 103.6e0) / 8, 9) as lon, value from radar_cell""",
)
def s6_cells_north_up(spark, folder):
    cells = radar.frames_to_cells(views.radar_frames(spark, folder))
    return cells.withColumns({"lat": rounded(F.col("lat"), 9), "lon": rounded(F.col("lon"), 9)})


_BOX = {"left": 103.68, "right": 104.0, "bottom": 1.25, "top": 1.45}


@query(
    "p4_crop",
    views.with_views("radar_cell") + """,
w as (select cast(trunc(greatest(0, (103.68e0 - 103.6e0) / ((104.1e0 - 103.6e0) / 8))) as int) as c0,
             cast(trunc(least(8, (104e0 - 103.6e0) / ((104.1e0 - 103.6e0) / 8))) as int) as c1,
             cast(trunc(greatest(0, (1.45e0 - 1.5e0) / ((1.188e0 - 1.5e0) / 8))) as int) as r0,
             cast(trunc(least(8, (1.25e0 - 1.5e0) / ((1.188e0 - 1.5e0) / 8))) as int) as r1)
select time_sgt, true as success, cast(row - r0 as int) as row, cast(col - c0 as int) as col, value,
       round(103.6e0 + (104.1e0 - 103.6e0) / 8 * c0, 9) as origin_x,
       round(1.5e0 + (1.188e0 - 1.5e0) / 8 * r0, 9) as origin_y
from radar_cell, w where row >= r0 and row < r1 and col >= c0 and col < c1""",
)
def p4_crop(spark, folder):
    frames = views.radar_frames(spark, folder).withColumn(
        "transform", radar.north_up_transform(F.col("bounds"), F.size("data"), F.size(F.col("data")[0]))
    )
    cut = radar.crop_frames(frames, _BOX)
    rows = cut.select(
        "time_sgt", "success", rounded(F.col("transform")[2], 9).alias("origin_x"),
        rounded(F.col("transform")[5], 9).alias("origin_y"), F.posexplode("data").alias("row", "_cells"),
    )
    return rows.select(
        "time_sgt", "success", "row", "origin_x", "origin_y", F.posexplode("_cells").alias("col", "value")
    )


@query(
    "p5_zoom_crop",
    views.with_views("radar_cell") + """
select time_sgt, row, col, value from radar_cell
where row >= round_even((1.5e0 - 1.45e0) / (1.5e0 - 1.188e0) * 8, 0) and row < round_even((1.5e0 - 1.25e0) / (1.5e0 - 1.188e0) * 8, 0)
  and col >= round_even((103.68e0 - 103.6e0) / (104.1e0 - 103.6e0) * 8, 0)
  and col < round_even((104e0 - 103.6e0) / (104.1e0 - 103.6e0) * 8, 0)""",
)
def p5_zoom_crop(spark, folder):
    bounds = F.struct(*[F.lit(radar.STUDY_BOX[k]).alias(k) for k in ("left", "right", "bottom", "top")])
    r0, r1, c0, c1 = radar.zoom_window(bounds, F.lit(8), F.lit(8), _BOX)
    row, col = F.col("row"), F.col("col")
    return views.radar_cells(spark, folder).where((row >= r0) & (row < r1) & (col >= c0) & (col < c1))


@query(
    "p5_coordinate_crop",
    views.with_views("radar_cell") + """
select time_sgt, row, col, case when value > 0 then value end as value from radar_cell
where 103.6e0 + col * (104.1e0 - 103.6e0) / 7 between 103.68e0 and 104e0
  and 1.188e0 + row * (1.5e0 - 1.188e0) / 7 between 1.25e0 and 1.45e0""",
)
def p5_coordinate_crop(spark, folder):
    """Coordinate mask, edges included, and the no-rain mask."""
    cells = radar.frames_to_cells(views.radar_frames(spark, folder), "ascending")
    return cells.where(radar.within_box(F.col("lat"), F.col("lon"), _BOX)).select(
        "time_sgt", "row", "col", mask_no_rain(F.col("value")).alias("value")
    )


def _gauge_times(spark, folder, minutes=20):
    return rain(spark, folder).groupBy(bucket_start(F.col("time_sgt"), minutes).alias("time_sgt")).agg(
        F.avg("value").alias("gauge_mean"), F.count(F.lit(1)).alias("gauges")
    )


_GAUGE_SQL = """,
g as (select time_bucket(interval '20 minutes', time_sgt) as time_sgt, avg(value) as gauge_mean, count(*) as gauges
      from obs where variable = 'rain_rate' group by 1)"""


@query(
    "j1_gauge_radar_join",
    views.with_views("obs", "radar_cell") + _GAUGE_SQL + """
select g.time_sgt, round(gauge_mean, 6) as gauge_mean, gauges, row, col, value from g join radar_cell r on g.time_sgt = r.time_sgt""",
)
def j1_gauge_radar_join(spark, folder):
    gauges = _gauge_times(spark, folder).withColumn("gauge_mean", rounded(F.col("gauge_mean")))
    return matching.fuse_on_time([gauges, views.radar_cells(spark, folder)])


def _match(spark, folder):
    return matching.match_times(s5_radar_catalogue(spark, folder), _gauge_times(spark, folder).select("time_sgt"))


@query(
    "j2_match_stats",
    _FILES_SQL + ",\nobs as (" + views.SQL["obs"] + ")" + _GAUGE_SQL + """
select (select count(*) from cat) as radar, (select count(*) from g) as weather, count(*) as matched,
       (select count(*) from cat where time_sgt not in (select time_sgt from g)) as radar_only,
       (select count(*) from g where time_sgt not in (select time_sgt from cat)) as weather_only,
       round(count(*) * 100e0 / (select count(*) from g), 6) as match_rate
from cat join g using (time_sgt)""",
)
def j2_match_stats(spark, folder):
    return _match(spark, folder).stats.withColumn("match_rate", rounded(F.col("match_rate")))


@query(
    "j2_match_parts",
    _FILES_SQL + ",\nobs as (" + views.SQL["obs"] + ")" + _GAUGE_SQL + """
select 'matched' as part, cat.time_sgt, path from cat join g using (time_sgt)
union all select 'radar_only', time_sgt, path from cat where time_sgt not in (select time_sgt from g)
union all select 'weather_only', time_sgt, null from g where time_sgt not in (select time_sgt from cat)""",
)
def j2_match_parts(spark, folder):
    found = _match(spark, folder)
    named = lambda df, part: df.select(F.lit(part).alias("part"), "time_sgt", "path")
    return (
        named(found.matched, "matched")
        .unionByName(named(found.radar_only, "radar_only"))
        .unionByName(named(found.weather_only.withColumn("path", F.lit(None).cast("string")), "weather_only"))
    )


_NEAREST_SQL = """,
t as (select distinct time_bucket(interval '15 minutes', time_sgt) as time_sgt from obs),
f as (select distinct time_sgt as frame_time from radar_cell),
n as (select t.time_sgt, arg_min(f.frame_time, (abs(epoch_us(f.frame_time) - epoch_us(t.time_sgt)), f.frame_time)) as frame_time
      from t join f on abs(epoch_us(f.frame_time) - epoch_us(t.time_sgt)) <= 900000000 group by t.time_sgt),
aligned as (select t.time_sgt, n.frame_time from t left join n on n.time_sgt = t.time_sgt)"""


def _station_times(spark, folder):
    return views.observations(spark, folder).select(bucket_start(F.col("time_sgt"), 15).alias("time_sgt")).distinct()


@query("j5_nearest_frame", views.with_views("obs", "radar_cell") + _NEAREST_SQL + "select * from aligned")
def j5_nearest_frame(spark, folder):
    return matching.nearest_time(_station_times(spark, folder), views.radar_frames(spark, folder))


@query(
    "a9_normalised_radar",
    views.with_views("obs", "radar_cell") + _NEAREST_SQL + """,
cells as (select a.time_sgt, c.row, c.col, coalesce(r.value, 0) as value
          from aligned a cross join (select distinct row, col from radar_cell) c
          left join radar_cell r on r.time_sgt = a.frame_time and r.row = c.row and r.col = c.col)
select time_sgt, row, col, round((value - (select min(value) from cells)) / ((select max(value) from cells) - (select min(value) from cells)), 9) as scaled
from cells""",
)
def a9_normalised_radar(spark, folder):
    """Radar aligned to station times, zero frames included, scaled to 0..1 over everything."""
    aligned = matching.align_radar(_station_times(spark, folder), views.radar_frames(spark, folder))
    cells = aligned.select("time_sgt", F.posexplode("data").alias("row", "_cells")).select(
        "time_sgt", "row", F.posexplode("_cells").alias("col", "value")
    )
    return matching.min_max_normalised(cells, "value", "scaled").select(
        "time_sgt", "row", "col", rounded(F.col("scaled"), 9).alias("scaled")
    )


@query(
    "j9_station_cell_lookup",
    views.with_views("stations", "radar_cell") + """
select s.gid, r.row, r.col, count(r.value) as frames, round(avg(r.value), 9) as mean_value, max(r.value) as max_value
from stations s left join radar_cell r
on r.row = floor((1.5e0 - latitude) / 0.039e0) and r.col = floor((longitude - 103.6e0) / 0.0625e0)
group by s.gid, r.row, r.col""",
)
def j9_station_cell_lookup(spark, folder):
    """Radar values in the cell of every station, over all frames; a station outside the grid has a NULL cell and no frames."""
    placed = views.stations(spark, folder).select(
        "gid", cell_index(F.col("latitude"), 1.5, 0.039, downward=True).cast("int").alias("row"),
        cell_index(F.col("longitude"), 103.6, 0.0625).cast("int").alias("col"),
    )
    # values of a cell are the same for all its stations, so frames are reduced before the join
    cells = views.radar_cells(spark, folder).groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("frames"), rounded(F.avg("value"), 9).alias("mean_value"), F.max("value").alias("max_value")
    )
    # columns of the grid side, so that a place without a cell has none
    cells = cells.withColumns({"at_row": F.col("row"), "at_col": F.col("col")})
    return placed.join(cells, ["row", "col"], "left").select(
        "gid", F.col("at_row").alias("row"), F.col("at_col").alias("col"), F.coalesce("frames", F.lit(0).cast("long")).alias("frames"), "mean_value", "max_value"
    )


@query(
    "p4_crop_report",
    _FILES_SQL + ",\nobs as (" + views.SQL["obs"] + ")" + _GAUGE_SQL + """,
w as (select time_sgt, row_number() over (order by time_sgt) - 1 as weather_idx from g)
select time_sgt as timestamp, weather_idx, path as input_path, true as success,
       '/cropped/' || strftime(time_sgt, '%Y%m%d') || '/cropped_' || split_part(path, '/', 4) as output_path
from cat join w using (time_sgt)""",
)
def p4_crop_report(spark, folder):
    """Matched radar files cropped to the study box, with source, target and success per file."""
    weather = numbered_times(_gauge_times(spark, folder), "time_sgt", "weather_idx")
    frames = views.radar_frames(spark, folder).withColumn(
        "transform", radar.north_up_transform(F.col("bounds"), F.size("data"), F.size(F.col("data")[0]))
    )
    matched = matching.fuse_on_time([s5_radar_catalogue(spark, folder), weather, frames])
    return radar.crop_report(radar.crop_frames(matched), "/cropped")
