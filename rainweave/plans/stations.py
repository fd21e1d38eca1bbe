"""Reshape, filter and aggregate queries over the station observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweave.functions.rain import mask_no_rain, rain_class, to_hourly_rate
from rainweave.functions.time import bucket_start, parse_station_time
from rainweave.operators import errors, reshape, temporal
from rainweave.plans.common import rain, rounded
from rainweave.plans.registry import query
from rainweave.sources import views
from rainweave.sources.readers import last_known_position

VARIABLES = ["rain_rate", "wind_speed", "wind_direction", "temperature", "humidity"]
_PAIRS = ", ".join(f"'{v}'" for v in VARIABLES)


def station_classes(spark, folder):
    counts = reshape.station_variable_counts(views.observations(spark, folder), "gid", "variable", "value", VARIABLES)
    return reshape.classify_stations(counts, VARIABLES)


CLASS_SQL = ",\nclasses as (select gid, case when least(" + ", ".join(
    f"count(*) filter (variable = '{v}' and value is not null)" for v in VARIABLES
) + ") = 0 then 'rainfall' else 'general' end as station_type from obs group by gid)"


@query(
    "s1_parse_station_rows",
    views.with_views("obs") + """
select gid, variable, case when gid % 7 <> 0 then date_trunc('minute', time_sgt) end as time_sgt, value, gid % 7 = 0 as quarantined
from obs""",
)
def s1_parse_station_rows(spark, folder):
    """Station rows as text in the file format, parsed; rows with wrong seconds are marked."""
    seconds = F.when(F.col("gid") % 7 == 0, ":30+08:00").otherwise(":00+08:00")
    text = views.observations(spark, folder).select(
        F.col("gid").alias("station_id"), "variable", "value",
        F.concat(F.date_format("time_sgt", "yyyy-MM-dd'T'HH:mm"), seconds).alias("timestamp"),
    )
    parsed = text.select(
        F.col("station_id").alias("gid"), "variable",
        parse_station_time(F.col("timestamp"), strict=False).alias("time_sgt"), "value",
    )
    return parsed.withColumn("quarantined", F.col("time_sgt").isNull())


@query(
    "s3_station_positions",
    """
select user_id as gid, arg_max(1.2e0 + (event_id % 300) * 0.001e0, ts) as latitude,
       arg_max(103.6e0 + (event_id % 500) * 0.001e0, ts) as longitude
from events group by user_id""",
)
def s3_station_positions(spark, folder):
    """One position per station; of several entries the last wins."""
    entries = views.table(spark, folder, "events").select(
        F.col("user_id").alias("gid"), "ts",
        (1.2 + (F.col("event_id") % 300) * 0.001).alias("latitude"),
        (103.6 + (F.col("event_id") % 500) * 0.001).alias("longitude"),
    )
    return last_known_position(entries, "ts")


@query(
    "p1_rate_modes",
    views.with_views("obs") + """
select gid, time_bucket(interval '15 minutes', time_sgt) as bucket,
       round(arg_min(value, time_sgt) * 12, 6) as first_rate, round(avg(value) * 12, 6) as mean_rate,
       round(sum(value) * 4, 6) as sum_rate, round(arg_min(value * 12, time_sgt), 6) as raw_first_rate
from obs where variable = 'rain_rate' group by all""",
)
def p1_rate_modes(spark, folder):
    return rain(spark, folder).groupBy("gid", bucket_start(F.col("time_sgt"), 15).alias("bucket")).agg(
        rounded(to_hourly_rate(F.min_by("value", "time_sgt"), "first")).alias("first_rate"),
        rounded(to_hourly_rate(F.avg("value"), "mean")).alias("mean_rate"),
        rounded(to_hourly_rate(F.sum("value"), "sum")).alias("sum_rate"),
        rounded(F.min_by(to_hourly_rate(F.col("value"), "raw"), "time_sgt")).alias("raw_first_rate"),
    )


@query(
    "p3_known_stations",
    views.with_views("obs", "stations") + """
select gid, time_sgt, variable, value from obs
where gid in (select gid from stations where latitude < 1.4e0) and gid <> 8""",
)
def p3_known_stations(spark, folder):
    known = views.stations(spark, folder).where(F.col("latitude") < 1.4).select("gid")
    return views.observations(spark, folder).where(F.col("gid") != 8).join(known, "gid", "left_semi")


@query(
    "p7_rain_class",
    views.with_views("obs") + """
select gid, time_sgt, case when value > 0 then value end as wet_value,
       cast((value >= 0.1e0)::int + (value >= 0.2e0)::int + (value >= 0.5e0)::int + (value >= 1)::int + (value >= 2)::int
       + (value >= 4)::int + (value >= 7)::int + (value >= 10)::int + (value >= 20)::int as int) as rain_class
from obs where variable = 'rain_rate'""",
)
def p7_rain_class(spark, folder):
    return rain(spark, folder).select(
        "gid", "time_sgt", mask_no_rain(F.col("value")).alias("wet_value"), rain_class(F.col("value")).alias("rain_class")
    )


_WIDE_SQL = """,
b as (select gid, variable, time_bucket(interval '1 day', time_sgt) as bucket, arg_min(value, time_sgt) as value
      from obs group by all),
wide as (select gid, bucket, """ + ", ".join(f"max(value) filter (variable = '{v}') as {v}" for v in VARIABLES) + """
         from b group by gid, bucket)"""


def _daily(spark, folder):
    return temporal.bucket_first(views.observations(spark, folder), ["gid", "variable"], "time_sgt", "value", 1440)


@query("r1_wide_by_variable", views.with_views("obs") + _WIDE_SQL + "select * from wide")
def r1_wide_by_variable(spark, folder):
    return reshape.to_wide(_daily(spark, folder), ["gid", "bucket"], "variable", "value", VARIABLES)


@query(
    "p10_fill_missing",
    views.with_views("obs") + _WIDE_SQL + """
select gid, bucket, """ + ", ".join(f"coalesce({v}, 0) as {v}" for v in VARIABLES) + """
from wide where rain_rate is not null""",
)
def p10_fill_missing(spark, folder):
    """Drop station days without rain data, fill the other variables with 0."""
    return r1_wide_by_variable(spark, folder).na.drop(subset=["rain_rate"]).na.fill(0.0)


@query(
    "r3_count_matrix",
    views.with_views("obs") + "select gid, "
    + ", ".join(f"count(value) filter (variable = '{v}') as {v}" for v in VARIABLES) + " from obs group by gid",
)
def r3_count_matrix(spark, folder):
    return reshape.station_variable_counts(views.observations(spark, folder), "gid", "variable", "value", VARIABLES)


@query(
    "r3_wide_to_long",
    views.with_views("obs") + _WIDE_SQL + """
select gid, bucket, variable, value from wide
unpivot include nulls (value for variable in (""" + ", ".join(VARIABLES) + "))",
)
def r3_wide_to_long(spark, folder):
    return reshape.to_long(r1_wide_by_variable(spark, folder), ["gid", "bucket"], VARIABLES, "variable", "value")


@query(
    "r4_features",
    views.with_views("obs") + _WIDE_SQL + """
select gid, bucket, array_to_string([coalesce(cast(round(v * 100) as bigint)::varchar, '-') for v in
       [""" + ", ".join(VARIABLES) + """]], '|') as x, rain_rate as y from wide""",
)
def r4_features(spark, folder):
    """Feature arrays with rain first; shown as text of hundredths so both engines can compare them."""
    nodes = reshape.assemble_features(_daily(spark, folder), ["gid", "bucket"], "variable", "value", VARIABLES, "rain_rate")
    text = F.transform("x", lambda v: F.coalesce(F.round(v * 100).cast("long").cast("string"), F.lit("-")))
    return nodes.select("gid", "bucket", F.array_join(text, "|").alias("x"), "y")


@query(
    "r5_node_numbers",
    views.with_views("obs") + CLASS_SQL + """
select gid, station_type, row_number() over (order by case station_type when 'general' then 0 else 1 end, gid) - 1 as node,
       row_number() over (partition by station_type order by gid) - 1 as local
from classes""",
)
def r5_node_numbers(spark, folder):
    classes = station_classes(spark, folder).select("gid", "station_type")
    return reshape.number_nodes(classes, "gid", "station_type", F.floor(F.col("gid") / 4096)).select(
        "gid", "station_type", "node", "local"
    )


@query(
    "r6_last_features",
    views.with_views("obs") + """
select gid, variable, arg_max(value, time_sgt) as value, max(time_sgt) as time_sgt from obs group by gid, variable""",
)
def r6_last_features(spark, folder):
    return views.observations(spark, folder).groupBy("gid", "variable").agg(
        F.max_by("value", "time_sgt").alias("value"), F.max("time_sgt").alias("time_sgt")
    )


@query(
    "a3_observation_counts",
    views.with_views("obs") + "select gid, variable, count(value) as n from obs group by gid, variable",
)
def a3_observation_counts(spark, folder):
    return views.observations(spark, folder).groupBy("gid", "variable").agg(F.count("value").alias("n"))


@query("a4_station_class", views.with_views("obs") + CLASS_SQL + "select gid, station_type from classes")
def a4_station_class(spark, folder):
    return station_classes(spark, folder).select("gid", "station_type")


@query(
    "a5_rainy_timesteps",
    views.with_views("obs") + """,
s as (select time_bucket(interval '15 minutes', time_sgt) as bucket, sum(value) as s from obs
      where variable = 'rain_rate' group by 1)
select count(*) filter (s <> 0) as rainy, count(*) as timesteps from s""",
)
def a5_rainy_timesteps(spark, folder):
    sums = temporal.bucket_stats(rain(spark, folder), [], "time_sgt", [F.sum("value").alias("s")], 15)
    return sums.agg(F.count_if(F.col("s") != 0).alias("rainy"), F.count(F.lit(1)).alias("timesteps"))


@query(
    "a6_missing_counts",
    views.with_views("obs") + _WIDE_SQL + """,
days as (select unnest(generate_series(min(bucket), max(bucket), interval '1 day')) as bucket from wide)
select k.gid, count(*) filter (w.rain_rate is null) as missing, count(w.rain_rate) as present
from (select distinct gid from wide) k cross join days left join wide w on w.gid = k.gid and w.bucket = days.bucket
group by k.gid""",
)
def a6_missing_counts(spark, folder):
    """Missing and present daily rain values per station on the dense axis."""
    obs = views.observations(spark, folder)
    axis = temporal.dense_slots(obs, ["gid"], "time_sgt", 1440)
    present = (
        rain(spark, folder).where(F.col("value").isNotNull())
        .select("gid", temporal.slot_of(F.col("time_sgt"), 1440).alias("slot")).distinct().withColumn("seen", F.lit(1))
    )
    return axis.join(present, ["gid", "slot"], "left").groupBy("gid").agg(
        F.count_if(F.col("seen").isNull()).alias("missing"), F.count("seen").alias("present")
    )


_DESCRIBE = """count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min,
       max(value) as max, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50,
       round(quantile_cont(value, 0.75), 6) as q75"""


def _rounded_description(df):
    return df.select(*[rounded(F.col(c)).alias(c) if c in ("mean", "std", "q25", "q50", "q75") else c for c in df.columns])


@query("a7_describe", views.with_views("obs") + f"select variable, {_DESCRIBE} from obs group by variable")
def a7_describe(spark, folder):
    return _rounded_description(errors.describe(views.observations(spark, folder), "value", ["variable"]))


@query("a7_describe_all", views.with_views("obs") + f"select {_DESCRIBE} from obs")
def a7_describe_all(spark, folder):
    return _rounded_description(errors.describe(views.observations(spark, folder), "value"))


@query(
    "a8_global_range",
    views.with_views("obs", "radar_cell") + """
select 'gauge' as source, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean_value from obs
where variable = 'rain_rate'
union all select 'radar', min(value), max(value), round(avg(value), 6) from radar_cell""",
)
def a8_global_range(spark, folder):
    def limits(df, name):
        return df.agg(
            F.lit(name).alias("source"), F.min("value").alias("lo"), F.max("value").alias("hi"),
            rounded(F.avg("value")).alias("mean_value"),
        )

    return limits(rain(spark, folder), "gauge").unionByName(limits(views.radar_cells(spark, folder), "radar"))


@query(
    "a23_histogram",
    views.with_views("obs") + """,
v as (select value from obs where variable = 'temperature'),
l as (select min(value) as lo, max(value) as hi from v),
c as (select least(cast(floor((value - lo) / ((hi - lo) / 100)) as int), 99) as bin, count(*) as n from v, l group by 1)
select cast(g.bin as int) as bin, round(lo + (hi - lo) / 100 * g.bin, 6) as left_edge, coalesce(c.n, 0) as n
from (select unnest(generate_series(0, 99)) as bin) g cross join l left join c on c.bin = g.bin""",
)
def a23_histogram(spark, folder):
    values = views.observations(spark, folder).where(F.col("variable") == "temperature")
    return errors.histogram(values, "value", 100).withColumn("left_edge", rounded(F.col("left_edge")))


@query(
    "a23_histogram_by_variable",
    views.with_views("obs") + """,
l as (select variable, min(value) as lo, max(value) as hi from obs where value is not null group by variable),
c as (select variable, case when hi > lo then least(cast(floor((value - lo) / ((hi - lo) / 100)) as int), 99) else 0 end as bin, count(*) as n
      from obs join l using (variable) where value is not null group by 1, 2)
select l.variable, cast(g.bin as int) as bin, round(lo + (hi - lo) / 100 * g.bin, 6) as left_edge, coalesce(c.n, 0) as n
from (select unnest(generate_series(0, 99)) as bin) g cross join l left join c on c.bin = g.bin and c.variable = l.variable""",
)
def a23_histogram_by_variable(spark, folder):
    found = errors.histogram_by(views.observations(spark, folder), ["variable"], "value", 100)
    return found.withColumn("left_edge", rounded(F.col("left_edge")))


@query("t1_sorted_rain", views.with_views("obs") + "select gid, time_sgt, value from obs where variable = 'rain_rate'")
def t1_sorted_rain(spark, folder):
    return rain(spark, folder).orderBy("time_sgt", "gid")


@query(
    "t3_first_rows",
    views.with_views("obs") + """
select gid, time_sgt, value from obs where variable = 'rain_rate' order by time_sgt, gid limit 9""",
)
def t3_first_rows(spark, folder):
    return rain(spark, folder).orderBy("time_sgt", "gid").limit(9)
