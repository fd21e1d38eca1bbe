"""Time-series queries over the station observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweave.functions.time import slot_time
from rainweave.operators import temporal
from rainweave.plans.common import rain, rounded
from rainweave.plans.registry import query
from rainweave.sources import views

_FILLED_SQL = """,
b as (select gid, variable, time_bucket(interval '6 hours', time_sgt) as bucket, arg_min(value, time_sgt) as value
      from obs where value is not null group by all),
axis as (select unnest(generate_series(min(time_bucket(interval '6 hours', time_sgt)),
                max(time_bucket(interval '6 hours', time_sgt)), interval '6 hours')) as bucket from obs),
dense as (select k.gid, k.variable, axis.bucket, b.value,
                 row_number() over (partition by k.gid, k.variable order by axis.bucket) as n
          from (select distinct gid, variable from b) k cross join axis
          left join b on b.gid = k.gid and b.variable = k.variable and b.bucket = axis.bucket),
e as (select *, last_value(value ignore nulls) over p as v0,
             last_value(case when value is not null then n end ignore nulls) over p as n0,
             first_value(value ignore nulls) over f as v1,
             first_value(case when value is not null then n end ignore nulls) over f as n1
      from dense
      window p as (partition by gid, variable order by n rows between unbounded preceding and current row),
             f as (partition by gid, variable order by n rows between current row and unbounded following)),
filled as (select gid, variable, bucket,
                  case when v0 is null then v1 when v1 is null then v0 when n1 = n0 then v0
                       else v0 + (v1 - v0) * (n - n0) / (n1 - n0) end as value from e)"""


def filled_observations(spark, folder):
    return temporal.resample_filled(views.observations(spark, folder), ["gid", "variable"], "time_sgt", "value", 360)


@query(
    "station_series_summary",
    views.with_views("obs") + _FILLED_SQL + """
select gid, variable, count(*) as n, round(avg(value), 6) as mean_value, round(min(value), 6) as min_value,
       round(max(value), 6) as max_value
from filled group by gid, variable""",
)
def station_series_summary(spark, folder):
    """First value per 6-hour bucket, dense axis, gap fill, statistics per station and variable."""
    return (
        filled_observations(spark, folder)
        .groupBy("gid", "variable")
        .agg(
            F.count(F.lit(1)).alias("n"),
            rounded(F.avg("value")).alias("mean_value"),
            rounded(F.min("value")).alias("min_value"),
            rounded(F.max("value")).alias("max_value"),
        )
    )


@query(
    "w6_gap_fill",
    views.with_views("obs") + _FILLED_SQL + "select gid, variable, bucket, round(value, 9) as value from filled",
)
def w6_gap_fill(spark, folder):
    return filled_observations(spark, folder).select("gid", "variable", "bucket", rounded(F.col("value"), 9).alias("value"))


@query(
    "w8_dense_axis",
    views.with_views("obs") + """,
axis as (select unnest(generate_series(min(time_bucket(interval '1 day', time_sgt)),
                max(time_bucket(interval '1 day', time_sgt)), interval '1 day')) as bucket from obs)
select k.gid, axis.bucket, count(o.value) as n
from (select distinct gid from obs) k cross join axis
left join obs o on o.gid = k.gid and time_bucket(interval '1 day', o.time_sgt) = axis.bucket
group by k.gid, axis.bucket""",
)
def w8_dense_axis(spark, folder):
    obs = views.observations(spark, folder)
    counted = temporal.bucket_stats(obs, ["gid"], "time_sgt", [F.count("value").alias("n")], 1440)
    axis = temporal.dense_slots(obs, ["gid"], "time_sgt", 1440).select("gid", slot_time(F.col("slot"), 1440).alias("bucket"))
    return axis.join(counted, ["gid", "bucket"], "left").select(
        "gid", "bucket", F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "a1_first_per_bucket",
    views.with_views("obs") + """
select gid, variable, time_bucket(interval '15 minutes', time_sgt) as bucket, arg_min(value, time_sgt) as value
from obs where value is not null group by all""",
)
def a1_first_per_bucket(spark, folder):
    return temporal.bucket_first(views.observations(spark, folder), ["gid", "variable"], "time_sgt", "value", 15)


@query(
    "a2_bucket_mean_sum_right",
    views.with_views("obs") + """
select gid, variable, time_bucket(interval '15 minutes', time_sgt) + interval '15 minutes' as bucket,
       round(avg(value), 6) as mean_value, round(sum(value), 6) as sum_value
from obs group by all""",
)
def a2_bucket_mean_sum_right(spark, folder):
    return temporal.bucket_stats(
        views.observations(spark, folder), ["gid", "variable"], "time_sgt",
        [rounded(F.avg("value")).alias("mean_value"), rounded(F.sum("value")).alias("sum_value")], 15, "right",
    )


@query(
    "a2_dense_daily_sum",
    views.with_views("obs") + """,
axis as (select unnest(generate_series(min(time_bucket(interval '1 day', time_sgt)),
                max(time_bucket(interval '1 day', time_sgt)), interval '1 day')) as bucket from obs),
d as (select gid, time_bucket(interval '1 day', time_sgt) as bucket, sum(value) as s from obs
      where variable = 'rain_rate' group by all)
select k.gid, axis.bucket, coalesce(round(d.s, 6), 0) as sum_value
from (select distinct gid from obs where variable = 'rain_rate') k cross join axis
left join d on d.gid = k.gid and d.bucket = axis.bucket""",
)
def a2_dense_daily_sum(spark, folder):
    """Daily sums on the dense axis; an empty day sums to 0."""
    obs = views.observations(spark, folder)
    wet = rain(spark, folder)
    sums = temporal.bucket_stats(wet, ["gid"], "time_sgt", [F.sum("value").alias("s")], 1440)
    bounds = obs.select("time_sgt")
    slots = bounds.agg(F.min(temporal.slot_of(F.col("time_sgt"), 1440)).alias("lo"), F.max(temporal.slot_of(F.col("time_sgt"), 1440)).alias("hi"))
    axis = wet.select("gid").distinct().select(
        "gid",
        F.explode(F.sequence(slots.select("lo").scalar(), slots.select("hi").scalar())).alias("slot"),
    ).select("gid", slot_time(F.col("slot"), 1440).alias("bucket"))
    return axis.join(sums, ["gid", "bucket"], "left").select(
        "gid", "bucket", F.coalesce(rounded(F.col("s")), F.lit(0.0)).alias("sum_value")
    )


@query(
    "p9_times_with_rain",
    views.with_views("obs") + """,
b as (select gid, time_bucket(interval '15 minutes', time_sgt) as bucket, arg_min(value, time_sgt) as value
      from obs where variable = 'rain_rate' group by all)
select gid, bucket, value from b
where bucket in (select bucket from b group by bucket having count(*) filter (value > 0) >= 2)""",
)
def p9_times_with_rain(spark, folder):
    first = temporal.bucket_first(rain(spark, folder), ["gid"], "time_sgt", "value", 15)
    return temporal.times_with_rain(first, "bucket", "value", 2)


@query(
    "p11_time_slice",
    views.with_views("obs") + """,
b as (select gid, time_bucket(interval '15 minutes', time_sgt) as bucket, arg_min(value, time_sgt) as value
      from obs where variable = 'rain_rate' group by all),
n as (select bucket, row_number() over (order by bucket) - 1 as n from (select distinct bucket from b))
select gid, bucket, value from b where bucket in (select bucket from n where n >= 593 and n < 602)""",
)
def p11_time_slice(spark, folder):
    """The event window at positions 593..601 of the time axis."""
    first = temporal.bucket_first(rain(spark, folder), ["gid"], "time_sgt", "value", 15)
    return temporal.time_slice(first, "bucket", 593, 602)


def _irregular_index(spark, folder):
    # the times of one event type are an irregular index for the others
    return views.observations(spark, folder).where(F.col("variable") == "wind_speed").select("time_sgt").distinct()


def _assigned(spark, folder, label, name):
    values = views.observations(spark, folder).where(F.col("variable") == "temperature")
    return (
        temporal.assign_to_index(values, _irregular_index(spark, folder), "time_sgt", label)
        .where(F.col("target").isNotNull())
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value")).alias(name))
    )


_ASOF_SQL = """,
i as (select distinct time_sgt from obs where variable = 'wind_speed'),
v as (select * from obs where variable = 'temperature'),
lim as (select greatest((select min(time_sgt) from i), (select min(time_sgt) from v)) as lo,
               least((select max(time_sgt) from i), (select max(time_sgt) from v)) as hi),
ic as (select i.time_sgt from i, lim where i.time_sgt between lim.lo and lim.hi),
vc as (select v.* from v, lim where v.time_sgt between lim.lo and lim.hi)"""


@query(
    "j11_assign_next_index",
    views.with_views("obs") + _ASOF_SQL + """
select ic.time_sgt as target, count(*) as n, round(avg(vc.value), 6) as mean_value
from vc asof join ic on vc.time_sgt <= ic.time_sgt group by ic.time_sgt""",
)
def j11_assign_next_index(spark, folder):
    return _assigned(spark, folder, "right", "mean_value")


@query(
    "j11_assign_last_index",
    views.with_views("obs") + _ASOF_SQL + """
select ic.time_sgt as target, count(*) as n, round(avg(vc.value), 6) as mean_value
from vc asof join ic on vc.time_sgt >= ic.time_sgt group by ic.time_sgt""",
)
def j11_assign_last_index(spark, folder):
    return _assigned(spark, folder, "left", "mean_value")
