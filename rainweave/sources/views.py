"""Sensor-shaped tables derived from the given test tables.

The given tables hold no rainfall, so stations, observations, links, predictions and radar
cells are expressed as views over them. ``SQL`` carries the same views for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.operators.partitioned import row_position


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _latitude(key: Column, factor: int) -> Column:
    return F.lit(1.188) + F.lit(0.312) * ((key * factor) % 997) / F.lit(997.0)


def _longitude(key: Column, factor: int) -> Column:
    return F.lit(103.6) + F.lit(0.5) * ((key * factor) % 1009) / F.lit(1009.0)


def stations(spark: SparkSession, folder: str) -> DataFrame:
    gid = F.col("gid")
    return (
        table(spark, folder, "events")
        .select(F.col("user_id").alias("gid"))
        .distinct()
        .select(gid, _latitude(gid, 379).alias("latitude"), _longitude(gid, 613).alias("longitude"))
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    variable = (
        F.when(kind == "purchase", "rain_rate")
        .when(kind == "view", "temperature")
        .when(kind == "click", "humidity")
        .when(kind == "signup", "wind_speed")
        .otherwise("wind_direction")
    )
    value = F.when(kind == "purchase", F.greatest(F.col("value") - 40.0, F.lit(0.0))).otherwise(F.col("value"))
    return (
        table(spark, folder, "events")
        .where(~((F.col("user_id") % 5 == 0) & (kind == "signup")))
        .select(
            F.col("user_id").alias("gid"),
            F.col("ts").alias("time_sgt"),
            variable.alias("variable"),
            value.alias("value"),
        )
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("link_id"),
        ((5 + key % 35).cast("double") + 0.25).alias("frequency"),
        (0.5 + (key % 10) * 0.75).alias("length"),
        F.when(key % 3 == 0, "HV").when(key % 3 == 1, "V").otherwise("H").alias("polarization"),
        _latitude(key, 379).alias("site_a_latitude"),
        _longitude(key, 613).alias("site_a_longitude"),
        _latitude(key, 521).alias("site_b_latitude"),
        _longitude(key, 787).alias("site_b_longitude"),
    )


def link_series(spark: SparkSession, folder: str) -> DataFrame:
    """Signal level per link, one row per minute ``t`` = 0, 1, 2, ..."""
    items = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
    )
    order = [
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    ]
    return row_position(items, ["l_suppkey"], F.col("l_shipdate"), order, "t").select(
        F.col("l_suppkey").alias("link_id"), "t", (F.col("l_quantity") * 0.05).alias("trsl")
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("fold"),
        F.col("l_suppkey").alias("station_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "general").otherwise("rainfall").alias("station_type"),
        F.col("l_orderkey").alias("timestep"),
        F.col("l_linenumber").alias("sub"),
        F.greatest(F.col("l_quantity") - 25.0, F.lit(0.0)).alias("true_value"),
        (F.col("l_discount") * 100.0 + F.col("l_tax") * 100.0).alias("pred_value"),
    )


def frame_time(number: Column) -> Column:
    """One radar frame per 20 minutes from 2024-01-01."""
    return F.timestamp_add("MINUTE", (number * 20).cast("int"), F.expr("timestamp_ntz'2024-01-01 00:00:00'"))


def radar_frames(spark: SparkSession, folder: str) -> DataFrame:
    """8 x 8 frames with the bounds of the study box."""
    cells = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(cells, r * 8 + 1, 8))
    return table(spark, folder, "embeddings").select(
        frame_time(F.col("vec_id")).alias("time_sgt"),
        rows.alias("data"),
        F.struct(
            F.lit(103.6).alias("left"), F.lit(1.188).alias("bottom"),
            F.lit(104.1).alias("right"), F.lit(1.5).alias("top"),
        ).alias("bounds"),
    )


def radar_cells(spark: SparkSession, folder: str) -> DataFrame:
    frames = table(spark, folder, "embeddings").select(
        frame_time(F.col("vec_id")).alias("time_sgt"), F.posexplode("embedding").alias("at", "x")
    )
    return frames.select(
        "time_sgt",
        F.floor(F.col("at") / 8).cast("int").alias("row"),
        (F.col("at") % 8).cast("int").alias("col"),
        F.col("x").cast("double").alias("value"),
    )


SQL = {
    "stations": """
select gid, 1.188e0 + 0.312e0 * ((gid * 379) % 997) / 997e0 as latitude,
       103.6e0 + 0.5e0 * ((gid * 613) % 1009) / 1009e0 as longitude
from (select distinct user_id as gid from events) u""",
    "obs": """
select user_id as gid, ts as time_sgt,
       case event_type when 'purchase' then 'rain_rate' when 'view' then 'temperature'
            when 'click' then 'humidity' when 'signup' then 'wind_speed' else 'wind_direction' end as variable,
       case when event_type = 'purchase' then greatest(value - 40e0, 0e0) else value end as value
from events where not (user_id % 5 = 0 and event_type = 'signup')""",
    "cml_link": """
select s_suppkey as link_id, cast(5 + s_suppkey % 35 as double) + 0.25e0 as frequency,
       0.5e0 + (s_suppkey % 10) * 0.75e0 as length,
       case when s_suppkey % 3 = 0 then 'HV' when s_suppkey % 3 = 1 then 'V' else 'H' end as polarization,
       1.188e0 + 0.312e0 * ((s_suppkey * 379) % 997) / 997e0 as site_a_latitude,
       103.6e0 + 0.5e0 * ((s_suppkey * 613) % 1009) / 1009e0 as site_a_longitude,
       1.188e0 + 0.312e0 * ((s_suppkey * 521) % 997) / 997e0 as site_b_latitude,
       103.6e0 + 0.5e0 * ((s_suppkey * 787) % 1009) / 1009e0 as site_b_longitude
from supplier""",
    "cml": """
select l_suppkey as link_id,
       cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber,
            l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as bigint) as t,
       l_quantity * 0.05e0 as trsl
from lineitem""",
    "predictions": """
select l_orderkey % 5 as fold, l_suppkey as station_id,
       case when l_suppkey % 2 = 0 then 'general' else 'rainfall' end as station_type,
       l_orderkey as timestep, l_linenumber as sub, greatest(l_quantity - 25e0, 0e0) as true_value,
       l_discount * 1e2 + l_tax * 1e2 as pred_value
from lineitem""",
    "radar_cell": """
select timestamp '2024-01-01' + to_minutes(20*vec_id) as time_sgt, cast(pos // 8 as int) as row,
       cast(pos % 8 as int) as col, cast(x as double) as value
from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding,1)-1 as pos from embeddings)""",
}


def with_views(*names: str) -> str:
    """Opening of a SQL statement with the named views as common table expressions."""
    return "with recursive " + ",\n".join(f"{name} as ({SQL[name]})" for name in names)
