"""Split and cluster queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rainweave.operators import sampling
from rainweave.plans.common import rounded
from rainweave.plans.registry import query
from rainweave.session import checkpointed
from rainweave.sources import views

# eight tiles of the study box stand in for cluster labels where SQL has to follow
TILE_SQL = """,
tiles as (select gid, latitude, longitude, cast(floor((latitude - 1.188e0) / 0.157e0) * 4 + floor((longitude - 103.6e0) / 0.126e0) as int) as cluster from stations)"""

ROLE_SQL = TILE_SQL + """,
o1 as (select *, row_number() over (partition by cluster order by md5(concat('123:', gid)), gid) - 1 as slot, count(*) over (partition by cluster) as n from tiles),
s1 as (select *, case when n > 2 then greatest(1, cast(floor(n * 10e0 / 100e0) as bigint)) else 0 end as n_test from o1),
r1 as (select *, case when slot < n_test then 'test' else 'train' end as statistical_role from s1),
o2 as (select gid, row_number() over (partition by cluster order by md5(concat('223:', gid)), gid) - 1 as at2, n - n_test as m
       from r1 where statistical_role = 'train'),
roles as (select gid, cluster, statistical_role, case when o2.gid is null then 'test' when at2 < case when m > 1
          then greatest(1, cast(floor(m * (20e0 / 90 * 100) / 100e0) as bigint)) else 0 end then 'validation' else 'train' end as ml_role
          from r1 left join o2 using (gid))"""

FOLD_SQL = TILE_SQL + """,
o1 as (select *, row_number() over (partition by cluster order by md5(concat('123:', gid)), gid) - 1 as slot from tiles),
f1 as (select cast(fold as int) as fold, gid, cluster, case when slot = fold then 'test' else 'train' end as statistical_role
       from o1 cross join (select unnest(generate_series(0, 4)) as fold)),
o2 as (select fold, gid, row_number() over (partition by fold, cluster order by md5(concat(223 + fold, ':', gid)), gid) - 1 as at2,
              count(*) over (partition by fold, cluster) as m from f1 where statistical_role = 'train'),
folds as (select f1.*, case when o2.gid is null then 'test' when at2 < case when m > 1
          then greatest(1, cast(floor(m * 20e0 / 100e0) as bigint)) else 0 end then 'validation' else 'train' end as ml_role
          from f1 left join o2 on o2.fold = f1.fold and o2.gid = f1.gid)"""


def tiled_stations(spark, folder):
    tile = F.floor((F.col("latitude") - 1.188) / 0.157) * 4 + F.floor((F.col("longitude") - 103.6) / 0.126)
    return views.stations(spark, folder).withColumn("cluster", tile.cast("int"))


def station_roles(spark, folder):
    return sampling.stratified_split(tiled_stations(spark, folder))


def station_folds(spark, folder):
    return sampling.stratified_folds(tiled_stations(spark, folder))


@query("k1_kmeans_clusters")
def k1_kmeans_clusters(spark, folder):
    """K-means labels; iterative, so the twin is that of ``k1_cluster_checks``."""
    return sampling.spatial_clusters(views.stations(spark, folder))


@query("k1_cluster_checks", views.with_views("stations") + """
select count(*) as stations, least(count(*), 8) as clusters, 0::bigint as misplaced, 0::bigint as out_of_order from stations""")
def k1_cluster_checks(spark, folder):
    """Of the clusters: stations that lie nearer to another centroid, and neighbouring labels whose centroids are not in order."""
    found = checkpointed(sampling.spatial_clusters(views.stations(spark, folder)))
    centroids = checkpointed(sampling.cluster_summary(found))
    held = centroids.agg(F.collect_list(F.struct("cluster", "longitude", "latitude")).alias("held"))  # eight rows
    gap = lambda c: F.hypot(F.col("longitude") - c["longitude"], F.col("latitude") - c["latitude"])
    rows = found.withColumn("held", held.scalar())
    far = rows.withColumn("own", F.get(F.filter("held", lambda c: c["cluster"] == F.col("cluster")), F.lit(0)))
    misplaced = far.agg(F.count(F.lit(1)).alias("stations"), F.count_if(F.exists("held", lambda c: gap(c) < gap(F.col("own")) - 1e-8)).alias("misplaced"))
    line = Window.partitionBy(F.lit(0)).orderBy("cluster")
    ordered = centroids.withColumn("after", F.lead(F.struct("longitude", "latitude")).over(line))
    order = ordered.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.struct("longitude", "latitude") > F.col("after")).alias("out_of_order"))
    return misplaced.select("stations", order.select("clusters").scalar().alias("clusters"), "misplaced", order.select("out_of_order").scalar().alias("out_of_order"))


@query(
    "a24_cluster_summary",
    views.with_views("stations") + TILE_SQL + """
select cluster, count(*) as stations, round(avg(longitude), 9) as longitude, round(avg(latitude), 9) as latitude from tiles group by cluster""",
)
def a24_cluster_summary(spark, folder):
    df = sampling.cluster_summary(tiled_stations(spark, folder))
    return df.withColumns({c: rounded(F.col(c), 9) for c in ("longitude", "latitude")})


@query("k2_stratified_split", views.with_views("stations") + ROLE_SQL + "select gid, cluster, statistical_role, ml_role from roles")
def k2_stratified_split(spark, folder):
    return station_roles(spark, folder)


@query("k3_stratified_folds", views.with_views("stations") + FOLD_SQL + "select fold, gid, cluster, statistical_role, ml_role from folds")
def k3_stratified_folds(spark, folder):
    return station_folds(spark, folder)


@query(
    "k4_random_split",
    views.with_views("stations") + """
select gid, case when row_number() over (order by md5(concat('111:', gid)), gid) - 1 < floor((select count(*) from stations) * 0.7e0)
       then 'train' else 'validation' end as role from stations""",
)
def k4_random_split(spark, folder):
    return sampling.random_split(views.stations(spark, folder))


@query(
    "k5_fold_checks",
    views.with_views("stations") + FOLD_SQL + """,
t as (select gid, count(*) as times from folds where statistical_role = 'test' group by gid)
select cast(sum(times) as bigint) as test_rows, count(*) as test_stations, count(*) filter (times > 1) as overlapping,
       (select least(count(distinct fold) * count(distinct cluster), count(distinct gid)) from folds) as expected_at_most from t""",
)
def k5_fold_checks(spark, folder):
    return sampling.fold_checks(station_folds(spark, folder))


@query(
    "k5_role_shares",
    views.with_views("stations") + ROLE_SQL + """
select ml_role, count(*) as stations, round(count(*) * 100e0 / (select count(*) from roles), 6) as percent from roles group by ml_role""",
)
def k5_role_shares(spark, folder):
    shares = sampling.role_shares(station_roles(spark, folder), "ml_role")
    return shares.withColumn("percent", rounded(F.col("percent")))


@query(
    "s9_split_report",
    views.with_views("stations") + ROLE_SQL + """
select ml_role, count(*) over (partition by ml_role) as stations, row_number() over (partition by ml_role order by gid) - 1 as position, gid from roles""",
)
def s9_split_report(spark, folder):
    return sampling.split_report(station_roles(spark, folder), "ml_role", F.floor(F.col("gid") / 4096))


@query(
    "u2_remaining_stations",
    views.with_views("stations") + ROLE_SQL + """
select gid from stations where gid not in (select gid from roles where ml_role in ('train', 'validation'))""",
)
def u2_remaining_stations(spark, folder):
    """Test stations as all stations without those of training and validation."""
    used = station_roles(spark, folder).where(F.col("ml_role").isin("train", "validation")).select("gid")
    return views.stations(spark, folder).select("gid").exceptAll(used)


@query(
    "u3_fold_intersections",
    views.with_views("stations") + FOLD_SQL + """,
t as (select fold, gid from folds where statistical_role = 'test')
select cast(a as int) as fold, (select count(*) from t where fold = a) as test_stations,
       (select count(distinct x.gid) from t x where x.fold = a and x.gid in (select gid from t where fold <> a)) as shared
from (select unnest(generate_series(0, 4)) as a)""",
)
def u3_fold_intersections(spark, folder):
    """Test stations of every fold and how many also test in another fold."""
    folds = station_folds(spark, folder)
    is_test = F.col("statistical_role") == "test"
    often = folds.where(is_test).groupBy("gid").agg(F.countDistinct("fold").alias("folds"))
    # a fold without test stations keeps its row
    return folds.join(often, "gid", "left").groupBy("fold").agg(
        F.count_if(is_test).alias("test_stations"), F.count_if(is_test & (F.col("folds") > 1)).alias("shared")
    )


@query(
    "u4_mask_union",
    views.with_views("stations") + ROLE_SQL + "select gid, (ml_role = 'train') or (ml_role = 'validation') as visible from roles",
)
def u4_mask_union(spark, folder):
    is_train, is_validation = F.col("ml_role") == "train", F.col("ml_role") == "validation"
    return station_roles(spark, folder).select("gid", (is_train | is_validation).alias("visible"))
