"""Graph-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweave.functions.activation import activation
from rainweave.operators import graph, learner, metrics, reshape, temporal
from rainweave.plans.common import rain, rounded
from rainweave.plans.registry import query
from rainweave.plans.sampling import FOLD_SQL, ROLE_SQL, station_folds, station_roles
from rainweave.plans.spatial import CELL_SQL, KNN_SQL, radar_grid, station_knn
from rainweave.plans.stations import CLASS_SQL, station_classes
from rainweave.sources import views

_TYPED_SQL = CLASS_SQL + KNN_SQL + """,
typed as (select src, s.station_type as src_type, dst, d.station_type as dst_type, dist,
                 (case s.station_type when 'general' then 'gen' else 'rain' end) || '_to_' ||
                 (case d.station_type when 'general' then 'gen' else 'rain' end) as edge_type
          from knn join classes s on s.gid = src join classes d on d.gid = dst)"""
_NODE_SQL = """,
nodes as (select gid, station_type, row_number() over (order by case station_type when 'general' then 0 else 1 end, gid) - 1 as node from classes)"""


def edges_with_types(spark, folder):
    return graph.typed_edges(station_knn(spark, folder), station_classes(spark, folder)).drop("rank")


def numbered_nodes(spark, folder):
    classes = station_classes(spark, folder).select("gid", "station_type")
    return reshape.number_nodes(classes, "gid", "station_type", F.floor(F.col("gid") / 4096)).drop("local")


def node_masks(spark, folder):
    return graph.with_masks(numbered_nodes(spark, folder), station_roles(spark, folder))


_MASK_SQL = _NODE_SQL + """,
masked as (select n.*, coalesce(ml_role = 'train', false) as train_mask, coalesce(ml_role = 'validation', false) as validation_mask,
                  not coalesce(ml_role in ('train', 'validation'), false) as test_mask from nodes n left join roles using (gid))"""


@query("g1_typed_edges", views.with_views("obs", "stations") + _TYPED_SQL + """
select edge_type, src_type, src, dst_type, dst, round(dist, 9) as dist from typed""")
def g1_typed_edges(spark, folder):
    df = edges_with_types(spark, folder).withColumn("dist", rounded(F.col("dist"), 9))
    return df.select("edge_type", "src_type", "src", "dst_type", "dst", "dist")


@query("g2_homogeneous_edges", views.with_views("obs", "stations") + _TYPED_SQL + _NODE_SQL + """
select a.node as src, b.node as dst, round(dist, 9) as dist from knn join nodes a on a.gid = src join nodes b on b.gid = dst""")
def g2_homogeneous_edges(spark, folder):
    edges = graph.renumbered_edges(station_knn(spark, folder), numbered_nodes(spark, folder))
    return edges.select("src", "dst", rounded(F.col("dist"), 9).alias("dist"))


_RADAR_EDGE_SQL = """,
near as (select cell_id, gid, 111e0 * sqrt((c.longitude - s.longitude) * (c.longitude - s.longitude) + (c.latitude - s.latitude) * (c.latitude - s.latitude)) as km
         from cell c, stations s)"""


@query("g3_radar_station_edges", views.with_views("stations") + CELL_SQL + _RADAR_EDGE_SQL + """
select 'radar_to_station' as edge_type, cell_id as src, gid as dst, round(km, 6) as dist from near where km <= 1.5e0
union all select 'station_to_radar', gid, cell_id, round(km, 6) from near where km <= 1.5e0""")
def g3_radar_station_edges(spark, folder):
    edges = graph.radar_station_edges(radar_grid(spark), views.stations(spark, folder), 1.5)
    return edges.select("edge_type", "src", "dst", rounded(F.col("dist")).alias("dist"))


@query("g4_radar_masks", views.with_views("radar_cell") + """
select row, col, count(*) as frames, true as train_mask, true as validation_mask, true as test_mask from radar_cell group by row, col""")
def g4_radar_masks(spark, folder):
    cells = views.radar_cells(spark, folder).groupBy("row", "col").agg(F.count(F.lit(1)).alias("frames"))
    return graph.radar_masks(cells)


@query("j12_node_masks", views.with_views("obs", "stations") + CLASS_SQL + ROLE_SQL + _MASK_SQL + """
select gid, node, train_mask, validation_mask, test_mask from masked""")
def j12_node_masks(spark, folder):
    return node_masks(spark, folder).select("gid", "node", "train_mask", "validation_mask", "test_mask")


_SUB_SQL = """,
e as (select a.node as src, b.node as dst, dist from knn join nodes a on a.gid = src join nodes b on b.gid = dst),
kept as (select node as orig_id, row_number() over (order by node) - 1 as node from masked where train_mask or validation_mask),
sub as (select a.node as src, b.node as dst, dist from e join kept a on a.orig_id = src join kept b on b.orig_id = dst)"""


def _graphs(spark, folder):
    edges = graph.renumbered_edges(station_knn(spark, folder), numbered_nodes(spark, folder)).select("src", "dst", "dist")
    return graph.split_graphs(node_masks(spark, folder), edges, F.floor(F.col("orig_id") / 4096))


@query("j13_validation_subgraph", views.with_views("obs", "stations") + _TYPED_SQL + ROLE_SQL + _MASK_SQL + _SUB_SQL + """
select src, dst, round(dist, 9) as dist from sub""")
def j13_validation_subgraph(spark, folder):
    _, edges = _graphs(spark, folder)["validation"]
    return edges.select("src", "dst", rounded(F.col("dist"), 9).alias("dist"))


@query("j13_subgraph_nodes", views.with_views("obs", "stations") + CLASS_SQL + ROLE_SQL + _MASK_SQL + """
select orig_id, node, gid from (select node as orig_id, row_number() over (order by node) - 1 as node, gid from masked where train_mask)""")
def j13_subgraph_nodes(spark, folder):
    nodes, _ = _graphs(spark, folder)["train"]
    return nodes.select("orig_id", "node", "gid")


@query("g8_subgraph_checks", views.with_views("obs", "stations") + _TYPED_SQL + ROLE_SQL + _MASK_SQL + _SUB_SQL + """
select count(*) as expected_nodes, count(*) as found_nodes, cast(0 as bigint) as one_sided,
       (select count(*) from (select distinct least(src, dst), greatest(src, dst) from sub)) as undirected_edges from kept""")
def g8_subgraph_checks(spark, folder):
    nodes, edges = _graphs(spark, folder)["validation"]
    return graph.subgraph_checks(node_masks(spark, folder), nodes, edges, F.col("train_mask") | F.col("validation_mask"))


@query("g5_components", views.with_views("obs", "stations") + KNN_SQL + """,
und as (select src, dst from knn union select dst, src from knn),
walk as (select gid as node, gid as reach from stations union select walk.node, und.dst from walk join und on und.src = walk.reach)
select node, min(reach) as component from walk group by node""")
def g5_components(spark, folder):
    nodes = views.stations(spark, folder).select(F.col("gid").alias("node"))
    return graph.connected_components(nodes, station_knn(spark, folder))


@query("g6_edge_checks", views.with_views("stations") + KNN_SQL + """,
o as (select count(*) as one_way from knn a where not exists (select 1 from knn b where b.src = a.dst and b.dst = a.src))
select (select count(*) from knn) as edges, (select count(*) from knn where src = dst) as self_loops, one_way, one_way = 0 as is_undirected from o""")
def g6_edge_checks(spark, folder):
    return graph.edge_checks(station_knn(spark, folder))


@query("g6_isolated_nodes", views.with_views("stations") + CELL_SQL + _RADAR_EDGE_SQL + """
select gid from stations where gid not in (select gid from near where km <= 1.5e0)""")
def g6_isolated_nodes(spark, folder):
    """Stations without any radar cell in reach."""
    edges = graph.radar_station_edges(radar_grid(spark), views.stations(spark, folder), 1.5)
    reached = edges.where(F.col("edge_type") == "radar_to_station").select(F.col("dst").alias("src"), "dst")
    return graph.isolated_nodes(views.stations(spark, folder).select("gid"), reached, "gid")


@query("g7_structure_report", views.with_views("obs", "stations") + _TYPED_SQL + ROLE_SQL + _MASK_SQL + """
select 'node' as kind, station_type as name, count(*) as n, count(*) filter (train_mask) as train_mask,
       count(*) filter (validation_mask) as validation_mask, count(*) filter (test_mask) as test_mask from masked group by station_type
union all select 'edge', edge_type, count(*), null, null, null from typed group by edge_type""")
def g7_structure_report(spark, folder):
    return graph.structure_report(
        node_masks(spark, folder), edges_with_types(spark, folder), "station_type", "edge_type",
        ["train_mask", "validation_mask", "test_mask"],
    )


DIMS = ["rain", "temp"]
_FEATURE_SQL = """,
fb as (select gid, variable, time_bucket(interval '1 day', time_sgt) as time_sgt, arg_min(value, time_sgt) as value from obs group by all),
feat as (select gid as node, time_sgt, coalesce(max(value) filter (variable = 'rain_rate'), 0) / 100e0 as rain,
                coalesce(max(value) filter (variable = 'temperature'), 0) / 100e0 as temp from fb group by gid, time_sgt)"""


def daily_features(spark, folder):
    """Rain and temperature per station and day, hundredths, missing as 0."""
    first = temporal.bucket_first(views.observations(spark, folder), ["gid", "variable"], "time_sgt", "value", 1440)

    def pick(name, alias):
        return (F.coalesce(F.max(F.when(F.col("variable") == name, F.col("value"))), F.lit(0.0)) / 100.0).alias(alias)

    return first.groupBy(F.col("gid").alias("node"), F.col("bucket").alias("time_sgt")).agg(
        pick("rain_rate", "rain"), pick("temperature", "temp")
    )


# weights of a small fixed network, one pair of matrices per relation
RELATIONS = {
    "gen_to_gen": {"neighbour": [[0.5, -0.1], [0.2, 0.3]], "own": [[0.1, 0.05], [-0.05, 0.2]], "bias": [0.01, -0.02]},
    "gen_to_rain": {"neighbour": [[0.4, 0.1], [-0.2, 0.1]], "own": [[0.2, 0.0], [0.1, 0.1]], "bias": [0.0, 0.01]},
    "rain_to_gen": {"neighbour": [[0.3, 0.2], [0.1, -0.3]], "own": [[0.1, 0.1], [0.0, 0.2]], "bias": [0.02, 0.0]},
    "rain_to_rain": {"neighbour": [[0.6, -0.2], [0.1, 0.2]], "own": [[0.05, 0.1], [0.2, 0.1]], "bias": [0.0, 0.0]},
}


def _layer_sql(source: str, name: str, mean: bool) -> str:
    fn = "avg" if mean else "sum"
    sums = ", ".join(
        f"coalesce({fn}({d}) filter (edge_type = '{r}'), 0) as {r}_{d}" for r in RELATIONS for d in DIMS
    )
    outputs = []
    for i in range(2):
        terms = []
        for r, m in RELATIONS.items():
            terms.append(f"({m['bias'][i]}e0 " + " ".join(f"+ {w}e0 * coalesce(a.{r}_{d}, 0)" for w, d in zip(m["neighbour"][i], DIMS))
                         + " " + " ".join(f"+ {w}e0 * f.{d}" for w, d in zip(m["own"][i], DIMS)) + ")")
        outputs.append(f"greatest({' + '.join(terms)}, 0) as {DIMS[i]}")
    return f""",
{name}_a as (select time_sgt, dst as node, {sums} from typed join {source} on {source}.node = src group by time_sgt, dst),
{name} as (select f.time_sgt, f.node, {', '.join(outputs)} from {source} f left join {name}_a a on a.time_sgt = f.time_sgt and a.node = f.node)"""


@query("g9_sum_two_layers", views.with_views("obs", "stations") + _TYPED_SQL + _FEATURE_SQL + _layer_sql("feat", "h1", False)
       + _layer_sql("h1", "h2", False) + "select time_sgt, node, round(greatest(0.7e0 * rain - 0.1e0 * temp + 0.05e0, 0), 9) as estimate from h2")
def g9_sum_two_layers(spark, folder):
    """Two layers of relation-wise sums and a readout, with given weights."""
    h = graph.run_layers(daily_features(spark, folder), edges_with_types(spark, folder), DIMS, [RELATIONS, RELATIONS])
    return graph.readout(h, DIMS, [0.7, -0.1], 0.05).withColumn("estimate", rounded(F.col("estimate"), 9))


@query("g9_mean_layer", views.with_views("obs", "stations") + _TYPED_SQL + _FEATURE_SQL + _layer_sql("feat", "h1", True)
       + "select time_sgt, node, round(rain, 9) as rain, round(temp, 9) as temp from h1")
def g9_mean_layer(spark, folder):
    h = graph.run_layers(daily_features(spark, folder), edges_with_types(spark, folder), DIMS, [RELATIONS], how="mean")
    return h.withColumns({d: rounded(F.col(d), 9) for d in DIMS})


@query("g9_normalised_layer", views.with_views("obs", "stations") + KNN_SQL + _FEATURE_SQL + """,
l as (select src, dst from knn union all select gid, gid from stations),
deg as (select dst as node, count(*) as n from l group by dst),
w as (select src, l.dst, 1 / sqrt(a.n * b.n) as weight from l join deg a on a.node = src join deg b on b.node = l.dst)
select time_sgt, dst as node, round(sum(weight * rain), 9) as rain, round(sum(weight * temp), 9) as temp
from w join feat on feat.node = src where (dst, time_sgt) in (select node, time_sgt from feat) group by time_sgt, dst""")
def g9_normalised_layer(spark, folder):
    nodes = views.stations(spark, folder).select(F.col("gid").alias("node"))
    edges = graph.normalised_weights(station_knn(spark, folder), nodes).withColumn("edge_type", F.lit("all"))
    unit = {"all": {"neighbour": [[1, 0], [0, 1]], "own": [[0, 0], [0, 0]]}}
    h = graph.aggregate_neighbours(daily_features(spark, folder), edges, DIMS, unit, act="identity", weight=F.col("weight"))
    return h.withColumns({d: rounded(F.col(d), 9) for d in DIMS})


@query("g9_attention_layer", views.with_views("obs", "stations") + KNN_SQL + _FEATURE_SQL + """,
m as (select f.time_sgt, dst, src, rain, temp from knn join feat f on f.node = src union all select time_sgt, node, node, rain, temp from feat),
r as (select m.*, 0.6e0 * m.rain + 0.2e0 * m.temp + 0.3e0 * t.rain - 0.4e0 * t.temp as raw from m join feat t on t.node = m.dst and t.time_sgt = m.time_sgt),
s as (select *, exp(case when raw >= 0 then raw else raw * 0.2e0 end) as a from r)
select time_sgt, dst as node, round(sum(a * rain) / sum(a), 9) as rain, round(sum(a * temp) / sum(a), 9) as temp from s group by time_sgt, dst""")
def g9_attention_layer(spark, folder):
    h = graph.attend_neighbours(daily_features(spark, folder), station_knn(spark, folder), DIMS, [0.6, 0.2], [0.3, -0.4])
    return h.withColumns({d: rounded(F.col(d), 9) for d in DIMS})


def _roles(spark, folder):
    return station_roles(spark, folder).select(F.col("gid").alias("node"), F.col("ml_role").alias("role"))


@query("g10_masked_examples", views.with_views("obs", "stations") + KNN_SQL + ROLE_SQL + _FEATURE_SQL + """,
reach as (select dst as example, src as node, dist from knn union all select gid, gid, 0e0 from stations),
c as (select time_sgt, node as example, rain as y from feat join roles on gid = node where ml_role = 'train')
select c.time_sgt, c.example, r.node, round(r.dist, 9) as dist,
       case when r.node = c.example or ml_role <> 'train' then 0 else f.rain end as rain,
       case when ml_role <> 'train' then 0 else f.temp end as temp, y
from c join reach r on r.example = c.example join feat f on f.node = r.node and f.time_sgt = c.time_sgt join roles on gid = r.node""")
def g10_masked_examples(spark, folder):
    """One example per day and training station, its neighbourhood as rows."""
    rows = graph.masked_examples(daily_features(spark, folder), station_knn(spark, folder), _roles(spark, folder), DIMS)
    return rows.withColumn("dist", rounded(F.col("dist"), 9))


@query("g11_visible_inputs", views.with_views("obs", "stations") + ROLE_SQL + _FEATURE_SQL + """
select time_sgt, node, ml_role as role, case when ml_role in ('train', 'validation') then rain else 0 end as rain,
       case when ml_role in ('train', 'validation') then temp else 0 end as temp from feat left join roles on gid = node""")
def g11_visible_inputs(spark, folder):
    df = graph.visible_inputs(daily_features(spark, folder), _roles(spark, folder), DIMS, ["train", "validation"])
    return df.select("time_sgt", "node", "role", *DIMS)


_FOLD_SQL = """,
reach as (select dst as example, src as node, dist from knn union all select gid, gid, 0e0 from stations),
x as (select a.fold, f.time_sgt, r.example, r.node <> r.example as other, r.dist, own.rain as y, a.ml_role as role,
             case when b.ml_role = 'train' and r.node <> r.example then f.rain else 0 end as rain
      from reach r join folds a on a.gid = r.example and a.ml_role in ('train', 'validation')
      join folds b on b.gid = r.node and b.fold = a.fold join feat own on own.node = r.example
      join feat f on f.node = r.node and f.time_sgt = own.time_sgt),
t as (select fold, time_sgt, example, any_value(role) as role, max(y) as y, count(*) filter (other)::double as x0, coalesce(avg(rain) filter (other), 0) as x1,
             coalesce(sum(rain / dist) filter (other and dist > 0) / sum(1 / dist) filter (other and dist > 0), 0) as x2 from x group by all),
m as (select fold, avg(y) as my, avg(x0) as m0, avg(x1) as m1, avg(x2) as m2, var_pop(x0) as v0, var_pop(x1) as v1, var_pop(x2) as v2,
             covar_pop(x0, x1) as c01, covar_pop(x0, x2) as c02, covar_pop(x1, x2) as c12,
             covar_pop(x0, y) as r0, covar_pop(x1, y) as r1, covar_pop(x2, y) as r2 from t where role = 'train' group by fold),
n as (select *, case when v0 > 0 then 1.1e0 * v0 else 1 end as a, case when v1 > 0 then 1.1e0 * v1 else 1 end as e, case when v2 > 0 then 1.1e0 * v2 else 1 end as i from m),
k as (select *, a * (e * i - c12 * c12) - c01 * (c01 * i - c12 * c02) + c02 * (c01 * c12 - e * c02) as det from n),
s as (select fold, my, m0, m1, m2,
             (r0 * (e * i - c12 * c12) - c01 * (r1 * i - c12 * r2) + c02 * (r1 * c12 - e * r2)) / det as b0,
             (a * (r1 * i - c12 * r2) - r0 * (c01 * i - c12 * c02) + c02 * (c01 * r2 - r1 * c02)) / det as b1,
             (a * (e * r2 - r1 * c12) - c01 * (c01 * r2 - r1 * c02) + r0 * (c01 * c12 - e * c02)) / det as b2 from k),
p as (select t.fold, time_sgt, y, my + b0 * (x0 - m0) + b1 * (x1 - m1) + b2 * (x2 - m2) as prediction from t join s using (fold) where role = 'validation')"""


def _learned(spark, folder):
    folds = station_folds(spark, folder).select("fold", F.col("gid").alias("node"), F.col("ml_role").alias("role"))
    examples = graph.masked_examples(
        daily_features(spark, folder), station_knn(spark, folder), folds, DIMS, centres=("train", "validation"), by=["fold"]
    )
    table = learner.example_table(examples, keys=["fold", "time_sgt", "example"])
    return learner.fit_folds(table.join(folds.withColumnRenamed("node", "example"), ["fold", "example"]))


@query("g12_baseline_learner")
def g12_baseline_learner(spark, folder):
    """Linear regression on masked examples, scored at validation stations per fold."""
    return metrics.average_rmse(_learned(spark, folder), ["time_sgt"], "y", "prediction", ["fold"])


@query("g12_fold_errors", views.with_views("obs", "stations") + KNN_SQL + FOLD_SQL + _FEATURE_SQL + _FOLD_SQL + """
select fold, count(*) as examples, round(avg((y - prediction) * (y - prediction)), 6) as mse, round(avg(prediction - y), 6) as bias from p group by fold""")
def g12_fold_errors(spark, folder):
    """The fits of all folds in one plan: mean square error and bias at the validation stations of each."""
    error = F.col("prediction") - F.col("y")
    return _learned(spark, folder).groupBy("fold").agg(
        F.count(F.lit(1)).alias("examples"), rounded(F.avg(error * error)).alias("mse"), rounded(F.avg(error)).alias("bias"))


@query("f12_activations", views.with_views("obs") + """,
v as (select gid, time_sgt, variable, (value - 60e0) / 20e0 as x from obs)
select gid, time_sgt, variable, round(greatest(x, 0), 6) as relu, round(case when x >= 0 then x else x * 0.1e0 end, 6) + 0e0 as leaky_relu,
       round(case when x >= 0 then x else exp(x) - 1 end, 6) + 0e0 as elu, round(1 / (1 + exp(-x)), 6) as sigmoid, round(tanh(x), 6) + 0e0 as tanh from v""")
def f12_activations(spark, folder):
    x = (F.col("value") - 60.0) / 20.0
    return views.observations(spark, folder).select(
        "gid", "time_sgt", "variable",
        *[rounded(activation(x, n)).alias(n) for n in ("relu", "leaky_relu", "elu", "sigmoid", "tanh")],
    )
