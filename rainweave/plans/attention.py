"""Queries over a graph of general stations, rain stations and radar cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweave.operators import attention, graph
from rainweave.plans.common import rounded
from rainweave.plans.graph import _FEATURE_SQL, _RADAR_EDGE_SQL, _TYPED_SQL, DIMS, daily_features, edges_with_types
from rainweave.plans.registry import query
from rainweave.plans.spatial import CELL_SQL, radar_grid
from rainweave.plans.stations import station_classes
from rainweave.sources import views

REACH_KM = 3.0
KINDS = {"gen": "general", "rain": "rainfall", "radar": "radar"}


def _relation(name: str, k: int) -> dict:
    """Weights of a small fixed network, different for every relation."""
    source, target = (KINDS[x] for x in name.split("_to_"))
    step = 0.05 * k
    return {
        "kinds": (source, target), "source": [[0.5 - step, 0.2], [-0.1, 0.3 + step]], "source_bias": [0.02, -0.01 * k],
        "target": [[0.1, 0.4 - step], [0.25, -0.2]], "target_bias": [0.01 * k, 0.03], "edge": [0.05 + step, -0.02],
        "attention": [0.7, -0.4 + step], "attend_source": [0.6, 0.2 - step], "attend_target": [0.3, -0.4], "attend_edge": [0.5, step], "bias": [0.01, -0.02 + step],
    }


STATION_RELATIONS = {name: _relation(name, k) for k, name in enumerate(["gen_to_gen", "gen_to_rain", "rain_to_gen", "rain_to_rain"])}
ALL_RELATIONS = STATION_RELATIONS | {name: _relation(name, k + 4) for k, name in enumerate(["radar_to_gen", "radar_to_rain", "gen_to_radar", "rain_to_radar"])}


def mixed_features(spark, folder):
    """Daily features of stations and radar cells; a cell has the mean and the largest value of its day."""
    stations = daily_features(spark, folder).join(station_classes(spark, folder).select(F.col("gid").alias("node"), F.col("station_type").alias("kind")), "node")
    cells = views.radar_cells(spark, folder).groupBy(F.date_trunc("day", "time_sgt").cast("timestamp_ntz").alias("time_sgt"), (F.col("row") * 8 + F.col("col")).cast("long").alias("node")).agg(
        F.avg("value").alias("rain"), F.max("value").alias("temp")).withColumn("kind", F.lit("radar"))
    columns = ["time_sgt", "kind", "node", *DIMS]
    return stations.select(*columns).unionByName(cells.select(*columns))


def mixed_edges(spark, folder):
    between = edges_with_types(spark, folder).select("edge_type", F.col("src_type").alias("src_kind"), "src", F.col("dst_type").alias("dst_kind"), "dst", "dist")
    reach = graph.radar_station_edges(radar_grid(spark), views.stations(spark, folder), REACH_KM).where("edge_type = 'radar_to_station'")
    reach = reach.join(station_classes(spark, folder).select(F.col("gid").alias("dst"), "station_type"), "dst")
    short = F.when(F.col("station_type") == "general", "gen").otherwise("rain")
    to_station = reach.select(F.concat(F.lit("radar_to_"), short).alias("edge_type"), F.lit("radar").alias("src_kind"), "src", F.col("station_type").alias("dst_kind"), "dst", "dist")
    to_radar = reach.select(F.concat(short, F.lit("_to_radar")).alias("edge_type"), F.col("station_type").alias("src_kind"), F.col("dst").alias("src"), F.lit("radar").alias("dst_kind"), F.col("src").alias("dst"), "dist")
    return between.unionByName(to_station).unionByName(to_radar)


_MIXED_SQL = views.with_views("obs", "stations", "radar_cell") + _TYPED_SQL + _FEATURE_SQL + CELL_SQL + _RADAR_EDGE_SQL + f""",
f as (select time_sgt, station_type as kind, node, rain, temp from feat join classes on gid = node
      union all select date_trunc('day', time_sgt)::timestamp, 'radar', row * 8 + col, avg(value), max(value) from radar_cell group by 1, 3),
reach as (select cell_id, near.gid, km, station_type, case station_type when 'general' then 'gen' else 'rain' end as short
          from near join classes on classes.gid = near.gid where km <= {REACH_KM}e0),
e as (select edge_type, src_type as src_kind, src, dst_type as dst_kind, dst, dist from typed
      union all select 'radar_to_' || short, 'radar', cell_id, station_type, gid, km from reach
      union all select short || '_to_radar', station_type, gid, 'radar', cell_id, km from reach)"""


def _sum(terms):
    return "(" + " + ".join(f"({w})::double * {c}" for w, c in terms) + ")"


def _case(relations, value) -> str:
    return "case edge_type " + " ".join(f"when '{name}' then {value(r)}" for name, r in relations.items()) + " end"


def _mapped(r, which, alias, i):
    return f"({r[which + '_bias'][i]} + {_sum(zip(r[which][i], (f'{alias}.rain', f'{alias}.temp')))})"


def _attention_sql(relations, joint: bool) -> str:
    def leaky(x):
        return f"(case when {x} >= 0 then {x} else 0.2e0 * {x} end)"

    def score(r):
        s, t = ([_mapped(r, which, alias, i) for i in range(2)] for which, alias in (("source", "a"), ("target", "b")))
        d = [f"({r['edge'][i]} * dist)" for i in range(2)]
        if joint:
            return _sum((r["attention"][i], leaky(f"({s[i]} + {t[i]} + {d[i]})")) for i in range(2))
        return leaky("(" + " + ".join(_sum(zip(r[name], own)) for name, own in (("attend_source", s), ("attend_target", t), ("attend_edge", d))) + ")")

    names = ", ".join(f"'{n}'" for n in relations)
    return f""",
m as (select b.time_sgt, edge_type, dst_kind, dst, exp({_case(relations, score)}) as w,
             {_case(relations, lambda r: _mapped(r, 'source', 'a', 0))} as s0, {_case(relations, lambda r: _mapped(r, 'source', 'a', 1))} as s1
      from e join f a on a.kind = src_kind and a.node = src join f b on b.kind = dst_kind and b.node = dst and b.time_sgt = a.time_sgt where edge_type in ({names})),
g as (select time_sgt, edge_type, dst_kind, dst, sum(w * s0) / sum(w) as h0, sum(w * s1) / sum(w) as h1 from m group by all)"""


def _combined_sql(relations) -> str:
    kinds: dict[str, list] = {}
    for r in relations.values():
        kinds.setdefault(r["kinds"][1], []).append(r)
    rows = ", ".join(f"('{k}', {sum(r['bias'][0] for r in own)}::double, {sum(r['bias'][1] for r in own)}::double, {len(own)}::double)" for k, own in kinds.items())
    return f""",
k(kind, b0, b1, n) as (values {rows})
select f.time_sgt, f.kind, f.node, round(greatest((coalesce(sum(h0), 0) + any_value(b0)) / any_value(n), 0), 9) as h0,
       round(greatest((coalesce(sum(h1), 0) + any_value(b1)) / any_value(n), 0), 9) as h1
from f join k on k.kind = f.kind left join g on g.time_sgt = f.time_sgt and g.dst_kind = f.kind and g.dst = f.node group by f.time_sgt, f.kind, f.node"""


def _shown(df):
    return df.withColumns({h: rounded(F.col(h), 9) for h in ("h0", "h1")})


@query("g9_gatv2_layer", _MIXED_SQL + _attention_sql(ALL_RELATIONS, True) + _combined_sql(ALL_RELATIONS))
def g9_gatv2_layer(spark, folder):
    """Attention with the distance in the score, eight relations, radar cells as a third kind, mean over relations."""
    return _shown(attention.attention_layer(mixed_features(spark, folder), mixed_edges(spark, folder), DIMS, ALL_RELATIONS))


@query("g9_relation_attention", _MIXED_SQL + _attention_sql(STATION_RELATIONS, False) + _combined_sql(STATION_RELATIONS))
def g9_relation_attention(spark, folder):
    """Attention with separate source and target scores, a softmax per station relation."""
    return _shown(attention.attention_layer(mixed_features(spark, folder), mixed_edges(spark, folder), DIMS, STATION_RELATIONS, scoring="split"))


@query("g9_relation_normalised", _MIXED_SQL + """,
w as (select edge_type, src_kind, src, dst_kind, dst, 1 / (1 + dist) as w from e where edge_type in ('gen_to_gen', 'gen_to_rain', 'rain_to_gen', 'rain_to_rain')
      union all select case kind when 'general' then 'gen_to_gen' else 'rain_to_rain' end, kind, node, kind, node, 1 from (select distinct kind, node from f where kind <> 'radar')),
i as (select edge_type, dst, sum(w) as d from w group by all),
o as (select edge_type, src, sum(w) as d from w where src_kind <> dst_kind group by all union all select i.* from i where edge_type in ('gen_to_gen', 'rain_to_rain')),
q as (select time_sgt, w.edge_type, dst_kind, w.dst, sum(w / sqrt(i.d * o.d) * rain) as rain, sum(w / sqrt(i.d * o.d) * temp) as temp
      from w join i on i.edge_type = w.edge_type and i.dst = w.dst join o on o.edge_type = w.edge_type and o.src = w.src
      join f on f.kind = src_kind and f.node = w.src group by all),
g as (select time_sgt, edge_type, dst_kind, dst, """ + ", ".join(f"{_case(STATION_RELATIONS, lambda r, i=i: _sum(zip(r['source'][i], ('rain', 'temp'))))} as h{i}" for i in range(2)) + " from q)" + _combined_sql(STATION_RELATIONS))
def g9_relation_normalised(spark, folder):
    """Degree-normalised sums per relation, self loops within a kind only, edges weighted by nearness."""
    features = mixed_features(spark, folder)
    nodes = features.where("kind != 'radar'").select("kind", "node").distinct()
    weights = attention.relation_weights(mixed_edges(spark, folder), nodes, STATION_RELATIONS, 1 / (1 + F.col("dist")))
    return _shown(attention.normalised_relation_layer(features, weights, DIMS, STATION_RELATIONS))
