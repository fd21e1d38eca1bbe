"""Station and radar graphs as node and edge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.functions.activation import activation
from rainweave.operators.partitioned import row_position, salted_join
from rainweave.operators.spatial import radius_join
from rainweave.session import checkpointed

_SHORT = {"general": "gen", "rainfall": "rain"}


def typed_edges(edges: DataFrame, classes: DataFrame, gid: str = "gid", node_type: str = "station_type") -> DataFrame:
    """Edges with the types of both ends and one of four relation names."""
    src = classes.select(F.col(gid).alias("src"), F.col(node_type).alias("src_type"))
    dst = classes.select(F.col(gid).alias("dst"), F.col(node_type).alias("dst_type"))

    def short(c: str) -> Column:
        name = F.col(c)
        for long, abbreviation in _SHORT.items():
            name = F.when(F.col(c) == long, abbreviation).otherwise(name)
        return name

    return edges.join(src, "src").join(dst, "dst").withColumn(
        "edge_type", F.concat_ws("_to_", short("src_type"), short("dst_type"))
    )


def renumbered_edges(edges: DataFrame, nodes: DataFrame, gid: str = "gid") -> DataFrame:
    """Edges between station ids as edges between node numbers."""
    src = nodes.select(F.col(gid).alias("src"), F.col("node").alias("_s"))
    dst = nodes.select(F.col(gid).alias("dst"), F.col("node").alias("_d"))
    joined = edges.join(src, "src").join(dst, "dst").drop("src", "dst")
    return joined.withColumnsRenamed({"_s": "src", "_d": "dst"})


def radar_station_edges(cells: DataFrame, stations: DataFrame, radius_km: float, cell_id: str = "cell_id",
                        gid: str = "gid", unit: str = "km") -> DataFrame:
    """Radius edges in both directions; no pair in reach gives an empty table of the same columns."""
    forward = radius_join(cells, stations, radius_km, cell_id, gid, unit=unit).withColumn("edge_type", F.lit("radar_to_station"))
    back = forward.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", F.lit("station_to_radar").alias("edge_type")
    )
    return forward.unionByName(back)


def radar_masks(cells: DataFrame) -> DataFrame:
    """Radar nodes belong to every split."""
    return cells.withColumns({m: F.lit(True) for m in ("train_mask", "validation_mask", "test_mask")})


def with_masks(nodes: DataFrame, roles: DataFrame, gid: str = "gid", role: str = "ml_role", explicit_test: bool = False) -> DataFrame:
    """Boolean masks per node. Test is what is neither train nor validation, or only listed test nodes."""
    joined = nodes.join(roles.select(gid, F.col(role).alias("_role")), gid, "left")
    train = F.coalesce(F.col("_role") == "train", F.lit(False))
    validation = F.coalesce(F.col("_role") == "validation", F.lit(False))
    test = F.coalesce(F.col("_role") == "test", F.lit(False)) if explicit_test else ~(train | validation)
    return joined.withColumns({"train_mask": train, "validation_mask": validation, "test_mask": test}).drop("_role")


def induced_subgraph(nodes: DataFrame, edges: DataFrame, keep: Column, coarse: Column, node: str = "node") -> tuple[DataFrame, DataFrame]:
    """Nodes that satisfy ``keep`` with new numbers, and the edges between them.

    The old number stays as ``orig_id``. ``coarse`` must be non-decreasing in the node number.
    """
    kept = row_position(nodes.where(keep).withColumnRenamed(node, "orig_id"), [], coarse, ["orig_id"], node)
    src = kept.select(F.col("orig_id").alias("src"), F.col(node).alias("_s"))
    dst = kept.select(F.col("orig_id").alias("dst"), F.col(node).alias("_d"))
    inner = edges.join(src, "src").join(dst, "dst").drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"})
    return kept, inner


def split_graphs(nodes: DataFrame, edges: DataFrame, coarse: Column) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Train graph (train), validation graph (train and validation), full graph."""
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    train, seen = F.col("train_mask"), F.col("train_mask") | F.col("validation_mask")
    return {
        "train": induced_subgraph(nodes, edges, train, coarse),
        "validation": induced_subgraph(nodes, edges, seen, coarse),
        "full": (nodes.withColumn("orig_id", F.col("node")), edges),
    }


def subgraph_checks(full: DataFrame, sub_nodes: DataFrame, sub_edges: DataFrame, keep: Column) -> DataFrame:
    """One row: node counts on both sides, nodes on one side only, undirected edge count."""
    expected = full.where(keep).select(F.col("node").alias("orig_id"), F.lit(1).alias("_e"))
    both = expected.join(sub_nodes.select("orig_id", F.lit(1).alias("_s")), "orig_id", "full")
    undirected = sub_edges.select(F.least("src", "dst"), F.greatest("src", "dst")).distinct().agg(F.count(F.lit(1)))
    return both.agg(
        F.count("_e").alias("expected_nodes"), F.count("_s").alias("found_nodes"),
        F.count_if(F.col("_e").isNull() | F.col("_s").isNull()).alias("one_sided"),
    ).withColumn("undirected_edges", undirected.scalar())


def structure_report(nodes: DataFrame, edges: DataFrame, node_type: str, edge_type: str, masks: Sequence[str] = ()) -> DataFrame:
    """Counts per node type with mask sums, and counts per edge type, as rows (kind, name, n, masks)."""
    per_node = nodes.groupBy(F.lit("node").alias("kind"), F.col(node_type).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(m)).alias(m) for m in masks]
    )
    per_edge = edges.groupBy(F.lit("edge").alias("kind"), F.col(edge_type).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), *[F.lit(None).cast("long").alias(m) for m in masks]
    )
    return per_node.unionByName(per_edge)


def isolated_nodes(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    touched = edges.select(F.col("src").alias(node)).union(edges.select(F.col("dst").alias(node))).distinct()
    return nodes.join(touched, node, "left_anti")


def edge_checks(edges: DataFrame) -> DataFrame:
    """One row: edges, self loops, edges without their reverse, and whether the graph is undirected."""
    pairs = edges.select("src", "dst").distinct()
    reverse = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = pairs.join(reverse, ["src", "dst"], "left_anti").agg(F.count(F.lit(1))).scalar()
    return edges.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops")
    ).withColumn("one_way", one_way).withColumn("is_undirected", F.col("one_way") == 0)


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Component of every node, named by its smallest node id, directions ignored.

    Alternates two rewrites of the edge list (Kiveris et al. 2014): neighbours above a node are
    hung on the smallest node around it, then neighbours below. Trees flatten in a logarithmic
    number of rounds even for long chains. Minima are aggregated before the shuffle and joined
    back salted, so a hub is no single task.
    """
    links = checkpointed(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    )

    def fingerprint(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = fingerprint(links)
    while True:
        around = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = salted_join(around.where("v > u"), smallest, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points from the larger to the smaller end
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = salted_join(large, lowest, ["u"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v"))
        )
        links = checkpointed(
            small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        after = fingerprint(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("u").alias(node), F.col("v").alias("component"))
    return nodes.select(node).join(roots, node, "left").select(node, F.coalesce("component", node).alias("component"))


# ---- neighbourhood aggregation -------------------------------------------------------------


def normalised_weights(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with self loops and weight 1/sqrt(deg(src) deg(dst)), degrees counted with the loops."""
    loops = nodes.select(F.col(node).alias("src"), F.col(node).alias("dst"))
    looped = edges.select("src", "dst").unionByName(loops)
    degree = looped.groupBy("dst").agg(F.count(F.lit(1)).alias("_deg"))
    src = degree.select(F.col("dst").alias("src"), F.col("_deg").alias("_ds"))
    weighted = salted_join(salted_join(looped, degree, ["dst"]), src, ["src"])
    return weighted.select("src", "dst", (F.lit(1.0) / F.sqrt(F.col("_deg") * F.col("_ds"))).alias("weight"))


def linear(columns: Sequence[Column], weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> list[Column]:
    """Small matrix times columns, one output per row of weights."""
    outputs = []
    for i, row in enumerate(weights):
        total = F.lit(float(bias[i]) if bias else 0.0)
        for w, c in zip(row, columns):
            total = total + F.lit(float(w)) * c
        outputs.append(total)
    return outputs


def aggregate_neighbours(features: DataFrame, edges: DataFrame, dims: Sequence[str], relations: Mapping[str, Mapping],
                         time: str = "time_sgt", node: str = "node", how: str = "sum", combine: str = "sum",
                         act: str = "relu", weight: Column | None = None) -> DataFrame:
    """One message-passing layer: features (time, node, dims) to features of the same columns.

    ``relations`` maps edge types to ``neighbour`` and ``own`` matrices and a ``bias``; their
    outputs are combined by sum or mean. ``how`` reduces neighbours by sum or mean; ``weight``
    scales messages (an edge column such as inverse distance). One join and one aggregation.
    """
    w = weight if weight is not None else F.lit(1.0)
    sent = edges.select("src", "dst", "edge_type", w.alias("_w")).join(
        features.select(F.col(time), F.col(node).alias("src"), *dims), "src"
    )
    sums = []
    for r, relation in enumerate(relations):
        mine = F.col("edge_type") == relation
        for d in dims:
            sums.append(F.sum(F.when(mine, F.col("_w") * F.col(d))).alias(f"_{r}_{d}"))
        sums.append(F.count_if(mine).alias(f"_{r}_n"))
    received = sent.groupBy(time, F.col("dst").alias(node)).agg(*sums)
    joined = features.join(received, [time, node], "left")
    outputs = None
    for r, matrices in enumerate(relations.values()):
        gathered = [F.coalesce(F.col(f"_{r}_{d}"), F.lit(0.0)) for d in dims]
        if how == "mean":
            gathered = [F.coalesce(g / F.nullif(F.col(f"_{r}_n"), F.lit(0)), F.lit(0.0)) for g in gathered]
        part = [
            a + b for a, b in zip(
                linear(gathered, matrices["neighbour"], matrices.get("bias")),
                linear([F.col(d) for d in dims], matrices["own"]),
            )
        ]
        outputs = part if outputs is None else [a + b for a, b in zip(outputs, part)]
    if combine == "mean":
        outputs = [o / F.lit(float(len(relations))) for o in outputs]
    return joined.select(time, node, *[activation(o, act).alias(d) for o, d in zip(outputs, dims)])


def run_layers(features: DataFrame, edges: DataFrame, dims: Sequence[str], layers: Sequence[Mapping[str, Mapping]],
               **options) -> DataFrame:
    """Layers in a row. Features are written between layers: each layer reads its input twice,
    so a deep network would otherwise double its plan with every layer."""
    edges = checkpointed(edges)
    for relations in layers:
        features = aggregate_neighbours(checkpointed(features), edges, dims, relations, **options)
    return features


def readout(features: DataFrame, dims: Sequence[str], weights: Sequence[float], bias: float = 0.0,
            time: str = "time_sgt", node: str = "node", act: str = "relu") -> DataFrame:
    value = linear([F.col(d) for d in dims], [weights], [bias])[0]
    return features.select(time, node, activation(value, act).alias("estimate"))


def attend_neighbours(features: DataFrame, edges: DataFrame, dims: Sequence[str], source_weights: Sequence[float],
                      target_weights: Sequence[float], time: str = "time_sgt", node: str = "node",
                      slope: float = 0.2) -> DataFrame:
    """Attention layer: neighbours and the node itself, weighted by a softmax of their scores.

    score = leaky relu of (source_weights . x_src + target_weights . x_dst). The largest score of
    a target is subtracted first; minima and sums are plain aggregations, so hubs are no single task.
    """
    loops = features.select(F.col(time), F.col(node).alias("dst"), F.col(node).alias("src"), *dims)
    arrived = edges.select("src", "dst").join(features.select(F.col(time), F.col(node).alias("src"), *dims), "src")
    messages = arrived.unionByName(loops)
    mine = features.select(time, F.col(node).alias("dst"), linear([F.col(d) for d in dims], [target_weights])[0].alias("_t"))
    raw = linear([F.col(d) for d in dims], [source_weights])[0] + F.col("_t")
    scored = messages.join(mine, [time, "dst"]).withColumn("_score", F.when(raw >= 0, raw).otherwise(raw * slope))
    top = scored.groupBy(time, "dst").agg(F.max("_score").alias("_top"))
    share = F.exp(F.col("_score") - F.col("_top"))
    return scored.join(top, [time, "dst"]).groupBy(time, F.col("dst").alias(node)).agg(
        *[(F.sum(share * F.col(d)) / F.sum(share)).alias(d) for d in dims]
    )


# ---- masked examples -----------------------------------------------------------------------


def masked_examples(features: DataFrame, edges: DataFrame, roles: DataFrame, dims: Sequence[str], time: str = "time_sgt",
                    node: str = "node", target: str = "rain", fill: str = "zero", seed: int = 123,
                    scope: str = "target", centres: Sequence[str] = ("train",), by: Sequence[str] = ()) -> DataFrame:
    """Leave-one-station-out examples: one per (time, station with a centre role), as rows per neighbour.

    Each example has the rows of the neighbours of its station and of the station itself.
    Stations outside training are 0 in all features; the station's own ``target`` feature
    (``scope='row'``: all its features) is 0 or standard normal noise; ``y`` is its true value.
    Only the neighbourhood is emitted, since other stations do not reach the station in one layer.
    ``by`` names columns of ``roles``, such as a fold, that repeat the examples.
    """
    by = list(by)
    marked = roles.select(*by, node, (F.col("role") == "train").alias("_train"), F.col("role").isin(list(centres)).alias("_centre"))
    known = features.join(marked, node)
    chosen = known.where("_centre").select(*by, F.col(time), F.col(node).alias("example"), F.col(target).alias("y"))
    reach = edges.select(F.col("dst").alias("example"), F.col("src").alias(node), "dist").unionByName(
        roles.select(F.col(node).alias("example"), F.col(node), F.lit(0.0).alias("dist")).distinct()
    )
    rows = chosen.join(reach, "example").join(known, [*by, time, node])
    own = F.col(node) == F.col("example")
    blank = F.lit(0.0) if fill == "zero" else F.randn(seed)
    masked = []
    for d in dims:
        value = F.when(F.col("_train"), F.col(d)).otherwise(F.lit(0.0))
        if d == target or scope == "row":
            value = F.when(own, blank).otherwise(value)
        masked.append(value.alias(d))
    return rows.select(*by, time, "example", node, "dist", *masked, "y")


def visible_inputs(features: DataFrame, roles: DataFrame, dims: Sequence[str], visible: Sequence[str] = ("train",),
                   node: str = "node") -> DataFrame:
    """Inputs of the stations with a visible role, 0 for all others."""
    seen = F.coalesce(F.col("role").isin(list(visible)), F.lit(False))
    joined = features.join(roles.select(node, "role"), node, "left")
    return joined.withColumns({d: F.when(seen, F.col(d)).otherwise(F.lit(0.0)) for d in dims})
