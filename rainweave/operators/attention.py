"""Message passing over graphs with several kinds of nodes: attention and degree normalisation per relation.

Features are rows (time, kind, node, dims); ids need to be unique within a kind only. Edges are rows (edge_type,
src_kind, src, dst_kind, dst, dist). Weights are given; every layer is joins and plain aggregations, and a target
with very many neighbours is pre-aggregated before the shuffle.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.functions.activation import activation
from rainweave.operators.graph import linear
from rainweave.session import checkpointed

# times of a node that travel as one row of arrays
TIMES_PER_ROW = 16
# messages in one task of an attention layer
MESSAGES_PER_TASK = 1 << 20
# scores whose exponentials are summed together lie within half of this of their anchor
SCORE_SPAN = 32.0


def _by_relation(relations: Mapping[str, Mapping], value: Callable[[Mapping], Column]) -> Column:
    chosen = F.lit(None).cast("double")
    for name, relation in relations.items():
        chosen = F.when(F.col("edge_type") == name, value(relation)).otherwise(chosen)
    return chosen


def _width(relations: Mapping[str, Mapping]) -> int:
    widths = {len(r["source"]) for r in relations.values()}
    if len(widths) != 1:
        raise ValueError("all relations of a layer need outputs of one width")
    return widths.pop()


def _targets(relations: Mapping[str, Mapping]) -> dict[str, list[Mapping]]:
    """Relations by the kind that they lead to."""
    kinds: dict[str, list[Mapping]] = {}
    for relation in relations.values():
        kinds.setdefault(relation["kinds"][1], []).append(relation)
    return kinds


def _activated(summed: DataFrame, relations: Mapping[str, Mapping], time: str, combine: str, act: str) -> DataFrame:
    """Outputs from the sums of the relations (NULL: none had a message): biases, mean over relations, activation."""
    width = _width(relations)
    columns = []
    for i in range(width):
        h = f"h{i}"
        shift, share = F.lit(None).cast("double"), F.lit(None).cast("double")
        for kind, own in _targets(relations).items():
            shift = F.when(F.col("kind") == kind, float(sum(r.get("bias", [0.0] * width)[i] for r in own))).otherwise(shift)
            share = F.when(F.col("kind") == kind, float(len(own) if combine == "mean" else 1)).otherwise(share)
        columns.append(activation((F.coalesce(h, F.lit(0.0)) + shift) / share, act).alias(h))
    return summed.select(time, "kind", "node", *columns)


def _combined(features: DataFrame, received: DataFrame, relations: Mapping[str, Mapping], time: str, combine: str, act: str) -> DataFrame:
    """Sum or mean over the relations that lead to a kind; a relation without a message gives its bias."""
    summed = received.groupBy(time, "kind", "node").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(_width(relations))])
    asked = features.where(F.col("kind").isin(list(_targets(relations)))).select(time, "kind", "node")
    return _activated(asked.join(summed, [time, "kind", "node"], "left"), relations, time, combine, act)


def attention_layer(features: DataFrame, edges: DataFrame, dims: Sequence[str], relations: Mapping[str, Mapping], scoring: str = "joint",
                    combine: str = "mean", act: str = "relu", time: str = "time_sgt", slope: float = 0.2) -> DataFrame:
    """One attention layer: (time, kind, node, h0, h1, ...) for the kinds that some relation leads to.

    A relation has ``kinds`` (source kind, target kind), matrices ``source`` and ``target`` with optional ``source_bias`` and
    ``target_bias``, ``edge`` (one weight per output for the edge distance), and ``bias``. With ``s`` and ``t`` the mapped
    source and target and ``e`` the weighted distance, the score of an edge is ``attention . leaky(s + t + e)`` when
    ``scoring`` is ``joint``, and ``leaky(attend_source . s + attend_target . t + attend_edge . e)`` when it is ``split``.
    Scores are made shares by a softmax per time, target and relation, without self loops; the output is the sum of the shares times
    ``s``, plus the bias; relations are combined by ``mean`` or ``sum``. A message needs features of both ends at the time;
    features have one row per time and node.

    Messages cross the network once: the times of a node travel in rows of arrays, a chunk of times each, and meet the
    same chunk of their target, where everything else is summed. Exponentials are summed per anchor, a multiple of
    ``SCORE_SPAN`` near the score, and the sums of a target are then scaled to its largest anchor, so no score overflows and
    none is needed twice. Tasks follow the number of messages.
    """
    if scoring not in ("joint", "split"):
        raise ValueError("scoring must be 'joint' or 'split'")
    width = _width(relations)
    outputs, values = [f"h{i}" for i in range(width)], [F.col(f"_s_{d}") for d in dims]
    features = checkpointed(features.select(time, "kind", "node", *dims))
    known = checkpointed(edges.where(F.col("edge_type").isin(list(relations))).select("edge_type", "src_kind", "src", "dst_kind", "dst", F.col("dist").cast("double").alias("dist")))
    rows, nodes, times = features.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("kind", "node")), F.approx_count_distinct(time)).first()
    tasks = math.ceil((known.count() * rows / max(nodes, 1) + rows) / MESSAGES_PER_TASK) or 1
    chunk = F.pmod(F.xxhash64(time), F.lit(math.ceil(times / TIMES_PER_ROW) or 1))
    nested = features.withColumn("_chunk", chunk).repartition("kind", "node").groupBy("kind", "node", "_chunk").agg(F.collect_list(F.struct(time, *dims)).alias("_rows"))

    def packed(end: str, prefix: str) -> DataFrame:
        return nested.select(F.col("kind").alias(f"{end}_kind"), F.col("node").alias(end), "_chunk", *[F.col(f"_rows.{c}").alias(f"{prefix}{c}") for c in (time, *dims)])

    place = ["dst_kind", "dst", "_chunk"]
    targets = packed("dst", "_t_").where(F.col("dst_kind").isin(list(_targets(relations))))
    sent = known.join(packed("src", "_all_"), ["src_kind", "src"]).drop("src_kind", "src")
    # a target without messages gets one of no relation, so that it has a row
    sent = sent.unionByName(targets.select(*place), allowMissingColumns=True)
    both = sent.repartition(tasks, *place).join(targets.repartition(tasks, *place), place)
    both = both.select(*place, "edge_type", "dist", *[f"_all_{c}" for c in (time, *dims)], F.explode(F.arrays_zip(*[f"_t_{c}" for c in (time, *dims)])).alias("_row"))
    at = F.array_position(f"_all_{time}", F.col(f"_row._t_{time}")).cast("int") - 1
    both = both.select(
        "_chunk", F.col(f"_row._t_{time}").alias(time), F.col("dst_kind").alias("kind"), F.col("dst").alias("node"), "edge_type", "dist",
        *[F.get(f"_all_{d}", at).alias(f"_s_{d}") for d in dims], *[F.col(f"_row._t_{d}").alias(f"_t_{d}") for d in dims])

    def leaky(x: Column) -> Column:
        return F.when(x >= 0, x).otherwise(x * slope)

    def score(relation: Mapping) -> Column:
        s = linear(values, relation["source"], relation.get("source_bias"))
        t = linear([F.col(f"_t_{d}") for d in dims], relation["target"], relation.get("target_bias"))
        e = [F.col("dist") * F.lit(float(w)) for w in relation.get("edge", [0.0] * width)]
        if scoring == "joint":
            return linear([leaky(a + b + c) for a, b, c in zip(s, t, e)], [relation["attention"]])[0]
        parts = [linear(x, [relation.get(name, [0.0] * width)])[0] for x, name in ((s, "attend_source"), (t, "attend_target"), (e, "attend_edge"))]
        return leaky(parts[0] + parts[1] + parts[2])

    mapped = {h: _by_relation(relations, lambda r, i=i: linear(values, r["source"], r.get("source_bias"))[i]) for i, h in enumerate(outputs)}
    target = ["_chunk", time, "kind", "node"]
    scored = both.select(*target, "edge_type", _by_relation(relations, score).alias("_score"), *[c.alias(h) for h, c in mapped.items()])
    # finite even where a score is minus infinity
    anchor = F.greatest(F.rint(F.col("_score") / SCORE_SPAN) * SCORE_SPAN, F.lit(-sys.float_info.max))
    weight = F.exp(F.col("_score") - F.col("_anchor"))
    sums = scored.withColumn("_anchor", anchor).groupBy(*target, "edge_type", "_anchor").agg(F.sum(weight).alias("_norm"), *[F.sum(weight * F.col(h)).alias(h) for h in outputs])
    scale = F.exp(F.col("_anchor") - F.max("_anchor").over(Window.partitionBy(*target, "edge_type")))
    norm = F.sum(F.col("_scale") * F.col("_norm"))
    norm = F.when(norm == 0, float("nan")).otherwise(norm)
    received = sums.withColumn("_scale", scale).groupBy(*target, "edge_type").agg(*[(F.sum(F.col("_scale") * F.col(h)) / norm).alias(h) for h in outputs])
    return _activated(received.groupBy(*target).agg(*[F.sum(h).alias(h) for h in outputs]), relations, time, combine, act)


def relation_weights(edges: DataFrame, nodes: DataFrame, relations: Mapping[str, Mapping], weight: Column | None = None) -> DataFrame:
    """Edges with ``weight / sqrt(degree of the source * degree of the target)``, per relation.

    Relations within one kind get a self loop of weight 1 at every node of ``nodes`` (kind, node), and degrees are the weights
    that arrive, loops included. Between two kinds, the source's degree is the weight that leaves it and there are no loops. A
    degree of 0 gives a weight of 0.
    """
    given = edges.where(F.col("edge_type").isin(list(relations))).select(
        "edge_type", "src_kind", "src", "dst_kind", "dst", (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"))
    for name, relation in relations.items():
        kind, other = relation["kinds"]
        if kind == other:
            own = nodes.where(F.col("kind") == kind)
            given = given.unionByName(own.select(F.lit(name).alias("edge_type"), *[F.col(c).alias(f"{end}{k}") for end in ("src", "dst") for c, k in (("kind", "_kind"), ("node", ""))], F.lit(1.0).alias("_w")))
    arrives = given.groupBy("edge_type", "dst_kind", "dst").agg(F.sum("_w").alias("_in"))
    within = [name for name, r in relations.items() if r["kinds"][0] == r["kinds"][1]]
    leaves = given.where(~F.col("edge_type").isin(within)).groupBy("edge_type", "src_kind", "src").agg(F.sum("_w").alias("_out"))
    leaves = leaves.unionByName(arrives.where(F.col("edge_type").isin(within)).toDF("edge_type", "src_kind", "src", "_out"))
    weighed = given.join(arrives, ["edge_type", "dst_kind", "dst"]).join(leaves, ["edge_type", "src_kind", "src"], "left")
    product = F.coalesce("_out", F.lit(0.0)) * F.col("_in")
    return weighed.select("edge_type", "src_kind", "src", "dst_kind", "dst", F.when(product > 0, F.col("_w") / F.sqrt(product)).otherwise(0.0).alias("weight"))


def normalised_relation_layer(features: DataFrame, weights: DataFrame, dims: Sequence[str], relations: Mapping[str, Mapping],
                              combine: str = "mean", act: str = "relu", time: str = "time_sgt") -> DataFrame:
    """One layer of weighted sums per relation, ``weights`` from ``relation_weights``; relations have ``kinds``, ``source``, ``bias``."""
    sources = features.select(F.col(time), F.col("kind").alias("src_kind"), F.col("node").alias("src"), *dims)
    sent = weights.join(sources, ["src_kind", "src"])
    sums = sent.groupBy(time, F.col("dst_kind").alias("kind"), F.col("dst").alias("node"), "edge_type").agg(*[F.sum(F.col("weight") * F.col(d)).alias(d) for d in dims])
    mapped = [_by_relation(relations, lambda r, i=i: linear([F.col(d) for d in dims], r["source"])[i]).alias(f"h{i}") for i in range(_width(relations))]
    return _combined(features, sums.select(time, "kind", "node", "edge_type", *mapped), relations, time, combine, act)


def attention_layers(features: DataFrame, edges: DataFrame, dims: Sequence[str], layers: Sequence[Mapping[str, Mapping]], **options) -> DataFrame:
    """Attention layers in a row; features and edges are written between layers, since each layer reads them more than once."""
    edges = checkpointed(edges)
    for relations in layers:
        features = attention_layer(checkpointed(features), edges, dims, relations, **options)
        dims = [c for c in features.columns if c.startswith("h")]
    return features
