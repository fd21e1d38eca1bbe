"""Layers over several kinds of nodes against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rainweave.operators import attention

KINDS = {"ab": ("a", "b"), "bb": ("b", "b"), "ca": ("c", "a"), "ac": ("a", "c")}


def relation(rng, name, dims, width):
    def m(n, k):
        return [[rng.uniform(-1, 1) for _ in range(k)] for _ in range(n)]

    v = m(8, width)
    return {"kinds": KINDS[name], "source": m(width, dims), "target": m(width, dims), "source_bias": v[0], "target_bias": v[1], "edge": v[2], "attention": v[3], "bias": v[4],
            "attend_source": v[5], "attend_target": v[6], "attend_edge": v[7]}


def plain(features, edges, relations, joint, mean):
    def leaky(x):
        return x if x >= 0 else 0.2 * x

    def mapped(m, bias, x):
        return [b + sum(w * y for w, y in zip(row, x)) for row, b in zip(m, bias)]

    out = {}
    for (t, kind, node), x in features.items():
        own = {k: r for k, r in relations.items() if r["kinds"][1] == kind}
        if not own:
            continue
        total = [0.0] * 3
        for name, r in own.items():
            found = []
            for e, sk, s, dk, d, dist in edges:
                if e == name and (dk, d) == (kind, node) and (t, sk, s) in features:
                    a, b = mapped(r["source"], r["source_bias"], features[(t, sk, s)]), mapped(r["target"], r["target_bias"], x)
                    c = [w * dist for w in r["edge"]]
                    if joint:
                        score = sum(w * leaky(p + q + z) for w, p, q, z in zip(r["attention"], a, b, c))
                    else:
                        score = leaky(sum(w * p for k, v in (("attend_source", a), ("attend_target", b), ("attend_edge", c)) for w, p in zip(r[k], v)))
                    found.append((math.exp(score), a))
            norm = sum(w for w, _ in found)
            for i in range(3):
                total[i] += r["bias"][i] + (sum(w * a[i] for w, a in found) / norm if found else 0)
        out[(t, kind, node)] = [max(0.0, v / (len(own) if mean else 1)) for v in total]
    return out


def graph(seed):
    rng = random.Random(seed)
    relations = {name: relation(rng, name, 2, 3) for name in KINDS}
    features = {(t, k, n): [rng.uniform(-2, 2) for _ in range(2)] for t in (1, 2) for k in "abcd" for n in range(5) if rng.random() < 0.8}
    edges = [(name, s, i, d, j, rng.random() * 3) for name, (s, d) in KINDS.items() for i in range(5) for j in range(4) if rng.random() < 0.6]
    return relations, features, edges + edges[:3] + [("other", "a", 0, "b", 0, 1.0)]


def tables(spark, features, edges):
    f = spark.createDataFrame([(*k, *v) for k, v in features.items()], "time_sgt int, kind string, node int, x double, y double")
    return f, spark.createDataFrame(edges, "edge_type string, src_kind string, src int, dst_kind string, dst int, dist double")


@pytest.mark.parametrize("joint,mean", [(True, True), (False, False)])
def test_attention_equals_loops(spark, joint, mean):
    relations, features, edges = graph(1)
    f, e = tables(spark, features, edges)
    got = attention.attention_layer(f, e, ["x", "y"], relations, scoring="joint" if joint else "split", combine="mean" if mean else "sum")
    want = plain(features, edges, relations, joint, mean)
    rows = {(r.time_sgt, r.kind, r.node): [r.h0, r.h1, r.h2] for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        attention.attention_layer(f, e, ["x", "y"], relations, scoring="other")


def test_large_scores_do_not_overflow_and_layers_chain(spark):
    relations, features, edges = graph(2)
    first = {k: r | {"attention": [900.0, -700.0, 800.0]} for k, r in relations.items()}
    f, e = tables(spark, features, edges)
    rng = random.Random(3)
    second = {name: relation(rng, name, 3, 3) for name in KINDS}
    rows = attention.attention_layers(f, e, ["x", "y"], [first, second]).collect()
    assert rows and all(math.isfinite(v) for r in rows for v in (r.h0, r.h1, r.h2))
    middle = {(r.time_sgt, r.kind, r.node): [r.h0, r.h1, r.h2] for r in attention.attention_layer(f, e, ["x", "y"], first).collect()}
    want = plain(middle, edges, second, True, True)
    assert {(r.time_sgt, r.kind, r.node): pytest.approx([r.h0, r.h1, r.h2]) for r in rows} == want


def test_normalised_relations_equal_loops(spark):
    relations, features, edges = graph(4)
    f, e = tables(spark, features, edges)
    nodes = f.select("kind", "node").distinct()
    weights = attention.relation_weights(e, nodes, relations, 1 / (1 + F.col("dist")))
    got = {(r.time_sgt, r.kind, r.node): [r.h0, r.h1, r.h2] for r in attention.normalised_relation_layer(f, weights, ["x", "y"], relations).collect()}
    sent = [(name, sk, s, dk, d, 1 / (1 + dist)) for name, sk, s, dk, d, dist in edges if name in relations]
    sent += [("bb", "b", n, "b", n, 1.0) for n in {n for _, k, n in features if k == "b"}]
    into, out = {}, {}
    for name, sk, s, dk, d, w in sent:
        into[(name, d)] = into.get((name, d), 0) + w
        out[(name, s)] = out.get((name, s), 0) + w
    for (t, kind, node), h in got.items():
        own = [k for k, r in relations.items() if r["kinds"][1] == kind]
        total = [0.0] * 3
        for name in own:
            x = [0.0, 0.0]
            for n2, sk, s, dk, d, w in sent:
                if n2 == name and (dk, d) == (kind, node) and (t, sk, s) in features:
                    degree = into[(name, s)] if sk == dk and (name, s) in into else 0 if sk == dk else out[(name, s)]
                    x = [a + (w / math.sqrt(degree * into[(name, d)]) if degree else 0) * v for a, v in zip(x, features[(t, sk, s)])]
            total = [v + b + sum(w * y for w, y in zip(row, x)) for v, b, row in zip(total, relations[name]["bias"], relations[name]["source"])]
        assert h == pytest.approx([max(0.0, v / len(own)) for v in total])
    assert {k for k in got} == {k for k in features if k[1] in "abc"}


@pytest.mark.parametrize("joint", [True, False])
def test_messages_meet_their_two_ends_once(spark, joint):
    relations, features, edges = graph(5)
    f, e = tables(spark, features, edges)
    got = attention.attention_layer(f, e, ["x", "y"], relations, scoring="joint" if joint else "split")
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 2


def test_scores_far_apart_and_many_times(spark):
    """Twenty neighbours with scores some hundreds apart, at more times than one row of arrays holds."""
    r = {"kinds": ("a", "b"), "source": [[1.0]], "target": [[0.0]], "edge": [1.0], "attention": [1.0]}
    times = 3 * attention.TIMES_PER_ROW
    f = spark.createDataFrame([(t, "a", n, 40.0 * n - 400 + t / 7) for t in range(times) for n in range(20) if (t + n) % 3] + [(t, "b", 0, 1.0) for t in range(times)],
                              "time_sgt int, kind string, node int, x double")
    e = spark.createDataFrame([("ab", "a", n, "b", 0, n % 4 * 30.0) for n in range(20)], "edge_type string, src_kind string, src int, dst_kind string, dst int, dist double")
    rows = attention.attention_layer(f, e, ["x"], {"ab": r}, act="identity", slope=1.0).collect()
    assert len(rows) == times
    for row in rows:
        x = {n: 40.0 * n - 400 + row.time_sgt / 7 for n in range(20) if (row.time_sgt + n) % 3}
        top = max(v + n % 4 * 30.0 for n, v in x.items())
        share = {n: math.exp(v + n % 4 * 30.0 - top) for n, v in x.items()}
        assert row.h0 == pytest.approx(sum(share[n] * x[n] for n in x) / sum(share.values()), rel=1e-12)
