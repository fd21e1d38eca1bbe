"""Collocations and centroid clusters against brute force, on small and odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rainweave.llm import centroids, collocations


def plain_collocations(rows, minimum, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            f = counts.setdefault(lang, Counter())
            for k in (1, 2, 3):
                f.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= minimum}
        around = Counter()
        for p, a in candidates.items():
            for part in (p[:2], p[1:]) if len(p) == 3 else ():
                around[part] = max(around[part], a)
        found = []
        for p, a in candidates.items():
            if len(p) == 2 and around[p] and 100 * around[p] >= 50 * a:
                continue
            score, k = min(((10**6 * a * a) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


SCHEMA = "doc_id long, text string, lang string, n long, a string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "a", 2) for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("minimum,top", [(3, 2000), (10, 15)])
def test_collocations_equal_brute_force(spark, minimum, top):
    rng = random.Random(5)
    words = ["a", "b", "A", "é", "radar,", "rain.", "x\ty", "of", "the", "in\x0bto", "\x1c", "W!", "ü;"] + [f"w{i}" for i in range(25)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(300)]
    rows += [("one long passage that all of these share without a stop", "en")] * 20 + [("a b " * 400, "en"), (None, "en"), ("", None), ("  \t ", "de"), (".,;", "fr")]
    got = rows_of(collocations.collocations(frame(spark, rows).repartition(5), minimum, top))
    assert got == plain_collocations(rows, minimum, top)


def test_collocations_of_few_rows(spark):
    assert rows_of(collocations.collocations(frame(spark, [("x", "en")]).limit(0))) == []
    assert rows_of(collocations.collocations(frame(spark, [(None, None), ("too few words", "en")]))) == []
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(long, "en")] * 10
    got = collocations.collocations(frame(spark, rows)).collect()
    assert len(got) == 2000 and {(r.a, r.l, r.r, r.score, r.n) for r in got} == {(10, 10, 10, 10**6, 300_000)}
    assert [r.phrase for r in sorted(got, key=lambda r: r["rank"])] == sorted(" ".join(f"w{j}" for j in range(i, i + 3)) for i in range(29_998))[:2000]


def test_full_filter_keeps_counts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_filter", lambda flows: (20, np.full(1 << 17, 255, dtype=np.uint8)))
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(12)), "en") for _ in range(60)]
    assert rows_of(collocations.collocations(frame(spark, rows), 3)) == plain_collocations(rows, 3, 2000)


def test_unary_paths_are_whole_passages(spark):
    rows = [("u1 u2 u3 u4 u5 u6 u7", "en")] * 12 + [("u3 u4 u9", "en")] * 3
    graph = collocations.word_graph(frame(spark, rows), 3)
    edges = graph.where("c is not null and n >= 3")
    nodes = collocations.flows(graph, "a", "b").selectExpr("*", "f = 12 and a not in ('u1', 'u6') as unary")
    assert sorted((r.n, tuple(r.words)) for r in collocations.unary_paths(edges, nodes).collect()) == [
        (3, ("u3", "u4", "u9")), (12, ("u1", "u2", "u3", "u4")), (12, ("u3", "u4", "u5", "u6", "u7"))]
    f = {(r.a, r.b): r.f for r in collocations.flows(graph, "a", "b").collect()}
    assert f[("u3", "u4")] == 15 and f[("u6", "u7")] == 12


def plain_clusters(rows, dimension, clusters, rounds):
    kept = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    places = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(places))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, own in groups.items():
            places[k] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    own = Counter()
    for _, d, k in found:
        own[k] += d
    def fits(x):  # a sum beyond a BIGINT is NULL
        return x if x < 1 << 63 else None

    return sorted((i, k, fits(d), fits(own[k]), fits(total), hashlib.sha256(",".join(map(str, places[k])).encode()).hexdigest()) for i, d, k in found)


@pytest.mark.parametrize("scale", [0.3, 1e-4, 3e5])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i in range(300)] + [(i, [0.5 * scale] * 6) for i in range(300, 420)]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 7), (504, [None] + [0.0] * 5), (505, [float("nan")] * 6), (506, [float("inf")] * 6), (507, [-0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(4)
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, dimension=6, rounds=4).collect())
    assert got == plain_clusters(rows, 6, 8, 4)


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([(1, [1.0] * 64)], schema).limit(0)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    rows = [(1, [1.0] * 64), (1, [1.0] * 64), (None, [2.0] * 64), (None, [3e38] + [0.0] * 63)]
    got = centroids.cluster(spark.createDataFrame(rows, schema).limit(3)).collect()
    assert len(got) == 3 and {r.distance for r in got} == {0} and {r.inertia for r in got} == {0}


def test_search_measures_fewer_distances():
    rng = np.random.default_rng(0)
    places = (rng.normal(size=(64, 16)) * 40 + np.arange(64)[:, None] * 300).astype(np.int64)
    vectors = places[rng.integers(0, 64, 2000)] + rng.integers(-30, 30, (2000, 16))
    number, best, measured = centroids.nearest_centroids(vectors, places)
    distances = ((vectors[:, None, :] - places[None]) ** 2).sum(axis=2)
    assert (number == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all() and measured < 0.1 * distances.size
