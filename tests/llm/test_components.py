"""Components of links against a plain union of sets, with hubs, chains and repeated links."""

import random
import re

import pytest

from rainweave.llm import components


def plain(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("hubs", [2, 1000])
def test_components_with_hubs_and_chains(spark, monkeypatch, hubs):
    monkeypatch.setattr(components, "HUBS", hubs)
    pick = random.Random(hubs)
    links = [(-5, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(7000, i) for i in range(6000, 6200)]
    links += [(pick.randrange(2000, 2200), pick.randrange(2000, 2200)) for _ in range(120)] + [(9, 9), (1, 2), (2, 1), (1, 2)]
    pick.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = [tuple(r) for r in components.components(df).collect()]
    assert len(got) == len(set(got)) and dict(got) == plain(links)
    assert components.components(df.limit(0)).count() == 0


def test_no_row_of_a_hub_is_copied_or_lost(spark):
    rows = [(1, i) for i in range(5000)] + [(i, 0) for i in range(2, 3000)] + [(1, 7), (1, 7)]
    got = [tuple(r) for r in components.with_least(spark.createDataFrame(rows, "v long, u long"), len(rows)).collect()]
    assert sorted(got) == sorted((v, u, 0) for v, u in rows)


def test_hubs_are_dealt_by_both_keys(spark):
    rows = spark.range(100).selectExpr("id % 3 as v", "id as u")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = components.with_least(rows, 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert re.search(r"SortMergeJoin \[v#\d+L, part#\d+\], \[v#\d+L, part#\d+\]", text)
