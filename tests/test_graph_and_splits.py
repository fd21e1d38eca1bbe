import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainweave.operators import graph, sampling


def union_find(n, edges):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "hand", "empty"])
def test_components(spark, kind):
    rng = np.random.default_rng(2)
    n, edges = {
        "chain": (200, [(i, i + 1) for i in range(150)]),
        "star": (120, [(60, i) for i in range(100)]),
        "random": (300, [tuple(map(int, e)) for e in rng.integers(0, 300, (180, 2))]),
        "hand": (6, [(0, 1), (1, 0), (2, 3), (3, 4), (4, 4)]),
        "empty": (4, []),
    }[kind]
    order = rng.permutation(n)
    edges = [(int(order[a]), int(order[b])) for a, b in edges]
    got = graph.connected_components(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == union_find(n, edges)


@pytest.fixture(scope="module")
def hand(spark):
    nodes = spark.createDataFrame([(i, "general" if i < 3 else "rainfall") for i in range(6)], "node long, station_type string")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0), (3, 4, 1.0), (2, 2, 0.0)], "src long, dst long, dist double")
    return nodes, edges


def test_edge_checks_and_isolated(spark, hand):
    nodes, edges = hand
    row = graph.edge_checks(edges).collect()[0]
    assert (row.edges, row.self_loops, row.one_way, row.is_undirected) == (5, 1, 2, False)
    assert [r.node for r in graph.isolated_nodes(nodes, edges).collect()] == [5]


def test_subgraph(spark, hand):
    nodes, edges = hand
    kept, inner = graph.induced_subgraph(nodes, edges, F.col("node").isin(1, 2, 4), F.floor(F.col("orig_id") / 2))
    assert {(r.orig_id, r.node) for r in kept.collect()} == {(1, 0), (2, 1), (4, 2)}
    assert {(r.src, r.dst) for r in inner.collect()} == {(0, 1), (1, 1)}
    check = graph.subgraph_checks(nodes, kept, inner, F.col("node").isin(1, 2, 4)).collect()[0]
    assert (check.expected_nodes, check.found_nodes, check.one_sided) == (3, 3, 0)


def test_masks(spark, hand):
    nodes, _ = hand
    roles = spark.createDataFrame([(0, "train"), (1, "validation"), (2, "test")], "node long, ml_role string")
    rest = graph.with_masks(nodes, roles, gid="node").where("test_mask").count()
    listed = graph.with_masks(nodes, roles, gid="node", explicit_test=True).where("test_mask").count()
    assert (rest, listed) == (4, 1)


def test_masked_examples_hide_the_answer(spark):
    features = spark.createDataFrame([("t", i, float(i + 1), 9.0) for i in range(4)], "time_sgt string, node long, rain double, temp double")
    edges = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.2), (0, 1, 0.1)], "src long, dst long, dist double")
    roles = spark.createDataFrame([(0, "train"), (1, "train"), (2, "test"), (3, "validation")], "node long, role string")
    got = {(r.example, r.node): (r.rain, r.temp, r.y) for r in graph.masked_examples(features, edges, roles, ["rain", "temp"]).collect()}
    assert got == {
        (0, 0): (0.0, 9.0, 1.0), (0, 1): (2.0, 9.0, 1.0), (0, 2): (0.0, 0.0, 1.0), (1, 1): (0.0, 9.0, 2.0), (1, 0): (1.0, 9.0, 2.0),
    }
    row = graph.masked_examples(features, edges, roles, ["rain", "temp"], scope="row").where("example = node").first()
    assert (row.rain, row.temp) == (0.0, 0.0)
    noisy = graph.masked_examples(features, edges, roles, ["rain", "temp"], fill="noise").where("example = node").collect()
    assert all(r.rain != r.y for r in noisy)


def test_aggregation_by_hand(spark):
    features = spark.createDataFrame([("t", 0, 1.0, 2.0), ("t", 1, 3.0, -1.0), ("t", 2, 5.0, 0.0)], "time_sgt string, node long, a double, b double")
    edges = spark.createDataFrame([(1, 0, "e"), (2, 0, "e"), (0, 1, "e")], "src long, dst long, edge_type string")
    unit = {"e": {"neighbour": [[1, 0], [0, 1]], "own": [[0, 0], [0, 0]]}}
    for how, want in (("sum", {0: (8.0, 0.0), 1: (1.0, 2.0), 2: (0.0, 0.0)}), ("mean", {0: (4.0, 0.0), 1: (1.0, 2.0), 2: (0.0, 0.0)})):
        got = graph.aggregate_neighbours(features, edges, ["a", "b"], unit, how=how)
        assert {r.node: (r.a, r.b) for r in got.collect()} == want


@pytest.fixture(scope="module")
def clustered(spark):
    sizes = {0: 1, 1: 2, 2: 3, 3: 10, 4: 400}
    rows = [(c * 1000 + i, c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "gid long, cluster int"), sizes


def test_split_sizes(clustered):
    df, sizes = clustered
    got = sampling.stratified_split(df, 10, 20).toPandas()
    assert len(got) == sum(sizes.values())
    for c, n in sizes.items():
        part = got[got["cluster"] == c]
        n_test = max(1, int(n * 10 / 100)) if n > 2 else 0
        m = n - n_test
        n_val = max(1, int(m * (20 / 90 * 100) / 100)) if m > 1 else 0
        assert (part["statistical_role"] == "test").sum() == n_test
        assert (part["ml_role"] == "test").sum() == n_test
        assert (part["ml_role"] == "validation").sum() == n_val
    again = sampling.stratified_split(df, 10, 20).toPandas()
    assert again.sort_values("gid", ignore_index=True).equals(got.sort_values("gid", ignore_index=True))


def test_split_rejects_percentages(clustered):
    with pytest.raises(ValueError):
        sampling.stratified_split(clustered[0], 60, 40)


def test_folds(clustered):
    df, sizes = clustered
    got = sampling.stratified_folds(df, 5, 20).toPandas()
    assert len(got) == 5 * sum(sizes.values())
    tests = got[got["statistical_role"] == "test"]
    assert tests["gid"].is_unique
    for c, n in sizes.items():
        assert (tests["cluster"] == c).sum() == min(n, 5)
        for f in range(5):
            pool = got[(got["fold"] == f) & (got["cluster"] == c) & (got["statistical_role"] == "train")]
            want = max(1, int(len(pool) * 20 / 100)) if len(pool) > 1 else 0
            assert (pool["ml_role"] == "validation").sum() == want
    check = sampling.fold_checks(sampling.stratified_folds(df, 5, 20)).collect()[0]
    assert check.overlapping == 0 and check.test_rows == check.test_stations == len(tests)
    assert {r.cluster for r in sampling.small_clusters(df, 5).collect()} == {0, 1, 2}


def test_random_split(spark):
    stations = spark.range(1000).withColumnRenamed("id", "gid")
    got = sampling.random_split(stations).toPandas()
    assert (got["role"] == "train").sum() == 700 and got["gid"].is_unique
    other = sampling.random_split(stations, seed=5).toPandas()
    assert not got.sort_values("gid")["role"].reset_index(drop=True).equals(other.sort_values("gid")["role"].reset_index(drop=True))


def test_clusters(spark):
    rng = np.random.default_rng(0)
    centres = [(103.65, 1.2), (103.8, 1.45), (104.0, 1.3)]
    rows = [(i * 10 + c, float(x + rng.normal(0, 0.003)), float(y + rng.normal(0, 0.003))) for c, (x, y) in enumerate(centres) for i in range(30)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["gid", "longitude", "latitude"]))
    got = sampling.spatial_clusters(df, 3, tries=3).toPandas()
    assert (got["gid"] % 10 == got["cluster"]).all()


def test_sums_of_starts_are_made_in_the_tasks():
    import numpy as np
    import pandas as pd

    batches = [pd.DataFrame({"_x": [0, 4, 10], "_y": [0, 0, 0]}), pd.DataFrame({"_x": [5, 11], "_y": [0, 0]})]
    starts = [(3, np.array([(0.0, 0.0), (10.0, 0.0), (99.0, 99.0)])), (7, np.array([(5.0, 0.0)]))]
    (three, seven) = (part.to_numpy().tolist() for part in sampling._sums_of_starts(iter(batches), starts))
    # 5 is equally near to both: the smaller number; a centroid without stations has no row
    assert three == [[3, 0, 3, 9, 0, 41], [3, 1, 2, 21, 0, 1]]
    assert seven == [[7, 0, 5, 30, 0, 25 + 1 + 25 + 36]]
