import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainweave.operators import partitioned as pt


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows."""
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(rng.random(n) < 0.3, 0.0, np.round(rng.normal(size=n) * 10 ** rng.integers(-6, 6, n).astype(float), 8))
    return pd.DataFrame({"key": key, "id": np.arange(n), "value": value})


def test_row_position(spark, skewed):
    got = pt.row_position(spark.createDataFrame(skewed), ["key"], F.floor(F.col("id") / 64), ["id"]).toPandas()
    want = skewed.sort_values("id").groupby("key").cumcount()
    assert got.set_index("id")["pos"].sort_index().tolist() == want.sort_index().tolist()


def test_row_position_without_keys(spark, skewed):
    got = pt.row_position(spark.createDataFrame(skewed), [], F.floor(F.col("id") / 100), ["id"]).toPandas()
    assert (got["pos"] == got["id"]).all() and len(got) == len(skewed)


def test_carry_last_and_next_row(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("v", F.when(F.col("id") % 7 == 0, F.col("value")))
    got = pt.carry_last(df, ["key"], F.floor(F.col("id") / 50), "id", F.col("v"), "held").toPandas().sort_values("id")
    base = skewed.assign(v=skewed["value"].where(skewed["id"] % 7 == 0))
    want = base.groupby("key")["v"].ffill()
    assert np.allclose(got["held"].to_numpy(float), want.to_numpy(float), equal_nan=True)
    nxt = pt.next_row(df, ["key"], F.floor(F.col("id") / 50), "id", F.col("id"), "n").toPandas().sort_values("id")
    want = skewed.groupby("key")["id"].shift(-1)
    assert np.allclose(nxt["n"].to_numpy(float), want.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_exact_quantiles(spark, skewed, keys):
    got = pt.exact_quantiles(spark.createDataFrame(skewed), keys, "value", {"a": 0.0, "b": 0.33, "c": 0.5, "d": 1.0}).toPandas()
    for _, row in got.iterrows():
        part = skewed if not keys else skewed[skewed["key"] == row["key"]]
        want = np.percentile(part["value"], [0, 33, 50, 100])
        assert np.allclose([row["a"], row["b"], row["c"], row["d"]], want)


def test_average_ranks(spark, skewed):
    got = pt.average_ranks(spark.createDataFrame(skewed), "value", "r").toPandas().set_index("value")["r"]
    want = skewed["value"].rank()
    assert np.allclose(skewed["value"].map(got), want)


def test_ordered_code_is_strictly_monotone(spark):
    rng = np.random.default_rng(5)
    values = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1e-12, 0.1, 0.1000001, 1.7976931348623157e308, float("inf")]
    values += [2.0**k for k in range(-1040, 1024, 13)] + [float(np.nextafter(2.0**k, d)) for k in range(-1000, 1000, 37) for d in (0, np.inf)]
    values += rng.normal(size=200).tolist() + (300 + np.arange(50) * 1e-13).tolist()
    values = sorted(set(values) | {-v for v in values})
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
           .select("i", pt.ordered_code(F.col("v")).alias("s")).orderBy("i").collect()]
    assert all(a < b for a, b in zip(got, got[1:]))
    assert spark.sql("select -0.0d as v").select(pt.ordered_code(F.col("v"))).first()[0] == 0


def test_quantiles_of_close_values_are_refined(spark, monkeypatch):
    monkeypatch.setattr(pt, "FEW", 40)
    values = 300 + np.random.default_rng(2).random(3000) * 0.04
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(3000) % 2, "v": values})).union(spark.createDataFrame([(0, float("nan")), (1, None), (2, float("nan"))], "k long, v double"))
    got = {r.k: (r.a, r.b) for r in pt.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.913}).collect()}
    assert got == {k: pytest.approx(tuple(np.percentile(values[k::2], [50, 91.3])), abs=1e-12) for k in (0, 1)}
    assert [r.a for r in pt.exact_quantiles(df.limit(0), [], "v", {"a": 0.5}).collect()] == [None]


def test_scans_without_keys_use_many_blocks(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 97 == 3, F.col("id")).alias("v"), F.lit(2).alias("c"))
    assert pt.ranged_blocks(rows, ["id"], 7).select("_block").distinct().count() == 7
    got = pt._sum_before(rows, [], "id", "c", "s").toPandas()
    assert (got["s"] == got["id"] * 2).all()
    for ahead in (False, True):
        got = pt.nearest_known(rows, "id", "v", "near", ahead).toPandas().sort_values("id", ignore_index=True)
        want = got["v"].shift(-1).bfill() if ahead else got["v"].shift(1).ffill()
        assert np.allclose(got["near"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_salted_join_keeps_unmatched_rows(spark, skewed):
    small = spark.createDataFrame([("hot", 1)], "key string, x int")
    got = pt.salted_join(spark.createDataFrame(skewed), small, ["key"], "left").toPandas()
    assert len(got) == len(skewed) and (got["x"].notna() == (got["key"] == "hot")).all()
