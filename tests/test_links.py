import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainweave.operators import links as ops


def loop_constant(trsl, wet, n):
    base = np.zeros(len(trsl))
    base[:n] = trsl[:n]
    for i in range(n, len(trsl)):
        if wet[i] and not wet[i - 1]:
            base[i] = base[i - n:i].mean()
        elif wet[i]:
            base[i] = base[i - 1]
        else:
            base[i] = trsl[i]
    return base


def loop_waa(loss, wet, top, dt, tau):
    waa = np.zeros(len(loss))
    for i in range(1, len(loss)):
        waa[i] = min(loss[i], top, waa[i - 1] + (top - waa[i - 1]) * 3 * dt / tau) if wet[i] else min(loss[i], top)
    return waa


def loop_linear(level, wet):
    """wet: True, False or None. Writes segment by segment, in order."""
    base, anchor, run, unknown = np.zeros(len(level)), 0, False, False
    base[0] = level[0]
    for i in range(1, len(level)):
        unknown = unknown or wet[i] is None
        if wet[i] is None or wet[i]:
            run = True
            continue
        if run:
            base[anchor:i + 1] = np.nan if unknown else np.linspace(level[anchor], level[i], i - anchor + 1)
        else:
            base[i] = level[i]
        anchor, run, unknown = i, False, False
    return base


@pytest.fixture(params=[0, 1, 2])
def series(request):
    """Three links of some length, with run lengths that make chains, and one much longer than the others."""
    rng = np.random.default_rng(request.param)
    frames = []
    for link, n in (("a", 400), ("b", 37), ("hot", 3000)):
        wet, flag = [], bool(request.param == 1)
        while len(wet) < n:
            length = rng.choice([1, 1, 2, 3, 4, 6, 20]) if not flag else rng.choice([1, 2, 5, 30])
            wet += [flag] * int(length)
            flag = not flag
        frames.append(pd.DataFrame({"link": link, "t": np.arange(n), "trsl": rng.normal(50, 5, n), "wet": wet[:n]}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(autouse=True)
def short_chunks(monkeypatch):
    # chunk borders must fall inside the small series
    monkeypatch.setattr(ops, "CHUNK", 64)
    monkeypatch.setattr(ops, "RUNS_PER_BLOCK", 16)


def by_link(got, column):
    return {k: g.sort_values("t")[column].to_numpy(float) for k, g in got.groupby("link")}


@pytest.mark.parametrize("n", [1, 3, 5])
def test_baseline_constant(spark, series, n):
    got = by_link(ops.baseline_constant(spark.createDataFrame(series), ["link"], "t", "trsl", "wet", n).toPandas(), "baseline")
    for link, part in series.groupby("link"):
        want = loop_constant(part["trsl"].to_numpy(), part["wet"].to_numpy(), n)
        assert np.allclose(got[link], want, rtol=0, atol=1e-9), link


def test_baseline_null_flag(spark):
    rows = [("a", i, 10.0 + i, w) for i, w in enumerate([False, None, True, False])]
    df = spark.createDataFrame(rows, "link string, t long, trsl double, wet boolean")
    kept = [r.baseline for r in ops.baseline_constant(df, ["link"], "t", "trsl", "wet").orderBy("t").collect()]
    assert kept == [10.0, 10.0, 10.0, 13.0]
    blank = [r.baseline for r in ops.baseline_constant(df, ["link"], "t", "trsl", "wet", wet_null="null").orderBy("t").collect()]
    assert blank == [10.0, None, 10.0, 13.0]


@pytest.mark.parametrize("block", [8, 2048])
def test_unknown_level_lasts_along_its_chain(spark, monkeypatch, block):
    # every other row is wet, so each run builds on the one before; the NULL lies several blocks ahead of the end
    monkeypatch.setattr(ops, "RUNS_PER_BLOCK", block)
    n, size = 2, 600
    wet = [i % 2 == 1 and i not in (450, 451, 452, 453) for i in range(size)]
    value = [None if i == 10 else 10.0 + i % 7 for i in range(size)]
    want = list(value)
    for i in range(n, size):
        if wet[i]:
            last = want[i - n:i]
            want[i] = None if None in last else sum(last) / n
    df = spark.createDataFrame([("a", i, value[i], wet[i]) for i in range(size)], "link string, t long, trsl double, wet boolean")
    got = [r.baseline for r in ops.baseline_constant(df, ["link"], "t", "trsl", "wet", n).orderBy("t").collect()]
    assert [x is None for x in got] == [x is None for x in want]
    assert sum(x is None for x in got) > 200 and got[599] is not None
    assert np.allclose([x for x in got if x is not None], [x for x in want if x is not None])


def test_baseline_null_level_is_held(spark):
    rows = [("a", 0, 1.0, False), ("a", 1, None, False), ("a", 2, 5.0, True), ("a", 3, 6.0, False)]
    df = spark.createDataFrame(rows, "link string, t long, trsl double, wet boolean")
    assert [r.baseline for r in ops.baseline_constant(df, ["link"], "t", "trsl", "wet").orderBy("t").collect()] == [1.0, None, None, 6.0]


@pytest.mark.parametrize("tau", [15.0, 4.0, 60.0, 3.0])
def test_waa(spark, series, tau):
    base = series.groupby("link")["trsl"].transform("mean")
    data = spark.createDataFrame(series.assign(base=base - 1))
    got = by_link(ops.wet_antenna_schleiss(data, ["link"], "t", "trsl", "base", "wet", 2.2, 1.0, tau).toPandas(), "waa")
    for link, part in series.assign(base=base - 1).groupby("link"):
        want = loop_waa((part["trsl"] - part["base"]).to_numpy(), part["wet"].to_numpy(), 2.2, 1.0, tau)
        assert np.allclose(got[link], want, rtol=0, atol=1e-9)


def test_waa_long_wet_run(spark):
    n = 6000
    df = spark.range(n).select(F.lit("a").alias("link"), F.col("id").alias("t"), (3.0 + F.sin("id")).alias("trsl"),
                               F.lit(0.0).alias("base"), (F.col("id") > 0).alias("wet"))
    got = by_link(ops.wet_antenna_schleiss(df, ["link"], "t", "trsl", "base", "wet").toPandas(), "waa")["a"]
    want = loop_waa(3.0 + np.sin(np.arange(n)), np.arange(n) > 0, 2.2, 1.0, 15.0)
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_waa_rejects_unstable_step(spark, series):
    with pytest.raises(ValueError):
        ops.wet_antenna_schleiss(spark.createDataFrame(series.assign(base=0.0)), ["link"], "t", "trsl", "base", "wet", tau=2.0)


def test_linear(spark, series):
    rng = np.random.default_rng(9)
    flags = [None if u < 0.03 else bool(w) for u, w in zip(rng.random(len(series)), series["wet"])]
    rows = [(r.link, r.t, r.trsl, f) for r, f in zip(series.itertuples(), flags)]
    df = spark.createDataFrame(rows, "link string, t long, trsl double, wet boolean")
    got = by_link(ops.baseline_linear(df, ["link"], "t", "trsl", "wet").toPandas(), "baseline")
    marked = series.assign(flag=pd.Series(flags, dtype=object))
    for link, part in marked.groupby("link"):
        want = loop_linear(part["trsl"].to_numpy(), part["flag"].tolist())
        assert np.allclose(got[link], want, equal_nan=True), link


def test_linear_ignore_null(spark):
    wet = [False, None, True, None, False, None]
    df = spark.createDataFrame([("a", i, float(i * i), w) for i, w in enumerate(wet)], "link string, t long, trsl double, wet boolean")
    got = [r.baseline for r in ops.baseline_linear(df, ["link"], "t", "trsl", "wet", ignore_null=True).orderBy("t").collect()]
    assert np.allclose(got, [0.0, 1.0, 6.0, 11.0, 16.0, 25.0])


def test_wet_events(spark, series):
    got = ops.wet_events(spark.createDataFrame(series), ["link"], "t", "wet").toPandas()
    want = []
    for link, part in series.groupby("link"):
        w = part["wet"].to_numpy()
        starts = [i for i in range(len(w)) if w[i] and (i == 0 or not w[i - 1])]
        ends = [i for i in range(len(w)) if w[i] and (i == len(w) - 1 or not w[i + 1])]
        want += [(link, s, e, e - s + 1) for s, e in zip(starts, ends)]
    assert sorted(map(tuple, got[["link", "start_pos", "end_pos", "samples"]].to_numpy().tolist())) == sorted(want)


def test_wet_flags_across_chunks(spark, series):
    got = by_link(ops.flag_wet(spark.createDataFrame(series.drop(columns="wet")), ["link"], "t", "trsl", 20, 5.0)
                  .withColumn("wet", F.col("wet").cast("int")).toPandas(), "wet")
    for link, part in series.groupby("link"):
        v = part["trsl"].to_numpy()
        want = [float(i >= 10 and i + 10 <= len(v) and v[i - 10:i + 10].std() > 5.0) for i in range(len(v))]
        assert got[link].tolist() == want
