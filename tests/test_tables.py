import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainweave.functions import geo, rain
from rainweave.operators import errors, metrics, reshape, temporal, traininglog


def test_duplicate_cell_raises(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0)], "t int, gid string, v double")
    with pytest.raises(Exception, match="duplicate"):
        reshape.to_wide(df, ["t"], "gid", "v", ["a"]).collect()
    other = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "t long, gid string, v double")
    with pytest.raises(Exception, match="not listed"):
        reshape.to_wide(other, ["t"], "gid", "v", ["a"]).collect()


def test_gap_fill_against_pandas(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for gid in range(6):
        values = np.where(rng.random(80) < 0.6, np.nan, rng.normal(size=80))
        values[rng.integers(0, 80)] = 1.0
        rows += [(gid, i, float(v)) for i, v in enumerate(values) if not math.isnan(v)]
        want[gid] = pd.Series(values).interpolate("linear").ffill().bfill().to_numpy()
    got = temporal.fill_gaps(spark.createDataFrame(rows, "gid int, slot long, value double"), ["gid"], "slot", "value", F.lit(0).cast("long"), F.lit(79).cast("long"))
    for gid, part in got.toPandas().groupby("gid"):
        part = part.sort_values("slot")
        assert part["slot"].tolist() == list(range(80)) and np.allclose(part["value"], want[gid])


def test_index_label_is_checked(spark):
    df = spark.range(1).withColumnRenamed("id", "t")
    with pytest.raises(ValueError):
        temporal.assign_to_index(df, df, "t", "middle")


@pytest.mark.parametrize("label", ["left", "right"])
@pytest.mark.parametrize("seed", range(4))
def test_index_assignment(spark, label, seed):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01")
    values = start + pd.to_timedelta(np.sort(rng.choice(400000, 60, replace=False)), unit="s")
    index = start + pd.to_timedelta(np.sort(np.append(rng.choice(400000, 25, replace=False), (values[5] - start).total_seconds())), unit="s")
    low, high = max(values.min(), index.min()), min(values.max(), index.max())
    marks = sorted({m for m in index if low <= m <= high})
    want = {}
    for v in values[(values >= low) & (values <= high)]:
        near = [m for m in marks if (m <= v if label == "left" else m >= v)]
        want[v] = (max(near) if label == "left" else min(near)) if near else None
    frame = lambda ts: spark.createDataFrame([(t.to_pydatetime(),) for t in ts], "t timestamp_ntz")
    got = temporal.assign_to_index(frame(values), frame(index), "t", label).collect()
    assert {pd.Timestamp(r.t): None if r.target is None else pd.Timestamp(r.target) for r in got} == want


def test_rain_class_edges(spark):
    values = [None, 0.0, 0.1, 0.19, 20.0, 19.9]
    got = [r.c for r in spark.createDataFrame([(v,) for v in values], "v double").select(rain.rain_class(F.col("v")).alias("c")).collect()]
    assert got == [None, 0, 1, 1, 9, 8]


def test_haversine_versions(spark):
    row = spark.range(1).select(
        geo.haversine_asin(F.lit(1.3), F.lit(103.8), F.lit(1.4), F.lit(103.9)).alias("a"),
        geo.haversine_atan(F.lit(103.8), F.lit(1.3), F.lit(103.9), F.lit(1.4)).alias("b"),
    ).first()
    assert row.a / row.b == pytest.approx(6371 / 6367) and 15 < row.a < 16


def test_time_without_truth(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (1, None, 3.0), (2, None, 1.0)], "t int, y double, p double")
    row = metrics.average_rmse(df, ["t"], "y", "p").first()
    assert (row.times, row.valid_times, row.rmse_all, row.rmse_valid, row.mse_all) == (2, 1, 1.0, 2.0, 2.0)


def test_event_error_does_not_cancel(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 1.0)], "y double, p double")
    assert metrics.event_mse(df, "y", "p").first().event_mse == 4.0


def test_rank_correlation_with_ties(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random(500) < 0.5, 0.0, np.round(rng.random(500) * 5))
    b = np.round(a + rng.normal(size=500))
    row = metrics.spearman(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), "a", "b").first()
    assert row.spearman == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank())) and row.n == 500


def test_false_zero_bounds(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (1.0, 2.1), (0.0, 1.0), (None, 1.0)], "true_value double, pred_value double")
    assert [r.is_false_zero for r in errors.with_errors(df).collect()] == [True, True, False, False, None]


def test_tied_errors_share_a_class(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 3.0, 4.0])], "station_id int, e double")
    got = {r.station_id: r.error_class for r in errors.error_tertiles(df, "e").collect()}
    assert got[0] == got[1] == got[2] == "Low" and got[5] == "High"
    assert [r.station_id for r in errors.worst(df, F.col("e"), "station_id", 2).collect()] == [5, 4]
    assert {r.station_id for r in errors.flag_high(df, "e").where("is_high").collect()} == {5, 4}


def test_histogram_of_one_value(spark):
    rows = errors.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 10).orderBy("bin").collect()
    assert [r.n for r in rows] == [2] + [0] * 9


def test_early_stop(spark):
    losses = [5.0, 4.0, 4.0, 4.5, 4.6, 4.7, 1.0]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(losses)], "run string, epoch int, val_loss double")
    got = traininglog.analyse_training(df, ["run"], patience=3)
    rows = got.orderBy("epoch").collect()
    assert [r.new_best for r in rows] == [True, True, False, False, False, False, True]
    assert [r.stale for r in rows] == [0, 0, 0, 1, 2, 3, 0]
    row = traininglog.summarise_training(got, ["run"]).first()
    assert (row.epochs, row.best_val_loss, row.best_epoch, row.stop_epoch) == (6, 4.0, 2, 6)


def test_wide_form_is_one_shuffle(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "b", 3.0)], "t int, gid string, v double").repartition(3)
    wide = reshape.to_wide(df, ["t"], "gid", "v", ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, 2.0, None), (2, None, 3.0)]
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
