"""Streams against their batch forms, for any cut into micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rainweave.operators import links as ops
from rainweave.operators import matching
from rainweave.streaming import links, replay
from rainweave.streaming import matching as streams

T0 = dt.datetime(2024, 1, 1)


def files_of(spark, tmp_path, name, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def run(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    query.processAllAvailable()
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    return stream.sparkSession.table(name).collect(), state


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_matched_streams_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    radar = [(at(5 * rng.randrange(40)), f"f{i}") for i in range(45)] + [(None, "f-none")]
    weather = [(at(5 * k), k) for k in range(0, 40, 2)] + [(at(10), 99), (None, 98)]
    end = [[(at(1000), None)], [(at(1010), None)]]

    def cut(rows, size):
        rows = sorted(rows, key=lambda r: (r[0] or T0) + dt.timedelta(minutes=rng.randrange(25)))  # up to 25 minutes out of order
        return [rows[i:i + size] for i in range(0, len(rows), size)]

    left = files_of(spark, tmp_path, "radar", cut(radar, 9) + [end[0]], "time_sgt timestamp, path string")
    right = files_of(spark, tmp_path, "weather", cut(weather, 4) + [end[1]], "time_sgt timestamp, gauges int")
    rows, state = run(streams.match_streams(left, right, late="30 minutes"), tmp_path, "matched_parts")
    batch = matching.match_times(spark.createDataFrame(radar, "time_sgt timestamp, path string").where("time_sgt is not null"),
                                 spark.createDataFrame(weather, "time_sgt timestamp, gauges int").where("time_sgt is not null"))
    want = [("matched", r.time_sgt, r.path, r.gauges) for r in batch.matched.collect()]
    want += [("radar_only", r.time_sgt, r.path, None) for r in batch.radar_only.collect()] + [("weather_only", r.time_sgt, None, r.gauges) for r in batch.weather_only.collect()]
    assert sorted(map(str, want)) == sorted(str((r.part, r.time_sgt, r.path, r.gauges)) for r in rows)
    assert state == 2  # the two rows that end the streams


def test_late_rows_are_dropped_and_bounds_join(spark, tmp_path):
    left = files_of(spark, tmp_path, "l", [[("a", at(0), "p0"), ("a", at(100), "p1"), ("b", at(100), "p2"), (None, at(100), "p3")], [("a", at(900), "p9")], [("a", at(20), "late")]], "area string, time_sgt timestamp, path string")
    right = files_of(spark, tmp_path, "r", [[("a", at(4), 1), ("a", at(-4), 2), ("a", at(107), 3)], [("a", at(905), 9)], [("b", at(1000), 4)]], "area string, time_sgt timestamp, gauges int")
    found, _ = run(streams.match_streams(left, right, keys=["area"], late="10 minutes", tolerance="5 minutes"), tmp_path, "bounded")
    got = {(r.part, r.area, r.path, r.gauges) for r in found}
    assert got >= {("matched", "a", "p0", 1), ("matched", "a", "p0", 2), ("radar_only", "a", "p1", None), ("radar_only", "b", "p2", None), ("weather_only", "a", None, 3), ("matched", "a", "p9", 9)}
    assert not any(r.path in ("late", "p3") for r in found)
    with pytest.raises(ValueError):
        streams.match_streams(left, right, tolerance="5 minutes")


def level_rows(rng, link, minutes):
    out, level = [], 1.0
    for k in range(minutes):
        level = 1.0 + (rng.random() * 6 if (k // 45) % 3 == 2 else rng.random() * 0.3)
        out.append((link, at(k + 1), None if rng.random() < 0.004 and k > 200 else round(level, 3)))
    return out


@pytest.mark.parametrize("seed,size", [(1, 60), (2, 500)])
def test_link_chain_equals_batch(spark, tmp_path, seed, size):
    rng = random.Random(seed)
    rows = [r for link, minutes in ((1, 700), (2, 330), (3, 45), (4, 1)) for r in level_rows(rng, link, minutes)]
    schema = "link_id int, time timestamp, trsl double"
    sent = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(20)))
    batches = [sent[i:i + size] for i in range(0, len(sent), size)] + [[(9, at(5000), 1.0), (None, at(5000), 1.0), (9, None, 1.0)]] + [[(1, at(3), 7.0)]]
    stream = files_of(spark, tmp_path, "in", batches, schema)
    found, state = run(links.wet_chain_stream(stream, "link_id", "time", "trsl", late="20 minutes", close_after_minutes=2000), tmp_path, f"chain{seed}")
    series = spark.createDataFrame(rows, schema).selectExpr("link_id", "(unix_seconds(time) - 1704067200) div 60 - 1 as t", "trsl")
    flagged = ops.flag_wet(series, ["link_id"], "t", "trsl")
    based = ops.baseline_constant(flagged, ["link_id"], "t", "trsl", "wet", 5)
    want = {(r.link_id, r.t): r for r in ops.wet_antenna_schleiss(based, ["link_id"], "t", "trsl", "baseline", "wet").collect()}
    assert len(found) == len(want) == 1076 and state == 1
    assert sum(r.wet for r in found) > 50
    for r in found:
        w = want[(r.link_id, r.position)]
        assert (r.wet, r.trsl) == (w.wet, w.trsl)
        for own, other in ((r.baseline, w.baseline), (r.waa, w.waa)):
            assert own == pytest.approx(other, abs=1e-9) if other is not None else own is None


def test_ended_link_starts_anew(spark, tmp_path):
    batches = [[(1, at(k + 1), float(k)) for k in range(3)], [(2, at(500), 0.0)], [(1, at(501 + k), 5.0) for k in range(2)], [(2, at(9000), 0.0)]]
    stream = files_of(spark, tmp_path, "in", batches, "link_id int, time timestamp, trsl double")
    found, _ = run(links.wet_chain_stream(stream, "link_id", "time", "trsl", late="5 minutes", close_after_minutes=60), tmp_path, "anew")
    assert sorted((r.position, r.trsl) for r in found if r.link_id == 1) == [(0, 0.0), (0, 5.0), (1, 1.0), (1, 5.0), (2, 2.0)]


def test_replayed_slices_arrive_in_order(spark, tmp_path):
    rows = spark.range(90).select("id", F.timestamp_seconds(F.col("id") + 10).alias("time"))
    end = spark.range(1).select(F.lit(-1).alias("id"), F.timestamp_seconds(F.lit(10_000)).alias("time"))
    stream = replay.read_slices(spark, replay.written_slices(rows, F.floor(F.col("id") / 30), 3, end), rows.schema)
    assert replay.collected(stream).count() == 91


def test_stream_rows_are_not_broadcast_to_the_links(spark, tmp_path, capsys):
    rows = [(1, at(k + 1), 1.0) for k in range(90)]
    stream = files_of(spark, tmp_path, "in", [rows, [(2, at(900), 1.0)]], "link_id int, time timestamp, trsl double")
    table = str(tmp_path / "links")
    spark.createDataFrame([(1, 20.0, 2.0, "V")], "link_id int, frequency double, length double, polarization string").write.parquet(table)
    rain = links.link_rain_stream(stream, spark.read.parquet(table), late="5 minutes", close_after_minutes=60)
    query = rain.writeStream.format("memory").queryName("planned").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.explain()
    query.stop()
    plan = capsys.readouterr().out
    assert "FlatMapGroupsInPandasWithState" in plan and "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert spark.table("planned").where("link_id = 1 and rain_rate = 0").count() == 90
