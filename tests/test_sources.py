import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainweave.operators import errors, matching
from rainweave.sources import radar, readers, sinks
from rainweave.streaming import resample


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def stations_csv(tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text(
        "timestamp,station_id,rain_rate,wind_speed,wind_direction,temperature,humidity\n"
        "2025-02-01T00:15:00+08:00,S1,0.2,NaN,90,26.5,80\n"
        "2025-02-01T00:20:00+08:00,S1,,1.5,,26.4,81\n"
    )
    return str(path)


def test_weather_station_csv(spark, stations_csv):
    rows = readers.read_weather_stations(spark, stations_csv).orderBy("time_sgt").collect()
    assert rows[0].time_sgt == at("2025-02-01T00:15:00") and rows[0].gid == "S1"
    assert rows[0].wind_speed is None and rows[1].rain_rate is None and rows[1].wind_speed == 1.5


@pytest.mark.parametrize("bad", ["2025-02-01T00:15:30+08:00", "2025-02-01T00:15:00+00:00", "2025-02-01 00:15:00", "x"])
def test_bad_time_raises_or_is_set_aside(spark, tmp_path, bad):
    path = tmp_path / "gauges.csv"
    path.write_text(f"time_sgt,gid,rain_rate\n{bad},G1,0.2\n2025-02-01T00:15:00+08:00,G2,0.4\n")
    with pytest.raises(Exception):
        readers.read_rain_gauges(spark, str(path)).collect()
    rows = readers.read_rain_gauges(spark, str(path), strict=False).orderBy("gid").collect()
    assert [r.time_sgt for r in rows] == [None, at("2025-02-01T00:15:00")]


def test_gauges_with_rain_filter(spark, tmp_path):
    path = tmp_path / "gauges.csv"
    lines = ["time_sgt,gid,rain_rate"]
    for minute, values in (("00", (0, 0)), ("05", ("", "")), ("10", (0.2, 0.4)), ("15", (0.2, 0))):
        lines += [f"2025-02-01T00:{minute}:00+08:00,G{i},{v}" for i, v in enumerate(values)]
    path.write_text("\n".join(lines) + "\n")
    minutes = {n: sorted({r.time_sgt.minute for r in readers.read_rain_gauges(spark, str(path), n).collect()}) for n in (0, 1, 2)}
    assert minutes == {0: [0, 5, 10, 15], 1: [10, 15], 2: [10]}


def test_last_position_wins(spark, tmp_path):
    path = tmp_path / "positions.csv"
    path.write_text("gid,latitude,longitude\nS1,1.2,103.7\nS2,1.3,103.8\nS1,1.25,103.75\n")
    got = {r.gid: (r.latitude, r.longitude) for r in readers.read_station_positions(spark, str(path)).collect()}
    assert got == {"S1": (1.25, 103.75), "S2": (1.3, 103.8)}


def test_links_parquet(spark, tmp_path):
    spark.createDataFrame([("a", 0, 1.0), ("a", 1, float("nan"))], "link_id string, t long, trsl double").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([("a", 20.0)], "link_id string, frequency double").write.parquet(str(tmp_path / "d"))
    rows = readers.read_links(spark, str(tmp_path / "f"), str(tmp_path / "d")).orderBy("t").collect()
    assert [(r.trsl, r.frequency) for r in rows] == [(1.0, 20.0), (None, 20.0)]


def test_radar_catalogue(spark, tmp_path):
    for day, name in (("20250201", "spacesync_99_202502010015_area_23.tif"), ("20250202", "spacesync_99_202502020000_area_23.tif"),
                      ("20250202", "spacesync_99_garbage_area.tif"), ("20250202", "spacesync_99_202513020000_x.tif"), ("20250202", "other.tif")):
        (tmp_path / day).mkdir(exist_ok=True)
        (tmp_path / day / name).write_bytes(b"x")
    rows = radar.read_radar_catalogue(spark, str(tmp_path)).collect()
    assert sorted(r.time_sgt for r in rows) == [at("2025-02-01T00:15:00"), at("2025-02-02T00:00:00")]


FRAME = "time_sgt timestamp_ntz, data array<array<double>>, bounds struct<left: double, bottom: double, right: double, top: double>"


def frames(spark, times, values=None):
    data = [(t, [[float((values or [0] * len(times))[i] + r * 5 + c) for c in range(5)] for r in range(4)], (103.6, 1.2, 104.1, 1.6))
            for i, t in enumerate(map(at, times))]
    return spark.createDataFrame(data, FRAME)


def test_cells_and_row_orders(spark):
    f = frames(spark, ["2025-02-01T00:00:00"])
    up = {(r.row, r.col): (round(r.lat, 6), round(r.lon, 6)) for r in radar.frames_to_cells(f).collect()}
    asc = {(r.row, r.col): (round(r.lat, 6), round(r.lon, 6)) for r in radar.frames_to_cells(f, "ascending").collect()}
    assert up[(0, 0)] == (1.55, 103.65) and asc[(0, 0)] == (1.2, 103.6) and asc[(3, 4)] == (1.6, 104.1)
    with pytest.raises(ValueError):
        radar.frames_to_cells(f, "south")


def test_crop_outside_fails_softly(spark):
    f = frames(spark, ["2025-02-01T00:00:00"]).withColumn("transform", radar.north_up_transform(F.col("bounds"), F.lit(4), F.lit(5)))
    inside = radar.crop_frames(f, {"left": 103.72, "right": 103.98, "bottom": 1.33, "top": 1.47}).collect()[0]
    assert inside.success and inside.data == [[6.0, 7.0]]
    outside = radar.crop_frames(f, {"left": 110.0, "right": 111.0, "bottom": 1.3, "top": 1.5}).collect()[0]
    assert not outside.success and outside.data is None


def test_nearest_frame_rules(spark):
    f = frames(spark, ["2025-02-01T00:00:00", "2025-02-01T01:00:00", "2025-02-01T01:10:00"])
    asked = ["2025-02-01T00:00:00", "2025-02-01T00:07:00", "2025-02-01T00:15:00", "2025-02-01T00:15:01", "2025-02-01T01:05:00"]
    times = spark.createDataFrame([(at(t),) for t in asked], "time_sgt timestamp_ntz")
    got = [r.frame_time for r in matching.nearest_time(times, f).orderBy("time_sgt").collect()]
    first, second = at("2025-02-01T00:00:00"), at("2025-02-01T01:00:00")
    assert got == [first, first, first, None, second]
    aligned = {r.time_sgt: r.data for r in matching.align_radar(times, f).collect()}
    assert aligned[at(asked[3])] == [[0.0] * 5] * 4 and aligned[at(asked[0])][0][1] == 1.0


def test_equal_values_normalise_to_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r.s for r in matching.min_max_normalised(df, "v", "s").collect()] == [None, None]


def test_match_with_duplicates_and_without_weather(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "time_sgt int, path string")
    weather = spark.createDataFrame([(1,), (3,)], "time_sgt int")
    found = matching.match_times(files, weather)
    row = found.stats.collect()[0]
    assert (row.radar, row.weather, row.matched, row.radar_only, row.weather_only, row.match_rate) == (3, 2, 2, 1, 1, 100.0)
    assert found.matched.count() == 2 and found.radar_only.count() == 1 and found.weather_only.count() == 1
    assert matching.match_times(files, weather.where("time_sgt > 9")).stats.collect()[0].match_rate is None


def test_csv_and_parquet_sinks(spark, tmp_path):
    rows = [(0, "S1", "general", 1, 5.0, 0.0), (1, "S1", "general", 2, 0.0, 0.0), (1, "S2", "rainfall", 2, 3.0, 2.0)]
    df = errors.with_errors(spark.createDataFrame(rows, "fold int, station_id string, station_type string, timestep int, true_value double, pred_value double"))
    sinks.write_predictions(df, str(tmp_path))
    back = spark.read.csv(str(tmp_path / "predictions"), header=True, inferSchema=True)
    assert back.count() == 3 and {r.fold for r in back.collect()} == {0, 1}
    assert spark.read.csv(str(tmp_path / "false_zeros"), header=True).count() == 2
    sinks.write_parquet(df, str(tmp_path / "p"), ["fold"])
    assert spark.read.parquet(str(tmp_path / "p")).where("fold = 1").count() == 2


def test_experiment_log(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_record(spark, path, {"timestamp": "2025-01-01T00:00:00", "radar_grid_nodes": 64, "grid_shape": [8, 8]})
    sinks.append_record(spark, path, {"timestamp": 1.5, "type": "model_config", "config": {"layers": 5}})
    for e, loss in enumerate([3.0, 2.0, 2.5], 1):
        sinks.append_record(spark, path, {"timestamp": 1.0 * e, "epoch": e, "train_loss": 1.0, "val_loss": loss, "best_val_so_far": 2.0, "new_best": e < 3})
    sinks.append_record(spark, path, {"timestamp": 9.0, "type": "test_metrics", "rmse": 1.25, "pearson_r": 0.5})
    spark.createDataFrame([("Total parameters: 12",)], "value string").write.mode("append").text(path)
    log = sinks.read_experiment_log(spark, path)
    assert log.count() == 7
    assert sinks.epoch_records(log).count() == 3
    assert sinks.records_of(log, "test_metrics").collect()[0].rmse == 1.25
    assert log.where("radar_grid_nodes is not null").collect()[0].grid_shape == [8, 8]
    assert log.where("_unreadable is not null").collect()[0]._unreadable.startswith("Total")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(
        (F.col("id") % 3).alias("gid"), F.timestamp_seconds(1735689600 + F.col("id") * 97).alias("time_sgt"), F.col("id").cast("double").alias("value")
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sums = resample.resample_stream(stream, ["gid"], "time_sgt", [F.sum("value").alias("total")])
    run = sums.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    run.processAllAvailable()
    run.stop()
    batch = rows.groupBy("gid", F.window("time_sgt", "15 minutes").start.alias("bucket")).agg(F.sum("value").alias("total"))
    key = lambda df: {(r.gid, r.bucket): r.total for r in df.collect()}
    assert key(spark.table("sums")) == key(batch)
    first = resample.first_per_bucket_stream(stream, ["gid"], "time_sgt", "value")
    run = first.writeStream.format("memory").queryName("firsts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    run.processAllAvailable()
    run.stop()
    want = rows.groupBy("gid", F.window("time_sgt", "15 minutes").start.alias("bucket")).agg(F.min_by("value", "time_sgt").alias("value"))
    assert {(r.gid, r.bucket): r.value for r in spark.table("firsts").collect()} == {(r.gid, r.bucket): r.value for r in want.collect()}


def test_stream_closes_buckets(spark, tmp_path):
    """Append mode: closed buckets are written once and leave the state."""
    for part, hours in ((0, 0), (1, 5)):
        spark.range(40).select(
            F.lit(1).alias("gid"), F.timestamp_seconds(1735689600 + hours * 3600 + F.col("id") * 60).alias("time_sgt"), F.col("id").cast("double").alias("value")
        ).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={part}"))
    stream = spark.readStream.schema("gid int, time_sgt timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    first = resample.first_per_bucket_stream(stream, ["gid"], "time_sgt", "value")
    run = first.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    state = run.lastProgress["stateOperators"][0]["numRowsTotal"]
    run.stop()
    assert spark.table("closed").count() == 3 and state == 3
