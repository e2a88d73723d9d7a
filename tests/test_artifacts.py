from __future__ import annotations

import json
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom import runner
from tagloom.operators import crops, grouping, reports
from tagloom.sources import artifacts as A
from tagloom.sources import labels
from tagloom.streaming import jobs


def test_storage_side_cars_and_manifest(spark, tmp_path):
    s = A.Storage(spark, str(tmp_path))
    assert not s.exists("a/b.json") and s.size("a/b.json") is None
    s.put_text("a/b.json", "ü1")
    assert s.get_text("a/b.json") == "ü1" and s.size("a/b.json") == 3
    (tmp_path / "x.bin").write_bytes(b"123")
    s.upload(str(tmp_path / "x.bin"), "up/x.bin")
    s.download("up/x.bin", str(tmp_path / "y.bin"))
    assert (tmp_path / "y.bin").read_bytes() == b"123"
    assert A.side_car(s, "debug/rows", spark.range(3), {"n": 3}).endswith("debug/rows") and spark.read.json(s.path("debug/rows")).count() == 3
    assert A.side_car(s, "debug/bad", spark.range(3).select(F.raise_error(F.lit("no")))) == ""
    stages = [runner.Stage("a", lambda f: {}, describe=lambda f: {"frames": len(f)}), runner.Stage("b", lambda f: 1 / 0), runner.Stage("c", lambda f: {})]
    _, done = runner.run_stages(stages, {})
    doc = A.manifest(s, "manifest.json", "j1", done, datetime.now(UTC))
    assert json.loads(s.get_text("manifest.json"))["status"] == doc["status"] == "failed"
    assert [x["status"] for x in doc["stages"]] == ["done", "failed", "skipped"] and doc["stages"][0]["input"] == {"frames": 0} and doc["started_at"].endswith("+00:00")


def test_preview_mock_empty_and_reload(spark):
    d = spark.range(30).select(F.col("id").alias("detection_id"))
    c = spark.range(30).select(F.col("id").alias("crop_id"), (F.col("id") % 7 / 10).alias("quality"))
    rows = spark.range(40).select(F.col("id").alias("ord"), F.lit("x").alias("name"))
    doc = json.loads(A.preview(d.agg(F.count("*").alias("n")), d, c, rows, "ord").head().preview)
    assert doc["stats"] == {"n": 30} and [x["detection_id"] for x in doc["detections"]] == list(range(10)) and len(doc["rows"]) == 25
    assert [x["crop_id"] for x in doc["crops"][:5]] == [6, 13, 20, 27, 5]
    assert A.mock_rows(spark, labels.COLUMNS).count() == 1 and A.mock_rows(spark, ["product_name", "barcode"]).head() == ("mock", "")
    assert A.emptied({"detections": d, "x": c})["detections"].count() == 0
    assert A.rehydrated({"x": d}, "x", None) is d and A.rehydrated({}, "x", lambda: c) is c
    assert A.table_of([d.limit(1), c.limit(1)]).columns == ["detection_id", "crop_id", "quality"]


def test_unlabelled_videos_names_and_keys(spark):
    v = spark.createDataFrame([("in/c.mp4",), ("in/a.mp4",), ("in/b.mp4",), ("in/z.mp4",)], "path string")
    got = A.unlabelled(v, v.where("path like '%z%'"), ["b.mp4", "none.mp4"])
    assert [(r.place, r.path) for r in got.orderBy("place").collect()] == [(1, "in/b.mp4"), (2, "in/a.mp4"), (3, "in/c.mp4")]
    assert [A.dataset_name("v", 5), A.dataset_name("v", 5, 7, 2), A.dataset_name("v", 5, None, -3)] == ["v_ts_5", "v_ts_5_f_000007_off_+002", "v_ts_5_f_unknown_off_-003"]
    assert spark.range(1).select(labels.near_filename_keys(F.lit("In\\Day1\\Clip.MP4")).alias("k")).head().k == ["in/day1/clip.mp4", "clip.mp4", "day1/clip.mp4"]


def test_settings():
    said = []
    assert [runner.coerced(v, k, d, "x", said) for v, k, d in [("yes", "bool", False), ("0", "bool", True), ("7", "int", 1), ("1.5", "float", 1.0), (0.3, "ratio", 0.5), (None, "int", 4)]] == [True, False, 7, 1.5, 0.3, 4]
    assert not said and [runner.coerced(v, k, 9, "x", said) for v, k in [("maybe", "bool"), (-1, "int"), (2, "ratio"), (True, "float"), ("a", "float")]] == [9] * 5 and len(said) == 5
    r = runner.Registry("default")
    r.add("mock", len)
    assert r.get("unknown") is len


def test_queue_runs_each_job_once(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "job_id string, payload string").coalesce(1).write.json(str(inbox))
    for _ in range(2):
        q = jobs.run_queue(spark, str(inbox), str(out), str(tmp_path / "ck"), lambda df: df.withColumn("message", F.col("payload")))
        assert jobs.poll(q, 0.2, 60) == "done"
    assert sorted(tuple(r) for r in spark.read.json(str(out)).select("job_id", "status", "message").collect()) == [("a", "done", "1"), ("b", "done", "2")]
    bad = jobs.run_queue(spark, str(inbox), str(tmp_path / "out2"), str(tmp_path / "ck2"), lambda df: df.select("none"), str(tmp_path / "log"))
    assert jobs.poll(bad, 0.2, 60) == "done" and {r.status for r in spark.read.json(str(tmp_path / "out2")).collect()} == {"failed"}
    assert {(r.job_id, r.status, tuple(r.steps)) for r in jobs.states(spark, str(tmp_path / "log")).collect()} == {(j, "failed", ("queued", "processing", "failed")) for j in "ab"}


def test_points_numbers_checks_and_lines(spark):
    df = spark.createDataFrame([([(10.2, 4.0), (30.9, 9.1)], 2.0, 0.0), ([(1.0, 1.0)], 1.0, 0.0), ([(1.0, 1.0), (5.0, 5.0)], 1.0, 90.0), ([], 1.0, 0.0)], "p array<struct<x:double,y:double>>, s double, r double")
    got = [r.b for r in df.select(crops.box_of_points(F.col("p"), F.col("s"), F.col("s"), F.col("r")).alias("b")).collect()]
    assert tuple(got[0]) == (5, 2, 16, 5) and got[1:] == [None, None, None]
    n = spark.createDataFrame([("1,5",), ("",), ("x",), (None,)], "c string")
    assert [r.v for r in n.select(reports.number(F.col("c")).alias("v")).collect()] == [1.5, None, None, None]
    with pytest.raises(Exception, match="no number"):
        n.select(reports.number(F.col("c"), strict=True).alias("v")).collect()
    s = spark.createDataFrame([("s", "c", "d", "x", "v", " ", 0, None, 2.0, "qr"), ("s", "c", "d", "x", "v", "p", 0, -1, 0.5, "odd"), ("s", "c", "d", "x", "v", "p", 0, 1, 0.5, "qr")], "symbol_id string, crop_id string, detection_id string, decoder string, variant string, payload string, frame_index int, timestamp_ms long, confidence double, symbol_type string")
    assert [r.violations for r in reports.checked(s, "symbol").collect()] == [["payload must not be empty", "confidence must be from 0 to 1"], ["timestamp_ms must be non-negative", "symbol_type is unknown"], []]
    with pytest.raises(Exception, match="symbol: payload"):
        reports.checked(s, "symbol", strict=True).collect()
    c = spark.createDataFrame([("c", "d", "s", 0, 1, 0, 5, 0.5, 1.5, 0.1)], "crop_id string, detection_id string, source string, frame_index int, timestamp_ms long, width int, height int, glare_ratio double, area_ratio double, score double")
    assert reports.checked(c, "crop").head().violations == ["width must be positive", "area_ratio must be from 0 to 1"]
    a = spark.createDataFrame([("a", "c", "", "v", -1)], "attempt_id string, crop_id string, decoder string, variant string, duration_ms int")
    assert reports.checked(a, "attempt").head().violations == ["decoder must not be empty", "duration_ms must be non-negative"]
    lines = spark.createDataFrame([("f", "0 1 2"), ("f", " "), ("g", "")], "f string, l string")
    assert {r.f: r.boxes for r in reports.box_lines(lines, "f", "l").collect()} == {"f": 1, "g": 0}


def test_strict_checks_name_the_first_row_that_breaks_a_rule(spark):
    n = 400_000
    late = F.when(F.col("id") == n // 2 - 1, F.lit("")).otherwise(F.lit("d"))  # the last row of the first part
    early = F.when(F.col("id") == n // 2, F.lit(-1)).otherwise(F.lit(1))  # the first row of the second part
    a = spark.range(0, n, 1, 2).select(F.col("id").cast("string").alias("attempt_id"), F.lit("c").alias("crop_id"), late.alias("decoder"), F.lit("v").alias("variant"), early.alias("duration_ms"))
    for _ in range(3):
        with pytest.raises(Exception, match="attempt: decoder must not be empty"):
            reports.checked(a, "attempt", strict=True).select(F.sum(F.size("violations"))).collect()
    good = reports.checked(a.where("decoder = 'd' and duration_ms = 1"), "attempt", strict=True)
    assert good.columns == [*a.columns, "violations"] and good.select(F.count("*"), F.sum(F.size("violations"))).first() == (n - 2, 0)


def test_camera_there_and_back(spark):
    cam = crops.Camera.of_lens(3840, 2160, 2.8, 16.0 / 2.8, (-0.02, 0.003, 0.0004, -0.0006, -0.0001))
    rng = np.random.default_rng(2)
    points = [(float(x), float(y)) for x, y in zip(rng.uniform(200, 1900, 40), rng.uniform(300, 3500, 40))]
    df = spark.createDataFrame([(i, (x, y, x + 1e-9, y + 1e-9)) for i, (x, y) in enumerate(points)], "i int, b struct<x_min:double,y_min:double,x_max:double,y_max:double>")
    raw = cam.to_raw(df, "b", "raw").select("i", F.col("raw.x_min").alias("x"), F.col("raw.y_min").alias("y"))
    back = cam.from_raw(raw, "x", "y").orderBy("i").collect()
    assert np.abs(np.array([(r.processed_x, r.processed_y) for r in back]) - points).max() < 3e-4


def test_symbols_join_their_track(spark):
    s = spark.createDataFrame([(1, "10", " t1 "), (2, "10", ""), (3, "99", None)], "symbol_id int, detection_id string, track_id string")
    t = spark.createDataFrame([("10", "t9")], "detection_id string, track_key string")
    assert {r.symbol_id: r.track_key for r in grouping.symbol_track(s, t).collect()} == {1: "t1", 2: "t9", 3: "99"}
