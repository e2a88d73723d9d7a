from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom import runner
from tagloom.operators import tracks
from tagloom.sources import labels
from tagloom.streaming import sessions


def test_labels_are_repaired_and_written_back(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "clip 1.csv").write_text('﻿product_name,price_card,wholesale_level_1_coun,x_min,y_min,x_max,y_max,frame_timestamp\n" A ""q"", b ","73,99",3,1,2,30,40.5,"12,5"\n', "utf-8")
    (tmp_path / "sample.csv").write_text("product_name\nskip\n")
    rows = labels.read_labels(spark, str(tmp_path))
    (r,) = rows.collect()
    assert rows.columns == labels.COLUMNS and (r.product_name, r.price_card, r.wholesale_level_1_count, r.filename, r.color) == ('A "q", b', "73,99", "3", "clip 1", "")
    b = labels.with_boxes(rows).head()
    assert tuple(b.bbox) == (1, 2, 30, 40.5) and b.timestamp_ms == 13
    out = tmp_path / "out"
    labels.write_rows(rows.withColumn("extra", F.lit(1)), str(out))
    assert labels.read_labels(spark, str(out)).collect() == [r]
    bad = rows.withColumn("x_max", F.lit("0"))
    assert labels.with_boxes(bad).head().bbox is None
    with pytest.raises(PySparkException):
        labels.with_boxes(bad, strict=True).collect()


def test_catalog_in_a_single_byte_charset(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("fullname;code\r\nВино Саммарко;08051070512049\r\n\"a;b\";12-3\r\n;5\r\n".encode("cp1251"))
    got = [(r.name, r.code) for r in labels.read_catalog(spark, str(tmp_path / "c.csv")).orderBy("ord").collect()]
    assert got == [("Вино Саммарко", "08051070512049"), ("a;b", "123")]


def test_videos_are_paired_with_labels(spark, tmp_path):
    for f in ("a/x.csv", "a/x.mp4", "a/y.mp4", "b/l.csv", "b/v.mp4", "c/l.csv"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    got = {tuple(p.rsplit("/", 2)[-2] + "/" + p.rsplit("/", 1)[-1] for p in (r.csv, r.video)) for r in labels.video_pairs(spark, str(tmp_path)).collect()}
    assert got == {("a/x.csv", "a/x.mp4"), ("b/l.csv", "b/v.mp4")}


def test_keys_preview_and_detector_labels(spark):
    assert spark.range(1).select(labels.filename_keys(F.lit("In\\Day1\\Clip.MP4")).alias("k")).head().k == ["in/day1/clip.mp4", "clip.mp4", "clip", "day1/clip.mp4", "day1"]
    df = spark.range(30).select("id", F.lit("x").alias("v"))
    assert labels.preview(df, "id", 2).head().preview == '{"n":30,"rows":[{"id":0,"v":"x"},{"id":1,"v":"x"}]}'


def test_streamed_tracks_equal_batch_tracks(spark, tmp_path):
    rows = [(k, k * 100 + i, i * 700 + (4000 if i > 5 else 0), i, 0.5, 10 * i, 0, 10 * i + 60, 50) for k in range(3) for i in range(10)]
    schema = "video int, detection_id long, timestamp_ms long, frame_index long, confidence double, x_min int, y_min int, x_max int, y_max int"
    df = spark.createDataFrame(rows, schema)
    for n in range(2):
        df.where(f"frame_index div 5 = {n}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = sessions.tracked(stream, "video").writeStream.format("memory").queryName("tracked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.video, r.detection_id): r.track for r in spark.sql("select * from tracked").collect()}
    want = {(r.video, r.detection_id): r.track for r in tracks.associate(df, "video", "video int, detection_id long, track long").collect()}
    assert got == want and len(set(want.values())) == 2


def test_streamed_sessions_and_windows(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:02"), ("u", "2024-01-01 00:00:10"), ("w", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "u string, t string").select("u", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("s", sessions.session_counts(stream, "ts", "u", "2500 milliseconds", "1 minute")), ("w", sessions.window_counts(stream, "ts", "u", "1 minute", "1 minute", "1 minute"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n for r in spark.sql("select * from s where u = 'u'").collect()) == [1, 2]
    assert [r.n for r in spark.sql("select * from w where u = 'u'").collect()] == [3]


def test_runner_reports_and_skips(spark):
    def fail(frames):
        raise RuntimeError("broken")

    stages = [runner.Stage("a", lambda f: {"x": spark.range(3)}), runner.Stage("b", fail), runner.Stage("c", lambda f: {}), runner.Stage("d", lambda f: {"y": f["x"]}, always=True)]
    frames, reports = runner.run_stages(stages, {})
    assert [(r.name, r.status) for r in reports] == [("a", "done"), ("b", "failed"), ("c", "skipped"), ("d", "done")] and frames["y"].count() == 3
    assert runner.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"e": 1}}
    r = runner.Registry("x")
    r.add("x", len)
    assert r.get("none") is len
