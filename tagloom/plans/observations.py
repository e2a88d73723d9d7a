"""Queries over derived detections: counts, summaries, top-K, spatial and temporal joins, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import assign, nms, ranking, spatial, tracks
from ..operators.components import connected_components
from ..sources.tables import DETECTIONS_SQL, detections, load
from .registry import query

HOUR = 3_600_000
GAP = 36 * HOUR
LABELS = ["click", "error", "purchase", "signup", "view"]
WITH = f"WITH {DETECTIONS_SQL}"
CELL = 256


@query(f"{WITH} SELECT video, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE label = {x!r}) AS n_{x}' for x in LABELS)} FROM detections GROUP BY video")
def detections_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections per video, with every label's number, zeros included."""
    d = detections(spark, sf_dir)
    return d.groupBy("video").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in LABELS])


@query(
    f"""{WITH} SELECT video, count(*) AS n, min(quality) AS least, max(quality) AS most, round(avg(quality::DECIMAL(18,6))::DOUBLE, 4) AS mean,
  median(quality) AS middle, round(avg(confidence::DECIMAL(18,6))::DOUBLE, 4) AS mean_confidence FROM detections GROUP BY video"""
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")).cast("double"), 4)
    return d.groupBy("video").agg(
        F.count("*").alias("n"), F.min("quality").alias("least"), F.max("quality").alias("most"), mean("quality").alias("mean"), F.median("quality").alias("middle"), mean("confidence").alias("mean_confidence")
    )


TRACKS_SQL = f"""{DETECTIONS_SQL},
tracks AS (SELECT video, track_id, count(*) AS n_detections, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, median(x_min) AS x_min, median(y_min) AS y_min,
  median(x_max) AS x_max, median(y_max) AS y_max FROM detections GROUP BY ALL)"""


def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.summaries(detections(spark, sf_dir), ["video", "track_id"])


@query(
    f"""WITH {TRACKS_SQL}, large AS (SELECT video, track_id, detection_id AS largest FROM detections
  QUALIFY row_number() OVER (PARTITION BY video, track_id ORDER BY (x_max - x_min) * (y_max - y_min) DESC, detection_id) = 1)
SELECT tracks.*, large.largest FROM tracks JOIN large USING (video, track_id)"""
)
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with times, median box and largest detection."""
    d = detections(spark, sf_dir)
    t = tracks.summaries(d, ["video", "track_id"])
    large = d.groupBy("video", "track_id").agg(F.max_by("detection_id", F.struct(G.area(F.col("bbox")), -F.col("detection_id"))).alias("largest"))
    return t.join(large, ["video", "track_id"]).select("video", "track_id", "n_detections", "first_ms", "last_ms", *[F.col(f"median_box.{c}").alias(c) for c in ("x_min", "y_min", "x_max", "y_max")], "largest")


TOP = "quality DESC, confidence DESC, detection_id"


def _order() -> list:
    return [F.desc("quality"), F.desc("confidence"), F.col("detection_id")]


@query(f"{WITH} SELECT track_id, detection_id, row_number() OVER (PARTITION BY track_id ORDER BY {TOP})::INT AS rank FROM detections WHERE quality >= 0.05 QUALIFY rank <= 3")
def topk_crops_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).where("quality >= 0.05")
    return ranking.top_k(d, ["track_id"], _order(), 3).select("track_id", "detection_id", "rank")


@query(
    f"""{WITH}, spans AS (SELECT *, min(timestamp_ms) OVER (PARTITION BY track_id) AS a, max(timestamp_ms) OVER (PARTITION BY track_id) AS z FROM detections),
placed AS (SELECT *, least(floor((timestamp_ms - a) * 5 / (z - a + 1)::DOUBLE), 4) AS bucket FROM spans),
best AS (SELECT *, row_number() OVER (PARTITION BY track_id, bucket ORDER BY {TOP}) = 1 AS is_best FROM placed)
SELECT track_id, detection_id, row_number() OVER (PARTITION BY track_id ORDER BY is_best DESC, {TOP})::INT AS rank FROM best QUALIFY rank <= 4"""
)
def temporal_diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return ranking.temporal_diverse_top_k(d, ["track_id"], "timestamp_ms", _order(), 4, 5).select("track_id", "detection_id", "rank")


@query(
    f"""{WITH}, coded AS (SELECT DISTINCT track_id FROM detections WHERE label = 'purchase'),
kept AS (SELECT * FROM detections WHERE track_id NOT IN (SELECT track_id FROM coded) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY {TOP}) <= 2)
SELECT track_id, detection_id, quality FROM kept ORDER BY {TOP} LIMIT 180"""
)
def capped_without_code_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps per track and in all, over tracks without code evidence (here: a purchase)."""
    d = detections(spark, sf_dir)
    coded = d.where("label = 'purchase'").select("track_id")
    return ranking.capped(d, ["track_id"], _order(), 2, 180, coded).select("track_id", "detection_id", "quality")


@query(
    f"""{WITH}, ranked AS (SELECT video, label, detection_id, confidence, lead(confidence) OVER w AS next, row_number() OVER w AS r FROM detections
  WINDOW w AS (PARTITION BY video, label ORDER BY confidence DESC, detection_id))
SELECT video, label, detection_id, confidence, round(confidence - next, 6) AS margin FROM ranked WHERE r = 1"""
)
def runner_up_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return ranking.runner_up(d, ["video", "label"], "confidence", "detection_id").withColumn("margin", F.round("margin", 6))


@query(
    f"""{WITH}, placed AS (SELECT video, detection_id, row_number() OVER (PARTITION BY video ORDER BY timestamp_ms, detection_id) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM detections)
SELECT video, detection_id FROM placed WHERE n <= 12 OR i IN (SELECT floor(j * (n - 1) / 11) FROM range(12) t(j))"""
)
def sample_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return ranking.sample_evenly(d, ["video"], [F.col("timestamp_ms"), F.col("detection_id")], 12).select("video", "detection_id")


@query(f"{WITH} SELECT video, track_id, detection_id, row_number() OVER (PARTITION BY video ORDER BY timestamp_ms, detection_id) % 7 = 0 AS held_out FROM detections")
def holdout_every_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return ranking.holdout(d, ["video"], [F.col("timestamp_ms"), F.col("detection_id")], 7).select("video", "track_id", "detection_id", "held_out")


@query(f"{WITH}, frames AS (SELECT detection_id AS frame_index FROM detections) SELECT frame_index, CASE WHEN true THEN round_even(frame_index / 29.97 * 1000, 0)::BIGINT END AS ms FROM frames WHERE frame_index % 6 = 0")
def systematic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames sampled from 29.97 to 5 a second, with their times."""
    frames = detections(spark, sf_dir).select(F.col("detection_id").alias("frame_index"))
    return ranking.systematic(frames, "frame_index", 29.97, 5.0).select("frame_index", G.frame_timestamp_ms(F.col("frame_index"), F.lit(29.97)).alias("ms"))


IOU = """greatest(least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min), 0) * greatest(least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min), 0)::DOUBLE
  / ((a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min)
  - greatest(least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min), 0) * greatest(least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min), 0))"""
BOXED = f"""{TRACKS_SQL}, probes AS (SELECT * FROM tracks WHERE track_id % 2 = 0), gallery AS (SELECT * FROM tracks WHERE track_id % 2 = 1),
pairs AS (SELECT a.video, a.track_id AS probe, b.track_id AS found, {IOU} AS iou FROM probes a JOIN gallery b ON a.video = b.video)"""


def _boxes(spark: SparkSession, sf_dir: str, rest: int, name: str) -> DataFrame:
    """Tracks of one side; every track is on one of the two."""
    return track_table(spark, sf_dir).where(F.col("track_id") % 2 == rest).select("video", F.col("track_id").alias(name), F.col("median_box").alias("bbox"), (F.col("track_id") % 100).alias("day"))


@query(f"WITH {BOXED} SELECT video, probe, found, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.3")
def iou_pairs_within_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = spatial.iou_pairs(_boxes(spark, sf_dir, 0, "probe"), _boxes(spark, sf_dir, 1, "found"), "video", "probe", "found", "bbox", CELL, 0.3)
    return j.withColumn("iou", F.round("iou", 6))


@query(f"WITH {BOXED} SELECT video, probe, arg_max(found, (round(iou, 9), -found)) AS found, round(max(iou), 6) AS iou FROM pairs WHERE iou >= 0.18 GROUP BY video, probe")
def best_iou_per_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = spatial.best_iou(_boxes(spark, sf_dir, 0, "probe"), _boxes(spark, sf_dir, 1, "found"), "video", "probe", "found", "bbox", CELL, 0.18, digits=9)
    return j.withColumn("iou", F.round("iou", 6))


@query(
    f"""WITH {BOXED}, per AS (SELECT video, probe, max(iou) AS best, count(DISTINCT found % 100) FILTER (WHERE iou >= 0.5) AS n FROM pairs WHERE iou > 0 GROUP BY video, probe)
SELECT a.video, a.track_id AS probe, round(coalesce(best, 0), 6) AS best_iou, coalesce(n, 0) AS n_tracks, coalesce(best >= 0.5, false) AS covered
FROM probes a LEFT JOIN per ON per.video = a.video AND per.probe = a.track_id"""
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth boxes with their best overlap and the number of tracks (here: days) that cover them."""
    c = spatial.coverage(_boxes(spark, sf_dir, 0, "probe"), _boxes(spark, sf_dir, 1, "found"), "video", "probe", "found", "day", "bbox", CELL, 0.5)
    return c.withColumn("best_iou", F.round("best_iou", 6))


@query(f"WITH {BOXED} SELECT DISTINCT video, probe FROM pairs WHERE iou >= 0.5")
def reachable_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join: truth boxes with any prediction at IoU 0.5."""
    a, b = _boxes(spark, sf_dir, 0, "probe"), _boxes(spark, sf_dir, 1, "found")
    return spatial.reached(a, b, "video", "probe", "bbox", CELL, 0.5)


@query(
    f"""WITH {TRACKS_SQL} SELECT a.video, a.track_id, b.track_id AS r_track_id, round({IOU}, 6) AS iou, b.first_ms - a.last_ms AS gap FROM tracks a JOIN tracks b
  ON a.video = b.video AND b.first_ms > a.last_ms AND b.first_ms - a.last_ms <= {GAP} WHERE {IOU} > 0"""
)
def gap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fragments of one video, one after the other within the gap, whose boxes meet."""
    p = spatial.gap_pairs(track_table(spark, sf_dir), "video", "track_id", "first_ms", "last_ms", GAP, "median_box", 128)
    p = p.withColumn("iou", G.iou(F.col("median_box"), F.col("r_median_box"))).where("iou > 0")
    return p.select("video", "track_id", "r_track_id", F.round("iou", 6).alias("iou"), (F.col("r_first_ms") - F.col("last_ms")).alias("gap"))


def _edge_sql(score: str, extra: str) -> str:
    return f"""WITH RECURSIVE {TRACKS_SQL},
raw AS (SELECT a.video, a.track_id AS l, b.track_id AS r, {IOU} AS iou, b.first_ms - a.last_ms AS gap,
  sqrt(pow((a.x_min + a.x_max - b.x_min - b.x_max) / 2.0, 2) + pow((a.y_min + a.y_max - b.y_min - b.y_max) / 2.0, 2)) / greatest(1.0,
  (sqrt(pow(a.x_max - a.x_min, 2) + pow(a.y_max - a.y_min, 2)) + sqrt(pow(b.x_max - b.x_min, 2) + pow(b.y_max - b.y_min, 2))) / 2) AS far,
  abs((a.y_min + a.y_max) / 2.0 - (b.y_min + b.y_max) / 2.0) / greatest(1.0, (a.y_max - a.y_min + b.y_max - b.y_min) / 2) AS dy,
  least((a.x_max - a.x_min) * (a.y_max - a.y_min), (b.x_max - b.x_min) * (b.y_max - b.y_min)) / greatest((a.x_max - a.x_min) * (a.y_max - a.y_min), (b.x_max - b.x_min) * (b.y_max - b.y_min)) AS size
  FROM tracks a JOIN tracks b ON a.video = b.video AND b.first_ms > a.last_ms AND b.first_ms - a.last_ms <= {GAP}),
edges AS (SELECT *, {score} AS score FROM raw WHERE {extra})"""


UNIT = "greatest(0.0, least({}, 1.0))".format
SLOT = _edge_sql(
    f"0.30 * {UNIT('iou / 0.10')} + 0.25 * {UNIT('1 - far / 0.55')} + 0.20 * {UNIT('1 - dy / 0.35')} + 0.15 * {UNIT('size')} + 0.10 * {UNIT(f'1 - gap / {GAP}::DOUBLE')}",
    "(iou >= 0.10 OR far <= 0.55) AND dy <= 0.35 AND size >= 0.45",
)


@query(f"{SLOT} SELECT video, l AS track_id, r AS r_track_id, round(score, 6) AS score FROM edges WHERE score >= 0.72")
def slot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spatial.gap_pairs(track_table(spark, sf_dir), "video", "track_id", "first_ms", "last_ms", GAP, "median_box", 128)
    return spatial.slot_edges(p, "median_box", "first_ms", "last_ms", GAP).select("video", "track_id", "r_track_id", F.round("score", 6).alias("score"))


@query(
    _edge_sql(f"0.35 * iou + 0.25 * {UNIT('1 - dy / 0.35')} + 0.20 * {UNIT('1 - far / 0.70')} + 0.10 * size + 0.10 * {UNIT(f'1 - gap / {GAP}::DOUBLE')}", "dy <= 0.35 AND far <= 0.70")
    + " SELECT video, l AS track_id, r AS r_track_id, round(score, 6) AS score FROM edges WHERE score >= 0.82"
)
def tracklet_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spatial.gap_pairs(track_table(spark, sf_dir), "video", "track_id", "first_ms", "last_ms", GAP, "median_box", 128)
    return spatial.tracklet_edges(p, "median_box", "first_ms", "last_ms", GAP).select("video", "track_id", "r_track_id", F.round("score", 6).alias("score"))


@query(
    f"""{SLOT}, links AS (SELECT l AS u, r AS v FROM edges WHERE score >= 0.72), ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM ways UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u),
heads AS (SELECT u, least(min(v), u) AS component FROM reach GROUP BY u)
SELECT track_id, coalesce(component, track_id) AS component FROM tracks LEFT JOIN heads ON heads.u = tracks.track_id"""
)
def slot_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments joined into slots by connected components of accepted edges."""
    t = track_table(spark, sf_dir)
    p = spatial.gap_pairs(t, "video", "track_id", "first_ms", "last_ms", GAP, "median_box", 128)
    e = spatial.slot_edges(p, "median_box", "first_ms", "last_ms", GAP)
    groups = connected_components(e, "track_id", "r_track_id").withColumnRenamed("node", "track_id")
    return t.select("track_id").join(groups, "track_id", "left").select("track_id", F.coalesce("component", "track_id").alias("component"))


@query(
    f"""{SLOT}, links AS (SELECT l AS u, r AS v FROM edges WHERE score >= 0.72), ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM ways UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u),
heads AS (SELECT u, least(min(v), u) AS component FROM reach GROUP BY u),
member AS (SELECT tracks.*, coalesce(component, track_id) AS component FROM tracks LEFT JOIN heads ON heads.u = tracks.track_id),
firsts AS (SELECT video, component, min((first_ms, y_min, x_min, track_id)) AS head FROM member GROUP BY video, component),
numbered AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY head) AS n FROM firsts)
SELECT video, track_id, component, printf('slot_%05d', n) AS slot FROM member JOIN numbered USING (video, component)"""
)
def slot_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots numbered by first time, place and member."""
    t = track_table(spark, sf_dir)
    e = spatial.slot_edges(spatial.gap_pairs(t, "video", "track_id", "first_ms", "last_ms", GAP, "median_box", 128), "median_box", "first_ms", "last_ms", GAP)
    order = [F.col("first_ms"), F.col("median_box.y_min"), F.col("median_box.x_min"), F.col("track_id")]
    return tracks.merge_fragments(t, e, "video", "track_id", order)


@query(
    f"""{WITH}, reserved AS (SELECT video, detection_id AS i FROM detections WHERE label = 'purchase' AND quality > 0.9)
SELECT video, detection_id FROM detections d WHERE NOT EXISTS (SELECT 1 FROM reserved r WHERE r.video = d.video AND abs(r.i - d.detection_id) <= 12)"""
)
def reserved_range_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    reserved = d.where("label = 'purchase' and quality > 0.9").select("video", "detection_id")
    return spatial.outside_reserved(d.select("video", "detection_id"), reserved, "video", "detection_id", 12)


@query(
    f"""{WITH}, targets AS (SELECT detection_id AS target, video, timestamp_ms AS seek_ms FROM detections WHERE label = 'error'),
frames AS (SELECT video, timestamp_ms, detection_id FROM detections WHERE label = 'view')
SELECT target, t.video, seek_ms, f.timestamp_ms, detection_id FROM targets t ASOF JOIN frames f ON t.video = f.video AND t.seek_ms >= f.timestamp_ms WHERE seek_ms - f.timestamp_ms <= {HOUR}"""
)
def asof_frame_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest frame at or before each target, an hour back at most."""
    d = detections(spark, sf_dir)
    targets = d.where("label = 'error'").select(F.col("detection_id").alias("target"), "video", F.col("timestamp_ms").alias("seek_ms"))
    frames = d.where("label = 'view'").select("video", "timestamp_ms", "detection_id")
    return spatial.seek_back(targets, frames, "video", "seek_ms", "timestamp_ms", HOUR)


@query(
    f"""{WITH}, steps AS (SELECT *, coalesce(timestamp_ms - lag(timestamp_ms) OVER w > {6 * HOUR}, false)::INT AS fresh FROM detections WINDOW w AS (PARTITION BY track_id // 100 ORDER BY timestamp_ms, detection_id)),
numbered AS (SELECT track_id // 100 AS person, timestamp_ms, sum(fresh) OVER (PARTITION BY track_id // 100 ORDER BY timestamp_ms, detection_id) AS session FROM steps)
SELECT person, session::BIGINT AS session, count(*) AS n, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM numbered GROUP BY person, session"""
)
def sessionize_events_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("person", F.expr("track_id div 100"))
    s = tracks.sessions(d, ["person"], "timestamp_ms", "detection_id", 6 * HOUR)
    return s.groupBy("person", "session").agg(F.count("*").alias("n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


def _greedy_sql(group: str, clash: str) -> str:
    """Table `kept` (group, x): items by falling confidence, without those that `clash` (of k, kept before, and d)."""
    box = "{'k': d.detection_id, 'c': d.confidence, 'n': d.label, 'x_min': d.x_min, 'y_min': d.y_min, 'x_max': d.x_max, 'y_max': d.y_max}"
    over = IOU.replace("a.", "k.").replace("b.", "d.")
    return f"""WITH RECURSIVE {DETECTIONS_SQL}, framed AS (SELECT *, {group} AS g FROM detections), ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY confidence DESC, detection_id) AS r FROM framed),
fold(g, r, ks) AS (SELECT g, 1, [{box}] FROM ranked d WHERE r = 1
  UNION ALL SELECT f.g, f.r + 1, CASE WHEN len(list_filter(ks, lambda k: {clash.format(iou=over)})) > 0 THEN ks ELSE list_append(ks, {box}) END FROM fold f JOIN ranked d ON d.g = f.g AND d.r = f.r + 1),
kept AS (SELECT g, unnest(arg_max(ks, r)) AS x FROM fold GROUP BY g)"""


@query(_greedy_sql("track_id // 100 * 1000000 + timestamp_ms // 3600000", "{iou} > 0.9") + " SELECT g AS frame, x.k AS detection_id, x.c AS confidence FROM kept")
def nms_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression among the detections of a frame (one hour of one place)."""
    d = detections(spark, sf_dir).withColumn("frame", F.expr(f"track_id div 100 * 1000000 + timestamp_ms div {HOUR}"))
    return nms.non_max_suppress(d, ["frame"], "detection_id", "confidence", "bbox", 0.9).select("frame", "detection_id", "confidence")


@query(_greedy_sql("track_id", "{iou} >= 0.6 AND k.n = d.label") + " SELECT g AS track_id, x.k AS detection_id FROM kept")
def spatial_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a track that are one thing, unless their names differ."""
    return nms.spatial_dedup(detections(spark, sf_dir), ["track_id"], "detection_id", "confidence", "bbox", "label", 0.6)


@query()
def associate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a user's stream associated with tracks over time."""
    d = detections(spark, sf_dir).select(F.expr("track_id div 100").alias("person"), "detection_id", "timestamp_ms", F.col("detection_id").alias("frame_index"), "confidence", "bbox.*")
    return tracks.associate(d, "person", "person long, detection_id long, track long", max_gap_ms=6 * HOUR)


@query()
def assign_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal assignment of all probe tracks to the gallery tracks of their video by overlap, with what tracks cover besides."""
    p = spatial.iou_pairs(_boxes(spark, sf_dir, 0, "probe"), _boxes(spark, sf_dir, 1, "found"), "video", "probe", "found", "bbox", CELL, 0.18)
    p = p.withColumn("score", F.when(F.col("iou") >= 0.5, 240 + 220 * F.col("iou")).otherwise(70 + 150 * F.col("iou")))
    return assign.assigned(p, "video", "probe", "found", "score", "iou").select("video", "probe", "found", "split")


@query(f"{WITH}, per AS (SELECT (track_id // 100) % 10 AS shelf, detection_id FROM detections) SELECT shelf, count(*) AS n, min(detection_id) AS first FROM per GROUP BY shelf")
def rows_by_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select((F.expr("track_id div 100") % 10).alias("shelf"), "detection_id")
    return d.groupBy("shelf").agg(F.count("*").alias("n"), F.min("detection_id").alias("first"))


@query(
    f"""{WITH}, turned AS (SELECT detection_id, 1100 - y_max AS x_min, x_min AS y_min, 1100 - y_min AS x_max, x_max AS y_max, x_max - x_min AS w, y_max - y_min AS h, x_min AS x0, y_min AS y0, x_max AS x1, y_max AS y1 FROM detections)
SELECT detection_id, x_min, y_min, x_max, y_max, greatest(0, least(x0 - round_even(w * 0.1, 0)::INT, 1920)) AS ex_min, greatest(0, least(y0 - round_even(h * 0.1, 0)::INT, 1100)) AS ey_min,
  greatest(0, least(x1 + round_even(w * 0.1, 0)::INT, 1920)) AS ex_max, greatest(0, least(y1 + round_even(h * 0.1, 0)::INT, 1100)) AS ey_max, (w * h)::BIGINT AS area FROM turned"""
)
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes turned by 90 degrees, and with a margin of a tenth inside the frame."""
    b, w, h = F.col("bbox"), F.lit(1920), F.lit(1100)
    d = detections(spark, sf_dir).select("detection_id", G.rotate(b, 90, w, h).alias("t"), G.expand(b, 0.1, w, h).alias("e"), G.area(b).cast("long").alias("area"))
    return d.select("detection_id", "t.*", *[F.col(f"e.{c}").alias(f"e{c}") for c in ("x_min", "y_min", "x_max", "y_max")], "area")
