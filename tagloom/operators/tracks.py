"""Tracks: keys, summaries, association over time, merging of fragments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..storage import stored
from .components import connected_components


def track_key(track_id: Column, detection_id: Column) -> Column:
    """The track's id, or the detection's own where that is blank."""
    return F.coalesce(F.nullif(F.trim(track_id.cast("string")), F.lit("")), detection_id.cast("string"))


def summaries(detections: DataFrame, group: list[str], time: str = "timestamp_ms", box: str = "bbox", confidence: str = "confidence", key: str = "detection_id") -> DataFrame:
    """Per track: number, first and last time, median box, the largest detection's box, mean confidence."""
    b = F.col(box)
    middle = G.box(*[F.median(b[c]).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])
    return detections.groupBy(*group).agg(
        F.count("*").alias("n_detections"),
        F.min(time).alias("first_ms"),
        F.max(time).alias("last_ms"),
        middle.alias("median_box"),
        F.max_by(b, F.struct(G.area(b), -F.col(key))).alias("largest_box"),
        F.avg(confidence).alias("mean_confidence"),
    )


def slot_summaries(detections: DataFrame, crops: DataFrame, group: list[str], time: str = "timestamp_ms", box: str = "bbox") -> DataFrame:
    """Boxes and times of a track from its crops, where it has any, else from its detections; `evidence` says which."""
    stats = lambda df, tag: df.groupBy(*group).agg(
        F.min(time).alias(f"{tag}_first"), F.max(time).alias(f"{tag}_last"), G.box(*[F.median(F.col(box)[c]) for c in ("x_min", "y_min", "x_max", "y_max")]).alias(f"{tag}_box"), F.count("*").alias(f"{tag}_n")
    )
    j = stats(detections, "d").join(stats(crops, "c"), group, "left")
    pick = lambda what: F.coalesce(F.col(f"c_{what}"), F.col(f"d_{what}")).alias({"first": "first_ms", "last": "last_ms", "box": "median_box", "n": "n"}[what])
    return j.select(*group, *map(pick, ("first", "last", "box", "n")), F.when(F.col("c_n").isNotNull(), F.lit("crops")).otherwise(F.lit("detections")).alias("evidence"))


def sessions(events: DataFrame, group: list[str], time: str, key: str, gap: int) -> DataFrame:
    """Adds `session` (from 0 per group): a new one begins where more than `gap` lies between neighbours."""
    w = Window.partitionBy(*group).orderBy(time, key)
    fresh = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    d = events.withColumn("_new", F.coalesce(fresh, F.lit(0)))
    return d.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_fragments(tracks: DataFrame, edges: DataFrame, on: str, key: str, order: list[Column], prefix: str = "slot_") -> DataFrame:
    """`on`, `key`, component, slot: connected tracks share a slot; slots are numbered in the order of their first member.

    Slots are numbered within each group of `on`, so that no task holds the components of all.
    """
    groups = connected_components(edges, key, f"r_{key}")
    t = tracks.join(groups.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", F.col(key)))
    heads = t.groupBy(on, "component").agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_head"))
    numbered = heads.withColumn("_n", F.row_number().over(Window.partitionBy(on).orderBy("_head", "component")))
    slot = F.format_string(f"{prefix}%05d", F.col("_n"))
    return t.join(numbered, [on, "component"]).select(on, key, "component", slot.alias("slot"))


def renamed(rows: DataFrame, slots: DataFrame, track: str) -> DataFrame:
    """Rows (detections or crops) with their slot as `track`, and the old track as `source_track_id`."""
    s = slots.select(F.col(track).alias("_old"), "slot")
    j = rows.join(s, F.col(track) == F.col("_old"), "left")
    return j.withColumns({"source_track_id": F.col(track), track: F.coalesce("slot", F.col(track).cast("string"))}).drop("_old", "slot")


def segments(detections: DataFrame, group: str, max_gap_ms: int, rows: int = 50_000) -> DataFrame:
    """Adds `_segment`, rising with time in each group: parts of about so many rows, between which no track lives on, as more than the gap lies there.

    Times are gathered in buckets as wide as the gap, within which nothing is cut; only buckets are put in order. A group with a detection
    without a time stays whole, since such tracks never end.
    """
    time = F.coalesce(F.col("timestamp_ms"), F.col("frame_index")).cast("long")
    d = detections.withColumn("_bucket", F.floor(time / max(max_gap_ms, 1)))
    per = d.groupBy(group, "_bucket").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.max(F.col("timestamp_ms").isNull()).alias("_timeless"), F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_bucket")
    cut = (F.col("_lo") - F.lag("_hi").over(w) > max_gap_ms) & ~F.max("_timeless").over(Window.partitionBy(group))
    # A cut begins a new part if the rows before it have filled the last one.
    per = per.withColumns({"_cut": F.coalesce(cut, F.lit(False)), "_before": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    filled = F.max(F.when(F.col("_cut"), F.floor(F.col("_before") / rows)).otherwise(F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    per = per.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), filled.alias("_segment"))
    return d.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b"))).drop("_g", "_b", "_bucket")


def associate(detections: DataFrame, group: str, schema: str, max_gap_ms: int = 2500, least_score: float = 0.18, rows: int = 50_000) -> DataFrame:
    """detection_id and track of each detection, in order of time, frame and falling confidence: the best open track of its group, or a new one.

    The rule depends on order, but nothing outlives a gap: a group (a video) is cut there and its segments run in tasks of their own. Tracks are
    numbered in each segment and moved on by the number of tracks before it. Columns: detection_id, timestamp_ms, frame_index, confidence, x_min, y_min, x_max, y_max.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        open_tracks, out = OpenTracks(max_gap_ms, least_score), []
        part = in_time_order(part)
        for d in part.itertuples():
            out.append(open_tracks.take(d))
        return pd.DataFrame({group: [key[0]] * len(part), "detection_id": part["detection_id"].to_numpy(), "track": out, "_segment": [key[1]] * len(part)})

    cut = segments(detections, group, max_gap_ms, rows)
    found = stored(cut.groupBy(group, "_segment").applyInPandas(run, f"{schema}, _segment long"), "segments")
    per = found.groupBy(group, "_segment").agg((F.max("track") + 1).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(group).alias("_g"), F.col("_segment").alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    j = found.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_segment") == F.col("_s")))
    return j.select(group, "detection_id", (F.col("track") + F.col("_before")).alias("track"))


def in_time_order(part: pd.DataFrame) -> pd.DataFrame:
    """Rows by time (the frame's number where there is none), frame and falling confidence."""
    time = part["timestamp_ms"].astype("Float64").fillna(part["frame_index"].astype("Float64"))
    return part.assign(_time=time).sort_values(["_time", "frame_index", "confidence", "detection_id"], ascending=[True, True, False, True])


class OpenTracks:
    """Tracks that may still grow: number, last time (or none), last frame and last box of each. Those beyond the gap are dropped as time goes on."""

    def __init__(self, max_gap_ms: int, least_score: float, tracks: list[list] | None = None, n: int = 0):
        self.gap, self.least, self.tracks, self.n = max_gap_ms, least_score, tracks or [], n

    def near(self, track: list, time: float | None, frame: int) -> bool:
        if time is None or track[1] is None:
            return frame >= track[2]
        return 0 <= time - track[1] <= self.gap

    def take(self, d) -> int:
        """The number of the best track that is near enough, of equal ones the oldest; else of a new one."""
        time = None if pd.isna(d.timestamp_ms) else int(d.timestamp_ms)
        box, best, at = (d.x_min, d.y_min, d.x_max, d.y_max), 0.0, None
        if time is not None:  # rows come in order of time, so a track beyond the gap stays beyond it
            self.tracks = [t for t in self.tracks if t[1] is None or time - t[1] <= self.gap]
        for t in self.tracks:
            if self.near(t, time, d.frame_index):
                score = match_score(tuple(t[3:]), box)
                if score > best:
                    best, at = score, t
        if at is None or best < self.least:
            at = [self.n, None, 0, 0, 0, 0, 0]
            self.tracks.append(at)
            self.n += 1
        at[1:] = [time, int(d.frame_index), *map(int, box)]
        return at[0]


def match_score(a: tuple, b: tuple) -> float:
    """IoU, or three quarters of the closeness of centers (0 beyond 0.65 of the longest side)."""
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    scale = max(1.0, *(side for x in (a, b) for side in (x[2] - x[0], x[3] - x[1])))
    far = (((a[0] + a[2] - b[0] - b[2]) / 2) ** 2 + ((a[1] + a[3] - b[1] - b[3]) / 2) ** 2) ** 0.5
    return max(w * h / union if union else 0.0, 0.75 * max(1 - far / max(0.65 * scale, 1.0), 0.0))
