"""Crops and frames: building, caps, banks, scores, zones, sampling, and the camera's geometry."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

# Confidence of decoders and what a picture's variant adds.
DECODER_BASE = {"opencv_qr_detector": 0.68, "pyzbar": 0.78}
DECODER_OTHER = 0.82
VARIANT_BONUS = {
    "original": 0.00,
    "grayscale": 0.02,
    "clahe": 0.05,
    "sharpened": 0.04,
    "resized_x2": 0.08,
    "resized_x3": 0.09,
    "resized_x4": 0.10,
    "adaptive_threshold": 0.03,
}
# Zones of a tag as shares of its width and height (x1, y1, x2, y2), and where a tag lies in its padded crop.
ZONES = {
    "product_name": (0.00, 0.00, 0.66, 0.34),
    "price_default": (0.60, 0.24, 1.00, 0.48),
    "price_card": (0.22, 0.44, 1.00, 0.92),
    "discount": (0.00, 0.48, 0.34, 0.92),
    "additional_info": (0.14, 0.28, 0.62, 0.50),
    "sku_date": (0.00, 0.78, 0.58, 1.00),
    "barcode": (0.34, 0.82, 1.00, 1.00),
    "special": (0.26, 0.83, 0.48, 0.99),
}
PAD_FROM, PAD_SPAN, SLACK = 0.097, 0.806, 0.025


def candidates(detections: DataFrame, width: int, height: int, padding: float, least: tuple[int, int], per_frame: int, total: int) -> DataFrame:
    """Crops (crop_id, detection_id, frame_index, bbox, padded_bbox, width, height) of detections, best first in each frame.

    Boxes are clipped, padded and clipped again; those outside and too small ones don't count for the caps of a frame and of all.
    """
    inside = G.clip(F.col("bbox"), F.lit(width), F.lit(height))
    d = detections.withColumn("_in", inside).where("_in is not null")
    d = d.withColumn("padded_bbox", G.expand(F.col("_in"), padding, F.lit(width), F.lit(height)))
    p = F.col("padded_bbox")
    d = d.withColumns({"width": (p["x_max"] - p["x_min"]).cast("int"), "height": (p["y_max"] - p["y_min"]).cast("int")}).where((F.col("width") >= least[0]) & (F.col("height") >= least[1]))
    w = Window.partitionBy("frame_index").orderBy(F.desc("confidence"), "detection_id")
    d = d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_frame)
    d = d.orderBy("frame_index", "_n").limit(total)
    return d.select(F.format_string("frame_%06d_crop_%06d", "frame_index", "_n").alias("crop_id"), "detection_id", "frame_index", F.col("_in").alias("bbox"), "padded_bbox", "width", "height")


def frame_rank_ids(detections: DataFrame, prefix: str, by: list[str], order: list[Column]) -> DataFrame:
    """Adds `rank` (from 1 in each frame) and `made_id`, which holds the frame and the rank."""
    d = detections.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return d.withColumn("made_id", F.format_string(f"{prefix}_%06d_%03d", F.col(by[-1]).cast("long"), F.col("rank")))


def bank(crops: DataFrame, most_tracks: int, least_crops: int) -> DataFrame:
    """track_id, crop_id, place (from 1) of the crops of the tracks with most crops, best quality first; tracks with few are left out after the cap."""
    sizes = crops.groupBy("track_id").agg(F.count("*").alias("n_crops"))
    chosen = sizes.orderBy(F.desc("n_crops"), "track_id").limit(most_tracks).where(F.col("n_crops") >= least_crops)
    w = Window.partitionBy("track_id").orderBy(F.desc("quality"), "crop_id")
    return crops.join(chosen, "track_id").withColumn("place", F.row_number().over(w)).select("track_id", "crop_id", "place", "n_crops")


def views(crops: DataFrame, group: str, most: int) -> DataFrame:
    """The crops of a group with the best quality less a quarter of their glare, then by area, then by little glare; with their `place`."""
    w = Window.partitionBy(group).orderBy(F.desc(F.col("quality") - 0.25 * F.col("glare_ratio")), F.desc("area"), F.asc("glare_ratio"), "crop_id")
    return crops.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def decoder_confidence(decoder: Column, variant: Column) -> Column:
    base, bonus = F.lit(DECODER_OTHER), F.lit(0.0)
    for name, c in DECODER_BASE.items():
        base = F.when(decoder == name, F.lit(c)).otherwise(base)
    for name, c in VARIANT_BONUS.items():
        bonus = F.when(variant == name, F.lit(c)).otherwise(bonus)
    bonus = F.when(variant.startswith("rotated_"), F.lit(0.08)).when(variant.startswith("tilt_"), F.lit(0.04)).otherwise(bonus)
    return F.least(base + bonus, F.lit(0.95))


def box_of_points(points: Column, scale_x: Column, scale_y: Column, rotation: Column) -> Column:
    """The box around corner points (array of struct x, y) found in a scaled picture; null if that was turned, or without points or area."""
    x, y = (F.transform(points, lambda p: p[c] / F.greatest(s, F.lit(1e-6))) for c, s in (("x", scale_x), ("y", scale_y)))
    b = G.box(F.floor(F.array_min(x)).cast("int"), F.floor(F.array_min(y)).cast("int"), F.ceil(F.array_max(x)).cast("int"), F.ceil(F.array_max(y)).cast("int"))
    good = (F.abs(rotation) <= 1e-6) & (b["x_min"] >= 0) & (b["y_min"] >= 0) & (b["x_max"] > b["x_min"]) & (b["y_max"] > b["y_min"])
    return F.when(F.coalesce(good, F.lit(False)), b)


def zone_boxes(crops: DataFrame, key: str, width: str, height: str) -> DataFrame:
    """key, zone, bbox: the pixels of each zone of a padded crop, a little wider than the zone."""
    low = lambda v: max(0.0, PAD_FROM + PAD_SPAN * v - SLACK)
    high = lambda v: min(1.0, PAD_FROM + PAD_SPAN * v + SLACK)
    zones = F.array(*[F.struct(F.lit(k).alias("zone"), *[F.lit(f(v)).alias(n) for n, f, v in zip("abcd", (low, low, high, high), z)]) for k, z in ZONES.items()])
    d = crops.select(key, width, height, F.explode(zones).alias("z"))
    px = lambda share, size: F.floor(F.col(f"z.{share}") * F.col(size)).cast("int")
    x1, y1 = px("a", width), px("b", height)
    return d.select(key, F.col("z.zone").alias("zone"), G.box(x1, y1, F.greatest(px("c", width), x1 + 1), F.greatest(px("d", height), y1 + 1)).alias("bbox"))


def band_texts(blocks: DataFrame, key: str, band: tuple[float, float, float], text: str = "text", ord: str = "ord") -> DataFrame:
    """key, texts of the blocks whose place is in a band (least y, greatest y, greatest x, as shares of the crop), in order."""
    lo, hi, right = band
    inside = (F.col("rel_y") >= lo) & (F.col("rel_y") < hi) & (F.col("rel_x") < right)
    return blocks.where(inside).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]).alias("texts"))


#: Bands of the fine print and of the product's name.
FINE_PRINT, NAME_BAND = (0.60, 1.01, 1.01), (0.03, 0.46, 0.70)


def _ramp(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(0.0), F.least((value - lo) / (hi - lo), F.lit(1.0)))


def candidate_score(f: dict[str, Column], aspect: tuple[float, float] = (1.5, 9.5), area: tuple[float, float] = (0.00008, 0.12)) -> Column:
    """How much a region looks like a tag: eight weighted features less a penalty for glare, from 0 to 1."""
    total = (
        0.22 * _ramp(f["rectangularity"], 0.45, 0.98)
        + 0.18 * G.preferred_range(f["aspect_ratio"], aspect[0], 2.2, 6.2, aspect[1])
        + 0.08 * G.preferred_range(f["area_ratio"], area[0], max(area[0] * 3.0, 0.0004), min(area[1] * 0.35, 0.03), area[1])
        + 0.14 * _ramp(f["white_ratio"], 0.18, 0.82)
        + 0.10 * _ramp(f["accent_ratio"], 0.01, 0.16)
        + 0.12 * _ramp(f["edge_density"], 0.02, 0.18)
        + 0.12 * _ramp(f["text_like"], 0.0, 1.0)
        + 0.06 * G.preferred_range(f["center_y"], 0.0, 0.35, 0.88, 1.0)
        - 0.10 * _ramp(f["glare_ratio"], 0.10, 0.70)
    )
    return F.greatest(F.lit(0.0), F.least(total, F.lit(1.0)))


def rejection_reason(f: dict[str, Column], area: tuple[float, float] = (0.00008, 0.12), aspect: tuple[float, float] = (1.5, 9.5), least_rectangularity: float = 0.32) -> Column:
    """Why a region can't be a tag, the first reason that holds; empty if it may be one. Bounds themselves pass."""
    return (
        F.when(f["area_ratio"] < area[0], "area_too_small")
        .when(f["area_ratio"] > area[1], "area_too_large")
        .when(f["aspect_ratio"] < aspect[0], "aspect_ratio_too_small")
        .when(f["aspect_ratio"] > aspect[1], "aspect_ratio_too_large")
        .when(f["rectangularity"] < least_rectangularity, "low_rectangularity")
        .otherwise("")
    )


def orientation(mode: Column) -> Column:
    """struct(mode, warning): none given turns by 90 degrees counterclockwise, an unknown one doesn't turn and is warned of."""
    given = F.trim(F.coalesce(mode, F.lit("")))
    known = given.isin("none", "rotate_90_cw", "rotate_90_ccw", "rotate_180")
    missing = F.coalesce(mode, F.lit("")) == ""
    chosen = F.when(known, given).when(missing, "rotate_90_ccw").otherwise("none")
    warning = F.when(known | missing, "").otherwise(F.concat(F.lit("Unknown orientation_mode '"), mode, F.lit("'. Falling back to 'none'.")))
    return F.struct(chosen.alias("mode"), warning.alias("warning"))


def motion_sampled(frames: DataFrame, index: str, motion: str, fps: float, dense_fps: float, sparse_fps: float, low: float = 7.5, high: float = 24.0) -> DataFrame:
    """Frames of the sparse rhythm, and those of the dense one that move little (no motion known counts as little), with `tick`."""
    step = lambda rate: max(int(round(fps / rate)), 1)
    sparse, dense = F.col(index) % step(sparse_fps) == 0, F.col(index) % step(dense_fps) == 0
    calm = F.col(motion).isNull() | (F.col(motion) <= max(low, high))
    return frames.where(sparse | (dense & calm)).withColumn("tick", F.when(sparse, F.lit("sparse")).otherwise(F.lit("dense")))


def manifest(sampled: DataFrame, group: str, index: str, time: str) -> DataFrame:
    """group, n, first and last index and time of the sampled frames, and a checksum of which they are; bounded whatever their number."""
    return sampled.groupBy(group).agg(
        F.count("*").alias("n"), F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.bit_xor(F.crc32(F.col(index).cast("string").cast("binary"))).alias("checksum")
    )


def listed(sampled: DataFrame, group: str, index: str, block: int = 100_000) -> DataFrame:
    """The sampled frames with their `place` (from 1) in their group: counted by blocks of numbers first, so that no task orders a whole video."""
    d = sampled.withColumn("_block", F.floor(F.col(index) / block))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(group, "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    d = d.join(per, [group, "_block"]).withColumn("_in", F.row_number().over(Window.partitionBy(group, "_block").orderBy(index)))
    return d.withColumn("place", (F.col("_before") + F.col("_in")).cast("int")).drop("_block", "_n", "_before", "_in")


def frames_at(targets: DataFrame, frames: DataFrame, on: str, index: str) -> DataFrame:
    """Targets with their frame, by number; those outside their video's frames have status `out_of_range`, missing ones `missing`."""
    bounds = frames.groupBy(on).agg(F.max(index).alias("_most"))
    j = targets.join(bounds, on, "left").join(frames.withColumn("_hit", F.lit(True)), [on, index], "left")
    outside = F.coalesce((F.col(index) < 0) | (F.col(index) > F.col("_most")), F.lit(True))
    return j.withColumn("status", F.when(outside, F.lit("out_of_range")).when(F.col("_hit"), F.lit("found")).otherwise(F.lit("missing"))).drop("_most", "_hit")


@dataclass(frozen=True)
class Camera:
    """A lens with radial and tangential distortion (Brown and Conrady), and the turned picture cut from the undistorted one.

    `focus` and `middle` are those of the raw picture, `new_focus` and `new_middle` of the undistorted one, from which `origin` and `size` are cut.
    """

    width: int
    height: int
    focus: tuple[float, float]
    middle: tuple[float, float]
    new_focus: tuple[float, float]
    new_middle: tuple[float, float]
    distortion: tuple[float, float, float, float, float]
    origin: tuple[int, int]
    size: tuple[int, int]
    turned: bool = True

    @staticmethod
    def of_lens(width: int, height: int, focal_mm: float, diagonal_mm: float, distortion: tuple[float, float, float, float, float]) -> Camera:
        aspect = width / height
        h = diagonal_mm / math.sqrt(aspect**2 + 1.0)
        f = (focal_mm * width / (aspect * h), focal_mm * height / h)
        m = (width / 2.0, height / 2.0)
        return Camera(width, height, f, m, f, m, distortion, (0, 0), (width, height))

    def distorted(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Where a ray (x, y at depth 1) falls in units of the focal length."""
        k1, k2, p1, p2, k3 = self.distortion
        r = x * x + y * y
        radial = 1 + r * (k1 + r * (k2 + r * k3))
        return x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y

    def to_raw(self, df: DataFrame, box: str, out: str) -> DataFrame:
        """Adds the raw box around a processed one: turned back, shifted, distorted, and kept inside the frame."""
        b = F.col(box)
        corners = F.array(*[F.struct(b[x].cast("double").alias("x"), b[y].cast("double").alias("y")) for x, y in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))])
        plain = (lambda p: (F.lit(float(self.size[0])) - p["y"], p["x"])) if self.turned else (lambda p: (p["x"], p["y"]))

        def ray(p: Column) -> Column:
            x, y = plain(p)
            return F.struct(((x + self.origin[0] - self.new_middle[0]) / self.new_focus[0]).alias("x"), ((y + self.origin[1] - self.new_middle[1]) / self.new_focus[1]).alias("y"))

        def pixel(p: Column) -> Column:
            x, y = self.distorted(p["x"], p["y"])
            inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, F.lit(most - 1.0)))
            return F.struct(inside(x * self.focus[0] + self.middle[0], self.width).alias("x"), inside(y * self.focus[1] + self.middle[1], self.height).alias("y"))

        d = df.withColumn("_p", F.transform(F.transform(corners, ray), pixel))
        xs, ys = F.transform("_p", lambda p: p["x"]), F.transform("_p", lambda p: p["y"])
        return d.withColumn(out, G.box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).drop("_p")

    def from_raw(self, df: DataFrame, x: str, y: str, rounds: int = 40) -> DataFrame:
        """Adds processed_x, processed_y of raw points: the distortion is undone by a fold of fixed-point steps, all in one expression."""
        k1, k2, p1, p2, k3 = self.distortion
        u, v = (F.col(x) - self.middle[0]) / self.focus[0], (F.col(y) - self.middle[1]) / self.focus[1]
        d = df.withColumn("_s", F.struct(u.alias("x"), v.alias("y")))

        def step(s: Column, i: Column) -> Column:
            a, b = s["x"], s["y"]
            r = a * a + b * b
            radial = 1 + r * (k1 + r * (k2 + r * k3))
            return F.struct(((F.col("_s.x") - (2 * p1 * a * b + p2 * (r + 2 * a * a))) / radial).alias("x"), ((F.col("_s.y") - (p1 * (r + 2 * b * b) + 2 * p2 * a * b)) / radial).alias("y"))

        d = d.withColumn("_r", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("_s"), step))
        px = F.col("_r.x") * self.new_focus[0] + self.new_middle[0] - self.origin[0]
        py = F.col("_r.y") * self.new_focus[1] + self.new_middle[1] - self.origin[1]
        out = {"processed_x": py, "processed_y": F.lit(float(self.size[0])) - px} if self.turned else {"processed_x": px, "processed_y": py}
        return d.withColumns(out).drop("_s", "_r")
