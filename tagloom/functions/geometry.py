"""Boxes: struct<x_min,y_min,x_max,y_max>, their overlap, and the scores made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(x_min.alias("x_min"), y_min.alias("y_min"), x_max.alias("x_max"), y_max.alias("y_max"))


def valid(b: Column) -> Column:
    return F.coalesce((b["x_min"] >= 0) & (b["y_min"] >= 0) & (b["x_max"] > b["x_min"]) & (b["y_max"] > b["y_min"]), F.lit(False))


def width(b: Column) -> Column:
    return b["x_max"] - b["x_min"]


def height(b: Column) -> Column:
    return b["y_max"] - b["y_min"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without union."""
    both = overlap(a, b).cast("double")
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def center_x(b: Column) -> Column:
    return (b["x_min"] + b["x_max"]) / 2.0


def center_y(b: Column) -> Column:
    return (b["y_min"] + b["y_max"]) / 2.0


def diagonal(b: Column) -> Column:
    return F.sqrt((width(b) * width(b) + height(b) * height(b)).cast("double"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    return F.sqrt(dx * dx + dy * dy)


def clip(b: Column, frame_width: Column, frame_height: Column) -> Column:
    """The part inside the frame, or null."""
    bound = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    c = box(bound(b["x_min"], frame_width), bound(b["y_min"], frame_height), bound(b["x_max"], frame_width), bound(b["y_max"], frame_height))
    return F.when(valid(c), c)


def expand(b: Column, ratio: float, frame_width: Column, frame_height: Column) -> Column:
    """The box with a margin of `ratio` of its size at each side, inside the frame."""
    dx, dy = F.bround(width(b) * F.lit(ratio), 0).cast("int"), F.bround(height(b) * F.lit(ratio), 0).cast("int")
    return clip(box(b["x_min"] - dx, b["y_min"] - dy, b["x_max"] + dx, b["y_max"] + dy), frame_width, frame_height)


def rotate(b: Column, degrees: int, frame_width: Column, frame_height: Column) -> Column:
    """The box after turning the frame clockwise."""
    if degrees == 0:
        return b
    if degrees == 90:
        return box(frame_height - b["y_max"], b["x_min"], frame_height - b["y_min"], b["x_max"])
    if degrees == 180:
        return box(frame_width - b["x_max"], frame_height - b["y_max"], frame_width - b["x_min"], frame_height - b["y_min"])
    if degrees == 270:
        return box(b["y_min"], frame_width - b["x_max"], b["y_max"], frame_width - b["x_min"])
    raise ValueError("degrees must be 0, 90, 180 or 270")


def yolo_line(b: Column, frame_width: Column, frame_height: Column, label: int = 0) -> Column:
    """`class cx cy w h`, in shares of the frame, with six decimals."""
    return F.format_string(
        f"{label} %.6f %.6f %.6f %.6f",
        (center_x(b) / frame_width).cast("double"),
        (center_y(b) / frame_height).cast("double"),
        (width(b) / frame_width).cast("double"),
        (height(b) / frame_height).cast("double"),
    )


def gap_ms(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    """Time between two intervals; 0 if they overlap."""
    return F.greatest(first_b - last_a, first_a - last_b, F.lit(0))


def size_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.least(area(a), area(b)).cast("double"), F.greatest(area(a), area(b))), F.lit(0.0))


def crop_quality(sharpness: Column, brightness: Column, contrast: Column, glare_ratio: Column, area_ratio: Column) -> Column:
    """A score from 0 to 1 of five measures."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return unit(
        0.35 * unit(sharpness / 500.0)
        + 0.20 * unit(1.0 - F.abs(brightness - 160.0) / 160.0)
        + 0.15 * unit(contrast / 64.0)
        + 0.20 * unit(1.0 - glare_ratio)
        + 0.10 * unit(area_ratio / 0.01)
    )


def preferred_range(v: Column, hard_min: float, preferred_min: float, preferred_max: float, hard_max: float) -> Column:
    """1 in the preferred range, falling to 0 at the hard bounds."""
    return (
        F.when((v <= hard_min) | (v >= hard_max), F.lit(0.0))
        .when(v < preferred_min, (v - hard_min) / (preferred_min - hard_min))
        .when(v > preferred_max, (hard_max - v) / (hard_max - preferred_max))
        .otherwise(F.lit(1.0))
    )


def frame_timestamp_ms(frame_index: Column, fps: Column) -> Column:
    return F.when(fps > 0, F.bround(frame_index / fps * 1000, 0).cast("long"))
