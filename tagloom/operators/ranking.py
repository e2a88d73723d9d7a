"""Top-K, caps, even samples and hold-outs. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. The planner keeps k rows per task before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def temporal_diverse_top_k(df: DataFrame, group: list[str], time: str, order: list[Column], k: int, buckets: int) -> DataFrame:
    """The best row of each time bucket first (by quality among them), then the best of the rest, k rows in all."""
    span = Window.partitionBy(*group)
    first, last = F.min(time).over(span), F.max(time).over(span)
    place = F.floor((F.col(time) - first) * buckets / (last - first + 1))
    d = df.withColumn("_bucket", F.least(place, F.lit(buckets - 1)))
    d = d.withColumn("_best", (F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) == 1).cast("int"))
    w = Window.partitionBy(*group).orderBy(F.desc("_best"), *order)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_bucket", "_best")


def capped(df: DataFrame, group: list[str], order: list[Column], per_group: int, total: int, skip: DataFrame | None = None) -> DataFrame:
    """At most `per_group` rows a group and `total` rows in all, in one order; rows whose group is in `skip` don't count."""
    if skip is not None:
        df = df.join(skip, group, "left_anti")
    return top_k(df, group, order, per_group).drop("rank").orderBy(*order).limit(total)


def selected(df: DataFrame, group: list[str], order: list[Column], per_group: int, total: int, then: list[Column]) -> DataFrame:
    """The rows of `capped` with their `place` in a last order, that of frames; as many rows as `total` at most are put in it."""
    return capped(df, group, order, per_group, total).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*then)))


def runner_up(df: DataFrame, group: list[str], score: str, key: str) -> DataFrame:
    """`group`, best key, best score, margin to the second (null if alone)."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), F.col(key))
    d = df.withColumns({"_r": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_r = 1")
    return d.select(*group, key, score, (F.col(score) - F.col("_next")).alias("margin"))


def sample_evenly(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """Rows at `limit` evenly spaced places of each group, first and last among them; all rows of a smaller group."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*group))})
    picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(max(limit - 1, 1))))
    return d.where((F.col("_n") <= limit) | F.array_contains(picks, F.col("_i").cast("long"))).drop("_i", "_n")


def holdout(df: DataFrame, group: list[str], order: list[Column], stride: int) -> DataFrame:
    """Adds `held_out`: every stride-th row of each group, if the group has that many."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("held_out", F.row_number().over(w) % stride == 0)


def systematic(frames: DataFrame, index: str, source_fps: float, sample_fps: float, most: int | None = None) -> DataFrame:
    """Every k-th frame, k being the rounded ratio of rates (half to even), the first `most` of them."""
    step = max(1, round(source_fps / sample_fps))
    kept = frames.where(F.col(index) % step == 0)
    return kept if most is None else kept.orderBy(index).limit(most)


def surest_order(confidence: str, ord: str) -> list[Column]:
    """The final order of rows: by falling confidence (none comes last), equals as they came."""
    return [F.desc_nulls_last(confidence), F.col(ord)]


def surest_first(rows: DataFrame, confidence: str, ord: str) -> DataFrame:
    """All rows in their final order, by a sort over ranges, so no task holds them all."""
    return rows.orderBy(*surest_order(confidence, ord))
