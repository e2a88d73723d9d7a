"""Greedy suppression of overlapping boxes, in a fold over each group's boxes in order of score.

A group is one frame or one video's rows, which bounds the array; groups run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.text import ABSENT, collapse


def _greedy(items: Column, clash) -> Column:
    """The items, in order, that clash with none kept before."""
    empty = F.slice(items, F.lit(1), F.lit(0))
    return F.aggregate(items, empty, lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def non_max_suppress(df: DataFrame, group: list[str], key: str, score: str, box: str, threshold: float, most: int | None = None) -> DataFrame:
    """`group`, key, score, box of the boxes kept: by falling score, none over `threshold` IoU with a better one."""
    item = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(box).alias("b"))
    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kept = _greedy(F.col("_items"), lambda a, b: iou(a["b"], b["b"]) > threshold)
    if most is not None:
        kept = F.slice(kept, 1, most)
    return g.select(*group, F.explode(kept).alias("_x")).select(*group, F.col("_x.k").alias(key), (-F.col("_x.s")).alias(score), F.col("_x.b").alias(box))


def spatial_dedup(df: DataFrame, group: list[str], key: str, score: str, box: str, name: str, threshold: float) -> DataFrame:
    """`group`, key of the rows that survive: by falling score, a row goes if a survivor overlaps it (IoU >= threshold) and their names agree (but for letter case and white space) or one has none."""
    named = F.lower(collapse(F.col(name)))
    item = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(box).alias("b"), F.when(named != ABSENT, named).otherwise(F.lit("")).alias("n"))
    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    agree = lambda a, b: (a["n"] == "") | (b["n"] == "") | (a["n"] == b["n"])
    kept = _greedy(F.col("_items"), lambda a, b: (iou(a["b"], b["b"]) >= threshold) & agree(a, b))
    return g.select(*group, F.explode(F.transform(kept, lambda x: x["k"])).alias(key))
