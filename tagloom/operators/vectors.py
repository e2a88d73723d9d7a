"""Vectors of observations: a robust mean of many, and labels carried to near frames whose vectors correlate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What the median and the mean count in a fused vector.
OF_MEDIAN, OF_MEAN = 0.65, 0.35
DEALS = 16


def fused(df: DataFrame, group: str, vector: str, bins: int = 1024) -> DataFrame:
    """`group`, at (from 0), median, mean, fused: for each component of a group's vectors 0.65 of the median and 0.35 of the mean.

    Medians are exact, without a list of a group's values anywhere. Values fall into equal bins between their least and greatest one, which are
    only counted; then different values are counted in the one or two bins that hold the middle. Both counts combine map-side, so a
    group with a third of all rows costs no task more than another. Vectors may differ in length; null ones and null or NaN components don't count.
    """
    cells = df.select(group, F.posexplode(vector).alias("at", "x")).withColumn("x", F.col("x").cast("double")).where("x is not null and not isnan(x)")
    span = cells.groupBy(group, "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.avg("x").alias("mean"))
    spans = span.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("lo", "hi", "n").alias("s")))).alias("_spans"))
    spans = spans.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).withColumnRenamed(group, "_g")
    dealt = df.withColumn("_deal", F.pmod(F.xxhash64(vector), F.lit(DEALS)).cast("int"))
    dealt = dealt.join(spans, F.col(group).eqNullSafe(F.col("_g")) & (dealt["_deal"] == spans["_deal"])).select(group, "_spans", F.posexplode(vector).alias("at", "x"))
    dealt = dealt.withColumn("x", F.col("x").cast("double")).where("x is not null and not isnan(x)").withColumn("s", F.element_at("_spans", F.col("at")))
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("s.lo")) / width))).otherwise(F.lit(0))
    dealt = dealt.select(group, "at", "x", F.col("s.n").alias("n"), b.cast("int").alias("b"))
    before = Window.partitionBy(group, "at").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "at", "n", "b").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    middle = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("k"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    held = counts.where(middle(low) | middle(high)).select(F.col(group).alias("_g"), F.col("at").alias("_at"), F.col("b").alias("_b"), "before")
    inside = dealt.join(held, F.col(group).eqNullSafe(F.col("_g")) & (F.col("at") == F.col("_at")) & (F.col("b") == F.col("_b")))
    values = inside.groupBy(group, "at", "n", "b", "before", "x").agg(F.count("*").alias("k"))
    upto = Window.partitionBy(group, "at", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.col("before") + F.coalesce(F.sum("k").over(upto), F.lit(0)))
    ends = values.groupBy(group, "at").agg(F.max(F.when(middle(low), F.col("x"))).alias("a"), F.max(F.when(middle(high), F.col("x"))).alias("z"))
    ends = ends.select(F.col(group).alias("_g"), F.col("at").alias("_at"), ((F.col("a") + F.col("z")) / 2).alias("median"))
    j = span.join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col("at") == F.col("_at")))
    return j.select(group, "at", "median", "mean", (OF_MEDIAN * F.col("median") + OF_MEAN * F.col("mean")).alias("fused"))


def centred(vector: Column) -> Column:
    """A vector less its mean, of length 1; null for a flat one and for one with gaps."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    wide = F.transform(vector, lambda x: x.cast("double"))
    moved = lambda a: F.transform(a, lambda x: x - total(a) / F.size(a))
    # Lambdas bind what is used twice, so that it is made once.
    once = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))
    scaled = lambda a: once(F.sqrt(total(F.transform(a, lambda x: x * x))), lambda norm: F.when(norm > 0, F.transform(a, lambda x: x / norm)))
    return once(once(wide, moved), scaled)


def propagated(labelled: DataFrame, frames: DataFrame, on: str, index: str, vector: str, reach: int, least: float, stride: int = 1, reserved: DataFrame | None = None, radius: int = 0) -> DataFrame:
    """`on`, reference, target, correlation: labelled frames and the frames up to `reach` away, by `stride`, whose vectors correlate at `least`.

    Each labelled frame looks for the numbers of its targets, so the join is one of equal numbers and grows with the labelled frames. Targets
    within `radius` of a reserved frame (`on`, `index`) are left out, as are vectors of another length, flat ones and ones with gaps.
    """
    near = F.filter(F.sequence(F.lit(-(reach // stride) * stride), F.lit((reach // stride) * stride), F.lit(stride)), lambda o: o != 0)
    asked = labelled.select(on, F.col(index).alias("reference"), F.size(vector).alias("_n"), centred(F.col(vector)).alias("_a"), F.explode(near).alias("_o"))
    asked = asked.withColumn("target", F.col("reference") + F.col("_o")).drop("_o").where(F.col("_a").isNotNull())
    if reserved is not None:
        around = F.explode(F.sequence(F.col(index) - radius, F.col(index) + radius))
        asked = asked.join(reserved.select(on, around.alias("target")).distinct(), [on, "target"], "left_anti")
    held = frames.select(on, F.col(index).alias("target"), F.size(vector).alias("_m"), centred(F.col(vector)).alias("_b"))
    j = asked.join(held, [on, "target"]).where((F.col("_n") == F.col("_m")) & F.col("_b").isNotNull())
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return j.select(on, "reference", "target", F.inline(F.array(F.struct(dot.alias("correlation"))))).where(F.col("correlation") >= least)
