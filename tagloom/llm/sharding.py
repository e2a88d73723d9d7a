"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in the order of a seeded hash. Row r of n gets the fractional rank
(r + 1/2) / n, all rows are sorted by it, and the order is cut into shards whose row counts differ
by one at most. So every shard, and every stretch of one, holds the sources in the proportions of
the whole.

Neither sort goes through one task: rows fall into cells of the hash range (and then of the
fractional rank), counts per cell are summed up, and only rows of one cell are numbered together.
The number of cells follows the input, so a source with a third of all rows is spread as well.

Defined cases: a null source is a source of its own. Rows with equal hashes (repeated doc_ids) go by
doc_id and then by a hash of the row; fully equal rows take either order. Empty tables give no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import boxed, narrow, unboxed

LAW = "rows"


@dataclass(frozen=True)
class ShardRules:
    shards: int = 40
    seed: int = 3
    rows_per_cell: int = 4_000


def _numbered(df: DataFrame, group: list[str], cell: Column, order: list[Column], name: str) -> DataFrame:
    """Adds `name`, the row's place from 0 within `group`, where cells follow each other in that order."""
    df = df.withColumn("_cell", cell)
    counts = df.groupBy(*group, "_cell").agg(F.count("*").alias("_in_cell"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_in_cell").over(before), F.lit(0))).drop("_in_cell")
    counts = counts.toDF(*[f"_g{i}" for i in range(len(group))], "_gcell", "_before")
    same = F.col("_cell") == F.col("_gcell")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy(*group, "_cell").orderBy(*order)
    df = df.withColumn("_in", F.row_number().over(w) - 1).join(counts, same)
    return df.withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before", "_cell", "_gcell", *[f"_g{i}" for i in range(len(group))])


def assign(docs: DataFrame, rules: ShardRules = ShardRules()) -> DataFrame:
    """All rows and columns of `docs`, with `shard` and the row's `slot` in it, gapless from 0."""
    total, k = docs.count(), rules.shards
    cells = max(1, -(-total // rules.rows_per_cell))
    d = boxed(docs, "doc_id", "source")
    d = d.withColumns({"_h": F.xxhash64(F.lit(rules.seed), F.col("k_doc_id")), "_tie": F.xxhash64("_row")})
    order = [F.col("_h"), F.col("k_doc_id"), F.col("_tie")]
    d = _numbered(d, ["k_source"], F.floor((F.col("_h") / float(1 << 64) + 0.5) * cells), order, "_rank")
    sizes = narrow(docs, "source").groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_s")
    d = d.join(sizes, F.col("k_source").eqNullSafe(F.col("_s")))
    d = d.withColumns({"_part": (F.col("_rank") + 0.5) / F.col("_n"), "_all": F.lit(0)})
    d = _numbered(d, ["_all"], F.floor(F.col("_part") * cells), [F.col("_part"), F.col("k_source"), *order], "_at")
    n = max(1, total)
    shard = F.expr(f"_at * {k}L div {n}L")
    # Shard s begins at place ceil(s * n / k).
    first = F.expr(f"((_at * {k}L div {n}L) * {n}L + {k - 1}L) div {k}L")
    return unboxed(d, docs, shard=shard.cast("int"), slot=(F.col("_at") - first).cast("long"))
