"""Queries over the embeddings: fused vectors and labels carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..sources.tables import load
from .registry import query


@query(
    """WITH cells AS (SELECT label, unnest(range(len(embedding)))::INT AS at_, unnest(embedding)::DOUBLE AS x FROM embeddings),
per AS (SELECT label, at_, median(x) AS m, avg(x) AS a FROM cells GROUP BY label, at_)
SELECT label, at_ AS "at", round(m, 6) AS median, round(a, 6) AS mean, round(0.65 * m + 0.35 * a, 6) AS fused FROM per"""
)
def fused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors fused by the median and the mean of their components."""
    f = vectors.fused(load(spark, sf_dir, "embeddings"), "label", "embedding", bins=256)
    return f.select("label", "at", *[F.round(c, 6).alias(c) for c in ("median", "mean", "fused")])


@query(
    """WITH frames AS (SELECT vec_id % 5 AS video, vec_id // 5 AS i, embedding AS e, list_sum(embedding::DOUBLE[]) / len(embedding) AS m FROM embeddings),
moved AS (SELECT video, i, list_transform(e, lambda x: x::DOUBLE - m) AS c FROM frames), reserved AS (SELECT video, i FROM frames WHERE i % 17 = 0),
met AS (SELECT a.video, a.i AS reference, b.i AS target, list_inner_product(a.c, b.c) / sqrt(list_inner_product(a.c, a.c) * list_inner_product(b.c, b.c)) AS r
  FROM moved a JOIN moved b ON b.video = a.video AND a.i % 4 = 1 AND abs(a.i - b.i) BETWEEN 1 AND 12 AND (a.i - b.i) % 2 = 0)
SELECT video, reference, target, round(r, 6) AS correlation FROM met WHERE r >= 0.2 AND NOT EXISTS (SELECT 1 FROM reserved WHERE reserved.video = met.video AND abs(reserved.i - met.target) <= 1)"""
)
def labels_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth frame's label carried to frames around it that look alike, but for those near reserved ones."""
    f = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("video"), F.expr("vec_id div 5").alias("i"), "embedding")
    out = vectors.propagated(f.where("i % 4 = 1"), f, "video", "i", "embedding", 12, 0.2, 2, f.where("i % 17 = 0"), 1)
    return out.withColumn("correlation", F.round("correlation", 6))
