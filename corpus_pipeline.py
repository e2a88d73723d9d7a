"""From raw documents to packed training sequences: the stages, and a run over all of them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and read again as the next stage's docs.

Defined cases, for all stages: columns of other names pass through all but the last, also names that an operator uses. An
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import mixing, ngram_join, packing, quality
from tagloom.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null, empty and very short texts among them. A null language isn't judged by distances. Repeated rows share their fate."""
    return quality.keep_good(docs, quality.PRODUCTION)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id; a null doc_id comes after all others. Texts without words all stay."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as their source's target weight asks; null sources and others that aren't listed are mixed as one. Equal doc_ids draw alike."""
    return mixing.mixed(docs, mixing.PRODUCTION)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a training sequence; a very long one is cut over several, a null or empty text has its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Best-fit packing goes piece by piece; SQL cannot express it. tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
