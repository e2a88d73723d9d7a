"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, divergence, html_extract, lm_score, media, mixing, ngram_join, packing, quality, quality_sql, sharding, token_output, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    return chat.digests(chat.format_chats(chat.text_messages(rows.unionByName(more))))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"), mixing.PRODUCTION)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.QUERY_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("key", "class_key")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")
    )
    law, grown = F.lit(sharding.LAW).alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return sharding.assign(docs).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.drop("char_distance", "word_distance")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(table(spark, sf_dir, "documents")), media.DIGESTS)


def op10_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_output.tokenize_to_orc(table(spark, sf_dir, "documents"), token_output.OutputRules(str(tokenizer)))[1]


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_chat_formatting,
        op2_mixing_sources,
        op3_url_filters,
        op4_best_fit_packing,
        op5_ngram_jaccard_join,
        op6_lm_scoring,
        op7_sharding,
        op8_quality_rules,
        op9_media_columns,
        op10_token_output,
        op11_source_divergence,
        op12_html_extraction,
        op13_centroid_clustering,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: not for packing, scoring, media files, CRC-32 checksums, token ids and html."""
    return {
        "op1_chat_formatting": chat.ORACLE_SQL,
        "op2_mixing_sources": mixing.oracle_sql(),
        "op3_url_filters": url_filter.ORACLE_SQL,
        "op5_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op8_quality_rules": quality_sql.oracle_sql(),
        "op11_source_divergence": divergence.oracle_sql(),
        "op13_centroid_clustering": centroids.oracle_sql(),
    }
