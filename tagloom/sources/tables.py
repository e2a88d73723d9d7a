"""The driver's tables, and observation tables derived from them by expressions that SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key, for heavy work on each: a small file, read whole, makes one task or two."""
    return df.repartition(key)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over time from `events`: a video has users, a track is a user's day."""
    e = load(spark, sf_dir, "events")
    x = (F.col("user_id") * 37) % 1800 + (F.col("event_id") % 7) * 3
    y = (F.col("user_id") * 91) % 1000 + (F.col("event_id") % 5) * 2
    w, h = 120 + F.col("user_id") % 30, 80 + F.col("user_id") % 20
    return e.select(
        F.col("event_id").alias("detection_id"),
        (F.col("user_id") % 4).alias("video"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("track_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        box(x, y, x + w, y + h).alias("bbox"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / (F.col("value") + 100))), 4).alias("confidence"),
        F.round((F.col("event_id") * 7919 % 1000) / 1000.0, 3).alias("quality"),
        F.col("event_type").alias("label"),
    )


#: The same in SQL, as the first parts of a WITH clause.
DETECTIONS_SQL = """
detections AS (SELECT event_id AS detection_id, user_id % 4 AS video, user_id * 100 + day(ts) AS track_id, epoch_us(ts) // 1000 AS timestamp_ms,
  (user_id * 37) % 1800 + (event_id % 7) * 3 AS x_min, (user_id * 91) % 1000 + (event_id % 5) * 2 AS y_min,
  (user_id * 37) % 1800 + (event_id % 7) * 3 + 120 + user_id % 30 AS x_max, (user_id * 91) % 1000 + (event_id % 5) * 2 + 80 + user_id % 20 AS y_max,
  round(greatest(0.0, least(1.0, value / (value + 100))), 4) AS confidence, round((event_id * 7919 % 1000) / 1000.0::DOUBLE, 3) AS quality, event_type AS label FROM events)"""


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code of 13 digits per part; every fifth has a wrong digit at place 7."""
    from ..functions.codes import check_digit

    p = load(spark, sf_dir, "part")
    body = (F.col("p_partkey") * 7919 + 270000000000).cast("string")
    p = p.select("p_partkey", "p_name", "p_brand", "p_retailprice", body.alias("body"))
    whole = F.concat("body", check_digit(F.col("body")))
    wrong = F.concat(F.left(whole, F.lit(6)), ((F.substr(whole, F.lit(7), F.lit(1)).cast("int") + 1) % 10).cast("string"), F.substr(whole, F.lit(8)))
    return p.withColumns({"true_code": whole, "code": F.when(F.col("p_partkey") % 5 == 0, wrong).otherwise(whole)})


def _check_sql(code: str) -> str:
    total = " + ".join(f"{3 if i % 2 else 1} * TRY_CAST(substr({code}, {i + 1}, 1) AS INT)" for i in range(12))
    return f"((10 - ({total}) % 10) % 10)::VARCHAR"


CODES_SQL = f"""
bodies AS (SELECT p_partkey, p_name, p_brand, p_retailprice, (p_partkey * 7919 + 270000000000)::VARCHAR AS body FROM part),
whole AS (SELECT *, body || {_check_sql("body")} AS true_code FROM bodies),
codes AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN left(true_code, 6) || ((substr(true_code, 7, 1)::INT + 1) % 10)::VARCHAR || substr(true_code, 8)
  ELSE true_code END AS code FROM whole)"""


def ean_ok_sql(code: str) -> str:
    return f"(regexp_full_match({code}, '[0-9]{{13}}') AND {_check_sql(code)} = right({code}, 1))"
