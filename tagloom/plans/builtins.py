"""Spark built-ins over the driver's tables, registered because users expect them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import load
from .registry import query

MONEY = "decimal(18,4)"


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity, round(sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE, 2) AS revenue
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(MONEY)
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("quantity"), F.round(F.sum(revenue).cast("double"), 2).alias("revenue"))


@query(
    """SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice::DECIMAL(18,4))::DOUBLE, 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)"""
)
def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    j = load(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double"), 2).alias("total"))


@query(
    """SELECT event_id, round(avg(value::DECIMAL(18,4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::DOUBLE, 4) AS mean5,
  lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"""
)
def moving_avg_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    mean = F.round(F.avg(F.col("value").cast(MONEY)).over(w.rowsBetween(-4, 0)).cast("double"), 4)
    return load(spark, sf_dir, "events").select("event_id", mean.alias("mean5"), F.lag("value").over(w).alias("before"))


@query(
    """(SELECT 'both' AS kind, o_custkey AS k FROM orders INTERSECT SELECT 'both', c_custkey FROM customer) UNION ALL (SELECT 'idle', c_custkey FROM customer EXCEPT SELECT 'idle', o_custkey FROM orders)"""
)
def set_ops_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return tag(o.intersect(c), "both").unionByName(tag(c.subtract(o), "idle"))


@query("SELECT coalesce(o.k, c.k) AS k, o.k IS NOT NULL AS ordered, c.k IS NOT NULL AS known FROM (SELECT DISTINCT o_custkey % 700 AS k FROM orders) o FULL JOIN (SELECT DISTINCT c_custkey % 900 AS k FROM customer) c ON o.k = c.k")
def key_union_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 700).alias("k")).distinct().withColumn("ordered", F.lit(True))
    c = load(spark, sf_dir, "customer").select((F.col("c_custkey") % 900).alias("k")).distinct().withColumn("known", F.lit(True))
    return o.join(c, "k", "full").select("k", F.coalesce("ordered", F.lit(False)).alias("ordered"), F.coalesce("known", F.lit(False)).alias("known"))


@query()
def approx_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text")
def doc_exact_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; texts are compared by 256-bit hashes, so that no text travels."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.md5("text").alias("text_md5"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("text_md5").alias("text_md5"), F.count("*").alias("n")).drop("h")


@query("SELECT doc_id, lang || ' ' || source AS words, 2 AS n FROM documents")
def order_preserving_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    words = F.array_distinct(F.split(F.concat_ws(" ", "lang", "source", "lang", "source"), " "))
    return d.select("doc_id", F.array_join(words, " ").alias("words"), F.size(words).alias("n"))


@query(
    """WITH split AS (SELECT DISTINCT user_id, CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS part FROM events)
SELECT part, count(*) AS n, (SELECT count(*) FROM (SELECT user_id FROM split WHERE part = 'val' INTERSECT SELECT user_id FROM split WHERE part = 'train')) AS shared FROM split GROUP BY part"""
)
def split_disjoint_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by user, and how many users both parts share."""
    s = load(spark, sf_dir, "events").select("user_id", F.when(F.col("user_id") % 5 == 0, F.lit("val")).otherwise(F.lit("train")).alias("part")).distinct()
    both = s.groupBy("user_id").agg(F.countDistinct("part").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared"))
    return s.groupBy("part").agg(F.count("*").alias("n")).join(F.broadcast(both))  # one row on the right


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, event_type || ':' || user_id AS tag FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("tag"))


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 2) AS total FROM events GROUP BY ALL"""
)
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast(MONEY)).cast("double"), 2).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, max(c_acctbal) AS most, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS richest FROM customer GROUP BY c_mktsegment")
def arg_max_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.max("c_acctbal").alias("most"), F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"))


@query("SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 49 GROUP BY s_suppkey")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return load(spark, sf_dir, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))
