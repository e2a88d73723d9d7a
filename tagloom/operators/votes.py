"""Votes and consensus: one value per group from many readings.

Ties go to the value that was seen first, by an explicit ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import has_value, output_value, vote_value

AMOUNT = "decimal(24,6)"


def _top(df: DataFrame, group: list[str], score: Column, first: Column, value: Column) -> Column:
    """The value with the greatest score, then the least `first`."""
    return F.max_by(value, F.struct(score, -first))


def weighted_vote(votes: DataFrame, group: list[str], field: str = "field", value: str = "value", weight: str = "weight", ord: str = "ord") -> DataFrame:
    """`group`, field, value (first spelling of the winner), weight: the value with the greatest total weight per field."""
    v = votes.withColumn("_n", vote_value(F.col(field), F.col(value))).where(has_value(F.col("_n")))
    per = v.groupBy(*group, field, "_n").agg(
        F.sum(F.col(weight).cast(AMOUNT)).alias("_w"), F.min(ord).alias("_o"), F.min_by(F.trim(F.col(value)), F.col(ord)).alias("_raw")
    )
    best = F.max_by(F.struct(output_value(F.col("_raw")).alias("value"), F.col("_w").alias("weight")), F.struct("_w", -F.col("_o")))
    return per.groupBy(*group, field).agg(best.alias("_b")).select(*group, field, F.col("_b.value").alias("value"), F.col("_b.weight").alias("weight"))


def as_maps(winners: DataFrame, group: list[str]) -> DataFrame:
    """One map of fields per group."""
    return winners.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def mode(df: DataFrame, group: list[str], value: str, ord: str, support: int = 1) -> DataFrame:
    """`group`, value, n: the most frequent value with at least `support` readings."""
    per = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*group, value).agg(F.count("*").alias("n"), F.min(ord).alias("_o"))
    best = per.where(F.col("n") >= support).groupBy(*group).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_o"))).alias("_b"))
    return best.select(*group, F.col(f"_b.{value}").alias(value), F.col("_b.n").alias("n"))


def position_consensus(df: DataFrame, group: list[str], value: str, ord: str, length: int) -> DataFrame:
    """`group`, value: per place the most frequent character among readings of `length` characters."""
    full = df.where(F.length(value) == length)
    at = full.select(*group, ord, F.posexplode(F.split(F.col(value), "")).alias("_p", "_c"))
    per = at.groupBy(*group, "_p", "_c").agg(F.count("*").alias("_n"), F.min(ord).alias("_o"))
    best = per.groupBy(*group, "_p").agg(F.max_by(F.col("_c"), F.struct("_n", -F.col("_o"))).alias("_c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_c"))), lambda x: x["_c"]), "")
    return best.groupBy(*group).agg(joined.alias(value))


def ean13_consensus(df: DataFrame, group: list[str], value: str, ord: str) -> DataFrame:
    """`group`, code: places voted among valid, completed and repaired readings; if that is invalid, their mode."""
    d = codes.digits(F.col(value))
    whole = F.when(F.length(d) == 12, F.concat(d, codes.check_digit(d))).when(F.length(d) == 13, codes.repair_one_digit(d)).otherwise(F.lit(""))
    good = df.withColumn("_code", whole).where(codes.ean13_ok(F.col("_code"))).select(*group, ord, "_code")
    voted = position_consensus(good, group, "_code", ord, 13).withColumnRenamed("_code", "_voted")
    usual = mode(good, group, "_code", ord).drop("n")
    return usual.join(voted, group).select(*group, F.when(codes.ean13_ok(F.col("_voted")), F.col("_voted")).otherwise(F.col("_code")).alias("code"))


def sku_consensus(df: DataFrame, group: list[str], value: str, ord: str) -> DataFrame:
    """`group`, sku, method, confidence, n: two equal readings (0.94), else places of three with prefix 27 or 37 (0.86), else rejected."""
    counted = df.groupBy(*group).agg(F.count("*").alias("_all"))
    usual = mode(df, group, value, ord).select(*group, F.col(value).alias("_mode"), F.col("n").alias("_n"))
    voted = position_consensus(df, group, value, ord, 12).select(*group, F.col(value).alias("_voted"))
    j = counted.join(usual, group, "left").join(voted, group, "left")
    exact = F.coalesce(F.col("_n") >= 2, F.lit(False))
    placed = (F.col("_all") >= 3) & F.coalesce(F.col("_voted").rlike(r"^[23]7\d{10}$"), F.lit(False))
    return j.select(
        *group,
        F.when(exact, F.col("_mode")).when(placed, F.col("_voted")).otherwise(F.lit("")).alias("sku"),
        F.when(exact, F.lit("exact_majority")).when(placed, F.lit("position_vote")).otherwise(F.lit("insufficient_support")).alias("method"),
        F.when(exact, F.lit(0.94)).when(placed, F.lit(0.86)).otherwise(F.lit(0.0)).alias("confidence"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n"),
    )


def idf(tokens: DataFrame, name: str, token: str, total: DataFrame) -> DataFrame:
    """`token`, df, idf = ln(1 + N / df), for the one-row frame `total` with N as `n`."""
    per = tokens.groupBy(token).agg(F.countDistinct(name).alias("df"))
    return per.join(F.broadcast(total)).select(token, "df", F.log1p(F.col("n") / F.col("df")).alias("idf"))  # one row on the right
