"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with share w of the weights and measured size n gets the mean repetition rate
w * epochs * total / n. Each document draws its number of copies by inverting the Poisson
distribution of its source's rate at a uniform number that the seed and its doc_id fix. A rate
above `CHUNK` is the sum of equal smaller ones, each with a draw of its own, so that the table of
the distribution keeps one length. The copies are dealt out and sorted by a hash of seed, doc_id
and copy, which is a uniform shuffle over all partitions.

Defined cases: all sources that the weights don't list, null ones among them, are mixed as one with
the weight `other`, so no source vanishes unless that is 0, and rates stay as few as the weights are,
however many sources there are (a null source counts as "", if that is listed). Null and empty texts
have size 0, get copies as any other; very long texts count by their bytes and are copied whole. Rows
that repeat a doc_id draw the same number. Sources of size 0 give no copies. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import boxed, column_index, unboxed

CHUNK = 8.0
TERMS = 64  # beyond rate 8, more than 64 events have a chance under 1e-33


@dataclass(frozen=True)
class Mixture:
    weights: dict[str, float]
    epochs: float = 1.0
    #: The weight of all other sources together.
    other: float = 0.05
    seed: int = 11


def _uniform(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 as a number from 0 to 1."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k from 0 to TERMS."""
    first = F.exp(-rate)
    state = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state, step, lambda s: s["c"])


def _listed(mixture: Mixture) -> Column:
    """`k_source` if the weights list it, else null, which stands for all others."""
    source = F.coalesce(F.col("k_source").cast("string"), F.lit(""))
    return F.when(source.isin(list(mixture.weights)), source)


def rates(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """`source` (null: all that aren't listed), `rate`, `draws`, `cdf` of every source that gets copies; a row more than the weights list at most."""
    sized = boxed(docs, "source", "text").select(_listed(mixture).alias("source"), F.coalesce(F.octet_length("k_text"), F.lit(0)).alias("b"))
    per = sized.groupBy("source").agg(F.sum("b").cast("double").alias("size"))
    total = per.agg(F.sum("size").alias("total"))
    listed = F.lit(float(mixture.other))
    for name, w in mixture.weights.items():
        listed = F.when(F.col("source") == name, F.lit(float(w))).otherwise(listed)
    per = per.withColumn("weight", listed).where("weight > 0 and size > 0")
    weights = per.agg(F.sum("weight").alias("all_weights"))
    one_row = total.join(F.broadcast(weights))
    per = per.join(F.broadcast(one_row))  # one row, for every source
    rate = F.col("weight") / F.col("all_weights") * mixture.epochs * F.col("total") / F.col("size")
    per = per.select("source", rate.alias("rate")).withColumn("draws", F.ceil(F.col("rate") / CHUNK).cast("int"))
    return per.select("source", "rate", "draws", _distribution(F.col("rate") / F.col("draws")).alias("cdf"))


def replicate(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """Each row of `docs` in as many copies as drawn, with `copy` from 1 and `shuffle_key`, in shuffled order."""
    d = boxed(docs, "source", "doc_id").withColumn("_s", _listed(mixture))
    per = F.broadcast(rates(docs, mixture))  # a row more than the weights list, at most
    d = d.join(per, F.col("_s").eqNullSafe(F.col("source")))
    # A draw's uniform number is made once, before it is compared.
    d = d.withColumn("_u", F.transform(F.sequence(F.lit(1), F.col("draws")), lambda i: _uniform(mixture.seed, F.col("k_doc_id"), i)))
    draw = F.transform("_u", lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    d = d.withColumn("_n", F.aggregate(draw, F.lit(0), lambda a, x: a + x)).where("_n > 0")
    d = d.select("_row", "k_doc_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(str(mixture.seed)), F.coalesce(F.col("k_doc_id").cast("string"), F.lit("")), "copy", F.lit("order")))
    d = d.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return unboxed(d, docs, copy=F.col("copy"), shuffle_key=F.col("shuffle_key"))


def mixed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The copies with the columns of `docs` alone."""
    names = docs.columns
    plain = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    own = {n: F.col(f"_d{column_index(docs, n)}") for n in ("doc_id", "source", "text")}
    return replicate(plain.withColumns(own), mixture).select(*plain.columns).toDF(*names)


#: For the registered query and the pipeline: one hot source is damped, the small ones are raised.
PRODUCTION = Mixture({"src0": 0.1, **{f"src{i}": round(0.02 + 0.003 * i, 3) for i in range(1, 20)}}, epochs=1.0)


def oracle_sql(m: Mixture = PRODUCTION) -> str:
    listed = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in m.weights.items())
    pool = f"CASE WHEN coalesce(source, '') IN ({', '.join(repr(k) for k in m.weights)}) THEN coalesce(source, '') END"
    unit = f"('0x' || substr(md5(concat_ws('|', '{m.seed}', coalesce(doc_id::VARCHAR, ''), draw::VARCHAR)), 1, 13))::BIGINT::DOUBLE / {1 << 52}"
    return f"""
WITH RECURSIVE weights(source, weight) AS (VALUES {listed}, (NULL, {m.other!r}::DOUBLE)),
pooled AS (SELECT *, {pool} AS pool FROM documents),
sizes AS (SELECT pool, sum(coalesce(strlen(text), 0))::DOUBLE AS size FROM pooled GROUP BY 1),
grand AS (SELECT sum(size) AS total FROM sizes),
chosen AS (SELECT coalesce(pool, '<others>') AS source, size, weight FROM sizes JOIN weights ON pool IS NOT DISTINCT FROM weights.source WHERE weight > 0 AND size > 0),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM chosen) * {m.epochs!r}::DOUBLE * total / size AS rate FROM chosen, grand),
chunks AS (SELECT source, ceil(rate / {CHUNK!r}::DOUBLE)::INT AS draws, rate / ceil(rate / {CHUNK!r}::DOUBLE) AS part FROM rates),
cdf AS (
  SELECT source, part, 0 AS k, exp(-part) AS p, exp(-part) AS c FROM chunks
  UNION ALL SELECT source, part, k + 1, p * part / (k + 1), c + p * part / (k + 1) FROM cdf WHERE k < {TERMS}),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT pooled.*, unnest(range(1, draws + 1)) AS draw, cs
  FROM pooled JOIN chunks ON coalesce(pool, '<others>') = chunks.source JOIN tables ON tables.source = chunks.source),
counted AS (SELECT *, len(list_filter(cs, lambda x: x <= {unit})) AS n FROM drawn),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM (
  SELECT doc_id, text, lang, source, n_chars, sum(n)::INT AS n FROM counted GROUP BY doc_id, text, lang, source, n_chars))
SELECT *, md5(concat_ws('|', '{m.seed}', coalesce(doc_id::VARCHAR, ''), copy::VARCHAR, 'order')) AS shuffle_key FROM copies
"""
