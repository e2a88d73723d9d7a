"""Source divergence audit by wide term vectors.

How differently do the sources of a language write? Terms are counted by language, source and term
while texts are scanned, and each kept term of a language is pivoted into one array with a place for
each of the language's sources. Higher-order functions turn counts into smoothed shares and emit what
the term contributes to the distance of every pair of sources; sums combine map-side. So a language's
distances take one pass over its vectors, whatever share of all rows a source holds: nothing is
grouped by source but sums and, behind a limit that Spark applies before the shuffle, the first ranks.

All arithmetic is in whole numbers (decimals of 38 digits before the division), so results don't
depend on the order of rows.

Bounds: a vector is as long as its language has sources, and a term gives half the square of that in
contributions, which is what the result holds as well.

Defined cases: null texts, languages and sources count as empty ones. A source without terms has a
group like any other; a language without kept terms has pairs of value 0. Repeated rows are documents
of their own. Terms of equal value go by their UTF-8 bytes. Very long texts are cut into terms whole.
Empty tables give no rows; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import forget, stored
from .frames import narrow

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class AuditRules:
    #: What stands between terms; whatever lies between two of these is one.
    between: str = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
    least_docs: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    top_terms: int = 50
    #: Parts into which a language's terms are dealt for the join with what is known of its sources.
    deals: int = 64


PRODUCTION = AuditRules()


def _lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def term_counts(docs: DataFrame, rules: AuditRules = PRODUCTION) -> DataFrame:
    """`lang`, `source`, `term`, `n` occurrences and `d` documents with the term."""
    docs = narrow(docs, "text", "lang", "source").fillna("")
    docs = docs.select("lang", "source", F.split(_lowered(F.col("text")), rules.between).alias("terms"))
    # Each document's terms twice: as they occur, and once each.
    lists = F.array(F.struct(F.lit(0).alias("once"), "terms"), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms")))
    each = docs.select("lang", "source", F.inline(lists)).select("lang", "source", "once", F.explode("terms").alias("term")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("once") == 0).alias("n"), F.sum("once").alias("d"))


def kept_vectors(counts: DataFrame, rules: AuditRules = PRODUCTION) -> DataFrame:
    """`lang`, `term`, `cells` (source, n) for terms in enough documents of their language."""
    cells = F.collect_list(F.struct("source", "n")).alias("cells")
    return counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), cells).where(F.col("docs") >= rules.least_docs).drop("docs")


def language_sources(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """`lang`, its kept terms `v`, their occurrences `total`, and `sources` (source, total) in order; a row for each language."""
    groups = narrow(docs, "lang", "source").fillna("").distinct()
    totals = vectors.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    sources = F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources")
    langs = groups.groupBy("lang").agg(sources, F.sum("total").alias("total"))
    return langs.join(vectors.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["v"])


def _share(count: Column, total: Column, v: Column, rules: AuditRules) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * v)), exactly."""
    above = (count + F.lit(rules.smoothing)).cast("decimal(20,0)") * F.lit(rules.scale).cast("decimal(10,0)")
    below = (total + F.lit(rules.smoothing) * v).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def shares(vectors: DataFrame, langs: DataFrame, rules: AuditRules = PRODUCTION) -> DataFrame:
    """`lang`, `term`, `sources` (names), `counts` and shares `p` by source, and the language's share `q`."""
    dealt = langs.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(rules.deals - 1))))
    vectors = vectors.withColumn("deal", F.pmod(F.xxhash64("term"), F.lit(rules.deals)).cast("int"))
    wide = vectors.join(dealt, ["lang", "deal"]).withColumn("by_source", F.map_from_entries("cells"))
    counts = F.transform("sources", lambda s: F.coalesce(F.element_at("by_source", s["source"]), F.lit(0)))
    wide = wide.select("lang", "term", "sources", "total", "v", counts.alias("counts"))
    p = F.zip_with("counts", "sources", lambda n, s: _share(n, s["total"], F.col("v"), rules))
    every = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    return wide.select("lang", "term", F.col("sources.source").alias("sources"), "counts", p.alias("p"), _share(every, F.col("total"), F.col("v"), rules).alias("q"))


def pair_distances(shared: DataFrame, langs: DataFrame) -> DataFrame:
    """`lang`, `source`, `item` (another source), `value`: the sum of the shares' differences, for every ordered pair."""
    after = lambda xs, i: F.slice(xs, i + 2, F.size(xs))
    parts = F.flatten(F.transform("p", lambda x, i: F.transform(after(F.col("p"), i), lambda y: F.abs(x - y))))
    sums = shared.select("lang", F.posexplode(parts).alias("pair", "f")).groupBy("lang", "pair").agg(F.sum("f").alias("value"))
    names = F.col("sources.source")
    pairs = F.flatten(F.transform(names, lambda a, i: F.transform(after(names, i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    named = langs.select("lang", F.posexplode(pairs).alias("pair", "ab")).join(sums, ["lang", "pair"], "left")
    both = F.array(F.struct(F.col("ab.a").alias("source"), F.col("ab.b").alias("item")), F.struct(F.col("ab.b").alias("source"), F.col("ab.a").alias("item")))
    return named.select("lang", F.coalesce("value", F.lit(0)).alias("value"), F.inline(both))


def marked_terms(shared: DataFrame) -> DataFrame:
    """`lang`, `source`, `item` (a term that the source uses more than its language), `value`."""
    cells = F.filter(F.arrays_zip("sources", "counts", "p"), lambda c: (c["counts"] > 0) & (c["p"] > F.col("q")))
    cells = F.transform(cells, lambda c: F.struct(c["sources"].alias("source"), (c["p"] - F.col("q")).alias("value")))
    return shared.select("lang", F.col("term").alias("item"), F.inline(cells))


def audit(docs: DataFrame, rules: AuditRules = PRODUCTION) -> DataFrame:
    """`lang`, `source`, `part` (pair or term), `item`, `value`, `rank` from 1 per group and part, by falling value and then item."""
    vectors = stored(kept_vectors(term_counts(docs, rules), rules), "term-vectors")
    langs = stored(language_sources(docs, vectors), "term-sources")
    shared = shares(vectors, langs, rules)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumns({"part": F.lit(part), "rank": F.row_number().over(w)})
    terms = ranked(marked_terms(shared), "term").where(F.col("rank") <= rules.top_terms)
    both = ranked(pair_distances(shared, langs), "pair").unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
    out = stored(both, "divergence")
    for done in (vectors, langs):
        forget(done)
    return out


def oracle_sql(rules: AuditRules = PRODUCTION) -> str:
    share = f"1 + ({rules.scale}::HUGEINT * ({{n}} + {rules.smoothing})) // ({{total}} + {rules.smoothing} * v)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{CAPITALS.lower()}'), '{rules.between.replace('[', '[^', 1)}')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT row) >= {rules.least_docs}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, {share.format(n="n", total="sum(n) OVER (PARTITION BY lang, source)")} AS p,
  {share.format(n="sum(n) OVER (PARTITION BY lang, term)", total="sum(n) OVER (PARTITION BY lang)")} AS q FROM cells JOIN vocabulary USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS left_source, y.source AS right_source, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.left_source = a.source AND s.right_source = b.source),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {rules.top_terms}"""
