from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tagloom.llm import sharding as S

from .helpers import DOCS, rows


def docs_of(n):
    return [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(n)] + [(None, "n", "en", None), (5, "again", "en", None)]


def test_shards_are_even_gapless_and_mixed(spark):
    docs = docs_of(1000)
    df = spark.createDataFrame(docs, DOCS).withColumn("slot", F.lit("own")).withColumn("_rank", F.lit(1))
    r = S.ShardRules(shards=7, rows_per_cell=90)
    got = rows(S.assign(df, r))
    shards = defaultdict(list)
    for x in got:
        shards[x["shard"]].append(x)
    sizes = sorted(len(v) for v in shards.values())
    assert sorted(shards) == list(range(7)) and sizes[-1] - sizes[0] <= 1
    total = Counter(s for *_, s in docs)
    for v in shards.values():
        assert sorted(x["slot"] for x in v) == list(range(len(v)))
        part = Counter(x["source"] for x in v)
        assert all(abs(part[s] - n / 7) <= 2 for s, n in total.items())
    assert all(x["_rank"] == 1 for x in got)


def test_places_match_a_plain_sort(spark):
    docs = docs_of(500)
    df = spark.createDataFrame(docs, DOCS)
    r = S.ShardRules(shards=6, rows_per_cell=40)
    h = {(x.doc_id, x.source): x.h for x in df.select("doc_id", "source", F.xxhash64(F.lit(r.seed), "doc_id").alias("h")).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    by = defaultdict(list)
    for d, _, _, s in docs:
        by[s].append(d)
    order = []
    for s, ids in by.items():
        ids.sort(key=lambda d: (h[d, s], low(d)))
        order += [((i + 0.5) / len(ids), (s is not None, s or ""), h[d, s], low(d), d) for i, d in enumerate(ids)]
    order.sort()
    n = len(order)
    want = Counter()
    for p, (*_, d) in enumerate(order):
        s = p * r.shards // n
        want[d, s, p - -(-s * n // r.shards)] += 1
    assert Counter((x["doc_id"], x["shard"], x["slot"]) for x in rows(S.assign(df, r))) == want


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a", "en", "s"), (1, "a", "en", "s")], DOCS)
    assert sorted((x["shard"], x["slot"]) for x in rows(S.assign(df))) == [(0, 0), (20, 0)]
    assert S.assign(df.limit(0)).count() == 0
