from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from tagloom.llm import mixing

from .helpers import DOCS, rows


def brute(docs, m):
    size = Counter()
    pool = lambda source: (source or "") if (source or "") in m.weights else None
    for _, text, _, source in docs:
        size[pool(source)] += len((text or "").encode())
    live = {s: w for s, w in {**m.weights, None: m.other}.items() if w > 0 and size[s] > 0}
    out = Counter()
    for doc_id, _, _, source in docs:
        s = pool(source)
        if s not in live:
            continue
        rate = live[s] / sum(live.values()) * m.epochs * sum(size.values()) / size[s]
        draws = math.ceil(rate / mixing.CHUNK)
        for i in range(1, draws + 1):
            u = int(hashlib.md5(f"{m.seed}|{'' if doc_id is None else doc_id}|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = c = math.exp(-rate / draws)
            k = 0
            while c <= u and k <= mixing.TERMS:
                k += 1
                p *= rate / draws / k
                c += p
            out[doc_id] += k
    return out


def test_counts_match_brute_force_and_rates(spark):
    docs = [(i, "x" * (10 + i % 7), "en", "a" if i % 3 else "b") for i in range(900)] + [(None, "nul", "en", "a"), (2000, None, "en", "b"), (2001, "ü", "en", None), (2002, "tiny", "en", "rare")]
    m = mixing.Mixture({"a": 0.5, "b": 0.3, "rare": 0.2, "none": 1.0}, epochs=1.5, other=0.0)
    df = spark.createDataFrame(docs, DOCS)
    got = Counter(r["doc_id"] for r in rows(mixing.replicate(df, m)))
    assert got == +brute(docs, m)
    by = Counter("b" if d is not None and d % 3 == 0 else "a" for d in got.elements() if d is None or d < 900)
    assert 1.2 < by["a"] / by["b"] < 2.2  # weights 5 to 3
    assert got[2002] > 100  # a rate above the chunk


def test_copies_are_whole_and_shuffled(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", "a") for i in range(300)], DOCS).withColumn("copy", F.lit("own")).withColumn("rate", F.lit(1))
    r = rows(mixing.replicate(df, mixing.Mixture({"a": 1.0}, epochs=3.0)))
    assert len({(x["doc_id"], x["copy"]) for x in r}) == len(r) and 700 < len(r) < 1100
    assert all(x["text"] == f"t{x['doc_id']}" and x["rate"] == 1 for x in r)
    kept = mixing.mixed(df, mixing.Mixture({"a": 1.0}))
    assert kept.columns == df.columns and {x["copy"] for x in rows(kept)} == {"own"}
    order = [x["doc_id"] for x in r[:50]]
    assert order != sorted(order)


def test_empty_and_unlisted(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.replicate(df, mixing.PRODUCTION).count() == 0
    df = spark.createDataFrame([(1, "x", "en", "q")], DOCS)
    assert mixing.replicate(df, mixing.Mixture({"a": 1.0}, other=0.0)).count() == 0
    assert mixing.replicate(df, mixing.Mixture({"a": 1.0}, other=0.5, epochs=20.0)).count() > 5


def test_no_source_vanishes(spark, tmp_path):
    """A hot null source and sources that nobody listed, through the registered query, its SQL and the pipeline's stage."""
    import corpus_pipeline
    import duckdb

    from tagloom.llm import queries

    docs = [(i, f"text {i} " * 9, "en", None if i % 3 == 0 else f"new{i}" if i % 3 == 1 else f"src{i % 20}", 9) for i in range(900)]
    df = spark.createDataFrame(docs, DOCS + ", n_chars long")
    df.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op2_mixing_sources(spark, str(tmp_path)))
    count = Counter(r["doc_id"] for r in got)
    assert count == +brute([d[:4] for d in docs], mixing.PRODUCTION)
    by = Counter("null" if r["source"] is None else r["source"][:3] for r in got)
    assert by["null"] > 10 and by["new"] > 10 and 0.02 < (by["null"] + by["new"]) / len(got) < 0.1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.oracle_sql()).df()
    assert sorted(map(str, want[["doc_id", "copy", "shuffle_key"]].itertuples(index=False, name=None))) == sorted(str((r["doc_id"], r["copy"], r["shuffle_key"])) for r in got)
    assert Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, df, "").collect()) == count
