from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest

from tagloom.llm import mixing, ngram_join, packing, quality_sql

from .helpers import prose
from .test_mixing import brute as brute_mix
from .test_ngram_join import brute as brute_near
from .test_packing import naive


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(12)
    docs = [(i, prose(rng, rng.randint(5, 200)), "en", f"src{rng.randrange(4) * rng.randrange(2)}") for i in range(220)]
    for i in range(0, 60, 3):
        w = docs[i][1].split()
        w[len(w) // 2] = "changed"
        docs.append((300 + i, " ".join(w) if i % 2 else docs[i][1], "en", "src1"))
    docs += [(500, None, "en", "src0"), (501, "", None, None), (502, " ".join("%%%" + str(i) for i in range(150)), "en", "src2"), (503, prose(rng, 9000), "en", "src3")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(a, b, c, d, len(b or "")) for a, b, c, d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder), docs


def test_run_matches_brute_force_stages(spark, table):
    folder, docs = table
    got = corpus_pipeline.run(spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_sql.oracle_sql()}) WHERE kept").fetchall()}
    assert 502 not in good and 500 not in good and len(good) > 150
    kept = [d for d in docs if d[0] in good]
    heads = {d for d, c, _, _ in brute_near(kept) if d == c}
    assert len(heads) < len(kept)
    kept = [d for d in kept if d[0] in heads]
    counts = brute_mix(kept, mixing.PRODUCTION)
    text = {d: t for d, t, _, _ in docs}
    r = packing.PackRules()
    want, lengths = Counter(), []
    for d, n in counts.items():
        size = len(text[d].encode()) + 1
        for piece, start in enumerate(range(0, size, max(r.capacities))):
            want[d, piece, start, min(max(r.capacities), size - start)] += n
            lengths += [min(max(r.capacities), size - start)] * n
    assert Counter((x.doc_id, x.piece, x.start, x.n_tokens) for x in got) == +want
    used = defaultdict(int)
    for x in got:
        used[x.sequence, x.capacity] += x.n_tokens
    assert sum(lengths) < r.group_tokens  # one packing group
    assert sorted((c, u) for (_, c), u in used.items()) == naive(sorted(lengths, reverse=True), r)


def test_stages_take_and_return_documents(spark, table):
    folder, _ = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    assert ngram_join.ForestRules().words == 5 and ngram_join.ForestRules().similarity == 0.8


def test_an_empty_table_and_clashing_names_go_through(spark, table, tmp_path):
    folder, docs = table
    df = spark.read.parquet(f"{folder}/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    odd = df.where("doc_id in (3, 303, 500, 501)").selectExpr("*", "1 as kept", "'k' as key", "2 as copy", "cast(null as string) as rate", "3 as class_id", "4 as sequence")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        assert all((r.kept, r.key, r.copy, r.rate, r.class_id, r.sequence) == (1, "k", 2, None, 3, 4) for r in out.collect()), name
    assert corpus_pipeline.pack_sequences(spark, odd, folder).count() == 4
