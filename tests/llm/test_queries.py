from __future__ import annotations

import zlib

import duckdb
import pytest

from tagloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    got = Q.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda df: sorted(str([None if v is None or v != v else v for v in r]) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())
    assert as_rows(got) == as_rows(want)


def test_sharding_query(spark):
    docs = {r.doc_id: r.text or "" for r in Q.table(spark, SF, "documents").collect()}
    got = Q.op7_sharding(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
