from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tagloom import plans

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def as_rows(df):
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(str([cell(v) for v in r]) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_query_matches_its_sql(spark, db, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), db.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert as_rows(got) == as_rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry_and_the_rest_work_without_the_llm_folders(tmp_path):
    for p in ("tagloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tagloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [x for x in q if x.startswith('op')] and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_evaluation_takes_every_order(spark):
    from tagloom.plans import readings

    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    p, t = (x.toPandas() for x in readings.labelled_pairs(spark, SF))
    assert len(p) == len(t) == n
    (total,) = plans.queries()["evaluation_totals"](spark, SF).collect()
    assert total.matched + total.unmatched_pred == total.matched + total.unmatched_truth == n

    def iou(a, b):
        w, h = min(a.x_max, b.x_max) - max(a.x_min, b.x_min), min(a.y_max, b.y_max) - max(a.y_min, b.y_min)
        return w * h / (2 * 120 * 80 - w * h) if w > 0 and h > 0 else 0.0

    want = set()
    for video, left in p.groupby("video"):
        right, taken = t[t.video == video].sort_values("truth_id"), set()
        first = {}
        for b in right.itertuples():
            first.setdefault(b.code, b.truth_id)
        for a in left.sort_values("pred_id").itertuples():  # one after the other
            if a.code and first.get(a.code, -1) not in (-1, *taken):
                found = first[a.code]
            else:
                near = [(-x, b.truth_id) for b in right.itertuples() if b.truth_id not in taken and (x := iou(a.bbox, b.bbox)) >= 0.5]
                found = min(near)[1] if near else None
            if found is not None:
                taken.add(found)
                want.add((video, a.pred_id, found))
    got = plans.queries()["evaluate_greedy_match"](spark, SF).collect()
    assert {(r.video, r.pred_id, r.truth_id) for r in got} == want


def test_assignment_takes_every_track(spark):
    from tagloom.plans import observations

    rows = plans.queries()["assign_one_to_one"](spark, SF).collect()
    sides = [{r.probe for r in rows}, {r.found for r in rows}]
    for side in sides:
        assert {k % 3 for k in side} == {0, 1, 2}
    every = {r.track_id for r in observations.track_table(spark, SF).select("track_id").collect()}
    taken = [{r.k for r in observations._boxes(spark, SF, rest, "k").collect()} for rest in (0, 1)]
    assert taken[0] | taken[1] == every and not taken[0] & taken[1]
