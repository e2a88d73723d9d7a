from __future__ import annotations

import random

from pyspark.sql import functions as F

from tagloom.llm import url_filter as U
from tagloom.operators.components import connected_components

from .helpers import rows

PAGES = "page_id long, url string, html string"


def judged(spark, pages, rules=U.QUERY_RULES, edges=None):
    return {r["page_id"]: r for r in rows(U.judge(spark.createDataFrame(pages, PAGES), rules, edges))}


def test_hosts_paths_and_rules(spark):
    got = judged(
        spark,
        [
            (1, "HTTP://A.Example.NET/en/x?q#f", None), (2, "http://b.example.net/EN/x", None), (3, "https://example.com/de/1", None), (4, "x.org/fr/", None), (5, None, None),
            (6, "https://ÄB.org/fr/z?u=http://a.net/", None), (7, "http://net", None), (8, "http://badexample.net/en/", None), (9, "http://q.com#/de/", None), (10, "http://x.net/", None), (11, "", None),
        ],
    )
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(1, 12)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("b.example.net", "/EN/x", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("Äb.org", "/fr/z", "org/fr/", "allow"), ("net", "", None, "allow"), ("badexample.net", "/en/", "net/", "block"), ("q.com", "", None, "allow"), ("x.net", "/", "net/", "block"), ("", "", None, "allow"),
    ]


def test_redirects_and_canonical_links_carry_blocks(spark):
    pages = [
        (1, "http://mirror.com/a", '<HEAD><link href="https://bad.net/a" REL="canonical"></HEAD>'),
        (2, "http://other.com/b", '<meta http-equiv=refresh content="0; url=http://mirror.com/a">'),
        (3, "https://other.com/b#frag", None),
        (4, "http://safe.com/c", '<link rel=canonical href="/c2">'),
        (5, "http://mixed.com/d", '<link rel="canonical" href="//x.net/d"><meta http-equiv="refresh" content="5;URL=https://x.org/fr/d">'),
        (6, "https://www.track.com/p.html?utm_source=z&id=3", None),
        (7, "http://track.com/p?id=3", '<meta http-equiv="refresh" content="0;url=http://q.net/">'),
        (7, "http://track.com/p?id=3", '<meta http-equiv="refresh" content="0;url=http://q.net/">'),
    ]
    got = judged(spark, pages)
    assert {k: v["verdict"] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block"}
    extra = spark.createDataFrame([("http://safe.com/c2", "http://e.net/"), (None, "http://e.net/")], "src string, dst string")
    assert judged(spark, pages, edges=extra)[4]["verdict"] == "block"


def test_links_are_read_as_browsers_do(spark):
    canon, moved = (lambda x: f"<link rel=canonical {x}>"), (lambda x: f'<meta http-equiv="refresh" content="{x}">')
    cases = [
        (canon('href="/login?next=http://bad.net/y"'), "://h.com/login?next=http://bad.net/y", None),
        (moved("0;url='http://bad.net/y'"), None, "://bad.net/y"),
        (moved("3, http://bad.net/y"), None, "://bad.net/y"),
        ("<meta content='1; URL=\"//bad.net/y\"' http-equiv=Refresh>", None, "://bad.net/y"),
        (canon('data-href="u" href="http://bad.net/y"'), "://bad.net/y", None),
        (canon('title="a > b href=z" href=http://x.com/y rel2=z'), "://x.com/y", None),
        ('<link rel="alternate Canonical" href="?q=2&amp;r=3">', "://h.com/a/b?q=2&r=3", None),
        (canon('href="#top"'), "://h.com/a/b?i=1", None),
        (canon('href="../x/./y/../z"'), "://h.com/x/z", None),
        (canon('href="../../../.."'), "://h.com/", None),
        (canon('href="c d"'), "://h.com/a/c d", None),
        ('<base href="https://base.org/k/">' + canon("href=m"), "://base.org/k/m", None),
        (canon('href="mailto:a@b.c"'), None, None),
        (moved("5"), None, None),
        ("<!-- " + canon("href=http://bad.net/") + " --><script>'" + canon("href=http://bad.net/") + "'</script>", None, None),
        ('<linked rel=canonical href="http://bad.net/"><a rel=canonical href="http://bad.net/">refresh</a>', None, None),
        ("canonical " + "<p>x</p>" * 20_000 + canon("href='http://x.com/long'"), "://x.com/long", None),
    ]
    df = spark.createDataFrame([(i, "http://h.com/a/b?i=1", h) for i, (h, _, _) in enumerate(cases)], PAGES)
    found = U.declared_links(df.toDF("page_id", "k_url", "k_html"))
    got = sorted(tuple(r) for r in found.select("page_id", U.node_of(F.col("_canon")), U.node_of(F.col("_moved"))).collect())
    assert got == [(i, c, m) for i, (_, c, m) in enumerate(cases)]


def test_verdicts_change_through_chains_of_three_links(spark):
    refresh = lambda to: f'<meta http-equiv="refresh" content="0; url=\'{to}\'">'
    pages = [
        (1, "http://one.com/", refresh("http://two.com/")), (2, "http://two.com/", '<link rel="canonical" href="http://three.com/">'),
        (3, "http://three.com/", refresh("http://bad.net/")), (4, "http://good.com/", refresh("http://better.com/")),
        (5, "http://shop.com/a", refresh("http://shop.com/b")), (6, "http://shop.com/b", refresh("http://evil.net/")),
        (7, "http://evil.net/", refresh("http://x.org/fr/home")), (8, None, refresh("http://bad.net/")),
    ]
    got = judged(spark, pages)
    # An allowed address in the component takes precedence for all its aliases without a rule.
    assert {k: v["verdict"] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow"}
    alone = judged(spark, [(i, u, None) for i, u, _ in pages])
    assert {k for k in got if got[k]["verdict"] != alone[k]["verdict"]} == {1, 2, 3}


def test_names_in_another_case_and_with_dots(spark):
    df = spark.createDataFrame([("old", 1, "http://a.net/", "", 5, "HT")], "`URL` string, page_id long, url string, html string, `a.b` int, `HTML` string")
    got = U.judge(df, U.QUERY_RULES)
    assert got.columns == ["URL", "page_id", "url", "a.b", "HTML", "host", "path", "rule", "verdict"]
    assert tuple(got.head()) == ("old", 1, "http://a.net/", 5, "HT", "a.net", "/", "net/", "block")


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "")], PAGES).withColumn("host", F.lit("own")).withColumn("node", F.lit(3))
    (r,) = rows(U.judge(df, U.QUERY_RULES))
    assert (r["host"], r["node"], r["verdict"]) == ("a.net", 3, "block")
    assert U.judge(df.limit(0), U.QUERY_RULES).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2100)] + [(7, 7), (None, 3)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in rows(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b"))}
    assert got == {x: find(x) for x in parent}
