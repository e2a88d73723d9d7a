from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tagloom.llm import divergence as D

from .helpers import DOCS

RULES = D.AuditRules(least_docs=3, top_terms=4, deals=3)


def plain(docs, r):
    low = str.maketrans(D.CAPITALS, D.CAPITALS.lower())
    groups, df, n = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in df[lang].items() if d >= r.least_docs]
        mine = sorted(s for g, s in groups if g == lang)
        every = Counter({t: sum(n[lang, s][t] for s in mine) for t in kept})

        def p(counts):
            total = sum(counts[t] for t in kept) + r.smoothing * len(kept)
            return {t: 1 + r.scale * (counts[t] + r.smoothing) // total for t in kept}

        share, q = {s: p(n[lang, s]) for s in mine}, p(every)
        for s in mine:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in mine if o != s]
            marked = [(share[s][t] - q[t], t) for t in kept if n[lang, s][t] and share[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", marked, r.top_terms)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(rows[:most])}
    return out


def made(n, seed=5):
    rng = random.Random(seed)
    words = ["Ärger", "ärger", "the", "The", "THE", "of", "x1y", "été", "naïve", "\U0001d518w", "and", "İn", "rare%d"]
    docs = []
    for i in range(n):
        text = rng.choice(["", " ", "\n", None]) if i % 9 == 0 else " ".join((w % i if "%" in w else w) for w in rng.choices(words, k=rng.randint(1, 30)))
        docs.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "a", "b", None, "é"])))
    return docs + [(1, "only here", "xx", "alone"), (2, None, "xx", "other"), *[docs[5]] * 3]


def as_set(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_matches_a_plain_count(spark):
    docs = made(160)
    df = spark.createDataFrame(docs, DOCS).withColumns({"term": F.lit("own"), "N": F.lit(3), "Total": F.lit("x")})
    got, want = as_set(D.audit(df.repartition(5), RULES)), plain(docs, RULES)
    assert got == want
    assert {r for r in got if r[0] == "xx"} == {("xx", "alone", "pair", "other", 0, 1), ("xx", "other", "pair", "alone", 0, 1)}


def test_a_very_long_text_and_sums_beyond_64_bits(spark):
    docs = made(40) + [(99, "The of " * 300_000, "en", "hot")]
    rules = D.AuditRules(least_docs=2, scale=10**9, deals=2)
    assert as_set(D.audit(spark.createDataFrame(docs, DOCS), rules)) == plain(docs, rules)
    # The product of scale and count is above 2 ** 63 here.
    share = spark.range(1).select(D._share(F.lit(10**12), F.lit(3 * 10**12), F.lit(1000), D.PRODUCTION)).head()[0]
    assert share == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 5000)


def test_empty_table(spark):
    assert as_set(D.audit(spark.createDataFrame([], DOCS))) == set()
