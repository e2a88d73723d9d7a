from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import ngram_join as N

from .helpers import DOCS, prose, rows


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    norm = [" ".join((t or "").lower().split()) for _, t, _, _ in docs]
    texts = {}
    for (d, *_), t in zip(docs, norm):
        if t:
            texts.setdefault(t, []).append(d)
    keys = list(texts)
    sets = [shingles(t) for t in keys]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(keys)
    for i in range(len(keys)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        r = find(i)
        least[r] = min(least.get(r, min(texts[k])), min(texts[k]))
    of = {k: (least[find(i)], links[i], len(texts[k])) for i, k in enumerate(keys)}
    return sorted(((d, *(of[t] if t else (d, 0, 1))) for (d, *_), t in zip(docs, norm)), key=str)


def corpus():
    rng = random.Random(8)
    docs = []
    for _ in range(12):
        base = prose(rng, rng.randint(3, 220)).split()
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma", "delta"])
            docs.append(" ".join(w) if rng.random() < 0.8 else "  ".join(w).upper())
    shared = prose(rng, 60)
    docs += [f"{shared} {prose(rng, 90)}" for _ in range(15)]
    docs += ["", None, "   ", "one", "One ", "two words", prose(rng, 30_000)]
    docs.append(docs[-1] + " end")
    return [(i, t, "en", "s") for i, t in enumerate(docs)]


@pytest.mark.parametrize("rules", [N.ForestRules(), N.ForestRules(block_rows=5, block_shingles=2000), N.ForestRules(block_rows=4, pivot_rows=3, pivot_sample=5, leaders=1)])
def test_classes_and_links_match_brute_force(spark, rules):
    docs = corpus()
    df = spark.createDataFrame(docs, DOCS).withColumn("key", F.lit("own")).withColumn("class_id", F.lit(1))
    got = N.near_duplicates(df, rules).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=str) == brute(docs)


def test_one_document_of_each_class_stays(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, DOCS)
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    want = {d for d, c, _, _ in brute(docs) if d == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_repeated_rows_nulls_and_empty(spark):
    docs = [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (1, "q r s t u v", "en", "s"), (None, "a b c d e f g", "en", "s")]
    df = spark.createDataFrame(docs, DOCS)
    got = rows(N.near_duplicates(df))
    assert sorted(x["n_copies"] for x in got) == [1, 3, 3, 3]
    assert sorted((r.doc_id, r.text[0]) for r in N.keep_one(df).collect()) == [(1, "a"), (1, "q")]
    assert N.near_duplicates(df.limit(0)).count() == 0 and N.keep_one(df.limit(0)).count() == 0


def test_prefixes_are_shortened_until_the_target_recall():
    assert N.ForestRules(depth=5, target_recall=0.5).stop == 5 and N.ForestRules(target_recall=0.5).stop == 8
    r = N.ForestRules()
    assert r.stop == 4 and r.recall(r.stop) >= r.target_recall > r.recall(r.stop + 1)


def test_a_node_is_walked_from_the_longest_runs_and_left_when_joined(monkeypatch):
    asked = []
    real = N._leader_links
    monkeypatch.setattr(N, "_leader_links", lambda sig, block, least, tree: asked.append(len(sig)) or real(sig, block, least, tree))
    sig = np.zeros((6, 40), np.uint8)
    sig[3:] = 9
    rest = np.array([[1], [1], [1], [2], [2], [3]], np.uint8)  # runs of three, two and one
    a, b = N._walk(sig, rest, None, 0.55)
    assert asked == [3, 2, 6]  # the longest runs, then the node, whose texts aren't joined yet
    edges = set(zip(a.tolist(), b.tolist()))
    assert len(edges) == 4 and all(sig[i, 0] == sig[j, 0] for i, j in edges)
    asked.clear()
    N._walk(np.zeros((4, 40), np.uint8), np.ones((4, 1), np.uint8), None, 0.55)
    assert asked == [4]  # all agree in all values: not shortened


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = random.Random(77)
    docs, wanted = [], 0
    for i in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(90, 400))]
        n, k = len(w) - 4, 0
        # k words changed at the end lose k shingles on either side.
        while (n - k - 1) / (n + k + 1) >= 0.8:
            k += 1
        other = w[: len(w) - k] + [f"v{rng.randrange(10**6)}" for _ in range(k)]
        share = len(shingles(" ".join(w)) & shingles(" ".join(other))) / len(shingles(" ".join(w)) | shingles(" ".join(other)))
        assert 0.8 <= share < 0.85
        wanted += 1
        docs += [(2 * i, " ".join(w), "en", "s"), (2 * i + 1, " ".join(other), "en", "s")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    met = sum(got[2 * i] == got[2 * i + 1] == (2 * i, 1) for i in range(300))
    assert met / wanted >= 0.99


def test_very_long_texts_at_exactly_the_threshold_are_linked():
    # c shared shingles and sizes that sum to 9c/4: similarity exactly 0.8.
    for c in (9_116, 12_000, 40_000, 400_000):
        for less in (0, 1):  # one shared shingle less, in texts of the same sizes
            own = c // 4 // 2 + less, c // 4 - c // 4 // 2 + less
            shared = np.arange(c - less, dtype=np.uint64)
            a, b = (np.concatenate([shared, np.arange(at, at + k, dtype=np.uint64)]) for at, k in zip((1_000_000, 2_000_000), own))
            assert len(a) + len(b) == 9 * c // 4
            degree, _, _ = N._exact_pairs([a, b, np.arange(3_000_000, 3_000_010, dtype=np.uint64)], None, 0.8)
            assert degree.tolist() == ([0, 0, 0] if less else [1, 1, 0]), (c, less)


def test_slices_of_a_few_words():
    for texts in (["w"], ["two words"], ["one two three"], ["a b c d"], ["a b c d e"], [""], ["", "x"]):
        hashes, bounds = N.shingle_hashes(pa.array(texts), 5)
        assert np.diff(bounds).tolist() == [1 if t else 0 for t in texts] and len(hashes) == bounds[-1]
        # The same text gets the same shingle beside a longer one.
        beside, at = N.shingle_hashes(pa.array([*texts, "q r s t u v w x"]), 5)
        assert beside[: bounds[-1]].tolist() == hashes.tolist() and at[len(texts)] == bounds[-1]


def test_small_tables_and_short_texts_before_very_long_ones(spark):
    rng = random.Random(14)
    tables = [["two words"], ["one two three"], ["a b c d", "a b c d"]]
    tables.append(["two words", " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10**6)) for _ in range(200_000)), "one two three"])
    assert len(tables[-1][1]) > N.SLICE_BYTES
    for texts in tables:
        docs = [(i, t, "en", "s") for i, t in enumerate(texts)]
        got = N.near_duplicates(spark.createDataFrame(docs, DOCS).coalesce(1)).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=str) == brute(docs)


def test_a_class_of_near_copies_of_all_distances(spark):
    """Texts close to the pivot, whose links are counted, and farther ones, which are compared by their differences."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    docs = []
    for i in range(240):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", f"v{rng.randrange(10**6)}"])
        docs.append((i, " ".join(w), "en", "s"))
    for rules in (N.ForestRules(), N.ForestRules(block_rows=40, pivot_rows=30, pivot_sample=21, leaders=2)):
        got = N.near_duplicates(spark.createDataFrame(docs, DOCS), rules).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=str) == brute(docs)


def test_texts_too_close_to_the_pivot_to_be_compared():
    rules = N.ForestRules()
    pivot = np.arange(100, dtype=np.uint64)
    sets = [pivot, pivot[:95], np.concatenate([pivot[5:], np.arange(500, 504, dtype=np.uint64)]), pivot[:60]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["c"] * 5), pa.array([None, "a", "b", "c", "d"]), pa.array([None, *[x.tobytes() for x in sets]], pa.binary()), pa.array([pivot.view(np.int64).tolist(), None, None, None, None], pa.list_(pa.int64()))],
        names=["component", "key", "shingles", "pivot"],
    )
    got = next(N._differences(rules)([batch])).to_pylist()
    assert [(x["size"], x["lost"], x["whole"], x["home"], len(x["shingles"]) // 8) for x in got] == [(100, 0, 100, True, 0), (95, 5, 100, True, 5), (99, 5, 100, True, 9), (60, 40, 100, False, 40)]
    differences = [np.frombuffer(x["shingles"], np.uint64) for x in got]
    size, lost = (np.array([x[k] for x in got]) for k in ("size", "lost"))
    whole = N._exact_pairs(sets, None, 0.8)
    apart = N._exact_pairs(differences, None, 0.8, size, lost, 100)
    assert whole[0].tolist() == apart[0].tolist() == [2, 2, 2, 0]
