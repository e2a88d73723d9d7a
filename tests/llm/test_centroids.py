from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import centroids as C

TABLE = "vec_id long, embedding array<float>, label int"


def plain(rows, r):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == r.length and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(r.scale * float(np.float32(x))) for x in e]))
    first = sorted(kept, key=lambda t: (hashlib.sha256(f"{r.seed}:{t[0]}".encode()).hexdigest() if t[0] is not None else "z", t[1]))[: r.k]
    cents = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(r.rounds):
        of = [near(v) for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, of) if o == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, near(v), far(v, cents[near(v)])) for i, v in kept]
    return sorted([(i, c, d, sum(x[2] for x in out if x[1] == c), sum(x[2] for x in out), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out], key=str)


def made(n, r, seed=1):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(r.length)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.4))) for c in rng.choice(centers)]) for i in range(n)]
    rows += [(i + n, [0.25] * r.length) for i in range(n // 3)]  # one large group of copies
    bad = [[], [0.0] * (r.length - 1), [math.nan] + [0.0] * (r.length - 1), [math.inf] + [0.0] * (r.length - 1), [None] + [0.0] * (r.length - 1), None]
    return rows + [(5, rows[9][1]), (None, rows[4][1])] + [(-i, b) for i, b in enumerate(bad)]


def got(spark, rows, r, parts=3):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], TABLE).withColumns({"cluster": F.lit("own"), "v": F.lit(1), "Upper": F.lit(2)})
    out = C.cluster(df.repartition(parts), r)
    return sorted([tuple(x) for x in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=str)


@pytest.mark.parametrize("k, groups, rounds", [(8, 3, 10), (12, 4, 3), (3, 1, 2)])
def test_same_as_comparing_with_every_centroid(spark, k, groups, rounds):
    r = C.ClusterRules(k=k, groups=groups, rounds=rounds, length=6)
    rows = made(150, r, seed=k)
    assert got(spark, rows, r) == plain(rows, r)


def test_few_equal_and_no_vectors(spark):
    r = C.ClusterRules(length=4)
    rows = [(i, [0.5, -0.5, 0.0, 1.0]) for i in range(3)]
    assert got(spark, rows, r) == plain(rows, r)
    assert {x[1] for x in got(spark, rows, r)} == {0}
    assert got(spark, [], r, 1) == []


def test_huge_components_are_held(spark):
    r = C.ClusterRules(length=2)
    far = got(spark, [(1, [3e38, -3e38]), (2, [0.0, 0.0])], r)
    assert [x[2] for x in far] == [0, 0] and len({x[1] for x in far}) == 2


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 3000, (16, 10))
    x = np.floor(centers[rng.integers(0, 16, 4000)] + rng.normal(0, 200, (4000, 10))).astype(np.int64)
    new = x[:16].copy()
    group, old, state, spent = C.grouped(new, 4), new, (np.zeros(4000, np.int64), np.full(4000, np.inf), np.full((4000, 4), -np.inf)), []
    for _ in range(8):
        own, upper, lower, n = C.advance(x, *state, old, new, group)
        d = np.sqrt((((x[:, None] - new[None]) ** 2).sum(2)).astype(float))
        assert (own == d.argmin(1)).all() and (upper * (1 + C.SLACK) >= d[np.arange(4000), own]).all()
        d[np.arange(4000), own] = np.inf
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= d[:, group == g].min(1) * (1 + C.SLACK) + C.SLACK).all()
        spent.append(n)
        state, old = (own, upper, lower), new
        new = np.array([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else new[c] for c in range(16)])
    assert spent[0] == 4000 * 16 and sum(spent[4:]) < 0.25 * 4 * 4000 * 16
