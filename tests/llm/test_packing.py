from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tagloom.llm import packing as P

from .helpers import DOCS, rows


def naive(lengths, r):
    """Best fit by looking at every bin; of bins with equal room the one that was touched last."""
    bins = []  # [capacity, used, touched]
    for n, length in enumerate(lengths):
        fits = [(c - u, -t, i) for i, (c, u, t) in enumerate(bins) if c - u >= length]
        if fits:
            pick = min(fits)[2]
        else:
            pick = len(bins)
            left = sum(c - u for c, u, _ in bins)
            held = lambda c: length + min(r.fill * (c - length), max(0, sum(x for x in lengths[n + 1 :] if x <= c - length) - left))  # noqa: B023, E731
            bins.append([min((k / held(c), c) for c, k in zip(r.capacities, r.cost()) if c >= length)[1], 0, 0])
        bins[pick][1] += length
        bins[pick][2] = n
    return sorted((min(c for c in r.capacities if c >= u), u) for _, u, _ in bins)


def test_best_fit_matches_the_naive_search():
    rng = random.Random(1)
    for turn in range(60):
        r = P.PackRules(capacities=(8, 20, 50), overhead=(0.0, 4.0, 30.0)[turn % 3], attention=(1e9, 100.0)[turn % 2])
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randint(0, 80))), reverse=True)
        where, offset, final = P.best_fit(lengths, r)
        used = defaultdict(int)
        for b, o, n in zip(where, offset, lengths):
            assert used[b] == o
            used[b] += n
        assert sorted((int(final[b]), u) for b, u in used.items()) == naive(lengths, r)
        assert len(used) == len(final)


def test_capacities_are_chosen_jointly_and_bins_shrink():
    r = P.PackRules()
    rng = random.Random(4)
    lengths = sorted((min(32768, int(rng.lognormvariate(7.2, 1.3)) + 1) for _ in range(3000)), reverse=True)
    where, _, final = P.best_fit(lengths, r)
    first = {}
    for b, n in zip(where.tolist(), lengths):
        first.setdefault(b, n)  # the piece that opened the bin
    smallest = lambda n: next(c for c in r.capacities if c >= n)
    assert sum(final[b] > smallest(n) for b, n in first.items()) > len(final) / 4
    cost = dict(zip(r.capacities, r.cost()))
    total = sum(cost[c] for c in final.tolist())
    for alone in ((c,) for c in r.capacities if c >= max(lengths)):
        assert total < sum(cost[alone[0]] for _ in P.best_fit(lengths, P.PackRules(capacities=alone))[2])
    # The smallest capacity that fits, filled best, costs more.
    rooms = []
    for n in lengths:
        fits = min((c - u, i) for i, (c, u) in enumerate(rooms) if c - u >= n) if any(c - u >= n for c, u in rooms) else None
        if fits is None:
            rooms.append((smallest(n), n))
        else:
            rooms[fits[1]] = (rooms[fits[1]][0], rooms[fits[1]][1] + n)
    assert total < sum(cost[smallest(u)] for _, u in rooms)
    # The last bins hold less than was expected when they were opened.
    few = sorted((rng.randint(1, 900) for _ in range(6)), reverse=True)
    opened = {}
    where, _, final = P.best_fit(few, r)
    for b, n in zip(where.tolist(), few):
        opened[b] = opened.get(b, 0) + n
    assert all(int(final[b]) == smallest(u) for b, u in opened.items())


def test_every_token_is_packed_once(spark):
    r = P.PackRules(capacities=(16, 64), group_tokens=300)
    texts = {1: "a" * 200, 2: None, 3: "", 4: "é" * 30, **{10 + i: "x" * (i % 40) for i in range(60)}}
    docs = [(k, t, "en", "s") for k, t in texts.items()] + [(None, "yy", "en", "s"), (1, "a" * 200, "en", "s")]
    df = spark.createDataFrame(docs, DOCS).withColumn("sequence", F.lit(1)).withColumn("len", F.lit(1))
    got = rows(P.pack(df, r))
    total = defaultdict(int)
    for x in got:
        total[x["doc_id"]] += x["n_tokens"]
    size = lambda t: len((t or "").encode()) + 1
    assert total == {**{k: size(t) for k, t in texts.items()}, None: 3, 1: 402}
    bins = defaultdict(list)
    for x in got:
        bins[x["sequence"], x["capacity"]].append((x["slot"], x["offset"], x["n_tokens"]))
    for (_, capacity), parts in bins.items():
        at = 0
        for slot, (s, o, n) in enumerate(sorted(parts)):
            assert (s, o) == (slot, at)
            at += n
        assert at <= capacity and (capacity == 16 or at > 16)
    assert len({s for s, _ in bins}) == len(bins)
    assert P.pack(df.limit(0), r).count() == 0


def test_materialised_sequences_hold_the_texts(spark):
    r = P.PackRules(capacities=(16, 32))
    df = spark.createDataFrame([(1, "hello", "", ""), (2, "ü" * 20, "", ""), (3, None, "", "")], DOCS)
    got = rows(P.materialise(df, P.pack(df, r)))
    assert sorted(b"".join(bytes(x["tokens"]) for x in got)) == sorted(("hello" + "ü" * 20).encode() + b"\0\0\0")
    assert all(len(x["tokens"]) <= x["capacity"] for x in got)


def test_lengths_from_a_column(spark):
    df = spark.createDataFrame([(1, "x", "", ""), (2, "y", "", "")], DOCS).withColumn("n", F.lit(40))
    got = rows(P.pack(df, P.PackRules(capacities=(32,)), F.col("n")))
    assert sorted((x["doc_id"], x["start"], x["n_tokens"]) for x in got) == [(1, 0, 32), (1, 32, 8), (2, 0, 32), (2, 32, 8)]
