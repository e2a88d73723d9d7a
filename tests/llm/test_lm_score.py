from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagloom.llm import lm_score as L

from .helpers import DOCS, rows

RULES = L.LmRules(quantum=20_000, batch=256)


def pattern(rng: random.Random, n: int) -> str:
    """Words in which each word depends on both neighbours."""
    out = []
    while len(out) < n:
        a, b = rng.choice(["red", "blue", "green"]), rng.choice(["cat", "dog", "bird"])
        out += ["the", a, b, {"cat": "sleeps", "dog": "runs", "bird": "flies"}[b], "and"]
    return " ".join(out[:n])


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, pattern(rng, rng.randint(30, 120)), "en", "s") for i in range(n)]


def test_forward_matches_a_plain_evaluation():
    net = {k: v + 0.01 for k, v in L.start(RULES).items()}
    rng = np.random.default_rng(0)
    ids = rng.integers(0, L.VOCABULARY, 40).astype(np.int32)
    padded, at = L.windows(ids, np.array([25, 0, 15]), 2)
    got = L.forward(net, padded, at, 2)[3]
    doc = [list(ids[:25]), list(ids[25:])]
    want = []
    for d in doc:
        for i, w in enumerate(d):
            h = net["shift"].astype(float).copy()
            for k, o in enumerate((-2, -1, 1, 2)):
                j = i + o
                h += net["embed"][k, d[j] if 0 <= j < len(d) else L.PAD]
            h = np.tanh(h)
            z = net["out"].astype(float) @ h
            g, m = divmod(int(w), L.MEMBERS)
            p, q = z[: L.GROUPS] + net["group"], z[L.GROUPS :] + net["member"][:, g]
            want.append(p[g] - np.log(np.exp(p).sum()) + q[m] - np.log(np.exp(q).sum()))
    assert np.allclose(got, want, atol=1e-4)


def test_gradient_lowers_the_loss_on_held_out_text():
    rules = RULES
    texts = pa.array([t for _, t, _, _ in corpus(1, 300)])
    held = pa.array([t for _, t, _, _ in corpus(2, 40)])
    padded, at = L.windows(*L.token_ids(texts), rules.side)
    trainer = L.Trainer(L.start(rules), rules)
    before = L.score_texts(trainer.net, held, rules)
    trainer.train(padded, at)
    after = L.score_texts(trainer.net, held, rules)
    assert after[1].sum() / after[0].sum() > before[1].sum() / before[0].sum() + 3


def test_scores_tell_order_from_disorder_on_held_out_documents(spark):
    train = spark.createDataFrame(corpus(3, 600), DOCS).repartition(3)
    net = L.train(train, RULES)
    rng = random.Random(5)
    good = corpus(6, 60)
    bad = []
    for i, t, _, _ in good:
        w = t.split()
        rng.shuffle(w)
        bad.append((1000 + i, " ".join(w), "en", "s"))
    got = {r["doc_id"]: r for r in rows(L.score(spark.createDataFrame(good + bad, DOCS), net, RULES))}
    wins = sum(got[i]["per_token"] > got[1000 + i]["per_token"] for i in range(60))
    assert wins >= 57
    # Both sides count: the word after an animal is known from the animal, the animal from the verb.
    masked = L.score_texts(net, pa.array(["the red cat sleeps and", "the red dog sleeps and"]), RULES)[1]
    assert masked[0] > masked[1]


def test_nulls_empty_repeats_and_clashes(spark):
    docs = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n ", "en", "s"), (4, "the cat", "en", "s"), (4, "the cat", "en", "s"), (None, "x " * 50_000, "en", "s")]
    df = spark.createDataFrame(docs, DOCS).withColumn("n_tokens", F.lit("own"))
    got = rows(L.score(df, rules=RULES))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_tokens"], r["log_likelihood"], r["per_token"]))
    assert by[1] == by[2] == by[3] == [(0, 0.0, None)]
    assert len(by[4]) == 2 and abs(by[4][0][1] - by[4][1][1]) < 1e-4 and by[None][0][0] == 50_000
    assert L.score(df.limit(0), rules=RULES).count() == 0


def test_words_far_above_the_fixed_ids_are_told_apart_on_held_out_text(spark):
    from pandas.util import hash_array

    rng = random.Random(11)
    known = [f"k{i}" for i in range(4000)]  # four times the fixed ids
    line = lambda: " ".join(w for _ in range(20) for w in ("the", rng.choice(known), "and"))
    docs = [(i, line(), "en", "s") for i in range(1500)] + [(5000 + i, f"the {w} and {w}", "en", "s") for i, w in enumerate(known)] + [(9000 + i, f"the once{i} and", "en", "s") for i in range(3000)]
    rules = L.LmRules(quantum=20_000, batch=256, words_per_root=14.0)
    net = L.train(spark.createDataFrame(docs, DOCS).repartition(3), rules)
    seen = len({w for _, t, _, _ in docs for w in t.split()})
    assert 4000 < len(net["words"]) < seen and net["spread"] > 0
    # Every own word keeps an id of its own, the others share ids that no own word has.
    ids, _ = L.token_ids(pa.array([" ".join(["the", "and", *known])]), net)
    assert len(set(ids)) == 4002 and max(ids) < len(net["words"])
    held = pa.array([line() for _ in range(40)])
    n, before = L.score_texts(L.start(rules, net["words"], 10), held, rules)
    after = L.score_texts(net, held, rules)[1]
    assert after.sum() / n.sum() > before.sum() / n.sum() + 3
    # Unseen words that share a known word's id of 1,024 score lower than it.
    code = lambda words: (hash_array(np.array(words, object), categorize=False) >> np.uint64(32)) % np.uint64(L.VOCABULARY)
    junk = dict(zip(code(made := [f"junk{i}" for i in range(20_000)]).tolist(), made))
    wrong = pa.array([" ".join(w if w in ("the", "and") else junk[int(code([w])[0])] for w in t.split()) for t in held.to_pylist()])
    assert (L.score_texts(net, wrong, rules)[1] < after).all()


def test_rounds_take_every_token_once_and_go_on_from_the_last(spark):
    docs = spark.createDataFrame(corpus(12, 400), DOCS)
    net, tokens = L.vocabulary(L.hashed(docs), RULES)
    assert tokens == sum(len(t.split()) for _, t, _, _ in corpus(12, 400)) > RULES.quantum
    untrained = L.Trainer(net, RULES)
    held = pa.array([t for _, t, _, _ in corpus(13, 40)])
    one = L.score_texts(L.train(docs, RULES), held, RULES)[1].sum()
    more = L.score_texts(L.train(docs.unionByName(spark.createDataFrame(corpus(14, 3000), DOCS)), RULES), held, RULES)[1].sum()
    assert more > one > L.score_texts(untrained.net, held, RULES)[1].sum()


def test_gradients_match_differences_of_the_loss():
    rules = L.LmRules(batch=64, rate=1e-3)
    rng = np.random.default_rng(3)
    words = rng.choice(1 << 32, 1500, replace=False).astype(np.uint32)
    net = {k: v.astype(np.float64) if k not in L.FIXED else v for k, v in L.start(rules, words, 40).items()}
    ids, counts = rng.integers(0, 1540, 50).astype(np.int32), np.array([30, 20])
    padded, at = L.windows(ids, counts, 2, L.pad_of(net))
    loss = lambda x: -L.forward(x, padded, at, 2)[3].mean()
    trainer = L.Trainer({k: v.copy() for k, v in net.items()}, rules)
    grads = {}
    trainer._step = lambda name, grad, rows=(): grads.setdefault(name, []).append((rows, grad))
    trainer.train(padded, at)
    for name in ("embed", "shift", "out", "group", "member", "member2"):
        whole = np.zeros_like(net[name])
        for rows_, g in grads[name]:
            whole[rows_] += g
        for place in map(tuple, np.argwhere(np.abs(whole) > np.abs(whole).max() / 2)[:3]):
            up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
            up[name][place] += 1e-2
            down[name][place] -= 1e-2
            assert abs((loss(up) - loss(down)) / 2e-2 - whole[place]) < 2e-4 + 0.02 * abs(whole[place]), (name, place)


def test_training_matches_copies_averaged_by_hand_however_the_input_is_split(spark):
    rules = L.LmRules(quantum=4_000, batch=256)
    docs = [*corpus(21, 150), (7, None, "en", "s"), (8, "the cat", "en", "s"), (8, "the cat", "en", "s")]
    df = spark.createDataFrame(docs, DOCS)
    keys = {(r.doc_id, r.text): r.key for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).collect()}
    net, tokens = L.vocabulary(L.hashed(df), rules)
    rounds = 1
    while tokens > rules.quantum << (rounds - 1):
        rounds += 1
    seen = L.Trainer(net, rules).seen
    bounds = [0, *[2 ** (30 - rounds + 1 + r) for r in range(rounds)]]
    assert rounds > 1 and bounds[-1] == 1 << 30
    for lo, hi in zip(bounds, bounds[1:]):
        groups = {}
        for d, t, _, _ in docs:
            k = keys[d, t]
            if t and lo <= (k % (1 << 64)) >> 34 < hi:
                groups.setdefault(k % L.LEAST_COPIES, []).append((k, t))
        copies = []
        for members in groups.values():
            trainer = L.Trainer(net, rules, seen)
            trainer.train(*L.windows(*L.token_ids(pa.array([t for _, t in sorted(members)]), net), rules.side, L.pad_of(net)))
            copies.append(trainer)
        total = sum(c.tokens for c in copies)
        mean = lambda part, k: sum(getattr(c, part)[k].astype(float) * c.tokens for c in copies) / total  # noqa: B023, E731
        net = net | {k: np.clip(mean("net", k), -rules.bound, rules.bound).astype(np.float32) for k in seen}
        seen = {k: mean("seen", k).astype(np.float32) for k in seen}
    texts = pa.array([t for _, t, _, _ in docs])
    want = L.score_texts(net, texts, rules)[1]
    for parts in (4, 16):
        got = L.score(df.repartition(parts), rules=rules)
        by = {(r["doc_id"], r["n_tokens"]): r["log_likelihood"] for r in rows(got)}
        n = L.token_ids(texts, net)[1]
        assert all(abs(by[d[0], int(k)] - w) < 1e-3 * max(1, int(k)) for d, k, w in zip(docs, n, want))


def test_repeated_words_of_the_whole_corpus_raise_scores(spark):
    """Words that the corpus repeats have ids of their own, so documents that occur often score above those that occur once."""
    rng = random.Random(31)
    made = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(40))
    once, often = [made() for _ in range(300)], [made() for _ in range(20)]
    docs = [(i, t, "en", "s") for i, t in enumerate(once)] + [(1000 + 10 * i + j, t, "en", "s") for i, t in enumerate(often) for j in range(6)]
    got = {r["doc_id"]: r["per_token"] for r in rows(L.score(spark.createDataFrame(docs, DOCS), rules=RULES))}
    assert min(got[1000 + 10 * i] for i in range(20)) > max(got[i] for i in range(300))


def test_the_untrained_network_gives_words_their_frequencies(spark):
    rng = random.Random(41)
    known = [f"k{i}" for i in range(1500)]
    docs = [(i, " ".join(rng.choices(known, [1 / (j + 1) for j in range(1500)], k=60)), "en", "s") for i in range(200)]
    net, tokens = L.vocabulary(L.hashed(spark.createDataFrame(docs, DOCS)), L.LmRules())
    net = net | {"embed": np.zeros_like(net["embed"])}
    counts = {w: sum(t.split().count(w) for _, t, _, _ in docs) for w in ("k0", "k1", "k9", "k200")}
    got = L.score_texts(net, pa.array(list(counts)), L.LmRules())[1]
    assert np.allclose(got, [np.log(n / tokens) for n in counts.values()], atol=0.15)
