from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import assign, evaluate, gate, nms, price_blocks, ranking, reports, resolve, score, spatial, symbols, tracks, vectors, votes
from tagloom.operators.components import connected_components, contracted_components

BOX = "struct<x_min:int,y_min:int,x_max:int,y_max:int>"


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0.0


def boxes(rng, n):
    out = []
    for _ in range(n):
        x, y = rng.randrange(400), rng.randrange(300)
        out.append((x, y, x + rng.randint(20, 120), y + rng.randint(20, 90)))
    return out


def test_suppression_golden_and_brute_force(spark):
    rows = [("f", 1, 0.9, (0, 0, 100, 100)), ("f", 2, 0.8, (10, 10, 95, 95)), ("f", 3, 0.7, (160, 20, 240, 80))]
    df = spark.createDataFrame(rows, f"frame string, id int, score double, b {BOX}")
    assert sorted(r.id for r in nms.non_max_suppress(df, ["frame"], "id", "score", "b", 0.4).collect()) == [1, 3]
    rng = random.Random(1)
    rows = [(f"f{k}", i, round(rng.random(), 2), b) for k in range(4) for i, b in enumerate(boxes(rng, 40))]
    df = spark.createDataFrame(rows, f"frame string, id int, score double, b {BOX}")
    want = set()
    for k in range(4):
        kept = []
        for f, i, s, b in sorted((r for r in rows if r[0] == f"f{k}"), key=lambda r: (-r[2], r[1])):
            if all(iou(b, o) <= 0.3 for *_, o in kept):
                kept.append((f, i, s, b))
        want |= {(f, i) for f, i, _, _ in kept}
    assert {(r.frame, r.id) for r in nms.non_max_suppress(df, ["frame"], "id", "score", "b", 0.3).collect()} == want


def test_dedup_respects_names(spark):
    rows = [("v", 1, 0.5, (0, 0, 100, 100), ""), ("v", 2, 0.9, (2, 0, 100, 100), "a"), ("v", 3, 0.8, (0, 1, 100, 100), "b"), ("v", 4, 0.1, (500, 0, 600, 50), "a")]
    df = spark.createDataFrame(rows, f"video string, id int, score double, b {BOX}, name string")
    assert sorted(r.id for r in nms.spatial_dedup(df, ["video"], "id", "score", "b", "name", 0.6).collect()) == [2, 3, 4]


def test_spatial_join_matches_brute_force(spark):
    rng = random.Random(2)
    a, b = boxes(rng, 80), boxes(rng, 90)
    left = spark.createDataFrame([("v", i, x) for i, x in enumerate(a)], f"video string, l int, bbox {BOX}")
    right = spark.createDataFrame([("v", i, x) for i, x in enumerate(b)], f"video string, r int, bbox {BOX}")
    got = {(r.l, r.r) for r in spatial.iou_pairs(left, right, "video", "l", "r", "bbox", 64, 0.2).collect()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if iou(x, y) >= 0.2}


def test_optimal_assignment_matches_brute_force():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 4), (4, 2), (5, 5), (3, 6), (6, 3)]:
        for _ in range(20):
            cost = rng.integers(-20, 20, (n, m)).astype(float)
            pairs = assign.hungarian(cost)
            assert len(pairs) == min(n, m) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
            small, wide = (cost, range(m)) if n <= m else (cost.T, range(n))
            best = min(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(wide, min(n, m)))
            assert sum(cost[r, c] for r, c in pairs) == pytest.approx(best)
    assert assign.hungarian(np.zeros((0, 3))) == []


def test_sparse_matching_matches_brute_force():
    rng = random.Random(12)
    for n, m, share in [(1, 1, 1.0), (3, 5, 0.6), (5, 3, 0.6), (5, 5, 1.0), (6, 6, 0.4), (4, 2, 0.9)]:
        for _ in range(25):
            rows = [[(c, rng.choice([-4.0, 1.0, 2.5, 7.0, rng.uniform(0, 9)])) for c in range(m) if rng.random() < share] for _ in range(n)]
            taken = assign.sparse_matching(rows, m)
            used = [c for c in taken if c >= 0]
            assert len(used) == len(set(used))
            got = sum(dict(rows[r])[c] for r, c in enumerate(taken) if c >= 0)
            weight = [dict(row) for row in rows]
            best = max(sum(max(0.0, weight[r].get(c, 0.0)) if c < m else 0.0 for r, c in enumerate(p)) for p in itertools.permutations(range(m + n), n))
            assert got == pytest.approx(best)


def test_assignment_is_one_to_one(spark):
    pairs = [("v", "t1", "e1", 300.0), ("v", "t1", "e2", 100.0), ("v", "t2", "e1", 290.0), ("v", "t2", "e2", 280.0), ("v", "t3", "e1", 20.0), ("w", "t1", "e1", 5.0), ("w", "t9", "e8", -3.0)]
    df = spark.createDataFrame(pairs, "video string, t string, e string, score double")
    got = {(r.video, r.t, r.e) for r in assign.optimal(df, "video", "t", "e", "score").collect()}
    assert got == {("v", "t1", "e1"), ("v", "t2", "e2"), ("w", "t1", "e1")}


def test_assignments_are_accepted_by_overlap_or_lead_and_split(spark):
    pairs = [
        ("v", 1, 1, 400.0, 0.7), ("v", 1, 2, 390.0, 0.65),  # the same track covers two entries
        ("v", 2, 3, 100.0, 0.3), ("v", 2, 4, 99.0, 0.2),  # leads by one only
        ("v", 3, 5, 100.0, 0.3), ("v", 3, 6, 97.0, 0.2),  # by three: enough where boxes meet
        ("v", 4, 7, 100.0, 0.1), ("v", 4, 8, 95.0, 0.1),  # by five: not enough where they don't
        ("v", 5, 9, 60.0, 0.2), ("u", 1, 1, 71.0, 0.0),
    ]
    df = spark.createDataFrame(pairs, "video string, t long, e long, score double, iou double")
    got = {(r.video, r.t, r.e, r.split) for r in assign.assigned(df, "video", "t", "e", "score", "iou").collect()}
    assert got == {("v", 1, 1, False), ("v", 1, 2, True), ("v", 3, 5, False), ("u", 1, 1, False)}
    assert {r.e for r in assign.assigned(df, "video", "t", "e", "score", "iou", split=False).collect()} == {1, 5}


def one_by_one(edges):
    """The sequential rule: left sides in order, each takes the best free right side."""
    taken, out = set(), set()
    for left in sorted({e[0] for e in edges}):
        free = [(-s, r) for a, r, s in edges if a == left and r not in taken]
        if free:
            taken.add(min(free)[1])
            out.add((left, min(free)[1]))
    return out


def test_first_come_equals_the_sequential_rule(spark):
    rng = random.Random(11)
    chain = [(i, j, 10.0 - j) for i in range(12) for j in range(i + 1)]  # every choice displaces the next
    for edges in (chain, [(a, b, rng.randrange(6) / 2) for a in range(80) for b in rng.sample(range(40), 7)], [(1, 1, 0.5)], []):
        df = spark.createDataFrame(edges, "l int, r int, s double")
        assert {(x.l, x.r) for x in assign.first_come(df, "l", "r", [-F.col("s")]).collect()} == one_by_one(edges)


def test_evaluation_goes_in_the_order_of_predictions(spark):
    kind = f"video string, {{}} long, code string, bbox {BOX}"
    far, box, near = (500, 500, 600, 600), (0, 0, 100, 100), (0, 20, 100, 120)
    p = spark.createDataFrame([("v", 0, "", near), ("v", 1, "4607124143901", far), ("v", 2, "", None)], kind.format("pred_id"))
    t = spark.createDataFrame([("v", 7, "4607124143901", box), ("w", 8, "", near)], kind.format("truth_id"))
    got = evaluate.match_rows(p, t, "video", 0.5, 64).collect()
    assert [(r.pred_id, r.truth_id, round(r.iou, 3), r.by_code) for r in got] == [(0, 7, 0.667, False)]  # the row with the code comes too late
    got = evaluate.match_rows(p.where("pred_id > 0"), t, "video", 0.5, 64).collect()
    assert [(r.pred_id, r.truth_id, r.iou, r.by_code) for r in got] == [(1, 7, 1.0, True)]
    codes = spark.createDataFrame([("4 607124 143901", None), ("46", "460712414390"), ("1" * 14, "x"), (None, None)], "b string, q string")
    assert [r[0] for r in codes.select(evaluate.row_code(F.col("b"), F.col("q"))).collect()] == ["4607124143901", "460712414390", "", ""]


def test_temporal_and_plain_top_k(spark):
    rows = [("t", f"early_{i}", i, q) for i, q in enumerate((1.00, 0.99, 0.98, 0.97))] + [("t", f"late_{t}", t, q) for t, q in ((100, 0.60), (200, 0.59), (300, 0.58))]
    df = spark.createDataFrame(rows, "track string, id string, ts long, q double")
    order = [F.desc("q"), F.col("id")]
    assert {r.id for r in ranking.temporal_diverse_top_k(df, ["track"], "ts", order, 4, 4).collect()} == {"early_0", "late_100", "late_200", "late_300"}
    assert {r.id for r in ranking.top_k(df, ["track"], order, 4).collect()} == {f"early_{i}" for i in range(4)}


def test_votes(spark):
    v = [("g", "price_card", "73,99", 1.0, 2), ("g", "price_card", "73.99 ₽", 1.5, 3), ("g", "price_card", "99", 2.0, 1), ("g", "color", "нет", 9.0, 4), ("g", "special_symbols", "K", 1.0, 5), ("g", "special_symbols", "К", 1.0, 6)]
    df = spark.createDataFrame(v, "g string, field string, value string, weight double, ord int")
    got = {r.field: (r.value, float(r.weight)) for r in votes.weighted_vote(df, ["g"]).collect()}
    assert got == {"price_card": ("73,99", 2.5), "special_symbols": ("K", 1.0)}


@pytest.mark.parametrize(
    ("readings", "sku", "method"),
    [(["270102701074", "270102701074", "270102701079"], "270102701074", "exact_majority"), (["270102701074", "270102701075", "270102701174", "271102701074", "270102701076"], "270102701074", "position_vote"), (["270102701074"], "", "insufficient_support")],
)
def test_sku_consensus(spark, readings, sku, method):
    df = spark.createDataFrame([("g", r, i) for i, r in enumerate(readings)], "g string, sku string, ord int")
    (r,) = votes.sku_consensus(df, ["g"], "sku", "ord").collect()
    assert (r.sku, r.method) == (sku, method)


def test_mode_with_support(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("b", "y", 2)], "g string, v string, o int")
    assert {(r.g, r.v) for r in votes.mode(df, ["g"], "v", "o", 2).collect()} == {("b", "y")}


def test_slots(spark):
    def slots(rows):
        t = spark.createDataFrame(rows, f"video string, track string, first_ms long, last_ms long, median_box {BOX}")
        e = spatial.slot_edges(spatial.gap_pairs(t, "video", "track", "first_ms", "last_ms", 1600, "median_box", 64), "median_box", "first_ms", "last_ms", 1600)
        return len({r.slot for r in tracks.merge_fragments(t, e, "video", "track", [F.col("first_ms"), F.col("track")]).collect()})

    assert slots([("v", "a", 0, 200, (100, 100, 200, 180)), ("v", "b", 700, 900, (106, 100, 206, 180))]) == 1
    assert slots([("v", "a", 0, 800, (100, 100, 200, 180)), ("v", "b", 700, 900, (106, 100, 206, 180))]) == 2


def test_tracker_and_gap(spark):
    rows = [("v", i, t, i, 0.9, x, 0, x + 50, 50) for i, (t, x) in enumerate([(0, 0), (1000, 5), (3500, 8), (6001, 8), (6002, 400)])]
    df = spark.createDataFrame(rows, "video string, detection_id long, timestamp_ms long, frame_index long, confidence double, x_min int, y_min int, x_max int, y_max int")
    got = {r.detection_id: r.track for r in tracks.associate(df, "video", "video string, detection_id long, track long").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def test_gate_and_confidence(spark):
    base = {c: "" for c in "product_name barcode qr_code_barcode price_default price_card discount_amount id_sku id_sku_confidence print_datetime print_datetime_confidence code code_confidence color x_min y_min x_max y_max".split()}
    at = {"x_min": "0", "y_min": "0", "x_max": "10", "y_max": "10"}
    rows = [
        base | at | {"price_card": "99.99"},
        base | at | {"product_name": "A", "price_card": "99.99"},
        base | at | {"product_name": "A", "barcode": "8051070512049", "price_default": "120", "price_card": "99.99", "discount_amount": "-10%"},
        base | at | {"price_default": "90", "price_card": "99.99", "discount_amount": "-10%"},
        base | {"price_card": "99.99"},
    ]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} string" for c in base)).withColumn("video", F.lit("v"))
    got = {r.id: r for r in gate.gated(df, ["video"], least=0.2, least_beside_identity=0.45).collect()}
    assert got[0].confidence <= got[1].confidence <= got[2].confidence
    assert got[2].tier == "high" and got[3].confidence < 0.40 and "price_default" not in got[3].evidence and "discount" not in got[3].evidence
    assert [got[i].keep for i in range(5)] == [False, True, True, False, False]
    assert got[0].reason == "weak_price_only_beside_identity" and got[4].reason == "no_bbox"


def test_resolver(spark):
    names = ["Вино Саммарко POGGIO красное", "Вино SAMMARCO сухое", "Вино NEGROAMARO PRIMA"] + [f"Вино FILLER{i} сорт{i % 3} RED" for i in range(40)]
    catalog = spark.createDataFrame([(n, f"{4600000000000 + i}") for i, n in enumerate(names)] + [(names[1], "8051070512049")], "name string, code string")
    q = spark.createDataFrame([(1, ["SANNARCO"], ""), (2, ["XQZJ", "ZZZZ"], ""), (3, ["AB", "CD"], ""), (4, ["SAMMARCO"], "805107051204")], "k int, texts array<string>, hint string")
    got = {r.k: r for r in resolve.resolve(q, catalog, "k", "texts", "hint", least_margin=2.0, quantile=0.5).collect()}
    assert set(got) == {1, 4} and got[1].accepted and got[1].name == names[1]
    for r in got.values():
        assert not r.accepted or (r.name and r.barcode in r.candidate_codes)
    assert got[4].barcode == "8051070512049"
    assert all((r.product_name, r.guess_name) == ((r.name, "") if r.accepted else ("", r.name)) for r in got.values())
    wine = spark.createDataFrame([("Вино RED", "1"), (" винный напиток", "2"), ("Сок", "3")], "name string, code string")
    assert {r.code for r in resolve.in_category(wine, "wine").collect()} == {"1", "2"} and resolve.in_category(wine, "all").count() == 3
    assert resolve.in_category(wine, "beer").count() == 3  # an unknown category holds all names
    rare = spark.createDataFrame([(float(i // 7),) for i in range(100)], "idf double")
    assert resolve.distinctive_idf(rare, 0.88).head()._bar == float(int(0.88 * 100) // 7)
    strict = resolve.resolve(q, catalog, "k", "texts", "hint", least_margin=60.0).collect()
    assert all(not r.accepted and r.barcode == "" and r.status == "catalog_guess" for r in strict)


def test_best_two_names_are_exact_whatever_is_opened(spark):
    rng = random.Random(4)
    words = [f"W{i:03d}" for i in range(60)]
    names = sorted({" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=3)) for _ in range(300)})
    catalog = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")
    tokens, _, rare = resolve.index(catalog.withColumn("code", F.lit("")))
    idf = {r.token: (r.idf, r.df) for r in rare.collect()}
    hits = [(k, q, t, *idf[t]) for k in range(25) for q in rng.sample(words, 4) for t in {q, *rng.sample(words, 2)} if t in idf]
    want = {}
    for k in range(25):
        scored = []
        for place, n in enumerate(names):
            mass = rarest = 0.0
            for q in {h[1] for h in hits if h[0] == k}:
                mine = [(t == q, i) for key, x, t, i, _ in hits if key == k and x == q and t in n.split()]
                if mine:
                    mass, rarest = mass + round(max(mine)[1], 9), max(rarest, max(mine)[1])
            if mass:
                scored.append((round(mass, 9), rarest, place, n))
        scored.sort(reverse=True)
        want[k] = (scored[0][3], scored[0][0], scored[1][0])
    df = spark.createDataFrame(hits, "k int, q string, token string, idf double, df long")
    places = catalog.select("name", F.col("ord").alias("_place"))
    for opened, growth in ((1, 3), (256, 16)):
        got = resolve.best_two(df, tokens, places, "k", opened, growth).collect()
        assert {r.k: (r.name, round(r.score, 9), round(r._second, 9)) for r in got} == want


def test_catalog_lookup_and_aliases(spark):
    c = spark.createDataFrame([("08051070512049", "first", 0), ("08051070512049", "second", 1), ("036000291452", "upc", 2)], "code string, name string, ord int")
    known = resolve.with_aliases(c, "ord")
    q = spark.createDataFrame([(1, "8051070512049"), (2, "036000291452"), (3, "999")], "k int, code string")
    assert {r.k: r.name for r in resolve.lookup(q, known, "k", "code").collect()} == {1: "first", 2: "upc", 3: ""}


BLOCK = "k string, ord int, text string, conf double, rel_x double, rel_y double, rel_w double, rel_h double, rel_cx double"


def tag(*blocks):
    """Blocks (text, height in the tag, own height, left edge, width) of one tag."""
    filled = [(*b, *(0.5, 0.1, 0.45, 0.15)[len(b) - 1 :]) for b in blocks]
    return [(i, t, 0.9, x, y, w, h, x + w / 2.0) for i, (t, y, h, x, w) in enumerate(filled)]


def test_price_blocks(spark):
    neighbours = [("373", 0.22, 0.08, 0.42, 0.14), ("69", 0.23, 0.03, 0.58, 0.06), ("299", 0.58, 0.14, 0.39, 0.16), ("99", 0.59, 0.04, 0.57, 0.07)]
    neighbours += [("599", 0.78, 0.08, 0.42, 0.14), ("50", 0.79, 0.03, 0.58, 0.06), ("469", 0.91, 0.14, 0.39, 0.16), ("99", 0.92, 0.04, 0.57, 0.07)]
    # Tags and the default price, card price, discount and symbol wanted of them.
    cases = {
        "smaller": ([("1894", 0.30, 0.06), ("1299", 0.60, 0.14), ("99", 0.58, 0.05), ("-31%", 0.55, 0.05)], ("1894.00", "1299.99", "-31%", "")),
        "not the tallest": ([("2894", 0.30, 0.20), ("1999", 0.62, 0.10), ("99", 0.60, 0.04)], ("2894.00", "1999.99", "", "")),
        "single": ([("1299", 0.6, 0.14), ("99", 0.58, 0.04)], ("", "1299.99", "", "")),
        "volume": ([("0.75L", 0.2, 0.05), ("1199", 0.6, 0.14), ("99", 0.58, 0.04)], ("", "1199.99", "", "")),
        "usual cents": ([("1894", 0.3), ("1299", 0.6, 0.14), ("31", 0.4), ("99", 0.58)], ("1894.00", "1299.99", "", "")),
        "near cents": ([("2631", 0.24, 0.08), ("57", 0.25, 0.03), ("1899", 0.63, 0.14), ("99", 0.64, 0.04), ("-27%", 0.55, 0.05)], ("2631.57", "1899.99", "-27%", "")),
        "no cents": ([("2631", 0.24, 0.08), ("1899", 0.63, 0.14), ("99", 0.64, 0.04)], ("2631.00", "1899.99", "", "")),
        "neighbours": (neighbours, ("373.69", "299.99", "", "")),
        "weight": ([("275г", 0.20), ("305", 0.30), ("244", 0.60), ("99", 0.61)], ("305.00", "244.99", "", "")),
        "trailing zero": ([("18940", 0.39, 0.08), ("1299", 0.60, 0.14), ("99", 0.58, 0.04), ("-31%", 0.62, 0.05)], ("1894.00", "1299.99", "-31%", "")),
        "left noise": ([("130", 0.60, 0.14, 0.45, 0.16), ("16", 0.61, 0.04, 0.30, 0.06)], ("", "130.99", "", "")),
        "lost digit": ([("1578", 0.30, 0.08), ("1199", 0.62, 0.14), ("99", 0.63, 0.04), ("4%", 0.58, 0.05)], ("1578.00", "1199.99", "-24%", "")),
        "symbol": ([("KO", 0.84, 0.05)], ("", "", "", "К")),
        "nothing": ([("word", 0.3), (None, 0.4), ("", 0.5)], ("", "", "", "")),
        "two in a block": ([("100 1500 x", 0.3), ("1200", 0.62)], ("1500.00", "1200.99", "", "")),
        "equal values": ([("500", 0.9), ("500", 0.3), ("400", 0.6)], ("", "500.99", "", "")),
    }
    rows = [(k, *b) for k, (blocks, _) in cases.items() for b in tag(*blocks)]
    got = {r.k: r for r in price_blocks.parse(spark.createDataFrame(rows, BLOCK).repartition(3), "k").collect()}
    assert {k: (r.price_default, r.price_card, r.discount_amount, r.special_symbols) for k, r in got.items()} == {k: want for k, (_, want) in cases.items()}


def test_contracted_components_match_the_others(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(500, 501 + i) for i in range(80)] + [(900, i) for i in range(700, 780)]
    loose = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    for edges in (chain + hub + loose + [(3, 3), (None, 4), (5, None)], [(2, 1)], []):
        rng.shuffle(edges)
        df = spark.createDataFrame(edges, "a long, b long").repartition(7)
        want = {tuple(r) for r in connected_components(df, "a", "b").collect()}
        assert {tuple(r) for r in contracted_components(df, "a", "b").collect()} == want
        text = df.select(F.lpad(F.col("a").cast("string"), 5, "0").alias("a"), F.lpad(F.col("b").cast("string"), 5, "0").alias("b"))
        assert {(int(r.node), int(r.component)) for r in contracted_components(text, "a", "b").collect()} == want


def test_components_and_sessions(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4)], "a int, b int")
    assert {(r.node, r.component) for r in connected_components(df, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (9, 8), (8, 8)}
    ev = spark.createDataFrame([("u", 0, 1), ("u", 2500, 2), ("u", 5001, 3)], "u string, t long, id int")
    assert [r.session for r in tracks.sessions(ev, ["u"], "t", "id", 2500).orderBy("t").collect()] == [0, 0, 1]


def test_seek_and_reserved(spark):
    t = spark.createDataFrame([("v", 1000, 1), ("v", 5000, 2), ("v", 90, 3)], "video string, at_ms long, k int")
    f = spark.createDataFrame([("v", 0, 10), ("v", 900, 11), ("v", 1001, 12), ("v", 100, 13)], "video string, ts long, id int")
    assert {r.k: r.id for r in spatial.seek_back(t, f, "video", "at_ms", "ts", 1000).collect()} == {1: 11, 3: 10}
    x = spark.createDataFrame([("v", i) for i in range(0, 50)], "video string, i long")
    r = spark.createDataFrame([("v", 10), ("v", 30)], "video string, i long")
    assert {y.i for y in spatial.outside_reserved(x, r, "video", "i", 4).collect()} == {i for i in range(50) if min(abs(i - 10), abs(i - 30)) > 4}


def test_fused_row_from_votes(spark):
    from tagloom.operators import fuse

    s = spark.createDataFrame([("g", 1, "qr", "b=8051070512049;p1=100.50;p4=69,99", 0.9), ("g", 2, "barcode", "8051070512049", 0.5), ("g", 3, "qr", "junk", 0.9)], "g string, symbol_id int, symbol_type string, payload string, confidence double")
    c = spark.createDataFrame([("g", 1, {"product_name": "Вино сух", "price_default": "100"}, {"product_name": 0.9}, 0.5, 0.3), ("g", 2, {"product_name": "Вино cух", "price_default": "нет"}, None, 0.2, 0.3)], "g string, crop_id int, fields map<string,string>, field_confidences map<string,double>, confidence double, quality double")
    d = spark.createDataFrame([("g", 1, " red ", 0.8), ("g", 2, "white", 0.5), ("g", 3, "white", 0.2), ("g", 4, "", 1.0)], "g string, detection_id int, color string, confidence double")
    every = fuse.ordered([fuse.symbol_votes(s, "g"), fuse.text_votes(c, "g"), fuse.color_votes(d, "g")])
    columns = "barcode qr_code_barcode price_default price_card price1_qr price2_qr price4_qr product_name discount_amount additional_info color special_symbols".split()
    (r,) = fuse.fused(every, "g", columns).collect()
    assert r.asDict() == {
        "g": "g", "barcode": "8051070512049", "qr_code_barcode": "8051070512049", "price_default": "100.50", "price_card": "69.99", "price1_qr": "100.50", "price2_qr": "94.99", "price4_qr": "69.99",
        "product_name": "Вино сух", "discount_amount": "-30%", "additional_info": "Сухое", "color": "red", "special_symbols": "нет",
    }


def test_materialised_rows(spark):
    from tagloom.operators import fuse

    rows = [("t1", "123", "8051070512049", "10", "", "", "red"), ("t2", "8051070512049", "8051070512056", "", "5", "", "")]
    df = spark.createDataFrame(rows, "track string, t_barcode string, e_barcode string, t_price_card string, e_price_card string, t_color string, e_color string")
    got = {r.track: (r.barcode, r.price_card, r.color) for r in fuse.materialised(df, ["barcode", "price_card", "color"], F.col("track") == "none").collect()}
    assert got == {"t1": ("8051070512049", "10", "red"), "t2": ("8051070512049", "5", "нет")}


def test_token_sort_ratio(spark):
    from tagloom.operators import evaluate

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in "ab")
        assert evaluate.common_length(a, b) == slow(a, b)
    df = spark.createDataFrame([("b a", "a  b"), ("abc", "abd"), (None, ""), ("x", None)], "a string, b string")
    assert [round(r.r, 4) for r in df.select(evaluate.token_sort_ratio("a", "b").alias("r")).collect()] == [1.0, 0.6667, 1.0, 0.0]
    p = spark.createDataFrame([(1, "Вино сухое POGGIO", "POGGIO Вино сухое")], "k int, p_product_name string, t_product_name string")
    assert evaluate.field_scores(p, ["k"], ["product_name"]).head().n_matches == 1


def test_symbol_gate(spark):
    good, unknown, bad = "8051070512049", "4690491122587", "8051070512040"
    rows = [
        (1, "qr", f"barcode={bad};p1=1299.99;p4=999,50"), (2, "qr", f"barcode={good};p1=5"), (3, "barcode", good), (4, "barcode", bad), (5, "barcode", unknown), (6, "barcode", "12ab"),
        (7, "qr", f"barcode={unknown}"), (8, "qr", good), (9, "unknown", "0" + good), (10, "qr", None), (11, "qr", ""),
    ]
    df = spark.createDataFrame(rows, "symbol_id int, symbol_type string, payload string")
    known = spark.createDataFrame([(good,), (good,), (bad,)], "code string")
    got = {r.symbol_id: (r.code, r.code_field, r.clean, r.reason) for r in symbols.gated(df, known).collect()}
    assert got == {
        1: ("", "", "p1=1299.99;p4=999.50", ""), 2: (good, "qr_code_barcode", f"p1=5;barcode={good}", ""), 3: (good, "barcode", good, ""), 4: ("", "", "", "bad_ean13_checksum"),
        5: ("", "", "", "barcode_not_in_catalog"), 6: ("", "", "", "no_usable_barcode_digits"), 7: ("", "", "", "qr_payload_no_safe_fields"), 8: (good, "qr_code_barcode", good, ""),
        9: (good, "qr_code_barcode", good, ""), 10: ("", "", "", "no_usable_barcode_digits"), 11: ("", "", "", "no_usable_barcode_digits"),
    }


def test_sharing_keys_and_fallback_of_all(spark):
    rows = spark.createDataFrame([(i % 7, [f"k{i % 5}", f"x{i}"]) for i in range(60)], "n int, ks array<string>").repartition(5, "n")
    wanted = spark.createDataFrame([(["k1", "x7"],), (["x8"],)], "w array<string>")
    assert reports.sharing_keys(rows, "ks", wanted, "w").count() == sum(i % 5 == 1 or i in (7, 8) for i in range(60))
    a, b = spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([(2,), (3,)], "i int")
    assert [r.i for r in reports.fallback(a, b, []).collect()] == [1]
    assert sorted(r.i for r in reports.fallback(a.limit(0), b, []).collect()) == [2, 3]


def test_fused_vectors_match_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(0, 5, (301, 4)), "even": rng.integers(0, 3, (20, 4)).astype(float), "one": np.array([[1.5, -2, 0, 7]]), None: np.array([[1.0, 1, 1, 1], [2, 1, 1, 9]])}
    rows = [(g, [float(x) for x in v]) for g, m in groups.items() for v in m]
    df = spark.createDataFrame(rows + [("hot", None), ("gaps", [None, float("nan"), 3.0, None])], "g string, v array<double>")
    for bins in (3, 1024):
        got = {(r.g, r.at): (r.median, r.mean, r.fused) for r in vectors.fused(df.repartition(5), "g", "v", bins).collect()}
        assert len(got) == 17 and got["gaps", 2] == (3.0, 3.0, 3.0)
        for g, m in groups.items():
            for at in range(4):
                mid, mean = np.median(m[:, at]), m[:, at].mean()
                assert got[g, at] == pytest.approx((mid, mean, 0.65 * mid + 0.35 * mean), abs=1e-9)


def test_labels_carried_by_correlation(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, 16)
    frames = [("v", i, [float(x) for x in (base if i % 3 else -base) + rng.normal(0, 0.3, 16)]) for i in range(40)] + [("v", 40, [1.0] * 16), ("v", 41, [1.0, 2.0]), ("w", 3, [2.0] * 16)]
    df = spark.createDataFrame(frames, "video string, i long, e array<double>")
    got = {(r.video, r.reference, r.target): r.correlation for r in vectors.propagated(df.where("i in (4, 20, 38, 40)"), df, "video", "i", "e", 6, 0.5, 2, df.where("i = 16"), 1).collect()}
    by = {(v, i): np.array(e) for v, i, e in frames}
    want = {}
    for ref in (4, 20, 38):
        for o in (-6, -4, -2, 2, 4, 6):
            t = ref + o
            if ("v", t) in by and len(by["v", t]) == 16 and abs(t - 16) > 1 and by["v", t].std() > 0:
                r = np.corrcoef(by["v", ref], by["v", t])[0, 1]
                if r >= 0.5:
                    want["v", ref, t] = pytest.approx(r, abs=1e-9)
    assert got == want and len(want) > 5


def test_tracker_on_cut_streams_equals_one_run(spark):
    import pandas as pd

    rng = random.Random(6)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 100, 400, 2499, 2500, 2501, 6000]) if i else 0
        x, y = rng.randrange(3) * 60, rng.randrange(2) * 50
        rows.append(("v" if i % 3 else "w", i, t, i, rng.random(), x, y, x + 100, y + 80))
    rows += [("n", 1000 + i, None if i == 4 else i * 4000, i, 0.5, 0, 0, 100, 80) for i in range(8)] + [(None, 2000, 5, 1, 0.5, 0, 0, 9, 9)]
    columns = "video string, detection_id long, timestamp_ms long, frame_index long, confidence double, x_min int, y_min int, x_max int, y_max int"
    df = spark.createDataFrame(rows, columns)
    want = {}
    for video in ("v", "w", "n", None):
        one = tracks.OpenTracks(2500, 0.18)
        part = pd.DataFrame([r for r in rows if r[0] == video], columns=[c.split()[0] for c in columns.split(", ")])
        want |= {d.detection_id: one.take(d) for d in tracks.in_time_order(part).itertuples()}
    for most in (1, 30, 50_000):
        got = {r.detection_id: r.track for r in tracks.associate(df, "video", "video string, detection_id long, track long", rows=most).collect()}
        assert got == want
        cuts = {r.video: r.n for r in tracks.segments(df, "video", 2500, most).groupBy("video").agg(F.countDistinct("_segment").alias("n")).collect()}
        assert cuts["n"] == 1 and (cuts["v"] > 20 if most == 1 else 2 <= cuts["v"] < 20 if most == 30 else cuts["v"] == 1)


def test_entries_are_used_up_in_the_order_of_rows(spark):
    rng = random.Random(10)
    rows = [(r, e, float(rng.choice([3, 8, 44, 46, 60, 61, 70, 90]) + rng.randrange(3)), rng.random() < 0.9, rng.choice([0.0, 0.1, 0.2, 0.3, 0.6])) for r in range(60) for e in rng.sample(range(45), 6)]
    rows += [(100 + i, 100 + j, 50.0 + j, True, 0.0) for i in range(6) for j in (i, i + 1)]  # each decision moves the next
    df = spark.createDataFrame(rows, "r int, e int, score double, same_file boolean, iou double")
    used, want = set(), set()
    for r in sorted({x[0] for x in rows}):
        free = sorted([(-s, e, same, o) for a, e, s, same, o in rows if a == r and e not in used])
        if not free:
            continue
        s, (_, e, same, o), second = -free[0][0], free[0], -free[1][0] if len(free) > 1 else 0.0
        ok = (o >= 0.5 or s - second >= 2) if same and o >= 0.18 else s >= 45 and s - second >= 8
        if ok:
            used.add(e)
            want.add((r, e, s, s - second))
    got = {(x.r, x.e, x.score, x.margin) for x in score.resolved(df, "r", "e").collect()}
    assert got == want and len(want) > 15
    assert score.resolved(df.limit(0), "r", "e").collect() == []


def test_best_partners_coverage_and_reach_against_all_pairs(spark):
    # Crowded boxes, many of them equal, some empty, on halves of pixels; ties of the best overlap and boxes beside each other's corner cells.
    rng = random.Random(11)

    def some(n, first):
        out = []
        for i in range(n):
            x, y = rng.randrange(0, 60) / 2, rng.randrange(0, 40) / 2
            far = 300 if rng.random() < 0.2 else 0
            w, h = rng.choice([(20, 10), (21, 10), (20.5, 12), (40, 30), (0, 5)])
            out.append((i % 2, first + i, (x + far, y, x + far + w, y + h), i % 70 if i % 9 else None))
        return out

    left, right = some(120, 0), some(260, 1000)
    schema = "video int, k long, bbox struct<x_min:double,y_min:double,x_max:double,y_max:double>, track int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    best, cover, met = {}, {}, set()
    for v, k, x, _ in left:
        near = [(iou(x, y), f, t) for w, f, y, t in right if v == w]
        top = max(s for s, _, _ in near)
        if top >= 0.18:
            best[k] = (min(f for s, f, _ in near if round(s, 9) == round(top, 9)), round(top, 9))
        cover[k] = (round(top, 9), len({t for s, _, t in near if s >= 0.5 and t is not None}), top >= 0.5)
        met |= {k} if top >= 0.5 else set()
    assert {0 < s < 0.9 for _, s in best.values()} == {True, False} and 0 < len(met) < len(left)
    got = spatial.best_iou(a, b.withColumnRenamed("k", "f"), "video", "k", "f", "bbox", 64, 0.18, digits=9).collect()
    assert {r.k: (r.f, round(r.iou, 9)) for r in got} == best and len(got) == len(best)
    got = spatial.coverage(a, b.withColumnRenamed("k", "f"), "video", "k", "f", "track", "bbox", 64, 0.5).collect()
    assert {r.k: (round(r.best_iou, 9), r.n_tracks, r.covered) for r in got} == cover and len(got) == len(cover)
    got = spatial.reached(a, b, "video", "k", "bbox", 64, 0.5).collect()
    assert {r.k for r in got} == met and len(got) == len(met)


def _joined_rows(df):
    """The most rows that any join of the query gave, from the metrics of its run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if "AdaptiveSparkPlan" in name:
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
        m = p.metrics().get("numOutputRows")
        if "Join" in name and m.isDefined():
            found.append(m.get().value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return max(found)


def test_pairs_of_equal_boxes_are_compared_once(spark):
    box = F.struct(*[F.lit(v).alias(c) for c, v in (("x_min", 0), ("y_min", 0), ("x_max", 20), ("y_max", 10))])
    a = spark.range(300).select(F.lit(1).alias("video"), F.col("id").alias("l"), box.alias("bbox"))
    pairs = spatial.iou_pairs(a, a.withColumnRenamed("l", "r"), "video", "l", "r", "bbox", 64, 0.3)
    assert pairs.count() == 300 * 300 and _joined_rows(pairs) == 1


def test_seek_back_takes_each_frame_and_target_once(spark):
    # Before, each target met all frames of its bucket: here 400 x 400 pairs.
    f = spark.range(400).select(F.lit("v").alias("video"), (F.col("id") * 10 % 1000).alias("ts"), F.col("id").alias("frame"))
    t = spark.range(400).select(F.lit("v").alias("video"), (F.col("id") * 7 % 2100 - 50).alias("at_ms"), F.col("id").alias("k"))
    got = spatial.seek_back(t, f, "video", "at_ms", "ts", 1000)
    frames, want = [(i * 10 % 1000, i) for i in range(400)], set()
    for k in range(400):
        at = k * 7 % 2100 - 50
        near = [x for x in frames if x[0] <= at and at - x[0] <= 1000]
        if near:
            want.add((k, *max(near)))
    assert {(r.k, r.ts, r.frame) for r in got.collect()} == want and _joined_rows(got) <= 400
