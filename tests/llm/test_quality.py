from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tagloom.llm import quality as Q

from .helpers import DOCS, prose, rows, words


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_measures_match_brute_force(spark):
    rng = random.Random(2)
    few = "alpha beta gamma delta".split()
    texts = [prose(rng, n) for n in (5, 19, 20, 80, 500)]
    texts += [" ".join(rng.choice(few) for _ in range(n)) for n in (8, 9, 16, 40, 300)]
    texts += ["a b c d e f g h\n" * 3, "x\n\nx\n x \n\t\n", "🎈 ünï\x0b#*$%&|<>\x0c\r\n end", "  a b", "", None, "   ", ("w " * 30_000), " ".join(texts[3:5] * 2)]
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, DOCS).withColumn("n_words", F.lit("own")).withColumn("_t", F.lit(1))
    got = {r["doc_id"]: r for r in rows(Q.judge(df))}
    for i, t in enumerate(texts):
        want = measures(t)
        assert {k: got[i][k] for k in want} == want, (i, want)
        assert got[i]["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert got[i]["_t"] == 1
    assert Q.judge(df.limit(0)).count() == 0


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    d = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(Q.js_distance(F.col("p"), F.col("q")).alias("d"), Q.js_distance(F.col("p"), F.col("p")).alias("z")).head()
    assert abs(d.d - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12 and d.z == 0


def test_distances_match_brute_force(spark):
    rng = random.Random(6)
    texts = [prose(rng, n) for n in (70, 200, 900)] + ["THE End. " * 40, "... " * 130, "Of, the; (and) 12 %% \n" * 30]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in rows(Q.judge(df, Q.QualityRules(guard_chars=1, guard_words=1)))}
    classes = [str.islower, lambda c: c in " \t\n\v\f\r", str.isupper, str.isnumeric, lambda c: c in ".,;:!?'\"()-", lambda c: c in "#*$%&|<>", lambda c: True]

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        return math.sqrt((kl(p) + kl(q)) / 2)

    for i, t in enumerate(texts):
        found = Counter(next(k for k, f in enumerate(classes) if f(c)) for c in t)
        assert abs(got[i]["char_distance"] - distance([found[k] / len(t) for k in range(7)], Q.char_reference("en"))) < 1e-9
        w = [x for x in re.split(r"[\s.,;:!?\"'()]+", t.lower()) if x]
        listed = [w.count(x) / len(w) if w else 0 for x in Q.COMMON_WORDS["en"]]
        if w:
            assert abs(got[i]["word_distance"] - distance([*listed, 1 - sum(listed)], Q.word_reference("en"))) < 1e-9
        else:
            assert got[i]["word_distance"] is None


def test_a_verdict_depends_on_its_document_alone_and_names_may_clash(spark):
    rng = random.Random(7)
    docs = [(i, prose(rng, 200) if i % 2 else " | ".join(words(rng, 90, common=0)), "en", "s") for i in range(8)]
    df = spark.createDataFrame([(*d, 5, "y") for d in docs], DOCS + ", `a.b` int, `TEXT` string")
    every = {r["doc_id"]: r["kept"] for r in rows(Q.judge(df, carry=["a.b", "doc_id"]))}
    alone = {i: Q.judge(df.where(f"doc_id = {i}")).head()["kept"] for i in (0, 1)}
    assert every[0] == alone[0] is False and every[1] == alone[1] is True
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in rows(kept.select("doc_id"))} == {1, 3, 5, 7}


def test_odd_documents_go_and_clean_and_unjudged_ones_stay(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(80, 400)), "en", "s") for i in range(200)]
    odd = [(1000, " ".join(f"{rng.randint(0, 10**6)}%%%" for _ in range(150)), "en", "s"), (1001, " ".join("".join(rng.choice("QXZWVK!?%") for _ in range(9)) for _ in range(120)), "en", "s")]
    free = [(1002, odd[0][1], "xx", "s"), (1003, odd[0][1], None, "s"), (1004, "short but fine " * 1 + "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18", "en", "s")]
    df = spark.createDataFrame(docs + odd + free, DOCS)
    got = {r["doc_id"]: r["kept"] for r in rows(Q.judge(df, carry=["doc_id"]))}
    assert all(got[i] for i in range(200)) and not got[1000] and not got[1001] and all(got[i] for i in (1002, 1003, 1004))
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 203


def test_the_pipeline_drops_lists_without_common_words(spark):
    import corpus_pipeline

    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randint(80, 400)), "en", "s") for i in range(200)]
    lists = [(1000 + i, " | ".join(words(rng, rng.randint(80, 200), common=0)), "en", "s") for i in range(10)]
    # Prose of few common words of its own language.
    few = [(2000 + i, " ".join(words(rng, rng.randint(300, 500), common=0.2)), "fr", "s") for i in range(40)]
    french = dict(zip(("the", "of", "and", "to", "in", "is"), ("de", "la", "le", "et", "les", "des")))
    few = [(i, " ".join(french.get(w, w) for w in t.split()), lang, s) for i, t, lang, s in few]
    junk = [(3000 + i, " ".join(words(rng, 200, common=0)), "fr", "s") for i in range(3)]
    df = spark.createDataFrame(docs + lists + few + junk, DOCS)
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, df, "").collect()}
    assert kept == {d[0] for d in docs + few}


def test_each_language_has_its_references():
    for lang in Q.COMMON_WORDS:
        words, chars = Q.word_reference(lang), Q.char_reference(lang)
        assert len(words) == 51 and len(chars) == 7 and abs(sum(words) - 1) < 1e-9 and abs(sum(chars) - 1) < 1e-9 and min(chars) >= 0
        none = [0.0] * 50 + [1.0]
        m = [(a + b) / 2 for a, b in zip(none, words)]
        kl = lambda a, m=m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        assert abs(Q.without_common_words(lang) - math.sqrt((kl(none) + kl(words)) / 2)) < 1e-12
    assert len({tuple(Q.char_reference(lang)) for lang in Q.COMMON_WORDS}) == 4
    assert Q.without_common_words("de") < Q.without_common_words("en")
