from __future__ import annotations

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import token_output as T

from .helpers import DOCS, prose, rows

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = str(public.path("word_bpe_49k.json"))


def whole(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_files_hold_the_ids_of_whole_texts(spark):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 7, 300)] + ["", None, "  a b \t don't STOP 12 3.4 ü é ́x", "a<|endoftext|>b <|startoftext|>", "x\x0by\x0cz\r\n", "word " * 40_000, "🎈🎈 ñ"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = [(i, texts[i], "en", "s") for i in ids]
    df = spark.createDataFrame(docs, DOCS).withColumn("ids", F.lit("own")).repartition(4)
    path, got = T.tokenize_to_orc(df, T.OutputRules(PATH, slice_bytes=500, word_cache=50))
    want, start = {}, 0
    for i, seq in enumerate(whole(texts)):
        want[i] = (start, len(seq), zlib.crc32(struct.pack(f"<{len(seq)}I", *seq)))
        start += len(seq)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(got)} == want
    some = {r["doc_id"]: r["ids"] for r in rows(T.read_ids(spark, path, doc_ids=[2, 5]))}
    assert some == {2: whole(texts)[2], 5: whole(texts)[5]}


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a", "", ""), (3, "b c", "", ""), (3, "b c", "", ""), (3, "d", "", "")], DOCS)
    _, got = T.tokenize_to_orc(df, T.OutputRules(PATH))
    spans = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in rows(got))
    assert spans[0] == (0, 2, None)
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(spans, spans[1:]))
    _, none = T.tokenize_to_orc(df.limit(0), T.OutputRules(PATH))
    assert none.count() == 0


def test_special_tokens_in_other_letter_case_are_plain_text():
    import pyarrow as pa

    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> B", "X<|STARTOFTEXT|>Y.", "A<|endoftext|>B,", "<|<|ENDOFTEXT|>", "Up <| DOWN |> <|Other|>", "", "END. <|startoftext|>. <|ENDOFTEXT|>."]
    known = T.WordIds(tokenizers.Tokenizer.from_file(PATH), 1000)
    ids, counts = T.token_lists(pa.array(texts), known)
    at = [0, *counts.cumsum()]
    assert [[*ids[a:b].tolist(), 1] for a, b in zip(at, at[1:])] == whole(texts)


def test_other_tokenizers_encode_whole_texts(spark):
    path = str(public.path("byte_bpe_50k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    assert not T.splits_at_space(t) and T.splits_at_space(tokenizers.Tokenizer.from_file(PATH))
    texts = ["Two words, and  more\n\nhere", None, " x", "a<|endoftext|>b", "é" * 3000]
    df = spark.createDataFrame([(i, x, "", "") for i, x in enumerate(texts)], DOCS)
    path_of_files, _ = T.tokenize_to_orc(df, T.OutputRules(path, end_id=50256))
    got = {r["doc_id"]: r["ids"] for r in rows(T.read_ids(spark, path_of_files))}
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 50256] for i, x in enumerate(texts)}


def test_probes_hold_and_a_changed_definition_falls_back():
    known = T._known.__wrapped__(PATH, 1000)
    assert known.by_words
    t = tokenizers.Tokenizer.from_file(PATH)
    t.normalizer = tokenizers.normalizers.NFKC()
    assert not T.splits_at_space(t)


def test_files_are_numbered_not_sorted_as_text(spark, tmp_path):
    """With more than 100,000 files, names have different widths."""
    for name, ids in (("part-99999-x", [(1, [5, 1]), (2, [1])]), ("part-100000-x", [(3, [7, 8, 1])])):
        spark.createDataFrame(ids, "doc_id long, ids array<int>").coalesce(1).write.orc(f"{tmp_path}/{name}")
        (part,) = (tmp_path / name).glob("part-*.orc")
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / f"{name}.orc")
    got = sorted((r["doc_id"], r["start"]) for r in rows(T.positions(spark, str(tmp_path / "all"), "long")))
    assert got == [(1, 0), (2, 2), (3, 3)]


def same_as_whole(texts, most=100_000):
    import pyarrow as pa

    known = T.WordIds(tokenizers.Tokenizer.from_file(PATH), most)
    ids, counts = T.token_lists(pa.array(texts), known)
    at = [0, *counts.cumsum()]
    return [t for t, a, b, w in zip(texts, at, at[1:], whole(texts)) if [*ids[a:b].tolist(), 1] != w]


def test_signs_behind_letters_that_become_marks():
    """U+0130 in lower case and U+0958 normalized end in marks, which the tokenizer doesn't cut from the signs behind them."""
    assert same_as_whole(["İ.", "ab İ, x", "क़,", "é.", "é.", "x$$$", "x,***", "x'!", "Ž;", "Я?", "a<|endoftext|>.", "a|>", "<|a.b|>,"]) == []


def test_words_of_all_characters_are_encoded_as_in_whole_texts():
    letters = [chr(c) for c in range(1, 0x3100)]
    assert same_as_whole([f.format(c) for c in letters for f in ("{}", "a{}b", "é{}$,")]) == []
    rng = random.Random(5)
    signs = [*"abzABZ019éßÿ×÷'.,;!#$%&*<|>{}~ \n", "'s", "'re", "<|endoftext|>", "́", "İ", "ᄀ", "ᅡ", "\x1c", "\x85"]
    for most in (20, 100_000):
        assert same_as_whole(["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(3000)], most) == []


def test_words_met_again_stay_and_signs_are_words_of_their_own(monkeypatch):
    import pyarrow as pa

    asked = []
    encoded = T.WordIds._encoded
    monkeypatch.setattr(T.WordIds, "_encoded", lambda self, words, *more: (asked.extend(words), encoded(self, words, *more))[1])
    known = T.WordIds(tokenizers.Tokenizer.from_file(PATH), 12)
    for i in range(20):
        T.token_lists(pa.array([f"often seen$$$ seen, {'x' * i}once twice{'y' * i}&&& {'z' * i}thrice"]), known)
        assert len(known.place) <= 12
    assert [asked.count(w) for w in ("often", "seen", "$$$", ",", "&&&")] == [1] * 5
    assert "seen$$$" not in asked and "twice&&&" not in asked


def test_files_are_measured_once(spark):
    df = spark.createDataFrame([(2, "a b", "", ""), (1, "c", "", "")], DOCS)
    _, got = T.tokenize_to_orc(df, T.OutputRules(PATH))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "orc" not in plan.lower()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in rows(got)) == [(1, 0, 2), (2, 2, 3)]
