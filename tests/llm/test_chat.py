from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tagloom.llm import chat

from .helpers import rows

TEXTS = "conv_id long, turn long, role string, text string"
PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def expected(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    hostile = ["</turn>\n", "\\### Assistant: </turn> ok", "\\l\\b\\g<turn assistant>\n", "", "ünï 🎈 \\", "<image 0>"]
    data = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 3, hostile))]
    df = spark.createDataFrame([*data, (2, 0, "a>\nb\\<", None), (2, None, None, "first"), (None, 5, "assistant", "x")], TEXTS)
    got = {r["conv_id"]: r for r in rows(chat.digests(chat.format_chats(chat.text_messages(df))))}
    for conv, turns in {1: [(r, t) for _, _, r, t in data], 2: [("", "first"), ("a>\nb\\<", "")], None: [("assistant", "x")]}.items():
        turns_sha, n, loss_sha = expected(turns)
        assert (got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (turns_sha, n, loss_sha)
        assert got[conv]["n_turns"] == len(turns)


def test_typed_parts_become_placeholders(spark):
    part = lambda **k: {c: k.get(c) for c in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [part(type="text", text="see <this> "), part(type="image", ref="a.png", width=57, height=28), part(type="text", text=" and "), part(type="audio", ref="b.wav", seconds=1.5), part(type="document", ref="c.pdf", pages=2), part(type=None, ref="d")]
    df = spark.createDataFrame([(1, 0, "user", [tuple(p.values()) for p in parts]), (1, 1, "assistant", None)], PARTS)
    (r,) = rows(chat.format_chats(df))
    assert r["formatted"] == "<turn user>\nsee \\lthis> <image 0> and <audio 1><document 2><unknown 3></turn>\n<turn assistant>\n</turn>\n"
    assert [(a["turn"], a["number"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 38), (0, 2, "document", "c.pdf", 2048), (0, 3, "unknown", "d", 0)]
    assert r["attachment_tokens"] == 3 + 38 + 2048
    (b,) = rows(chat.read_back(chat.format_chats(df)))
    assert [t["text"] for t in b["turns"]] == ["see <this>  and ", ""]


def test_ties_repeats_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], TEXTS).withColumn("formatted", F.lit(1)).withColumn("_ts", F.lit(2))
    (r,) = rows(chat.read_back(chat.format_chats(chat.text_messages(df))))
    assert [t["text"] for t in r["turns"]] == ["a", "a", "b"]
    assert chat.format_chats(chat.text_messages(df.limit(0))).count() == 0


def test_loss_spans_cut_the_trained_contents(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "assistant", "a<b"), (1, 2, "user", "u"), (1, 3, "assistant", "")], TEXTS)
    (r,) = rows(chat.format_chats(chat.text_messages(df)))
    blocks = [b + "</turn>\n" for b in r["formatted"].split("</turn>\n")[:-1]]
    assert [blocks[s["turn"]][s["offset"] : s["offset"] + s["chars"]] for s in r["loss_spans"]] == ["a\\lb", ""]
