"""Chat formatting of typed content parts, in DataFrame functions only.

A message is a list of parts: text, image, audio or document. A visitor turns each part into
template text: a text part into its escaped text, an attachment into a placeholder such as `<image 0>`,
numbered within its turn, whose reference and expanded token count go to the conversation's
attachment list. A turn becomes `<turn ROLE>`, a line end, its parts and `</turn>` with a line end.

Inside texts and roles `\\` becomes `\\b`, `<` becomes `\\l` and (in roles) `>` becomes `\\g`. So `<`
stands in markup alone, every control string that a text holds is inert, and replacing `\\l`, `\\g`
and then `\\b` back restores the text.

The loss mask lists the contents of turns whose role is trained on, as spans: the turn's number, and
offset and length inside the turn's block, so that cutting them out is linear in the length.

Defined cases: turns go by number (null first), ties by role, then by content; repeated rows stay.
A null text, role or part list counts as empty; a part of unknown type is an attachment of no
tokens. A null conv_id is a conversation of its own. A conversation is one row, so one task holds
its text; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import narrow

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class ChatRules:
    trained_roles: tuple[str, ...] = ("assistant",)
    image_patch: int = 28
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    for code, mark in (("\\l", "<"), ("\\g", ">"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def _visit_tokens(p: Column, r: ChatRules) -> Column:
    """Tokens that the placeholder of an attachment stands for."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / r.image_patch)
    return (
        F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * r.audio_tokens_per_second))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * F.lit(r.document_tokens_per_page))
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_text(p: Column) -> Column:
    return p["type"] == "text"


def text_messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts from a table with one text a turn."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
    )
    return narrow(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(messages: DataFrame, rules: ChatRules = ChatRules()) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens, one row per conversation."""
    m = narrow(messages, "conv_id", "turn", "role", "parts")
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    m = m.withColumns({"parts": parts, "role": F.coalesce("role", F.lit(""))})
    m = m.withColumn("_held", F.filter("parts", lambda p: ~F.coalesce(_is_text(p), F.lit(False))))
    pieces = F.transform(
        "parts",
        lambda p, i: F.when(F.coalesce(_is_text(p), F.lit(False)), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), _kind(p), F.lit(" "), F.size(F.filter(F.slice("parts", F.lit(1), i), lambda q: ~F.coalesce(_is_text(q), F.lit(False)))), F.lit(">"))
        ),
    )
    m = m.withColumn("_content", F.array_join(pieces, ""))
    m = m.withColumn("_head", F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(">\n")))
    held = F.transform("_held", lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"), _visit_tokens(p, rules).alias("tokens")))
    turn = F.struct("turn", "role", F.col("_content").alias("content"), F.col("_head").alias("head"), held.alias("held"))
    g = m.select("conv_id", turn.alias("_t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    spans = F.filter(
        F.transform(
            "_ts",
            lambda t, i: F.struct(i.alias("turn"), F.length(t["head"]).alias("offset"), F.length(t["content"]).alias("chars"), t["role"].isin(list(rules.trained_roles)).alias("_on")),
        ),
        lambda s: s["_on"],
    )
    return g.select(
        "conv_id",
        F.size("_ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("_ts", lambda t: F.concat(t["head"], t["content"], F.lit("</turn>\n"))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["turn"].alias("turn"), s["offset"].alias("offset"), s["chars"].alias("chars"))).alias("loss_spans"),
        F.flatten(F.transform("_ts", lambda t, i: F.transform(t["held"], lambda a, j: F.struct(i.alias("turn"), j.alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.transform("_ts", lambda t: F.transform(t["held"], lambda a: a["tokens"]))), F.lit(0).cast("long"), lambda s, x: s + x).alias("attachment_tokens"),
    )


def _kind(p: Column) -> Column:
    """The type of an attachment as it stands in markup."""
    return F.regexp_replace(F.coalesce(p["type"], F.lit("unknown")), r"[^A-Za-z0-9_-]", "_")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; placeholders left out) and loss_text, from the formatted string and its spans alone."""
    f = narrow(formatted, "conv_id", "formatted", "loss_spans")
    blocks = F.split("formatted", "</turn>\n")  # `<` is markup everywhere, so this is exact
    f = f.withColumn("_blocks", F.slice(blocks, F.lit(1), F.size(blocks) - 1))
    plain = lambda x: unescape(F.regexp_replace(x, "<[^>]*>", ""))
    head = lambda b: F.substring_index(b, ">\n", 1)
    turns = F.transform(
        "_blocks",
        lambda b: F.struct(
            unescape(F.replace(head(b), F.lit("<turn "), F.lit(""))).alias("role"),
            plain(F.substr(b, F.length(head(b)) + 3)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: plain(F.substr(F.get("_blocks", s["turn"]), s["offset"] + 1, s["chars"])))
    return f.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of the formatted conversations, read back from them."""
    back = read_back(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
WITH rows_of AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS e,
  replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS r FROM rows_of)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, e)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, e) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(e) + 16)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
