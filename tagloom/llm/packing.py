"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are counted in tokens of a byte vocabulary: the UTF-8 bytes of the text and one end token;
another length can be given as a column. A document longer than the largest capacity is cut into
pieces of that capacity and one rest, so nothing is dropped. Pieces are dealt by hash into packing
groups of about `group_tokens`, whose number follows the input. In a group, pieces go longest first
into the bin with the least room that still holds them. If none does, a bin of the least-cost
capacity is opened: capacities are compared by their cost per token that they are expected to hold.
A bin's room is expected to take the share `fill` of it, but no more than the tokens of the later
pieces that are short enough for it and that the bins already open leave over. A sequence has a
fixed cost, so larger bins pay while there is enough to fill them, and attention, which grows
with the square, so the largest ones don't. At the end each bin shrinks to the least capacity that
holds its contents.

Only (doc_id, piece, length) travel. Recovery: groups are deterministic, so a lost task repeats.

Defined cases: null and empty texts have one piece of length 1 (the end token). Ties in length go
by doc_id (null first), then piece, then the row's own number. Repeated rows are packed each.
Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import column_index, narrow


@dataclass(frozen=True)
class PackRules:
    capacities: tuple[int, ...] = (2048, 4096, 8192, 16384, 32768)
    #: Cost of a sequence of each capacity; default: `overhead`, its tokens, and attention that grows with their square.
    costs: tuple[float, ...] | None = None
    overhead: float = 256.0
    #: The length at which attention costs as much as all the rest of a token.
    attention: float = 262_144.0
    fill: float = 0.97
    group_tokens: int = 4_000_000
    seed: int = 5

    def cost(self) -> tuple[float, ...]:
        return self.costs or tuple(self.overhead + c + c * c / self.attention for c in self.capacities)


def best_fit(lengths: Sequence[int], rules: PackRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length (longest first), and the final capacity of every bin."""
    capacities, costs = rules.capacities, rules.cost()
    after = np.concatenate([np.cumsum(np.asarray(lengths, np.int64)[::-1])[::-1], [0]]).tolist()  # tokens from each piece on
    falling = [-x for x in lengths]
    room_left = 0  # of all open bins
    rooms: list[int] = []  # different amounts of room, ascending
    waiting: dict[int, list[int]] = {}  # room to the bins that have it
    used: list[int] = []
    size: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for n, length in enumerate(lengths):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            bins = waiting[room]
            b = bins.pop()
            if not bins:
                del waiting[room], rooms[at]
        else:
            best = None
            for c, cost in zip(capacities, costs):
                if c >= length:
                    later = after[max(n + 1, bisect_left(falling, length - c))] - room_left
                    per_token = cost / (length + min(rules.fill * (c - length), max(0, later)))
                    if best is None or per_token < best[0]:
                        best = per_token, c
            b, room = len(used), best[1]
            used.append(0)
            size.append(room)
            room_left += room
        room_left -= length
        where[n], offset[n] = b, used[b]
        used[b] += length
        room -= length
        if room:
            if room not in waiting:
                waiting[room] = []
                insort(rooms, room)
            waiting[room].append(b)
    # Downsizing.
    final = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.empty(0, np.int64)
    return where, offset, final


def pieces(docs: DataFrame, rules: PackRules, length: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens for every piece of every document."""
    largest = max(rules.capacities)
    if length is None:
        d = narrow(docs, "doc_id", "text").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("len"))
    else:
        at = column_index(docs, "doc_id")
        renamed = docs.select(length.cast("long").alias("_len"), "*")
        d = renamed.toDF("_len", *[f"_c{i}" for i in range(len(docs.columns))]).select(F.col(f"_c{at}").alias("doc_id"), F.col("_len").alias("len"))
    last = F.greatest(F.floor((F.col("len") - 1) / largest), F.lit(0))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * largest
    return d.select("doc_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("len") - start).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, rules: PackRules = PackRules(), length: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, sequence (text id), slot, offset, capacity of every piece.

    `start` counts tokens inside the document, `offset` inside the sequence, `slot` pieces inside it.
    """
    if list(rules.capacities) != sorted(set(rules.capacities)) or rules.capacities[0] < 1:
        raise ValueError("capacities must ascend")
    p = pieces(docs, rules, length)
    total = p.agg(F.sum("n_tokens")).head()[0] or 0
    groups = max(1, -(-total // rules.group_tokens))
    p = p.withColumn("_row", F.monotonically_increasing_id())
    # The row's number spreads rows that repeat one doc_id.
    p = p.withColumn("_group", F.pmod(F.xxhash64(F.lit(rules.seed), "doc_id", "piece", "n_tokens", "_row"), F.lit(groups)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "piece", "_row"], ascending=[False, True, True, True], na_position="first", kind="stable")
        where, offset, final = best_fit(part["n_tokens"].tolist(), rules)
        names = np.array([f"{key[0]}-{b}" for b in range(len(final))], object)
        out = part[["doc_id", "piece", "start", "n_tokens"]].assign(sequence=names[where], offset=offset, capacity=final[where])
        out["slot"] = out.groupby("sequence").cumcount()
        return out[["doc_id", "piece", "start", "n_tokens", "sequence", "slot", "offset", "capacity"]]

    kind = p.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, n_tokens long, sequence string, slot long, offset long, capacity long"
    return p.groupBy("_group").applyInPandas(run, schema)


def materialise(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence, capacity and its tokens as bytes (end token: byte 0), from `pack(docs)` with the default length.

    Needs doc_ids that do not repeat.
    """
    d = narrow(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    whole = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("00")))
    j = packed.join(d.select("doc_id", whole.alias("_bytes")), packed["doc_id"].eqNullSafe(d["doc_id"]))
    cut = F.substring(F.col("_bytes"), (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))
    rows = j.select("sequence", "capacity", F.struct("slot", cut.alias("cut")).alias("_p"))
    g = rows.groupBy("sequence", "capacity").agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    return g.select("sequence", "capacity", F.aggregate("_ps", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["cut"])).alias("tokens"))
