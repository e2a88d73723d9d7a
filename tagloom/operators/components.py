"""Distributed connected components by alternating large-star and small-star rounds.

Every round re-hangs edges onto smaller neighbours with a map-side combined minimum and an
equi-join, which the adaptive planner splits where one node is hot. The edge table is written to
the shared folder after each round, so a lost executor costs one round at most. Rounds grow with
the logarithm of the longest chain. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored

#: Edges that a task contracts at once, and how many make a task of their own.
CHUNK, TASK_EDGES = 1_000_000, 200_000


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """`node`, `component` for every node of an edge; the component is its least node.

    Null ends and loops are ignored; repeated and reversed edges count once. No edges: no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    e, sign = stored(e.distinct(), "edges"), None
    while True:
        got = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if not got["n"] or (got["n"], got["h"]) == sign:
            break
        sign, last = (got["n"], got["h"]), e
        e = stored(_small_star(_large_star(e).distinct()).distinct(), "edges")
        forget(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1, the least one that edges lead to."""
    label = np.arange(n)
    while True:
        before, x, y = label.copy(), label[a], label[b]
        least = np.minimum(x, y)
        for at in (x, y, a, b):
            np.minimum.at(label, at, least)
        label = label[label]
        if (label == before).all():
            return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars: each node but the least one of what they join points to that one. `moved`: the edge is new."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        ends = pa.concat_arrays([table.column(c).combine_chunks() for c in ("u", "v")]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[ends.indices.to_numpy()]
        u, v = codes[:n], codes[n:]
        to = _least_reached(len(order), u, v)
        node = np.flatnonzero(to != np.arange(len(to)))
        known = np.isin(node * len(to) + to[node], u * len(to) + v)
        single = np.bincount(u, minlength=len(to))[node] <= 1
        names = ends.dictionary.take(pa.array(order))
        return pa.RecordBatch.from_arrays([names.take(pa.array(node)), names.take(pa.array(to[node])), pa.array(~(known & single))], names=["u", "v", "moved"])

    held, rows = [], 0
    for b in batches:
        held.append(b.select(["u", "v"]))
        rows += b.num_rows
        if rows >= CHUNK:
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def contracted_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """The same as `connected_components`, in few and short rounds, with Arrow batches.

    Tasks first contract the edges that they hold to stars, so a hub has an edge a task at most when edges meet by their greater node. There
    they are contracted again, and each node goes on from its parent to the parent's parent by an equi-join. A round takes three shuffles
    and halves the distance to the least node at least; the last one is that in which no edge moves. There are as many tasks as the edges
    fill, or two a core, so that rounds over few edges don't cost more than their shuffles.
    """
    kind = edges.schema[src].dataType.simpleString()
    fields = f"u {kind}, v {kind}, moved boolean"
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    e = stored(e.mapInArrow(_contract, fields), "edges")
    tasks = max(2 * e.sparkSession.sparkContext.defaultParallelism, e.count() // TASK_EDGES)
    while True:
        a = e.repartition("u").coalesce(tasks).mapInArrow(_contract, fields)
        up = a.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("v"), "w")
        b = a.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), (F.col("moved") | F.col("w").isNotNull()).alias("moved"))
        last, e = e, stored(b.coalesce(tasks), "edges")
        forget(last)
        if e.where("moved").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
