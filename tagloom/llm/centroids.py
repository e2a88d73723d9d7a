"""Centroid clustering with Yinyang bounds.

Vectors of whole numbers go to their nearest centroid, round after round. Centroids are put into a few
groups once, before the first round. Every vector carries an upper bound of the distance to its own
centroid and one lower bound a group for all others in it. After centroids have moved, bounds follow by
the drifts: a vector whose upper bound is below all lower ones stays without a look at it; of the others,
only groups that may hold a nearer centroid are opened, and in them only centroids whose own bound
doesn't exclude them are measured, exactly. So results are those of comparing with every centroid.

A round is one narrow pass that writes vectors and bounds to the shared folder; the table before it is
deleted. Sums change by the vectors that moved alone: each batch adds these up, and what meets in a
shuffle is a row for each batch, centroid and component. The driver sees sums and centroids, whose number
parameters fix. There is no shuffle of vectors, so no cluster is too large for a task. Once nothing
moves, the rounds that are left would change nothing and are left out.

Defined cases: vectors of another length, or with a component that is null or not finite, are left out;
repeated vec_ids are vectors of their own, a null vec_id never is a first centroid before others.
Components are held within +-2 ** 27 after scaling, so that every distance fits a long. Equal distances
go to the smaller number. Fewer vectors than centroids: as many centroids as vectors. Empty tables
give no rows; columns of other names aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored
from .frames import narrow

#: Bounds are floating-point numbers; within this share of each other they don't exclude anything.
SLACK = 1e-9


@dataclass(frozen=True)
class ClusterRules:
    k: int = 8
    rounds: int = 10
    groups: int = 3
    length: int = 64
    scale: int = 1024
    seed: int = 3
    largest: int = 1 << 27


def whole_vectors(embeddings: DataFrame, rules: ClusterRules = ClusterRules()) -> DataFrame:
    """`vec_id` and `v`, the components as whole numbers, of all vectors that can be clustered."""
    e = narrow(embeddings, "vec_id", "embedding")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    near = lambda x: F.greatest(F.lit(-float(rules.largest)), F.least(F.lit(float(rules.largest)), x))
    v = F.transform("embedding", lambda x: F.floor(near(x.cast("double") * F.lit(float(rules.scale)))))
    return e.where((F.size("embedding") == rules.length) & good).select("vec_id", v.alias("v"))


def first_centroids(vectors: DataFrame, rules: ClusterRules) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order: k rows."""
    order = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "vec_id", "v").select("v").take(rules.k)
    return np.array([r.v for r in rows], np.int64).reshape(-1, rules.length)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids, begun at those that lie farthest apart."""
    c = centroids.astype(np.float64)
    seeds = [0]
    while len(seeds) < min(groups, len(c)):
        seeds.append(int(np.argmax(np.min([((c - c[s]) ** 2).sum(1) for s in seeds], axis=0))))
    means = c[seeds]
    for _ in range(5):
        of = np.argmin(((c[:, None] - means[None]) ** 2).sum(2), axis=1)
        means = np.array([c[of == g].mean(0) if (of == g).any() else means[g] for g in range(len(means))])
    return np.unique(of, return_inverse=True)[1]


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def advance(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, group: np.ndarray):
    """New numbers and bounds after centroids have moved from `old` to `new`, and how many distances that took."""
    drift = np.sqrt(_squared(old, new).astype(np.float64))
    most = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    own, upper, before = own.copy(), upper + drift[own], lower
    lower = lower - most
    at = np.flatnonzero(lower.min(1) <= upper * (1 + SLACK))  # the global filter
    mine = _squared(x[at], new[own[at]])
    upper[at] = np.sqrt(mine.astype(np.float64))
    still = lower[at].min(1) <= upper[at] * (1 + SLACK)
    measured = len(at)
    at, mine = at[still], mine[still]
    reach, rows = upper[at] * (1 + SLACK), np.arange(len(at))
    bound = before[at][:, group] - drift
    open_group = lower[at] <= reach[:, None]
    look = open_group[:, group] & (bound <= reach[:, None])  # the groups' filter, and each centroid's
    look[rows, own[at]] = False
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, own[at]], bound[rows, own[at]] = mine, upper[at]
    for c in range(len(new)):
        hit = np.flatnonzero(look[:, c])
        exact[hit, c] = _squared(x[at[hit]], new[c])
        bound[hit, c] = np.sqrt(exact[hit, c].astype(np.float64))
        measured += len(hit)
    own[at] = best = exact.argmin(1)  # the first of equals
    upper[at] = bound[rows, best]
    bound[rows, best] = np.inf
    for g in range(lower.shape[1]):
        lower[at, g] = bound[:, group == g].min(1)
    return own, upper, lower, measured


def _matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _round(old: np.ndarray | None, new: np.ndarray, group: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = _matrix(b.column("v"), new.shape[1])
            if old is None:
                was = np.full(n, -1, np.int32)
                state = np.zeros(n, np.int64), np.full(n, np.inf), np.full((n, group.max() + 1), -np.inf)
            else:
                was = b.column("cluster").to_numpy()
                state = was.astype(np.int64), b.column("upper").to_numpy(), _matrix(b.column("lower"), group.max() + 1, np.float64)
            own, upper, lower, _ = advance(x, *state, new if old is None else old, new, group)
            made = [b.column("vec_id"), b.column("v"), pa.array(was), pa.array(own.astype(np.int32)), pa.array(upper), _lists(lower)]
            yield pa.RecordBatch.from_arrays(made, names=["vec_id", "v", "was", "cluster", "upper", "lower"])

    return run


def _moves(k: int, width: int):
    """How sums and counts of the centroids change by a batch of vectors that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            change = np.zeros((k, width + 1), np.int64)
            x = np.column_stack([_matrix(b.column("v"), width), np.ones(b.num_rows, np.int64)])
            was, now = b.column("was").to_numpy(), b.column("cluster").to_numpy()
            np.add.at(change, now, x)
            np.subtract.at(change, was[was >= 0], x[was >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), _lists(change)], names=["c", "change"])

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("cluster")
            far = _squared(_matrix(b.column("v"), centroids.shape[1]), centroids[own.to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), own, pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(embeddings: DataFrame, rules: ClusterRules = ClusterRules()) -> DataFrame:
    """`vec_id`, `cluster`, `distance` (squared), and of its cluster `cluster_inertia`, `centroid_sha256`; `inertia` is of all."""
    spark = embeddings.sparkSession
    vectors = stored(whole_vectors(embeddings, rules), "whole-vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    now = first_centroids(vectors, rules)
    if not len(now):
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    k, width = now.shape
    group, old, state = grouped(now, rules.groups), None, vectors
    sums = np.zeros((k, width + 1), object)
    fields = f"vec_id {kind}, v array<bigint>, was int, cluster int, upper double, lower array<double>"
    for left in range(rules.rounds, -1, -1):
        before, state = state, stored(state.mapInArrow(_round(old, now, group), fields), "yinyang")
        forget(before)
        if not left:
            break
        moved = state.where("was <> cluster").select("v", "was", "cluster").mapInArrow(_moves(k, width), "c int, change array<bigint>")
        moved = moved.select("c", F.posexplode("change").alias("at", "x")).groupBy("c", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        changes = moved.collect()  # k * (width + 1) rows at most
        if not changes:
            break
        for r in changes:
            sums[r["c"], r["at"]] += int(r["x"])
        old, now = now, np.array([[int(s // row[-1]) for s in row[:-1]] if row[-1] else list(c) for row, c in zip(sums, now)], np.int64)
    near = stored(state.mapInArrow(_distances(now), f"vec_id {kind}, cluster int, distance bigint"), "nearest")
    forget(state)
    inertia = {r["cluster"]: int(r["s"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digest[c]) for c in range(k)]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(rules: ClusterRules = ClusterRules()) -> str:
    good = "x IS NOT NULL AND isfinite(x)"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({rules.scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {rules.length} AND len(list_filter(embedding, lambda x: {good})) = {rules.length})""",
        f"cells AS MATERIALIZED (SELECT row, unnest(range(1, {rules.length + 1})) AS place, unnest(v) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT c, place, x FROM (SELECT row, row_number() OVER (ORDER BY sha256('{rules.seed}:' || vec_id)) - 1 AS c FROM kept)
  JOIN cells USING (row) WHERE c < {rules.k})""",
    ]
    for i in range(rules.rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT row, c, sum((cells.x - c{i}.x) * (cells.x - c{i}.x))::BIGINT AS d FROM cells JOIN c{i} USING (place) GROUP BY 1, 2),
a{i} AS MATERIALIZED (SELECT row, arg_min(c, d::HUGEINT * {rules.k} + c) AS c, min(d) AS d FROM d{i} GROUP BY 1)""")
        if i < rules.rounds:
            parts.append(f"""s{i} AS (SELECT c, place, sum(x) AS s, count(*) AS n FROM a{i} JOIN cells USING (row) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c, place, CASE WHEN n IS NULL THEN x ELSE ((s - (s % n + n) % n) // n)::BIGINT END AS x FROM c{i} LEFT JOIN s{i} USING (c, place))""")
    last = rules.rounds
    return f"""WITH {", ".join(parts)},
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{last} GROUP BY 1)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{last} JOIN kept USING (row) JOIN digests USING (c)"""
