"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact Jaccard similarity.

1. Texts are lower-cased, white space is unified, and texts with the same words share a key.
2. Each text gets `trees` labels of `depth` MinHash values. The labels of a tree, in order, are its prefix trie. A
   prefix of k values meets a pair at the threshold in some tree with chance 1 - (1 - similarity ** k) ** trees;
   `stop` is the longest one that reaches the target recall. Tries are dealt out by their nodes of that length.
3. A node's rows come sorted by label and are walked from the full depth up: first the runs that agree in all values are
   linked, then prefixes are shortened a value at a time. A node whose texts are joined already is not
   shortened; others end at `stop`. Rows are linked where their signatures agree; a leader links all
   that agree with it at once, so no pairs of a group are listed. The rows of a node with very many of them are first compared with a few
   leaders; what all links so far have joined needs no further look, and only rows outside of a node's main group meet all others of
   it, dealt out in blocks.
4. Connected components of these links are the candidate groups, and every pair of one is compared exactly. Small groups are
   compared at once, by sparse products of shingle columns. A larger one gets a pivot, the shingles that most of some of its texts hold,
   and each text is written as its difference from it: what it lacks and what it adds. Texts whose difference is so small that any two
   of them must be links are counted, not compared; for all other pairs the product goes over the differences alone, dealt out in pairs
   of blocks. Classes are the components of exact links.

So a class costs time in proportion to its texts as far as they lie close to their pivot, and a small share of comparing all pairs beyond.

Defined cases: null texts and texts without words have no links and form their own class. Texts of
fewer words than a shingle are one shingle. Repeated rows are repeated in the result. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import contracted_components
from ..storage import forget, stored
from .frames import boxed, narrow, unboxed


@dataclass(frozen=True)
class ForestRules:
    words: int = 5
    similarity: float = 0.8
    trees: int = 24
    depth: int = 8
    target_recall: float = 0.99999
    seed: int = 17
    #: A candidate needs this share of equal signature values; chance keeps a true pair above it (see `_agree`).
    least_estimate: float = 0.55
    #: Nodes and candidate groups with more rows than this are dealt out.
    block_rows: int = 768
    block_shingles: int = 1_000_000
    leaders: int = 4
    #: Candidate groups with more texts than this get a pivot, from so many of their texts.
    pivot_rows: int = 128
    pivot_sample: int = 65

    def recall(self, prefix: int) -> float:
        """The chance that a pair at the threshold shares a prefix of this length in some tree."""
        return 1 - (1 - self.similarity**prefix) ** self.trees

    @property
    def stop(self) -> int:
        """The longest prefix that reaches the target recall: none is shortened further."""
        return max((k for k in range(1, self.depth + 1) if self.recall(k) >= self.target_recall), default=1)


SLICE_BYTES = 2_000_000
#: Parts in which a group's texts take what was summed up of it.
DEALS = 16


def _deal(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(DEALS)).cast("int")


def _every_deal(per_group: DataFrame) -> DataFrame:
    """A row of each group for each of its deals, so that a group with very many texts isn't joined in one task."""
    return per_group.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))


def unified(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `most` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of unified texts, and where each text's begin (one more entry than texts)."""
    from pandas.util import hash_array

    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.dictionary_encode()
    known = hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    h = known[coded.indices.to_numpy(zero_copy_only=False)]
    # A text of n >= words words has n - words + 1 shingles, a shorter one with a word has one of all its words.
    n = np.diff(bounds)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.zeros(len(h), np.uint64)
    for j in range(min(words, len(h))):  # a slice may hold fewer words than a shingle
        total[: len(h) - j] += _mix(h[j:] + np.uint64(j + 1))
    start = np.repeat(bounds[:-1], n)
    left = n.repeat(n) - (np.arange(len(h)) - start)
    keep = (left >= words) & ~empty.repeat(n)
    short = np.flatnonzero((n < words) & ~empty)
    for i in short:
        a, b = bounds[i], bounds[i + 1]
        total[a] = sum((_mix(h[a + j : a + j + 1] + np.uint64(j + 1)) for j in range(b - a)), np.zeros(1, np.uint64))[0]
        keep[a] = True
    counts = np.where(empty, 0, np.maximum(n - words + 1, 1))
    return _mix(total[keep]), np.concatenate([[0], np.cumsum(counts)])


def signatures(hashes: np.ndarray, bounds: np.ndarray, rules: ForestRules) -> np.ndarray:
    """Least values of `trees * depth` multiplicative orders of the hashes, one row per text that has shingles."""
    rng = np.random.default_rng(rules.seed)
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), rules.trees * rules.depth), np.uint32)
    buffer = np.empty_like(low)
    for p in range(out.shape[1]):
        a, b = np.uint32(rng.integers(1 << 32) | 1), np.uint32(rng.integers(1 << 32))
        np.multiply(low, a, out=buffer)
        buffer ^= b
        out[:, p] = np.minimum.reduceat(buffer, starts) if len(starts) else 0
    return out


def _signed(rules: ForestRules):
    weights = np.random.default_rng(rules.seed + 1).integers(1 << 63, size=(rules.trees, rules.stop), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "norm"):
                hashes, bounds = shingle_hashes(part.column("norm"), rules.words)
                has = np.flatnonzero(np.diff(bounds) > 0)
                sig = signatures(hashes, bounds, rules)
                paths = sig.reshape(-1, rules.trees, rules.depth)[:, :, : rules.stop].astype(np.uint64)
                buckets = _mix((paths * weights).sum(axis=2) + np.arange(rules.trees, dtype=np.uint64)).view(np.int64)
                tiny = (sig >> np.uint32(13)).astype(np.uint8)
                k, m = len(has), rules.trees
                # Texts without words have neither signature nor nodes.
                size = np.diff(bounds)
                ends = np.concatenate([[0], np.cumsum(m * (size > 0))]).astype(np.int32)
                signed = np.full(len(size), None, object)
                signed[has] = [r.tobytes() for r in tiny]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        part.column("raw"),
                        pa.array(size, pa.int64()),
                        pa.array(signed, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.ravel() if k else np.empty(0, np.int64), pa.int64())),
                    ],
                    names=["doc_id", "key", "raw", "n_shingles", "sig", "buckets"],
                )

    return run


def _first(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.filter(F.sequence(F.lit(0).cast("long"), n.cast("long")), lambda i: i < n)


def _dealt(df: DataFrame, group: str, member: str, home: Column, home_blocks: Column, other_blocks: Column) -> DataFrame:
    """Adds `unit`, `block` and `crossed`: units in which all pairs of a group meet once, but for those of two home members.

    Others fall into blocks, and each block and pair of blocks is a unit; so is each pair of a block of others and one of home members.
    In a crossed unit only rows of different blocks are pairs.
    """
    df = df.withColumns({"_home": home, "_hb": home_blocks.cast("long"), "_ob": other_blocks.cast("long")})
    df = df.withColumn("_b", F.pmod(F.xxhash64(member), F.greatest(F.when(F.col("_home"), F.col("_hb")).otherwise(F.col("_ob")), F.lit(1))))
    unit = lambda kind, a, b, block, crossed: F.struct(F.xxhash64(group, F.lit(kind), a, b).alias("unit"), block.cast("int").alias("block"), crossed.alias("crossed"))
    mine, yes = F.col("_b"), F.lit(True)
    among = F.transform(_first(F.col("_ob")), lambda j: unit("others", F.least(mine, j), F.greatest(mine, j), mine, mine != j))
    to_home = F.transform(_first(F.col("_hb")), lambda j: unit("home", j, mine, F.lit(1), yes))
    from_home = F.transform(_first(F.col("_ob")), lambda j: unit("home", mine, j, F.lit(0), yes))
    places = F.when(F.col("_home"), from_home).otherwise(F.concat(among, to_home))
    kept = [c for c in df.columns if c not in ("_home", "_hb", "_ob", "_b")]
    return df.withColumn("_places", places).select(*kept, F.inline("_places"))


def _blocks(rows: Column, volume: Column | None, rules: ForestRules) -> Column:
    """How many blocks so many rows make: larger ones the more rows there are, up to `block_rows`."""
    size = F.least(F.lit(float(rules.block_rows)), F.greatest(F.lit(min(144.0, rules.block_rows)), 6 * F.sqrt(rows)))
    parts = F.ceil(rows / size)
    return parts if volume is None else F.greatest(parts, F.ceil(volume / rules.block_shingles))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches in the order of the key."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1])
        if rest and rest[-1].column(key)[-1].as_py() != k[0]:
            cut = np.concatenate([[-1], cut])
        if not len(cut):
            rest.append(b)
            continue
        at = int(cut[-1]) + 1
        head = [*rest, b.slice(0, at)] if at else rest
        if head:
            yield pa.Table.from_batches(head)
        rest = [b.slice(at)]
    if rest:
        yield pa.Table.from_batches(rest)


def _agree(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether enough one-byte values are equal; with 120 values a pair at 0.8 stays under 0.55 with chance 1e-10."""
    return (a == b).mean(axis=-1) >= least


def _forest_links(rules: ForestRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "unit"):
            unit = table.column("unit").to_numpy()
            keys = table.column("key").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(unit), -1)
            block, crossed = table.column("block").to_numpy(), table.column("crossed").to_numpy(zero_copy_only=False)
            joined = table.column("joined").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(unit)]]))
            # The values of a row's own label beyond the node's prefix.
            at = table.column("tree").to_numpy()[:, None] * rules.depth + np.arange(rules.stop, rules.depth)
            rest = np.take_along_axis(sig, at, axis=1)
            left, right = [], []
            two = starts[sizes == 2]  # most nodes: one pair
            two = two[(joined[two] != joined[two + 1]) & _agree(sig[two], sig[two + 1], rules.least_estimate)]
            left.append(two), right.append(two + 1)
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                tree = np.unique(joined[s : s + n], return_inverse=True)[1]
                a, b = _walk(sig[s : s + n], rest[s : s + n], block[s : s + n] if crossed[s] else None, rules.least_estimate, tree)
                left.append(a + s), right.append(b + s)
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(keys[a], pa.string()), pa.array(keys[b], pa.string())], names=["src", "dst"])

    return run


def _walk(sig: np.ndarray, rest: np.ndarray, block: np.ndarray | None, least: float, tree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a trie node's rows, which come sorted by `rest`, the values beyond its prefix: the longest runs first.

    At each length the runs of equal values are linked; a run that is one tree already is left as it is. `tree` tells
    what earlier links have joined.
    """
    tree = np.arange(len(sig)) if tree is None else tree
    links = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for length in range(rest.shape[1], -1, -1):
        differs = (rest[1:, :length] != rest[:-1, :length]).any(axis=1)
        cut = np.concatenate([[0], np.flatnonzero(differs) + 1, [len(sig)]])
        for s, e in zip(cut[:-1], cut[1:]):
            if e - s > 1 and (tree[s:e] != tree[s]).any():
                a, b = _leader_links(sig[s:e], None if block is None else block[s:e], least, tree[s:e])
                links.append((a + s, b + s))
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def _leader_links(sig: np.ndarray, block: np.ndarray | None, least: float, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows; only rows not yet in the leader's tree are compared with it.

    `tree` tells the rows' trees, and is brought up to date. With `block`, only rows of different blocks are linked.
    """
    n = len(sig)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(n - 1):
        rest = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
        if block is not None:
            rest = rest[block[rest] != block[i]]
        if not len(rest):
            continue
        hit = rest[_agree(sig[rest], sig[i], least)]
        if len(hit):
            _, first = np.unique(tree[hit], return_index=True)
            tree[np.isin(tree, tree[hit])] = tree[i]
            a.append(np.full(len(first), i)), b.append(hit[first])
    return np.concatenate(a), np.concatenate(b)


def _shingled(rules: ForestRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "norm"):
                hashes, bounds = shingle_hashes(part.column("norm"), rules.words)
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("component", "key", "m", "v")), pa.array(sets, pa.large_binary()).cast(pa.binary())],
                    names=["component", "key", "m", "v", "shingles"],
                )

    return run


def _exact_pairs(
    sets: list[np.ndarray], block: np.ndarray | None, t: float, size: np.ndarray | None = None, lost: np.ndarray | None = None, whole: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links between the sets: each one's number of links, and a spanning forest of them.

    With `size`, what is given are differences from a pivot of `whole` shingles, of which each set lacks `lost`: two sets share
    the pivot without what either lacks, and what both of their differences hold, which is lacked by both or added by both.
    """
    n, given = len(sets), np.array([len(s) for s in sets])
    size = given if size is None else size
    owner = np.repeat(np.arange(n), given)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one set meets nothing
    owner, column = owner[often], column[often]
    column = np.unique(column, return_inverse=True)[1]
    both = np.zeros((n, n))  # n is at most two blocks; each product stays far below 2**24, their sum is one of doubles
    wide = max(1, 8_000_000 // n)
    for at in range(0, int(column.max(initial=-1)) + 1, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        x = np.zeros((n, min(wide, int(column[hi - 1]) - at + 1)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x @ x.T
    if lost is not None:
        both += whole - lost[:, None] - lost[None, :]
    linked = np.empty((n, n), bool)
    for i in range(n):  # whole numbers, which doubles hold exactly; row by row, so no more tables of this size are made
        linked[i] = both[i] / (size[i] + size - both[i]) >= t
    np.fill_diagonal(linked, False)
    if block is not None:
        linked &= block[:, None] != block[None, :]
    tree = np.full(n, -1)
    a, b = [], []
    for root in range(n):
        if tree[root] >= 0:
            continue
        tree[root], queue = root, [root]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(linked[i] & (tree < 0)):
                tree[j] = root
                queue.append(j)
                a.append(i), b.append(j)
    return linked.sum(axis=1), np.array(a, np.int64), np.array(b, np.int64)


def _verified(rules: ForestRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "unit"):
            unit = table.column("unit").to_numpy()
            keys = table.column("key").to_numpy(zero_copy_only=False)
            block, crossed = table.column("block").to_numpy(), table.column("crossed").to_numpy(zero_copy_only=False)
            cells = table.column("shingles")
            size, lost, whole = (table.column(c).to_numpy() for c in ("size", "lost", "whole"))
            starts = np.concatenate([np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])), [len(unit)]])
            src, dst, links = [], [], []
            for s, e in zip(starts[:-1], starts[1:]):
                sets = [np.frombuffer(cells[int(i)].as_py(), np.uint64) for i in range(s, e)]
                about = () if whole[s] < 0 else (size[s:e], lost[s:e], int(whole[s]))
                degree, a, b = _exact_pairs(sets, block[s:e] if crossed[s] else None, rules.similarity, *about)
                some = np.flatnonzero(degree)
                src += [keys[s + some], keys[s + a]]
                dst += [np.full(len(some), None, object), keys[s + b]]
                links += [degree[some], np.zeros(len(a), np.int64)]
            if src:
                cells_out = [np.concatenate(x) for x in (src, dst, links)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells_out[0], pa.string()), pa.array(cells_out[1], pa.string()), pa.array(cells_out[2].astype(np.int64), pa.int64())],
                    names=["src", "dst", "links"],
                )

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        of = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("component").take(of), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], names=["component", "shingle"])


def _differences(rules: ForestRules):
    """Each text's difference from the pivot of its group, which comes before it; `home` texts are so close to it that any two are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pivot, more = None, np.empty(0, np.uint64), 1 + rules.similarity
        for batch in batches:
            components, keys = batch.column("component").to_pylist(), batch.column("key").to_pylist()
            kept, made = [], []
            for i, (component, key) in enumerate(zip(components, keys)):
                if component != of:
                    of, pivot = component, np.empty(0, np.uint64)
                if key is None:
                    pivot = np.sort(batch.column("pivot")[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                    continue
                s = np.frombuffer(batch.column("shingles")[i].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(pivot, s), max(len(pivot) - 1, 0))
                held = pivot[at] == s if len(pivot) else np.zeros(len(s), bool)
                lacks = np.ones(len(pivot), bool)
                lacks[at[held]] = False
                lost = int(lacks.sum())
                # Two texts share what the pivot has and neither lacks: with this, at least the similarity's share of their union.
                home = 2 * (rules.similarity * len(s) + more * lost) <= more * len(pivot) * (1 - 1e-9)
                kept.append(i)
                made.append((len(s), lost, len(pivot), home, np.concatenate([pivot[lacks], s[~held]]).tobytes()))
            size, lost, whole, home, cells = zip(*made) if made else ((),) * 5
            at = pa.array(kept, pa.int64())
            kinds = zip((size, lost, whole, home, cells), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("component").take(at), batch.column("key").take(at), *[pa.array(list(x), k) for x, k in kinds]],
                names=["component", "key", "size", "lost", "whole", "home", "shingles"],
            )

    return run


def _candidate_groups(one: DataFrame, rules: ForestRules) -> DataFrame:
    """`node`, `component` of all texts that the forest links."""
    paths = one.select("key", F.posexplode("buckets").alias("tree", "bucket"))
    nodes = stored(paths.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    met = paths.join(nodes, "bucket").join(one.select("key", "sig"), "key")
    met = met.withColumn("label", F.substring(F.col("sig"), (F.col("tree") * rules.depth + rules.stop + 1).cast("int"), F.lit(rules.depth - rules.stop)))
    columns = ["unit", "block", "crossed", "tree", "key", "sig", "label", "joined"]

    def linked(units: DataFrame) -> DataFrame:
        return units.select(columns).repartition("unit").sortWithinPartitions("unit", "label", "sig", "key").drop("label").mapInArrow(_forest_links(rules), "src string, dst string")

    no, yes, zero = F.lit(False), F.lit(True), F.lit(0)
    units = met.where(F.col("n") <= rules.block_rows).withColumns({"unit": F.col("bucket"), "block": zero, "crossed": no, "joined": F.xxhash64("key")})
    if nodes.where(F.col("n") > rules.block_rows).isEmpty():
        groups = contracted_components(linked(units), "src", "dst")
        forget(nodes)
        return groups
    hot = stored(met.where(F.col("n") > rules.block_rows).withColumn("parts", F.ceil(F.col("n") / rules.block_rows)), "hot-nodes")
    ranked = hot.select("bucket", "key").withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("key"))).where(F.col("r") <= rules.leaders)
    leaders = hot.join(ranked.drop("r"), ["bucket", "key"]).withColumn("part", F.explode(_first(F.col("parts"))))
    members = hot.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    for rows, block in ((leaders, 0), (members, 1)):
        rows = rows.withColumns({"unit": F.xxhash64("bucket", "part"), "block": F.lit(block), "crossed": yes, "joined": F.xxhash64("key")})
        units = units.select(columns).unionByName(rows.select(columns))
    groups = contracted_components(linked(units), "src", "dst")
    forget(nodes)
    # Of a hot node, only rows outside of its main component can tell anything new.
    known = hot.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("joined", F.xxhash64(F.coalesce("component", "key"))).drop("component")
    per = known.groupBy("bucket", "joined").agg(F.count("*").alias("k")).groupBy("bucket")
    main = per.agg(F.max_by("joined", F.struct("k", "joined")).alias("main"), F.max("k").alias("n_home"), (F.sum("k") - F.max("k")).alias("n_other")).where("n_other > 0")
    main = stored(main, "split-nodes")
    if not main.isEmpty():
        rest = known.withColumn("_deal", _deal("key")).join(_every_deal(main), ["bucket", "_deal"])
        units = _dealt(rest, "bucket", "key", F.col("joined") == F.col("main"), _blocks(F.col("n_home"), None, rules), _blocks(F.col("n_other"), None, rules))
        links = stored(linked(units), "links")
        if not links.isEmpty():
            edges = groups.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(links)
            last, groups = groups, contracted_components(edges, "src", "dst")
            forget(last)
        forget(links)
    forget(main)
    forget(hot)
    return groups


def _exact_links(sets: DataFrame, rules: ForestRules) -> DataFrame:
    """`src`, `dst`, `links`: numbers of links of a text (dst null), and edges that join the texts of a class; from candidate groups' `sets`."""
    large = (F.col("m") > rules.pivot_rows) | (F.col("v") > rules.block_shingles)
    whole = {"size": F.lit(0).cast("long"), "lost": F.lit(0).cast("long"), "whole": F.lit(-1).cast("long")}
    columns = ["unit", "block", "crossed", "key", "shingles", "size", "lost", "whole"]
    small = sets.where(~large).withColumns({"unit": F.xxhash64("component"), "block": F.lit(0), "crossed": F.lit(False), **whole})
    compared = lambda units: units.select(columns).repartition("unit").sortWithinPartitions("unit", "key").mapInArrow(_verified(rules), "src string, dst string, links long")
    hot = sets.where(large).withColumn("parts", F.greatest(F.ceil(F.col("m") / 512), F.ceil(F.col("v") / rules.block_shingles)))
    if hot.isEmpty():
        return stored(compared(small), "links")
    ranked = hot.select("component", "key").withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("key"), "key")))
    sample = hot.join(ranked.where(F.col("r") <= rules.pivot_sample).drop("r"), ["component", "key"])
    sizes = sample.groupBy("component").agg(F.count("*").alias("n"), F.first("parts").alias("parts"))
    held = sample.mapInArrow(_spread, "component string, shingle long").groupBy("component", "shingle").agg(F.count("*").alias("c"))
    pivots = held.join(sizes, "component").where("2 * c > n").groupBy("component").agg(F.collect_list("shingle").alias("pivot"), F.first("parts").alias("parts"))
    pivots = pivots.select("component", F.explode(_first(F.col("parts"))).alias("part"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("binary").alias("shingles"), "pivot")
    texts = hot.select("component", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), "key", "shingles", F.lit(None).cast("array<long>").alias("pivot"))
    both = texts.unionByName(pivots).repartition("component", "part").sortWithinPartitions("component", "part", F.asc_nulls_first("key"))
    fields = "component string, key string, size long, lost long, whole long, home boolean, shingles binary"
    differences = apart = stored(both.mapInArrow(_differences(rules), fields), "differences")
    home, volume = F.col("home"), F.octet_length("shingles") / 8
    about = apart.groupBy("component").agg(
        F.count_if(home).alias("n_home"), F.count_if(~home).alias("n_other"), F.sum(F.when(home, volume).otherwise(0)).alias("v_home"),
        F.sum(F.when(home, 0).otherwise(volume)).alias("v_other"), F.min(F.when(home, F.col("key"))).alias("head"),
    )
    apart = apart.withColumn("_deal", _deal("key")).join(_every_deal(about), ["component", "_deal"])
    units = _dealt(apart, "component", "key", home, _blocks(F.col("n_home"), F.col("v_home"), rules), _blocks(F.col("n_other"), F.col("v_other"), rules))
    sure = apart.where(home & (F.col("n_home") > 1)).select(
        F.inline(F.array(
            F.struct(F.col("key").alias("src"), F.lit(None).cast("string").alias("dst"), (F.col("n_home") - 1).alias("links")),
            F.struct(F.col("key").alias("src"), F.col("head").alias("dst"), F.lit(0).cast("long").alias("links")),
        ))
    )
    links = stored(compared(small.select(columns).unionByName(units.select(columns))).unionByName(sure), "links")
    forget(differences)
    return links


def near_duplicates(docs: DataFrame, rules: ForestRules = ForestRules()) -> DataFrame:
    """One row per row of `docs`: doc_id, key, class_id, class_key, n_links, n_copies.

    class_id is the least doc_id among the documents joined by links or equal words; n_links counts
    the other different texts at or above the similarity; n_copies counts the rows with equal words.
    key tells texts apart, class_key classes, also where different documents repeat a doc_id.
    """
    plain = narrow(docs, "doc_id", "text").withColumn("raw", F.xxhash64("text"))
    d = plain.select("doc_id", "raw", unified(F.col("text")).alias("norm")).withColumn("key", F.md5("norm"))
    signed = stored(d.mapInArrow(_signed(rules), f"{_id_type(docs)}, key string, raw long, n_shingles long, sig binary, buckets array<long>"), "signed")
    worded = signed.where("sig is not null")
    one = worded.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id").alias("row"), "raw")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("buckets").alias("buckets"))
    one = stored(one.select("key", "at.*", "n_shingles", "sig", "buckets"), "texts")
    candidates = _candidate_groups(one, rules)
    groups = candidates.join(one.select(F.col("key").alias("node"), "n_shingles", "row", "raw"), "node")
    groups = groups.withColumn("_deal", _deal("node"))
    volume = _every_deal(groups.groupBy("component").agg(F.sum("n_shingles").alias("v"), F.count("*").alias("m")))
    groups = groups.join(volume, ["component", "_deal"]).select(F.col("node").alias("key"), "row", "raw", "component", "m", "v")
    # One row of each text of a candidate group: its own words are unified again, not those of all texts. Copies of a text are
    # dealt out by their rows, and all but one of them stay behind.
    texts = plain.withColumn("row", F.xxhash64("doc_id")).join(groups, ["row", "raw"]).groupBy("key", "row").agg(*[F.first(c).alias(c) for c in ("component", "m", "v", "text")])
    texts = texts.select("key", "component", "m", "v", unified(F.col("text")).alias("norm"))
    sets = stored(texts.mapInArrow(_shingled(rules), "component string, key string, m long, v long, shingles binary"), "shingles")
    forget(candidates)
    forget(one)
    exact = _exact_links(sets, rules)
    forget(sets)
    classes = contracted_components(exact, "src", "dst")
    degrees = exact.groupBy("src").agg(F.sum("links").alias("n_links")).where("n_links > 0")
    copies = worded.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    copies = copies.join(classes.withColumnRenamed("node", "key"), "key", "left").join(degrees.withColumnRenamed("src", "key"), "key", "left")
    # A class with very many texts is dealt out when its least doc_id comes back to them; texts without links need no class.
    linked = copies.where("component is not null").withColumn("_deal", _deal("key"))
    heads = _every_deal(linked.groupBy("component").agg(F.min("least").alias("class_id")))
    columns = ["key", "class_id", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"]
    alone = copies.where("component is null").withColumns({"class_id": F.col("least"), "component": F.col("key")})
    copies = stored(linked.join(heads, ["component", "_deal"]).select(*columns).unionByName(alone.select(*columns)), "classes")
    forget(classes)
    forget(exact)
    out = signed.select("doc_id", "key").join(copies, "key", "left")
    wordless = F.col("n_copies").isNull()
    out = out.select(
        "doc_id",
        "key",
        F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("component", "key").alias("class_key"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )
    out = stored(out, "near-duplicates")
    forget(signed)
    forget(copies)
    return out


def _id_type(docs: DataFrame) -> str:
    return f"doc_id {narrow(docs, 'doc_id').schema[0].dataType.simpleString()}"


def keep_one(docs: DataFrame, rules: ForestRules = ForestRules()) -> DataFrame:
    """The rows of `docs` without near copies: of each class the row with the least doc_id, and every row without words.

    Rows that repeat both doc_id and words count as copies of each other.
    """
    result = near_duplicates(docs, rules)
    wordless = F.md5(F.lit(""))
    head = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") != wordless)
    chosen = result.where(head).groupBy("class_key").agg(F.first("class_id").alias("_id"), F.min("key").alias("_key")).drop("class_key")
    boxes = boxed(docs, "doc_id", "text").withColumn("_k", F.md5(unified(F.col("k_text"))))
    without = boxes.where(F.col("_k") == wordless)
    kept = boxes.join(chosen, F.col("k_doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")))
    kept = kept.groupBy("k_doc_id", "_k").agg(F.first("_row").alias("_row"))
    return unboxed(kept.select("_row").unionByName(without.select("_row")), docs)


ORACLE_SQL = r"""
WITH RECURSIVE norm AS (
  SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents),
texts AS (SELECT t, min(doc_id) AS id, count(*) AS n_copies, string_split(t, ' ') AS w FROM norm WHERE t <> '' GROUP BY t),
shingles AS (SELECT DISTINCT id, hash(array_to_string(w[i : i + 4], ' ')) AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
met AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE c::DOUBLE / (p.n + q.n - c) >= 0.8),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
heads AS (SELECT x AS id, least(min(y), x) AS class_id FROM reach GROUP BY x),
degrees AS (SELECT x AS id, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, CASE WHEN norm.t = '' THEN doc_id ELSE coalesce(class_id, texts.id) END AS class_id,
  coalesce(n_links, 0)::BIGINT AS n_links, CASE WHEN norm.t = '' THEN 1 ELSE n_copies END AS n_copies
FROM norm LEFT JOIN texts ON texts.t = norm.t LEFT JOIN heads ON heads.id = texts.id LEFT JOIN degrees ON degrees.id = texts.id
"""
