"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The words of all documents are counted first. The most frequent ones get ids of their own and the
others share buckets of their own, both growing with the root of the number of tokens. Each token is
masked in turn and predicted from the `side` tokens before and after it: their embeddings, one table
per place, are summed and pass through tanh. An id is spelled in digits of base 32, and one softmax
per digit, which also sees the digits before it, gives its probability; a word in a bucket gets an equal
share of the bucket's. Before training, the biases give each id its share of all tokens. A document's score is the
sum of these conditional log-probabilities over its tokens.

Texts are cut into words once; from then on their 32-bit hashes travel, four bytes a token. Training covers every
token of every document, in rounds that double in size. A hash of doc_id and text gives each document its round and its group.
For every group of a round a copy of the network and of its Adagrad sums goes on from where the last round ended, over
the group's documents in the order of their hashes; the copies, cut into pieces, are averaged by tokens in two
levels. A group holds at least twice as much text as a copy has bytes. The driver holds the averaged network alone.

Defined cases: null texts and texts without words have no tokens and the score 0. Equal texts get scores equal to
rounding. Empty tables give no rows. How the input is split into files or partitions changes scores by rounding alone, and a
repeated task repeats its result. Rows that repeat both doc_id and text share a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored
from .frames import narrow
from .ngram_join import text_slices

GROUPS = MEMBERS = 32
VOCABULARY = GROUPS * MEMBERS
PAD = VOCABULARY
#: Copies of a small round, so that it keeps some cores busy.
LEAST_COPIES = 4
TOKENS_AT_ONCE = 400_000


@dataclass(frozen=True)
class LmRules:
    side: int = 2
    width: int = 16
    batch: int = 4096
    rate: float = 0.2
    #: Tokens of the first round, at most; each further round about doubles the sum.
    quantum: int = 2_000_000
    #: Ids for words of their own per root of the number of tokens, and shared ones for each of these.
    words_per_root: float = 2.0
    shared: float = 0.25
    pieces: int = 16
    bound: float = 4.0
    seed: int = 23


Network = dict[str, np.ndarray]


def start(rules: LmRules, words: np.ndarray | None = None, shared: int = 0, spread: float = 0.0) -> Network:
    """The untrained network: for hashed ids alone, or for `words` (hashes, most frequent first) and `shared` ids for the rest."""
    rng = np.random.default_rng(rules.seed)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    d, n = rules.width, VOCABULARY if words is None else len(words) + shared
    levels = 2
    while MEMBERS**levels < n:
        levels += 1
    net = {
        "embed": normal(2 * rules.side, n + 1, d),
        "shift": np.zeros(d, np.float32),
        "out": normal(MEMBERS * levels, d),
        "group": np.zeros(GROUPS, np.float32),
        "member": np.zeros((MEMBERS, GROUPS), np.float32),
    }
    for k in range(2, levels):
        net[f"member{k}"] = np.zeros((MEMBERS, MEMBERS**k), np.float32)
    if words is not None:
        order = np.argsort(words, kind="stable")
        net |= {"words": words[order], "rank": order.astype(np.int32), "spread": np.float64(spread)}
    return net


def with_frequencies(net: Network, counts: np.ndarray, bound: float) -> Network:
    """The network with its biases at the frequencies of the ids, so that before any training it gives each id its share of all tokens."""
    levels = net["out"].shape[0] // MEMBERS
    full = np.zeros(MEMBERS**levels)
    full[: len(counts)] = counts + 0.5
    out = dict(net)
    for k in range(levels):
        name = "group" if not k else "member" if k == 1 else f"member{k}"
        shares = np.log(full.reshape(MEMBERS ** (k + 1), -1).sum(axis=1).reshape(-1, MEMBERS) + 1e-9)
        logs = np.clip(shares - shares.max(axis=1, keepdims=True), -2 * bound, 0) + bound
        out[name] = (logs[0] if not k else np.ascontiguousarray(logs.T)).astype(np.float32)
    return out


#: Parts of a network that training leaves as they are.
FIXED = ("words", "rank", "spread")


def pad_of(net: Network) -> int:
    return net["embed"].shape[1] - 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words, the place of each token's among them, and how many tokens each text has."""
    from pandas.util import hash_array

    words = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashes = (hash_array(known, categorize=False) >> np.uint64(32)).astype(np.uint32) if len(known) else np.empty(0, np.uint32)
    blank = known == ""
    flat = coded.indices.to_numpy(zero_copy_only=False)
    if blank.any():  # splitting leaves empty words at the ends
        full = ~blank[flat]
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts))
        flat = flat[full]
    return hashes, flat, counts


def ids_of(hashes: np.ndarray, net: Network | None = None) -> np.ndarray:
    """The ids of words, from their hashes."""
    if net is None or "words" not in net:
        return (hashes % np.uint32(VOCABULARY)).astype(np.int32)
    own = net["words"]
    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
    shared = np.uint32(pad_of(net) - len(own))
    return np.where(own[at] == hashes, net["rank"][at], len(own) + (hashes % shared).astype(np.int32)).astype(np.int32)


def token_ids(texts: pa.Array, net: Network | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts, and how many each text has."""
    hashes, flat, counts = word_hashes(texts)
    return ids_of(hashes, net)[flat], counts


def windows(ids: np.ndarray, counts: np.ndarray, side: int, pad: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `side` pads between texts, and the places of the tokens."""
    gap = side * (np.repeat(np.arange(len(counts)), counts) + 1)
    places = np.arange(len(ids)) + gap
    padded = np.full(len(ids) + side * (len(counts) + 1), pad, np.int32)
    padded[places] = ids
    return padded, places


def _offsets(side: int) -> list[int]:
    return [*range(-side, 0), *range(1, side + 1)]


def _digits(net: Network, ids: np.ndarray) -> Iterator[tuple[int, str, np.ndarray | None, np.ndarray]]:
    """Per level from the front: its number, its table of weights, the digits before (none: None) and the digit."""
    levels = net["out"].shape[0] // MEMBERS
    for k in range(levels):
        rest = ids // MEMBERS ** (levels - 1 - k)
        yield k, "group" if not k else "member" if k == 1 else f"member{k}", rest // MEMBERS if k else None, rest % MEMBERS


def forward(net: Network, padded: np.ndarray, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hidden values (tokens by width), the first digit's softmax and the others' (choices by tokens), and the log-probability of each token."""
    h = net["embed"][0].take(padded[at - side], axis=0)
    for table, o in zip(net["embed"][1:], _offsets(side)[1:]):
        h += table.take(padded[at + o], axis=0)
    h += net["shift"]
    np.tanh(h, out=h)
    z = net["out"] @ h.T
    every, found = np.arange(len(at)), np.zeros(len(at), np.float32)
    for k, name, before, digit in _digits(net, padded[at]):
        p = z[MEMBERS * k : MEMBERS * (k + 1)]
        p += net[name][:, None] if before is None else net[name].take(before, axis=1)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        found += np.log(np.maximum(p[digit, every], np.float32(1e-30)))
    return h, z[:GROUPS], z[GROUPS:], found


def _bounded(net: Network, rules: LmRules) -> Network:
    """Weights within bounds under which exp() cannot overflow."""
    return {k: v if k in FIXED else np.clip(v, -rules.bound, rules.bound) for k, v in net.items()}


class Trainer:
    """Adagrad on batches of tokens, from a network and the sums of squares that it was left with."""

    def __init__(self, net: Network, rules: LmRules, seen: Network | None = None):
        self.rules = rules
        self.net = {k: v if k in FIXED else v.copy() for k, v in net.items()}
        self.seen = {k: np.full_like(v, 1e-6) if seen is None else seen[k].copy() for k, v in net.items() if k not in FIXED}
        self.tokens = 0

    def _step(self, name: str, grad: np.ndarray, rows: tuple = ()) -> None:
        seen, net = self.seen[name], self.net[name]
        if rows:
            seen[rows] += grad * grad
            net[rows] -= self.rules.rate * grad / np.sqrt(seen[rows])
        else:
            seen += grad * grad
            net -= self.rules.rate * grad / np.sqrt(seen)
        if name in ("out", "group", "shift"):
            np.clip(net, -self.rules.bound, self.rules.bound, out=net)
        elif rows and name != "embed":
            net[rows] = np.clip(net[rows], -self.rules.bound, self.rules.bound)

    def train(self, padded: np.ndarray, at: np.ndarray) -> None:
        side = self.rules.side
        for lo in range(0, len(at), self.rules.batch):
            a = at[lo : lo + self.rules.batch]
            h, p, q, _ = forward(self.net, padded, a, side)
            n = len(a)
            every, z = np.arange(n), np.concatenate([p, q])
            for k, _, _, digit in _digits(self.net, padded[a]):
                z[MEMBERS * k + digit, every] -= 1
            z /= np.float32(n)
            dh = z.T @ self.net["out"]
            dh *= 1 - h * h
            self._step("out", z @ h)
            for k, name, before, _ in _digits(self.net, padded[a]):
                own = z[MEMBERS * k : MEMBERS * (k + 1)]
                if before is None:
                    self._step(name, own.sum(axis=1))
                    continue
                order = np.argsort(before, kind="stable")
                some, first = np.unique(before[order], return_index=True)
                self._step(name, np.add.reduceat(own[:, order], first, axis=1), (slice(None), some))
            self._step("shift", dh.sum(axis=0))
            for k, o in enumerate(_offsets(side)):
                ids = padded[a + o]
                ids = ids.astype(np.uint16) if pad_of(self.net) < 1 << 16 else ids
                order = np.argsort(ids, kind="stable")
                some, first = np.unique(ids[order], return_index=True)
                self._step("embed", np.add.reduceat(dh[order], first, axis=0), (k, some))
            self.tokens += n


def _flat(*nets: Network) -> np.ndarray:
    return np.concatenate([net[k].ravel() for net in nets for k in sorted(net) if k not in FIXED])


def _shaped(flat: np.ndarray, like: Network) -> Network:
    out, at = {}, 0
    for k in sorted(like):
        if k in FIXED:
            out[k] = like[k]
            continue
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _pieces(net: Network, rules: LmRules) -> int:
    return max(rules.pieces, 2 * _flat(net).nbytes >> 20)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            hashes, flat, counts = word_hashes(part.column("text"))
            cells = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(counts)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(hashes[flat]))]
            )
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(counts, pa.int64()), cells.cast(pa.binary())], names=["doc_id", "key", "n", "words"])


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of doc_id and text), n (tokens) and words (a 32-bit hash each, one after the other) of every document, in the shared folder."""
    d = narrow(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return stored(d.mapInArrow(_hashed, f"doc_id {kind}, key long, n long, words binary"), "words")


def _stretches(column: pa.ChunkedArray | pa.Array, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Hashes and counts of stretches of documents, of about `TOKENS_AT_ONCE` tokens; a longer document is one of its own."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, "right")), at + 1)
        yield np.frombuffer(b"".join(column.slice(at, upto - at).to_pylist()), np.uint32), counts[at:upto], slice(at, upto)
        at = upto


def _copy(rules: LmRules, net: Network, seen: Network):
    """A copy of each group, after all tokens of its documents."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        trainer = Trainer(net, rules, seen)
        for hashes, counts, _ in _stretches(table.column("words"), table.column("n").to_numpy()):
            trainer.train(*windows(ids_of(hashes, net), counts, rules.side, pad_of(net)))
        cut = np.array_split(_flat(trainer.net, trainer.seen), _pieces(net, rules))
        n = len(cut)
        return pa.table(
            {
                "piece": pa.array(range(n), pa.int32()),
                "copy": pa.array([table.column("part")[0].as_py()] * n, pa.int64()),
                "weight": pa.array([float(trainer.tokens)] * n, pa.float64()),
                "cells": pa.array([c.astype(np.float32).tobytes() for c in cut], pa.binary()),
            }
        )

    return run


def _mean(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("copy")
    total = part["weight"].sum()
    cells = sum(np.frombuffer(c, np.float32).astype(np.float64) * (w / total) for c, w in zip(part["cells"], part["weight"]))
    return pd.DataFrame({"piece": part["piece"].iloc[:1], "copy": part["copy"].iloc[:1], "weight": [total], "cells": [cells.astype(np.float32).tobytes()]})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hashes, _, _ in _stretches(batch.column("words"), batch.column("n").to_numpy()):
            words, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int32)), pa.array(n, pa.int64())], names=["word", "n"])


def vocabulary(words: DataFrame, rules: LmRules) -> tuple[Network, int]:
    """The untrained network for the words of all documents (`hashed`), and the number of tokens."""
    counts = stored(words.select("n", "words").mapInArrow(_counted, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    every = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    own = max(VOCABULARY, int(rules.words_per_root * every.tokens**0.5))
    top = counts.orderBy(F.desc("n"), "word").limit(own).toArrow()
    best, often = top.column("word").to_numpy().astype(np.int32).view(np.uint32), top.column("n").to_numpy()
    forget(counts)
    shared = max(MEMBERS, int(rules.shared * own))
    spread = np.log(max(1.0, (every.words - len(best)) / shared))
    if not len(best):
        return start(rules), every.tokens
    rest = np.full(shared, (every.tokens - often.sum()) / shared)
    return with_frequencies(start(rules, best, shared, spread), np.concatenate([often, rest]), rules.bound), every.tokens


def trained(words: DataFrame, rules: LmRules = LmRules()) -> Network:
    """The network after all documents (`hashed`), in rounds."""
    schema = "piece int, copy long, weight double, cells binary"
    net, tokens = vocabulary(words, rules)
    seen = Trainer(net, rules).seen
    rounds = 1
    while tokens > rules.quantum << (rounds - 1):
        rounds += 1
    # Round 0 and 1 take a share of 2 ** (1 - rounds) each, and each further one twice that of the one before.
    place = F.shiftrightunsigned("key", 34).cast("long")
    for r in range(rounds):
        lo, hi = (1 << 30 >> rounds - r if r else 0), 1 << 30 >> rounds - 1 - r
        share = tokens * (hi - lo) / (1 << 30)
        copies = max(LEAST_COPIES, int(share * 6 / (4 * _flat(net).nbytes)) + 1)  # a token has about six bytes of text
        mine = words.where((F.col("n") > 0) & (place >= lo) & (place < hi)).select("key", "n", "words", F.pmod("key", F.lit(copies)).alias("part"))
        made = mine.groupBy("part").applyInArrow(_copy(rules, net, seen), schema)
        folds = max(1, int(copies**0.5))
        halves = made.withColumn("fold", F.pmod("copy", F.lit(folds))).groupBy("piece", "fold").applyInPandas(lambda p: _mean(p), schema)
        got = halves.groupBy("piece").applyInPandas(lambda p: _mean(p), schema).select("piece", "cells").collect()
        if not got:
            continue
        flat = np.concatenate([np.frombuffer(x["cells"], np.float32) for x in sorted(got, key=lambda x: x["piece"])])
        own = len(flat) // 2
        net, seen = _bounded(_shaped(flat[:own], net), rules), _shaped(flat[own:], seen)
    return net


def train(docs: DataFrame, rules: LmRules = LmRules()) -> Network:
    """The network after all documents."""
    words = hashed(docs)
    net = trained(words, rules)
    forget(words)
    return net


def _sums(net: Network, ids: np.ndarray, counts: np.ndarray, rules: LmRules) -> np.ndarray:
    """The score of each text, from the ids of all."""
    padded, at = windows(ids, counts, rules.side, pad_of(net))
    each = np.empty(len(at))
    for lo in range(0, len(at), rules.batch):
        each[lo : lo + rules.batch] = forward(net, padded, at[lo : lo + rules.batch], rules.side)[3]
    if "words" in net:
        each -= net["spread"] * (ids >= len(net["words"]))
    ends = np.cumsum(counts)
    some, sums = counts > 0, np.zeros(len(counts))
    if some.any():
        sums[some] = np.add.reduceat(each, (ends - counts)[some])
    return sums


def score_texts(net: Network, texts: pa.Array, rules: LmRules) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens and score of each text."""
    ids, counts = token_ids(texts, net)
    return counts, _sums(net, ids, counts, rules)


def score(docs: DataFrame, net: Network | None = None, rules: LmRules = LmRules()) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens, natural logarithm), per_token (null without tokens)."""
    words = hashed(docs)
    net = trained(words, rules) if net is None else net

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            s = np.zeros(len(n))
            for hashes, counts, at in _stretches(batch.column("words"), n):
                s[at] = _sums(net, ids_of(hashes, net), counts, rules)
            mean = pa.array(np.divide(s, n, out=np.zeros(len(n)), where=n > 0), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s, pa.float64()), mean], names=["doc_id", "n_tokens", "log_likelihood", "per_token"])

    d = words.select("doc_id", "n", "words")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, log_likelihood double, per_token double")
