"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id as text, then tokenized where they lie, so ids
are made in file order and never shuffled. ORC stores the list of ids with its run-length encoding,
keeps the least and greatest doc_id per stripe and row group, and a Bloom filter on doc_id, so that
readers take stripes in parallel and skip those that cannot hold a document.

A tokenizer whose definition shows that it never joins across white space (see `splits_at_space`) encodes each
different word of a worker once, and the ids of a text are those of its words in order. Words of small Latin letters, which its
normalizer and cuts leave as they are, go to its model without them. Every worker first
compares both ways on texts made for it. Any other tokenizer encodes whole texts.

Defined cases: null and empty texts have the end id alone. Null doc_ids come first. Rows that repeat
a doc_id follow each other, in the order of their texts' hashes; a doc_id that very many rows repeat
is spread over several files. Empty tables give no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import new_path, stored
from .frames import narrow
from .ngram_join import text_slices


@dataclass(frozen=True)
class OutputRules:
    tokenizer: str
    end_id: int = 1
    stripe_bytes: int = 16 << 20
    row_index_stride: int = 1000
    bloom_fpp: float = 0.01
    word_cache: int = 500_000
    slice_bytes: int = 4_000_000


# The definition, as the library prints it, for which words can be encoded apart. White space becomes blanks, letters
# small ones one by one; runs of letters, single digits and runs of other signs are cut apart, and what is between them is dropped.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PROBES = (
    "",
    " \n\t ",
    "One two,  THREE... don't 12,5 3.4%\r\nx",
    "a\u00a0b\u2003c \u0301d e\u0301 \u00c4\u0130\u1e9e \u03a3\u0391\u03a3. \U0001f388\u200d x\x1cy",
    "<|startoftext|> A<|endoftext|>b, <|ENDOFTEXT|>. <|x|>",
    "I'LL we've '' ''s. -- (a.b), A.B., 1., ..",
    "\u00e9t\u00e9 \u00c9T\u00c9, stra\u00dfe \u00f8y\u00ff na\u00efve\u00d7 \u00f7a aa$$$ aa.*** \u00e9!? x') 7% x\u0301, don't'' \u0130. \u017b\u00d3\u0141. \u042f!",
)
#: Letters that normalizing and lower case leave as they are, one by one and side by side: `a` to `z`, and the small ones of Latin-1.
PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
#: ASCII signs at the end of a word, not those of special tokens, behind a digit or a Latin or Russian letter. Others may end in a mark once
#: they are normalized and in lower case, as U+0130 does, and the tokenizer cuts no sign from a mark.
CLOSING = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u0410-\u044f])([!-/:;=?@\\[-`{}~]+)$"


def splits_at_space(tokenizer) -> bool:
    """Whether the ids of a text are those of its words one after the other, in lower case where no special token can be met.

    It follows from the definition: the normalizer and the cuts never look across white space, pieces are merged inside a cut
    without chance or unknown signs, added tokens are taken from the raw text, hold no white space and begin with `<|`, and nothing is
    added, cut or padded.
    """
    d = json.loads(tokenizer.to_str())
    model, added = d["model"], d["added_tokens"]
    plain = not any((model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("byte_fallback"), d["truncation"], d["padding"]))
    apart = all(a["content"].startswith("<|") and a["content"].split() == [a["content"]] and not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in added)
    cuts = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    return model["type"] == "BPE" and plain and apart and d["normalizer"] == NORMALIZER and d["pre_tokenizer"] == cuts


def whole_ids(texts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and the number of each text's, from the library on whole texts."""
    each = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    size = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter((i for x in each for i in x), np.int32, int(size.sum())), size


def _of_plain_words(tokenizer):
    """The tokenizer's model behind cuts at blanks alone, which give words of `PLAIN` letters the same ids."""
    from tokenizers import Tokenizer, pre_tokenizers

    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain


class WordIds:
    """The ids of words met so far, in one pool of numbers; when it holds too many words, it keeps those that are met again just then."""

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.most = tokenizer, most
        self.by_words = splits_at_space(tokenizer)
        vocabulary = tokenizer.get_vocab()
        #: Whether an id ends a word, in vocabularies that mark it.
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.plain = _of_plain_words(tokenizer) if self.by_words and self.closes.any() else None
        self.place: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.pool = np.empty(0, np.int32)

    def _encoded(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if plain:
            (together,) = self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)
            ids = np.array(together.ids, np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            # Every word ends at least once, so equal numbers mean once each.
            if len(ends) == len(words):
                return ids, np.diff(np.concatenate([[0], ends]))
        return whole_ids(words, self.tokenizer)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of these words, all different and without white space, lie in the pool."""
        if not len(words):
            return np.empty(0, np.int64)
        each = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py().split("\n")
        at = np.fromiter(map(self.place.get, each, repeat(-1)), np.int64, len(each))
        new = at < 0
        if len(self.place) + int(new.sum()) > self.most:
            met = np.flatnonzero(~new)
            self.pool, self.ends = _gathered(self.pool, self.ends, at[met])
            at[met] = np.arange(len(met))
            self.place = {each[i]: k for k, i in enumerate(met.tolist())}
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) & (self.plain is not None)
        pools, sizes = [self.pool], []
        for quick in (True, False):
            which = np.flatnonzero(new & (plain == quick))
            for i in range(0, len(which), 2000):
                some = which[i : i + 2000]
                ids, size = self._encoded(part := [each[j] for j in some.tolist()], quick)
                at[some] = fresh = np.arange(len(self.place), len(self.place) + len(part))
                self.place.update(zip(part, fresh.tolist()))
                pools.append(ids)
                sizes.append(size)
        if sizes:
            self.pool = np.concatenate(pools)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        return at


def _gathered(pool: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's stretches numbered `at` (from ends[i] to ends[i + 1]) one after the other, and where they end, from 0."""
    start, long = ends[at], ends[at + 1] - ends[at]
    total = np.concatenate([[0], np.cumsum(long)])
    return pool[np.repeat(start - total[:-1], long) + np.arange(int(total[-1]))], total


def token_lists(texts: pa.Array, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and the number of each text's.

    The different words of the texts are cut once more: signs that end a word behind most letters and digits (see `CLOSING`)
    are words of their own to the tokenizer. ASCII letters are put in lower case, as it would, except in words that may hold a special token, which
    it looks for in the raw text.
    """
    if not known.by_words:
        return whole_ids(pc.fill_null(texts, "").to_pylist(), known.tokenizer)
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = words.flatten().dictionary_encode()
    raw = coded.dictionary
    lowered = pc.if_else(pc.match_substring(raw, "<|"), raw, pc.ascii_lower(raw))
    cut = pc.split_pattern(pc.replace_substring_regex(lowered, CLOSING, r"\1 \2"), " ")
    parts = cut.flatten().dictionary_encode()
    at = known.places(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)]
    pool, ends = _gathered(known.pool, known.ends, at)
    ends = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype(np.int64)]
    ids, total = _gathered(pool, ends, coded.indices.to_numpy(zero_copy_only=False))
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return ids, np.diff(total[bounds])


@cache
def _known(path: str, most: int) -> WordIds:
    """One table of words for all tasks of a worker."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; threads of the library hold memory each
    known = WordIds(Tokenizer.from_file(path), most)
    by_words, whole = token_lists(pa.array(PROBES), known), whole_ids(list(PROBES), known.tokenizer)
    known.by_words &= all(np.array_equal(a, b) for a, b in zip(by_words, whole))
    return known


def _tokenized(rules: OutputRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(rules.tokenizer, rules.word_cache)
        for batch in batches:
            for part in text_slices(batch, "text", rules.slice_bytes):
                ids, counts = token_lists(part.column("text"), known)
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]) if len(ends) else 0, rules.end_id, np.int32)
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return run


def write_ids(docs: DataFrame, path: str, rules: OutputRules) -> None:
    """ORC files of (doc_id, ids), ascending by doc_id from file to file."""
    d = narrow(docs, "doc_id", "text")
    d = d.withColumns({"_t": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    d = d.repartitionByRange("doc_id", "_t", "_row").sortWithinPartitions("doc_id", "_t", "_row").select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    options = {
        "compression": "zstd",
        "orc.stripe.size": rules.stripe_bytes,
        "orc.row.index.stride": rules.row_index_stride,
        "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": rules.bloom_fpp,
    }
    d.mapInArrow(_tokenized(rules), f"doc_id {kind}, ids array<int>").write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def read_ids(spark: SparkSession, path: str, id_type: str = "long", doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of the files; with `doc_ids`, stripes that cannot hold one of them are skipped."""
    df = spark.read.schema(f"doc_id {id_type}, ids array<int>").orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        bounds = ids.offsets.to_numpy()
        flat = ids.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(flat[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("file"), b.column("place"), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())],
            names=["doc_id", "file", "place", "n_tokens", "ids_crc32"],
        )


def positions(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    The files are read once, and what was measured is stored. Files are summed up first; then only rows of one file are numbered together.
    """
    df = read_ids(spark, path, id_type).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("place"))
    m = stored(df.mapInArrow(_measured, f"doc_id {id_type}, file string, place struct<at:long,row:long>, n_tokens long, ids_crc32 long"), "id-sums")
    files = m.groupBy("file").agg(F.sum("n_tokens").alias("t"))
    # One row a file. Files go by number: names of more than five digits don't sort as text.
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    files = files.select("file", F.coalesce(F.sum("t").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("file").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("inside", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(files, "file")
    return m.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_orc(docs: DataFrame, rules: OutputRules) -> tuple[str, DataFrame]:
    """The folder of the files, in the shared folder, and the documents' positions in them."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write_ids(docs, path, rules)
    return path, positions(spark, path, narrow(docs, "doc_id").schema[0].dataType.simpleString())
