"""Media columns: payloads as progressive JPEG files, and the tensors read back from them.

A text's payload is its UTF-8 bytes and then bytes of 255 up to a positive multiple of 576. A byte b
becomes the quantized coefficient b - 128, so the file holds the payload without loss in the unit of
its format: blocks of 64 coefficients in zigzag order, luma first, then both chromas, in an image of
16 x 16 MCUs with 4:2:0 sampling that is about as wide as high. A comment segment holds the payload's
length. Reading accumulates all scans into the coefficients, inverse-transforms them, doubles chroma
and gives a full-resolution RGB tensor.

Defined cases: null texts count as empty and become 576 bytes of 255. Equal texts give equal files,
tensors and features. Repeated rows are stored each. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .frames import narrow

UNIT = 576
SLICE_BYTES = 3_000_000


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def to_files(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload (a positive multiple of 64 bytes)."""
    images, blocks = [], []
    for p in payloads:
        n = len(p) // 64
        mcus = -(-n // 6)
        w = max(1, int(mcus**0.5))
        image = jpeg.Image(w, -(-mcus // w), b"payload %d" % len(p))
        cells = np.zeros((image.blocks, 64), np.int16)
        cells[:n] = np.frombuffer(p, np.uint8).reshape(n, 64).astype(np.int16) - 128
        images.append(image)
        blocks.append(cells)
    return jpeg.encode(np.concatenate(blocks), images) if images else []


def from_files(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and RGB tensors of the files."""
    images = [jpeg.parse(f) for f in files]
    if not images:
        return [], []
    coef = jpeg.decode(images)
    payloads, at = [], 0
    for i in images:
        size = int(i.comment.split()[1])
        payloads.append((coef[at : at + size // 64] + 128).astype(np.uint8).tobytes())
        at += i.blocks
    return payloads, jpeg.tensors(coef, images)


def feature(tensor: np.ndarray) -> str:
    """Shape, mean of each channel in thousandths, and checksum of an RGB tensor."""
    means = tensor.sum(axis=(0, 1), dtype=np.int64) * 1000 // (tensor.shape[0] * tensor.shape[1])
    return f"{tensor.shape[0]}x{tensor.shape[1]} {means[0]} {means[1]} {means[2]} {zlib.crc32(tensor):08x}"


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + UNIT)
    at = 0
    while at < len(ends):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, "data"):
            data = [x or b"" for x in part.column("data").to_pylist()]
            files = to_files([padded(x) for x in data])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (the file)."""
    d = narrow(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("data"))
    return d.mapInArrow(_stored, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _read(wanted: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "media"):
                files = part.column("media").to_pylist()
                payloads, rgb = from_files(files)
                made = {
                    "payload": lambda: pa.array(payloads, pa.binary()),
                    "tensor": lambda: pa.array([t.tobytes() for t in rgb], pa.binary()),
                    "height": lambda: pa.array([t.shape[0] for t in rgb], pa.int32()),
                    "width": lambda: pa.array([t.shape[1] for t in rgb], pa.int32()),
                    "payload_bytes": lambda: pa.array([len(p) for p in payloads], pa.int64()),
                    "payload_sha256": lambda: pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    "tail_crc32": lambda: pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    "media_bytes": lambda: pa.array([len(f) for f in files], pa.int64()),
                    "media_sha256": lambda: pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
                    "feature": lambda: pa.array([feature(t) for t in rgb], pa.string()),
                }
                names = ["doc_id", "n_bytes", *wanted]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[made[w]() for w in wanted]], names=names)

    return run


TYPES = {"payload": "binary", "tensor": "binary", "height": "int", "width": "int", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
DIGESTS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def read_back(media: DataFrame, wanted: tuple[str, ...] = ("payload", "height", "width", "tensor")) -> DataFrame:
    """doc_id, n_bytes and the columns wanted, from the stored files alone."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(_read(wanted), ", ".join([f"doc_id {kind}", "n_bytes long", *[f"{w} {TYPES[w]}" for w in wanted]]))
