from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import jpeg, media

from .helpers import DOCS, rows

RNG = np.random.default_rng(7)
PAYLOADS = [
    b"",
    "Привет, срцр ярр мир! ".encode() * 90,
    bytes(RNG.integers(0, 256, 5000, dtype=np.uint8)),
    bytes(RNG.integers(125, 132, 9000, dtype=np.uint8)),
    bytes([128]) * 3000,
    b"plain words and lines\n" * 400,
    bytes(np.where(RNG.random(20_000) < 0.03, RNG.integers(120, 136, 20_000), 128).astype(np.uint8)),
    bytes(RNG.integers(0, 256, 40_000, dtype=np.uint8)),
]


def test_payloads_survive_and_do_not_depend_on_the_batch():
    p = [media.padded(x) for x in PAYLOADS]
    files = media.to_files(p)
    back, rgb = media.from_files(files)
    assert back == p
    for x, f, t in zip(p, files, rgb):
        assert media.to_files([x]) == [f]
        (one,), (alone,) = media.from_files([f])
        assert one == x and media.feature(alone) == media.feature(t)


def test_intervals_in_small_chunks(monkeypatch):
    p = [media.padded(x) for x in PAYLOADS]
    files = media.to_files(p)
    monkeypatch.setattr(jpeg, "CHUNK", 3)
    assert media.to_files(p) == files and media.from_files(files)[0] == p


def test_scans_build_up_the_coefficients():
    """Spectral selection and successive approximation: what the file holds after each group of scans."""
    (f,) = media.to_files([media.padded(PAYLOADS[2])])
    image = jpeg.parse(f)
    assert {(lo, hi, h, low) for _, lo, hi, h, low, *_ in image.scans} == {(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0), (0, 0, 1, 0)}
    whole = jpeg.decode([image]).astype(int)
    scans = image.scans
    image.scans = scans[:1]
    dc = jpeg.decode([image]).astype(int)
    assert (dc[:, 1:] == 0).all() and (dc[:, 0] == (whole[:, 0] >> 1 << 1)).all()
    image.scans = scans[:7]
    coarse = jpeg.decode([image]).astype(int)
    assert (coarse[:, 1:] == np.sign(whole[:, 1:]) * (np.abs(whole[:, 1:]) >> 1 << 1)).all()


def test_end_of_block_runs_of_other_writers_are_read():
    """A scan of one component with an end-of-block run over all blocks, as files of other writers have."""
    (f,) = media.to_files([media.padded(b"abc" * 100)])
    image = jpeg.parse(f)
    n = image.part(0)[1]
    size = n.bit_length() - 1
    counts, symbols = bytes([0] * 7 + [2] + [0] * 8), bytes([size << 4, 0xF0])
    bits = "00000000" + format(n - (1 << size), f"0{size}b") if size else "00000000"
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    image.scans = [((0,), 1, 63, 0, 0, (counts, symbols), 0, data)]
    assert not jpeg.decode([image]).any()


def test_transform_and_color_match_their_definitions():
    coef = RNG.integers(-60, 60, (6, 64))
    natural = np.zeros((6, 64))
    natural[:, jpeg.zigzag()] = coef
    c = [np.sqrt(1 / 8)] + [0.5] * 7
    k = np.array([[c[u] * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    want = np.clip(np.einsum("yv,xu,nvu->nyx", k, k, natural.reshape(6, 8, 8)) + 128, 0, 255)
    got = jpeg.samples(coef.astype(np.int16))
    assert np.abs(got - want).max() <= 1
    (rgb,) = jpeg.tensors(coef.astype(np.int16), [jpeg.Image(1, 1)])
    y, cb, cr = float(got[0, 0, 0]), float(got[4, 0, 0]) - 128, float(got[5, 0, 0]) - 128
    want = np.clip([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 0, 255)
    assert rgb.shape == (16, 16, 3) and np.abs(rgb[0, 0] - want).max() <= 1 and (rgb[0, 0] == rgb[0, 0]).all()


def test_zigzag_is_the_usual_one():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))


def test_columns(spark):
    texts = ["", None, "é" * 300, "é" * 300, "x" * 576]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).withColumn("media", F.lit("own"))
    got = {r["doc_id"]: r for r in rows(media.read_back(media.store(df), media.DIGESTS))}
    for i, t in enumerate(texts):
        p = media.padded((t or "").encode())
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["payload_bytes"] == len(p)
        assert got[i]["payload_sha256"] == hashlib.sha256(p).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(p[-32:])
    assert {k: v for k, v in got[2].items() if k != "doc_id"} == {k: v for k, v in got[3].items() if k != "doc_id"}
    full = rows(media.read_back(media.store(df)))
    assert all(len(r["tensor"]) == r["height"] * r["width"] * 3 for r in full)
    assert media.read_back(media.store(df.limit(0))).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")
