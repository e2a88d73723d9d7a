"""A progressive JPEG codec in numpy that works on many images at once.

Writing: quantized coefficients go out in scans of spectral selection (the DC, AC 1 to 5, AC 6 to 63)
and successive approximation (all but the last bit, then the last bit). Reading: every scan adds its
bits to the images' coefficient arrays. Restart intervals are short, so all intervals of all images
of a batch are decoded side by side, one symbol or block of each per step.

Blocks are rows of 64 coefficients in zigzag order. The transform uses whole numbers small enough to
be exact in float32, so an image gives the same samples in any batch.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import cache

import numpy as np

INTERVAL = 8  # blocks or MCUs between restart markers
CHUNK = 4096  # intervals handled at once
SCANS = [((0, 1, 2), 0, 0, 0, 1)] + [((c,), a, b, h, l) for a, b, h, l in ((1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0)) for c in range(3)] + [((0, 1, 2), 0, 0, 1, 0)]
SAMPLING = [(2, 2), (1, 1), (1, 1)]


@cache
def zigzag() -> np.ndarray:
    """Row-major place of each zigzag index."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


# Huffman tables: symbols by code length. Often used symbols of text payloads come first.
@cache
def code_lengths(kind: str) -> tuple[tuple[int, int], ...]:
    """(symbol, length) in canonical order for DC, first AC scans, and refining AC scans."""
    if kind == "dc":
        return tuple((s, n) for s, n in zip((3, 2, 4, 5, 1, 6, 0, 7, 8, 9, 10, 11), (2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)))
    if kind == "refine":
        return ((0, 1), *((s, 6) for s in [*range(16, 240, 16), *range(1, 256, 16), 240]))
    first = (4, 6, 3, 5, 2, 0)
    rest = [s for s in (r * 16 + n for r in range(16) for n in range(11)) if s not in first]
    return (*((s, i + 1) for i, s in enumerate(first)), *((s, 14) for s in rest))


def encoder_table(lengths: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, last = 0, 0
    codes, sizes = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for symbol, n in lengths:
        code <<= n - last if last else 0
        codes[symbol], sizes[symbol], last = code, n, n
        code += 1
    return codes, sizes


def decoder_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: length of the code * 256 + symbol (0: no code)."""
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            lo = code << (16 - n)
            out[lo : lo + (1 << (16 - n))] = n * 256 + symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def _tables() -> bytes:
    out = b""
    for number, kind in ((0x00, "dc"), (0x10, "first"), (0x11, "refine")):
        lengths = code_lengths(kind)
        counts = bytes(sum(n == k for _, n in lengths) for k in range(1, 17))
        out += bytes([number]) + counts + bytes(s for s, _ in lengths)
    return _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, out) + _segment(0xDD, struct.pack(">H", INTERVAL))


def _bits_of(v: np.ndarray) -> np.ndarray:
    """Number of bits of the magnitude (below 2**15)."""
    return SIZES[np.abs(v)]


SIZES = np.array([n.bit_length() for n in range(1 << 15)], np.int64)


def _layout(mcu_w: int, mcu_h: int) -> np.ndarray:
    """Blocks of one image in MCU order: luma first by rows of the whole image, then both chromas."""
    y = np.arange(4 * mcu_w * mcu_h).reshape(mcu_h, 2, mcu_w, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    c = 4 * mcu_w * mcu_h + np.arange(mcu_w * mcu_h)[:, None]
    return np.concatenate([y, c, c + mcu_w * mcu_h], axis=1)


@dataclass
class Image:
    """Size in MCUs of 16 x 16 samples, and a comment."""

    mcu_w: int
    mcu_h: int
    comment: bytes = b""
    scans: list = field(default_factory=list)

    @property
    def blocks(self) -> int:
        return 6 * self.mcu_w * self.mcu_h

    def part(self, component: int) -> tuple[int, int]:
        """First block and number of blocks of a component."""
        n = self.mcu_w * self.mcu_h
        return (0, 4 * n) if component == 0 else ((3 + component) * n, n)


# ---------------------------------------------------------------- writing


def _pack(values: np.ndarray, sizes: np.ndarray, owner: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings, in order of their segments, as stuffed bytes with each segment's marker (-1: none); and each segment's end."""
    n = len(marks)
    total = np.bincount(owner, sizes, n).astype(np.int64)
    size = (total + 7) // 8
    start = np.cumsum(size) - size
    before = np.cumsum(sizes) - sizes
    at = before - (np.cumsum(total) - total)[owner] + start[owner] * 8
    words = np.zeros(int(size.sum()) // 4 + 3, np.uint64)
    w = at >> 5
    wide = values << (64 - (at & 31) - sizes).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.empty(0, np.int64)
    if len(w):
        np.add.at(words, w[first], np.add.reduceat(wide >> np.uint64(32), first))
        np.add.at(words, w[first] + 1, np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first))
    data = words.astype(">u4").view(np.uint8)[: int(size.sum())].copy()
    some = size > 0
    data[(start + size - 1)[some]] |= ((1 << (-total[some] % 8)) - 1).astype(np.uint8)
    more = np.ones(len(data), np.int64) + (data == 0xFF)
    tail = np.zeros(len(data), np.int64)
    marked = some & (marks >= 0)
    tail[(start + size - 1)[marked]] = 2
    place = np.cumsum(more + tail) - more - tail
    out = np.zeros(int((more + tail).sum()), np.uint8)
    out[place] = data
    ends = (start + size - 1)[marked]
    out[place[ends] + more[ends]] = 0xFF
    out[place[ends] + more[ends] + 1] = 0xD0 + marks[marked] % 8
    bounds = np.concatenate([place, [len(out)]])
    return out, bounds[start + size]


def _dc_tokens(dc: np.ndarray, mcus: np.ndarray, first: np.ndarray, low: int, refine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the DC values, dc[mcus], where `first` marks the MCUs that begin an interval."""
    v = dc[mcus] >> low
    if refine:
        return (v & 1).astype(np.uint64).ravel(), np.ones(v.size, np.int64)
    last = np.empty_like(v)
    last[:, 1:4] = v[:, :3]
    last[1:, 0], last[1:, 4:] = v[:-1, 3], v[:-1, 4:]
    last[np.ix_(first, [0, 4, 5])] = 0
    diff = (v - last).ravel()
    codes, lengths = encoder_table(code_lengths("dc"))
    n = _bits_of(diff)
    low_bits = np.where(diff < 0, diff + (1 << n) - 1, diff).astype(np.uint64)
    return codes[n] << n.astype(np.uint64) | low_bits, lengths[n] + n


def _first_tokens(v: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a first AC scan over rows of coefficients: values, sizes and the row of each."""
    m = np.abs(v) >> low
    rows, width = v.shape
    codes, lengths = encoder_table(code_lengths("first"))
    held = m > 0
    k = np.arange(width)
    last = np.maximum.accumulate(np.where(held, k, -1), axis=1)
    prior = np.concatenate([np.full((rows, 1), -1), last[:, :-1]], axis=1)
    run = k - prior - 1
    n = SIZES[m]
    symbol = (run & 15) * 16 + n
    value = codes[symbol] << n.astype(np.uint64) | np.where(v < 0, (1 << n) - 1 - m, m).astype(np.uint64)
    size = lengths[symbol] + n
    ends = last[:, -1:] < width - 1
    value = np.concatenate([value, np.full((rows, 1), codes[0])], axis=1)
    size = np.concatenate([size, np.full((rows, 1), lengths[0])], axis=1)
    used = np.concatenate([held, ends], axis=1)
    row = np.broadcast_to(np.arange(rows)[:, None], used.shape)
    out = value[used], size[used], row[used]
    skips = np.where(held, run >> 4, 0)
    if skips.any():  # runs of sixteen zeros, before the value that ends them
        key = np.broadcast_to(np.arange(used.size).reshape(used.shape), used.shape)[used] * 2 + 1
        where = np.repeat(np.flatnonzero(np.concatenate([skips, np.zeros((rows, 1), skips.dtype)], axis=1).ravel()), skips[skips > 0])
        order = np.argsort(np.concatenate([key, where * 2]), kind="stable")
        n = len(where)
        out = (
            np.concatenate([out[0], np.full(n, codes[0xF0])])[order],
            np.concatenate([out[1], np.full(n, lengths[0xF0])])[order],
            np.concatenate([out[2], where // (width + 1)])[order],
        )
    return out


def _refine_tokens(v: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a refining AC scan over rows of coefficients."""
    m = np.abs(v) >> low
    rows, width = v.shape
    codes, lengths = encoder_table(code_lengths("refine"))
    known, new = m > 1, m == 1
    value = np.concatenate([np.full((rows, 1), codes[0]), (m & 1).astype(np.uint64)], axis=1)
    size = np.concatenate([np.full((rows, 1), lengths[0]), np.ones((rows, width), np.int64)], axis=1)
    used = np.concatenate([np.ones((rows, 1), bool), known], axis=1)
    busy = np.flatnonzero(new.any(axis=1))
    if len(busy):
        kn, ne = known[busy], new[busy]
        k = np.arange(width)
        last_new = np.where(ne, k, -1).max(axis=1, keepdims=True)
        zeros = np.cumsum(~kn & ~ne, axis=1)
        since = zeros - np.maximum.accumulate(np.where(ne, zeros, 0), axis=1)
        before = np.concatenate([np.zeros((len(busy), 1), np.int64), zeros[:, :-1]], axis=1)
        base = np.maximum.accumulate(np.where(ne, zeros, 0), axis=1)
        base = np.concatenate([np.zeros((len(busy), 1), np.int64), base[:, :-1]], axis=1)
        run = (before - base) % 16
        skip = ~kn & ~ne & (since % 16 == 0) & (since > 0) & (k < last_new)
        event = ne | skip
        group = np.cumsum(event, axis=1) - event
        symbol = np.where(ne, run * 16 + 1, 0xF0)
        token = np.where(ne, codes[symbol] << np.uint64(1) | (v[busy] > 0).astype(np.uint64), codes[symbol])
        value[busy, 1:] = np.where(event, token, value[busy, 1:])
        size[busy, 1:] = np.where(event, lengths[symbol] + ne, 1)
        used[busy, 1:] = kn | event
        # Of each group: its event, then the correction bits up to there; the rest follows the end of block.
        key = np.concatenate([2 * event.sum(axis=1, keepdims=True), 2 * group + kn], axis=1)
        used[busy, 0] = (last_new < width - 1)[:, 0]
        order = np.argsort(key, axis=1, kind="stable")
        for grid in (value, size, used):
            grid[busy] = np.take_along_axis(grid[busy], order, axis=1)
    row = np.broadcast_to(np.arange(rows)[:, None], used.shape)
    return value[used], size[used], row[used]


def encode(blocks: np.ndarray, images: list[Image]) -> list[bytes]:
    """One file per image; `blocks` holds the images' blocks one after the other, each luma, Cb, Cr by rows."""
    first_block = np.cumsum([0] + [i.blocks for i in images])
    pieces: list[list[bytes]] = [[] for _ in images]
    for number, image in enumerate(images):
        frame = struct.pack(">BHHB", 8, 16 * image.mcu_h, 16 * image.mcu_w, 3) + b"".join(bytes([c + 1, h * 16 + v, 0]) for c, (h, v) in enumerate(SAMPLING))
        pieces[number].append(b"\xff\xd8" + _segment(0xFE, image.comment) + _tables() + _segment(0xC2, frame))
    for components, lo, hi, high, low in SCANS:
        # Units are blocks of one component, or MCUs; each image's are cut into intervals.
        if lo:
            spans = [(first_block[n] + i.part(components[0])[0], i.part(components[0])[1]) for n, i in enumerate(images)]
        else:
            spans = [(first_block[n] // 6, i.mcu_w * i.mcu_h) for n, i in enumerate(images)]
            mcus = np.concatenate([first_block[n] + _layout(i.mcu_w, i.mcu_h) for n, i in enumerate(images)])
        of_image = np.repeat(np.arange(len(images)), [-(-n // INTERVAL) for _, n in spans])
        index = np.arange(len(of_image)) - np.searchsorted(of_image, of_image)
        begin = np.array([s for s, _ in spans])[of_image] + index * INTERVAL
        length = np.minimum(INTERVAL, np.array([n for _, n in spans])[of_image] - index * INTERVAL)
        marks = np.where(np.concatenate([of_image[1:] == of_image[:-1], [False]]), index, -1)
        table = 0x11 if high else 0x10
        head = _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, table & 15 if lo else 0]) for c in components) + bytes([lo, hi, high * 16 + low]))
        for p in pieces:
            p.append(head)
        for at in range(0, len(of_image), CHUNK):
            part = slice(at, at + CHUNK)
            units = np.repeat(begin[part] - (np.cumsum(length[part]) - length[part]), length[part]) + np.arange(length[part].sum())
            owner = np.repeat(np.arange(len(length[part])), length[part])
            if lo:
                tokens = (_refine_tokens if high else _first_tokens)(blocks[units, lo : hi + 1].astype(np.int64), low)
                values, sizes, owners = tokens[0], tokens[1], owner[tokens[2]]
            else:
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                values, sizes = _dc_tokens(blocks[:, 0].astype(np.int64), mcus[units], starts, low, bool(high))
                owners = np.repeat(owner, 6)
            out, ends = _pack(values, sizes, owners, marks[part])
            starts = np.concatenate([[0], ends[:-1]])
            own = of_image[part]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for a, b in zip(edge, [*edge[1:], len(own)]):
                pieces[own[a]].append(out[starts[a] : ends[b - 1]].tobytes())
    return [b"".join([*p, b"\xff\xd9"]) for p in pieces]


# ---------------------------------------------------------------- reading

SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def parse(data: bytes) -> Image:
    """Size, comment and scans of a progressive file with 2 x 2 luma sampling; a scan: parameters, tables, interval and its bytes."""
    at, dc, ac, interval, image, comment = 2, {}, {}, 0, None, b""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (length,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, high, wide, n = struct.unpack_from(">BHHB", body)
            if [divmod(body[7 + 3 * c], 16) for c in range(n)] != SAMPLING:
                raise ValueError("only 4:2:0 files with three components are read")
            image = Image(-(-wide // 16), -(-high // 16), comment)
        elif marker == 0xDA:
            n = body[0]
            parts = tuple(body[1 + 2 * c] - 1 for c in range(n))
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            end = SCAN_END.search(data, at).start()
            tables = (ac if lo else dc).get(body[2] & 15 if lo else body[2] >> 4)
            image.scans.append((parts, lo, hi, approx >> 4, approx & 15, tables, interval, data[at:end]))
            at = end
        elif marker not in (0xDB, *range(0xE0, 0xF0)):
            raise ValueError(f"marker {marker:x} isn't read")
    return image


def _lanes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without stuffing and markers, the first byte of every interval, and the part of each."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    edge = np.cumsum([0] + [len(p) for p in parts])
    after = np.concatenate([[False], raw[:-1] == 0xFF]) if len(raw) else np.zeros(0, bool)
    after[edge[:-1][np.diff(edge) > 0]] = False
    restart = after & ((raw & 0xF8) == 0xD0)
    gone = after & (raw == 0) | restart
    gone[np.flatnonzero(restart) - 1] = True
    kept = np.cumsum(~gone) - ~gone
    starts = np.concatenate([edge[:-1], np.flatnonzero(restart) + 1])
    owner = np.searchsorted(edge, starts, "right") - 1
    owner[: len(parts)] = np.arange(len(parts))
    order = np.argsort(starts, kind="stable")
    total = int((~gone).sum())
    first = np.concatenate([kept, [total]])[starts[order]]
    return raw[~gone], first, owner[order]


def _windows(data: np.ndarray) -> np.ndarray:
    """For each byte: it and the four that follow, as one number of 40 bits."""
    d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    n = len(data) + 4
    return d[:n] << 32 | d[1 : n + 1] << 24 | d[2 : n + 2] << 16 | d[3 : n + 3] << 8 | d[4 : n + 4]


def _read_dc(coef: np.ndarray, win: np.ndarray, pos: np.ndarray, rows: np.ndarray, size: np.ndarray, lut: np.ndarray, low: int) -> None:
    """rows: first MCU of each lane in `mcus`, given as lists of blocks by step."""
    last = np.zeros((len(pos), 3), np.int64)
    for step in range(rows.shape[1]):
        on = np.flatnonzero(step < size)
        w, shift = win[pos[on] >> 3], pos[on] & 7
        got = lut[(w >> (24 - shift)) & 0xFFFF]
        length, n = got >> 8, got & 255
        bits = (w >> (40 - shift - length - n)) & ((1 << n) - 1)
        diff = np.where((n > 0) & (bits < (1 << np.maximum(n - 1, 0))), bits - (1 << n) + 1, bits)
        c = max(0, step % 6 - 3)
        last[on, c] += diff
        coef[rows[on, step], 0] = last[on, c] << low
        pos[on] += length + n


def _read_first(coef: np.ndarray, win: np.ndarray, pos: np.ndarray, block: np.ndarray, stop: np.ndarray, lut: np.ndarray, lo: int, hi: int, low: int) -> None:
    flat = coef.reshape(-1)
    k = np.full(len(pos), lo)
    while len(pos):
        w, shift = win[pos >> 3], pos & 7
        got = lut[(w >> (24 - shift)) & 0xFFFF]
        length, run, n = got >> 8, (got >> 4) & 15, got & 15
        none = n == 0
        plain = not none.any()
        if not plain:
            n = np.where(none & (run < 15), run, n)  # an end of block has `run` bits of its count
        bits = (w >> (40 - shift - length - n)) & ((1 << n) - 1)
        pos = pos + length + n
        if plain:
            k = k + run
            half = 1 << (n - 1)
            flat[block * 64 + k] = np.where(bits < half, bits - 2 * half + 1, bits) << low
            k = k + 1
        else:
            at = np.flatnonzero(~none)
            k = k + np.where(none & (run < 15), 0, run)
            m = n[at]
            b = bits[at]
            flat[block[at] * 64 + k[at]] = np.where(b < (1 << (m - 1)), b - (1 << m) + 1, b) << low
            ended = none & (run < 15)
            k = np.where(ended, hi + 1, k + 1)
            block = block + np.where(ended, (1 << run) + bits - 1, 0)
        over = k > hi
        if over.any():
            block = block + over
            k = np.where(over, lo, k)
            on = block < stop
            if not on.all():
                pos, block, stop, k = pos[on], block[on], stop[on], k[on]


def _bit(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def _read_refine(coef: np.ndarray, data: np.ndarray, win: np.ndarray, pos: np.ndarray, block: np.ndarray, stop: np.ndarray, lut: np.ndarray, lo: int, hi: int, low: int) -> None:
    one, cells = 1 << low, np.arange(lo, hi + 1)
    k, ending = np.full(len(pos), lo), np.zeros(len(pos), np.int64)
    while len(pos):
        w, shift = win[pos >> 3], pos & 7
        fresh = ending == 0
        got = np.where(fresh, lut[(w >> (24 - shift)) & 0xFFFF], 0)
        length, run, n = got >> 8, (got >> 4) & 15, got & 15
        ends = fresh & (n == 0) & (run < 15)
        more = np.where(ends, run, np.where(fresh & (n == 1), 1, 0))
        bits = (w >> (40 - shift - length - more)) & ((1 << more) - 1)
        pos = pos + length + more
        ending = np.where(ends, (1 << run) + bits, ending)
        rows = coef[block, lo : hi + 1].astype(np.int64)
        known = rows != 0
        ahead = cells >= k[:, None]
        walks = ending == 0  # up to the zero that the symbol names
        upto = np.full(len(pos), hi + 1)
        if walks.any():
            z = np.cumsum(~known[walks] & ahead[walks], axis=1)
            upto[walks] = lo + np.argmax((z == (run[walks] + 1)[:, None]) & ~known[walks] & ahead[walks], axis=1)
        fix = known & ahead & (cells < upto[:, None])
        count = fix.sum(axis=1)
        r, c = np.nonzero(fix)
        rank = np.arange(len(r)) - (np.cumsum(count) - count)[r]
        v = rows[r, c]
        coef[block[r], c + lo] = v + np.where(_bit(data, pos[r] + rank) == 1, np.sign(v) * one, 0)
        pos = pos + count
        put = np.flatnonzero(walks & (n == 1))
        coef[block[put], upto[put]] = np.where(bits[put] == 1, one, -one)
        k = np.where(walks, upto + 1, hi + 1)
        ending = np.where(walks, 0, ending - 1)
        over = k > hi
        block = block + over
        k = np.where(over, lo, k)
        on = block < stop
        if not on.all():
            pos, block, stop, k, ending = pos[on], block[on], stop[on], k[on], ending[on]


def decode(images: list[Image]) -> np.ndarray:
    """The coefficient blocks of all images, from their scans."""
    first_block = np.cumsum([0] + [i.blocks for i in images])
    coef = np.zeros((int(first_block[-1]), 64), np.int16)
    todo = [list(i.scans) for i in images]
    while any(todo):
        # Scans of the same kind that come next in their files, of one component after the other, go together.
        key = next(t for t in todo if t)[0][1:7]
        batch = []
        for n, t in enumerate(todo):
            seen: set[int] = set()
            while t and t[0][1:7] == key and not seen & set(t[0][0]):
                batch.append((n, t[0][0], t[0][7]))
                seen |= set(t.pop(0)[0])
        lo, hi, high, low, tables, interval = key
        lut = decoder_table(*tables) if tables else None
        data, first, part = _lanes([b for _, _, b in batch])
        index = np.arange(len(part)) - np.searchsorted(part, part)
        units = np.array([images[n].part(c[0])[1] if lo else images[n].mcu_w * images[n].mcu_h for n, c, _ in batch])
        step = interval or int(units.max())
        size = np.minimum(step, units[part] - index * step)
        if lo:
            base = np.array([first_block[n] + images[n].part(c[0])[0] for n, c, _ in batch])
        else:
            mcus = np.concatenate([first_block[n] + _layout(images[n].mcu_w, images[n].mcu_h) for n, _, _ in batch])
            base = np.cumsum(units) - units
        begin = base[part] + index * step
        for at in range(0, len(part), CHUNK):
            s = slice(at, at + CHUNK)
            a, z = int(first[at]), int(first[at + CHUNK]) if at + CHUNK < len(first) else len(data)
            own = np.concatenate([data[a:z], np.zeros(16, np.uint8)])
            pos = (first[s] - a) * 8
            if not lo:
                every = np.arange(int(size[s].max()) * 6)
                where = np.minimum(begin[s][:, None] * 6 + every, mcus.size - 1)
                rows, on = mcus.reshape(-1)[where], every < size[s][:, None] * 6
                if high:
                    r, c = np.nonzero(on)
                    coef[rows[r, c], 0] |= (_bit(own, pos[r] + c).astype(np.int16) << low).astype(np.int16)
                else:
                    _read_dc(coef, _windows(own), pos, rows, size[s] * 6, lut, low)
            elif high:
                _read_refine(coef, own, _windows(own), pos, begin[s], begin[s] + size[s], lut, lo, hi, low)
            else:
                _read_first(coef, _windows(own), pos, begin[s], begin[s] + size[s], lut, lo, hi, low)
    return coef


@cache
def _inverse() -> np.ndarray:
    """From zigzag coefficients to samples, in units of 2**-12."""
    u = np.arange(8)
    c = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.rint(both[zigzag()] * 4096).astype(np.float32)


def samples(blocks: np.ndarray) -> np.ndarray:
    """Blocks of 8 x 8 samples from 0 to 255 (quantization steps of 1)."""
    s = np.rint((blocks.astype(np.float32) @ _inverse()) / 4096).astype(np.int32) + 128
    return np.clip(s, 0, 255).reshape(-1, 8, 8)


def tensors(coef: np.ndarray, images: list[Image]) -> list[np.ndarray]:
    """Full-resolution RGB tensors (height, width, 3) of bytes: chroma doubled in both directions."""
    pixels, out, at = samples(coef), [], 0
    for i in images:
        n, h, w = i.mcu_w * i.mcu_h, i.mcu_h, i.mcu_w
        plane = lambda p, rows, cols: p.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        y = plane(pixels[at : at + 4 * n], 2 * h, 2 * w) << 16
        cb, cr = (plane(pixels[at + (4 + c) * n : at + (5 + c) * n], h, w).repeat(2, axis=0).repeat(2, axis=1) - 128 for c in (0, 1))
        rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=-1)
        out.append(np.clip((rgb + 32768) >> 16, 0, 255).astype(np.uint8))
        at += i.blocks
    return out
