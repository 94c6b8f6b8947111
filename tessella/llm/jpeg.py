"""Progressive JPEG: scans are accumulated into coefficient arrays, which become full-resolution RGB tensors.

Decoding works on many images at once. Every restart interval is a lane with its own place in the bit stream, and
all lanes of scans with equal parameters advance together by numpy look-ups of 16 bits, so an image of many
intervals, or many images, decode without a loop over symbols of one stream. Spectral selection and successive
approximation, DC and AC, first and refining scans, interleaved or not, end-of-band runs and restart intervals are
read; sampling factors of 1 and 2 are upsampled by repetition.

A payload of bytes is stored as an image whose quantised coefficients stand for its bytes, small ones for common bytes,
64 to a block, in 4:2:0 order of blocks; coefficients are JPEG's own lossless unit. Files hold a restart marker after every interval.

Defined results: null media and media that is no readable progressive JPEG give null tensors; an empty payload is
one block of zero bytes; equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

UNIT = 64
#: Bytes by how often texts have them, about; all others follow in order. The commonest is coefficient 0, the next are 1, -1,
#: 2, -2 and so on: common letters are small, and zeros cost least.
COMMON = b" eaisnrtoldcumpgbhfvqyj,.z\nk'wx\xc3-\xa9ESLDAPCTIMNROBG0123456789FHUVJWQKYXZ:;()\"!?"


def _coefficients() -> np.ndarray:
    order = [*COMMON, *(b for b in range(256) if b not in COMMON)]
    out = np.empty(256, np.int32)
    out[order] = [(k + 1) // 2 * (1 if k % 2 else -1) for k in range(256)]
    return out


COEFFICIENT = _coefficients()
BYTE = np.empty(257, np.uint8)  # from 0 for -128
BYTE[COEFFICIENT + 128] = np.arange(256)
BLANK = bytes(BYTE[128:129])
#: Scans of a payload: components, first and last coefficient, bits already sent and bits still withheld.
SCANS = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 15, 0, 1), ((0,), 16, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]


def _zigzag() -> np.ndarray:
    at = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))
    return np.array([r * 8 + c for r, c in at])


ZIGZAG = _zigzag()
_k = np.arange(8)
_DCT = np.sqrt((1 + (_k[:, None] > 0)) / 8) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)
#: From 64 coefficients in zigzag order to 64 samples.
INVERSE = np.einsum("ui,vj->uvij", _DCT, _DCT).reshape(64, 64)[ZIGZAG].astype(np.float32)


class Table:
    """A Huffman table: from counts of code lengths and symbols, or made for expected weights of symbols."""

    def __init__(self, counts: list[int], symbols: bytes):
        self.counts, self.symbols = list(counts), bytes(symbols)
        self.code, self.bits = np.zeros(256, np.uint32), np.zeros(256, np.int64)
        self.look = np.zeros(1 << 16, np.uint16)  # symbol * 32 + length
        code, k = 0, 0
        for size, n in enumerate(self.counts, 1):
            for _ in range(n):
                s = self.symbols[k]
                self.code[s], self.bits[s] = code, size
                self.look[code << (16 - size) : (code + 1) << (16 - size)] = s * 32 + size
                code, k = code + 1, k + 1
            code <<= 1

    @classmethod
    def made(cls, weight: dict[int, float]) -> Table:
        """Codes of at most 16 bits, none of which is all ones: shorter for the heavier."""
        floor = sum(weight.values()) / 30_000
        heap = [(max(w, floor), [s]) for s, w in weight.items()] + [(floor / 2, [256])]
        size = {s: 0 for s in [*weight, 256]}
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[1] + b[1]:
                size[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
        order = sorted(weight, key=lambda s: (size[s], -weight[s], s))
        counts = [sum(size[s] == n for s in weight) for n in range(1, 17)]
        if max(size[s] for s in weight) > 16:
            raise ValueError("codes too long")
        return cls(counts, bytes(order))

    def segment(self, kind: int, ident: int) -> bytes:
        body = bytes([kind << 4 | ident, *self.counts]) + self.symbols
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


#: Expected weights: of sizes after runs of zeros, and of runs before coefficients that become 1 or -1.
DC_TABLE = Table.made({s: (207, 188, 261, 180, 105, 27, 33)[s] if s < 7 else 0.1 for s in range(12)})
#: Of a coefficient's size after no zeros, and how that falls with each zero before it.
_FIRST = {1: (168, 0.52), 2: (174, 0.58), 3: (166, 0.19), 4: (52, 0.58), 5: (45, 0.08), 6: (31, 0.02), 7: (0.5, 0.5)}
AC_TABLE = Table.made({**{r << 4 | s: n * fall ** (r**1.3) for s, (n, fall) in _FIRST.items() for r in range(16)}, 0x00: 8.0, 0xF0: 0.05})
REFINE_TABLE = Table.made({**{r << 4 | 1: (368, 420, 100, 22, 6)[r] if r < 5 else 0.4 ** (r - 5) for r in range(16)}, 0x00: 82.0, 0xF0: 0.05})


def layout(blocks: int) -> tuple[int, int]:
    """Width and height in units of 16 by 16 samples (six blocks) that hold so many blocks."""
    units = max(1, -(-blocks // 6))
    wide = int(np.ceil(np.sqrt(units)))
    return wide, -(-units // wide)


def size_of(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def pack(code: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of up to 24 bits, in order, as bytes: each lane starts a byte, ends in ones, and has FF escaped.

    Returns the bytes and the number of each lane's."""
    total = np.bincount(lane, weights=bits, minlength=lanes).astype(np.int64)
    size = (total + 7) // 8
    begin = np.cumsum(size) - size
    run = np.cumsum(bits)
    before = run - bits
    p = before - (np.cumsum(total) - total)[lane] + begin[lane] * 8
    out = np.zeros(int(size.sum()) + 4)
    value = code.astype(np.uint64) << (np.uint64(32) - (p & 7).astype(np.uint64) - bits.astype(np.uint64))
    for k in range(4):
        out += np.bincount((p >> 3) + k, weights=(value >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(np.float64), minlength=len(out))[: len(out)]
    raw = out[:-4].astype(np.uint8)
    pad = size * 8 - total
    last = (begin + size - 1)[size > 0]
    raw[last] |= ((1 << pad[size > 0]) - 1).astype(np.uint8)
    full = np.flatnonzero(raw == 255)
    where = np.searchsorted(begin, full, "right") - 1
    # lanes without bytes start where the next does: the last of them holds the byte
    return np.insert(raw, full + 1, 0), size + np.bincount(where, minlength=lanes)


def dc_tokens(v: np.ndarray, al: int, refine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a DC scan. v: (units, 6) values, four of luma and one of each chroma."""
    lane = np.repeat(np.arange(len(v)), 6)
    if refine:
        return (v >> al & 1).ravel().astype(np.uint32), np.ones(v.size, np.int64), lane
    d = (v >> al).copy()
    d[:, 1:4] -= d[:, :3].copy()
    d = d.ravel()
    s = size_of(d)
    extra = np.where(d < 0, d + (1 << s) - 1, d).astype(np.uint32)
    return DC_TABLE.code[s] << s.astype(np.uint32) | extra, DC_TABLE.bits[s] + s, lane


def ac_tokens(v: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a first AC scan over (blocks, coefficients of the band)."""
    v = np.sign(v) * (np.abs(v) >> al)
    n, width = v.shape
    row, k = np.nonzero(v)
    x = v[row, k]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    run = k - np.where(new, 0, np.concatenate(([0], k[:-1] + 1)))
    last = np.full(n, -1)
    last[row] = k  # the highest stays, as k rises in a row
    eob = last < width - 1
    ends = np.cumsum(eob) - eob  # of earlier blocks
    many = run // 16 + 1
    at = np.cumsum(many) - 1 + ends[row]
    total = int(many.sum() + eob.sum())
    code, bits, lane = np.full(total, AC_TABLE.code[0xF0], np.uint32), np.full(total, AC_TABLE.bits[0xF0]), np.zeros(total, np.int64)
    s = size_of(x)
    symbol = (run % 16) << 4 | s
    code[at] = AC_TABLE.code[symbol] << s.astype(np.uint32) | np.where(x < 0, x + (1 << s) - 1, x).astype(np.uint32)
    bits[at] = AC_TABLE.bits[symbol] + s
    per = np.bincount(row, weights=many, minlength=n).astype(np.int64) + eob
    lane = np.repeat(np.arange(n), per)
    stop = (np.cumsum(per) - 1)[eob]
    code[stop], bits[stop] = AC_TABLE.code[0], AC_TABLE.bits[0]
    return code, bits, lane


def refine_tokens(v: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a refining AC scan: a symbol for each coefficient that becomes non-zero, after it the correction bits
    of those that were; runs of over 15 zeros before one take symbols of their own."""
    n, width = v.shape
    a = np.abs(v) >> al
    old, new, zero = a > 1, a == 1, a == 0
    # segments end with a new coefficient; what follows the last of a block is its tail
    seg = np.cumsum(new, axis=1) - new
    count = new.sum(axis=1)
    tail = (old | zero) & (seg == count[:, None])
    has_tail = tail.any(axis=1)
    zeros = np.cumsum(zero, axis=1)
    prev = np.concatenate((np.zeros((n, 1), np.int64), zeros[:, :-1]), axis=1)
    row, k = np.nonzero(new)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    z = zeros[row, k]
    run = z - np.where(first, 0, np.concatenate(([0], z[:-1])))
    long = np.unique(row[run > 15])
    segs = count + has_tail
    seg_of = (np.cumsum(segs) - segs)[:, None] + seg
    olds = np.cumsum(old.ravel()).reshape(n, width)
    total = int(segs.sum() + olds.ravel()[-1]) if n else 0
    code, bits = np.zeros(total, np.uint32), np.zeros(total, np.int64)
    r, c = np.nonzero(old)
    at = olds[r, c] - 1 + seg_of[r, c] + 1
    code[at], bits[at] = a[r, c] & 1, 1
    # a segment's symbol stands before the old coefficients since the last new one
    per_seg = np.bincount(seg_of[r, c], minlength=int(segs.sum()))
    head = np.arange(int(segs.sum())) + np.cumsum(per_seg) - per_seg
    symbol = np.minimum(run, 15) << 4 | 1
    h = head[seg_of[row, k]]
    code[h] = REFINE_TABLE.code[symbol] << np.uint32(1) | (v[row, k] > 0)
    bits[h] = REFINE_TABLE.bits[symbol] + 1
    h = head[(np.cumsum(segs) - 1)[has_tail]]
    code[h], bits[h] = REFINE_TABLE.code[0], REFINE_TABLE.bits[0]
    lane = np.repeat(np.arange(n), segs + old.sum(axis=1))
    if not len(long):
        return code, bits, lane
    # blocks with long runs of zeros are rewritten symbol by symbol
    cut = np.searchsorted(lane, np.arange(n + 1))
    parts, start = [], 0
    for b in long:
        out: list[tuple[int, int]] = []
        held: list[int] = []
        r, stop = 0, int(np.flatnonzero(new[b])[-1])
        for k in range(width):
            if zero[b, k]:
                r += 1
                continue
            while r > 15 and k <= stop:
                out += [(int(REFINE_TABLE.code[0xF0]), int(REFINE_TABLE.bits[0xF0])), *((x, 1) for x in held)]
                held, r = [], r - 16
            if old[b, k]:
                held.append(int(a[b, k] & 1))
                continue
            s = r << 4 | 1
            out += [(int(REFINE_TABLE.code[s]) << 1 | int(v[b, k] > 0), int(REFINE_TABLE.bits[s]) + 1), *((x, 1) for x in held)]
            held, r = [], 0
        if r or held:
            out += [(int(REFINE_TABLE.code[0]), int(REFINE_TABLE.bits[0])), *((x, 1) for x in held)]
        made = np.array(out, np.int64).reshape(-1, 2)
        parts += [(code[start : cut[b]], bits[start : cut[b]], lane[start : cut[b]]), (made[:, 0].astype(np.uint32), made[:, 1], np.full(len(made), b))]
        start = cut[b + 1]
    parts.append((code[start:], bits[start:], lane[start:]))
    return tuple(np.concatenate(x) for x in zip(*parts))


@lru_cache(maxsize=1024)
def _few_places(wide: int, high: int) -> np.ndarray:
    return _places(wide, high)


def block_places(wide: int, high: int) -> np.ndarray:
    """As below, kept for the sizes that most payloads have."""
    return _few_places(wide, high) if wide * high <= 1024 else _places(wide, high)


def _places(wide: int, high: int) -> np.ndarray:
    """For each block of a payload in order: its place among all blocks, component by component in raster order."""
    unit = np.arange(wide * high)
    r, c = unit // wide, unit % wide
    luma = [(2 * r + i) * 2 * wide + 2 * c + j for i in (0, 1) for j in (0, 1)]
    n = 4 * len(unit)
    return np.stack([*luma, n + unit, n + len(unit) + unit], axis=1).ravel()


def encode(payloads: list[bytes]) -> list[bytes]:
    """Payloads (a multiple of UNIT bytes each) as progressive JPEG files."""
    plans = [layout(len(p) // UNIT) for p in payloads]
    units = np.array([w * h for w, h in plans])
    base = np.cumsum(units * 6) - units * 6
    raw = np.frombuffer(b"".join(p + BLANK * (int(u) * 6 * UNIT - len(p)) for p, u in zip(payloads, units)), np.uint8)
    order = COEFFICIENT[raw].reshape(-1, 6, UNIT)  # blocks of all units
    places = [block_places(w, h) for w, h in plans]
    flat = np.empty((len(raw) // UNIT, UNIT), np.int32)
    flat[np.concatenate([b + p for b, p in zip(base, places)])] = order.reshape(-1, UNIT)
    parts: list[list[bytes]] = [[] for _ in payloads]
    for comps, lo, hi, ah, al in SCANS:
        if lo == 0:
            lanes = units
            tokens = dc_tokens(order[:, :, 0], al, ah > 0)
        else:
            c = comps[0]
            lanes = units * (4 if c == 0 else 1)
            start = base + units * (0, 4, 5)[c]
            pick = np.repeat(start - (np.cumsum(lanes) - lanes), lanes) + np.arange(lanes.sum())
            tokens = (refine_tokens if ah else ac_tokens)(flat[pick, lo : hi + 1], al)
        data, size = pack(*tokens, int(lanes.sum()))
        # a marker follows every lane but the last of a scan
        nth = np.arange(len(size)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        marked = size + 2
        out = np.empty(int(marked.sum()), np.uint8)
        end = np.cumsum(marked)
        out[end - 2], out[end - 1] = 0xFF, 0xD0 + nth % 8
        body = np.ones(len(out), bool)
        body[end - 2] = body[end - 1] = False
        out[body] = data
        cut = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(lanes)))]
        head = b"\xff\xdd\x00\x04\x00\x01\xff\xda" + struct.pack(">HB", 6 + 2 * len(comps), len(comps)) + b"".join(bytes([c + 1, 0 if lo == 0 else (1 if ah else 0)]) for c in comps) + bytes([lo, hi, ah << 4 | al])
        text = out.tobytes()
        for i in range(len(payloads)):
            parts[i].append(head + text[cut[i] : cut[i + 1] - 2])
    tables = b"\xff\xdb\x00\x43\x00" + b"\x01" * 64 + DC_TABLE.segment(0, 0) + AC_TABLE.segment(1, 0) + REFINE_TABLE.segment(1, 1)
    files = []
    for p, (w, h), scans in zip(payloads, plans, parts):
        frame = b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, h * 16, w * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        files.append(b"\xff\xd8\xff\xfe" + struct.pack(">HQ", 10, len(p)) + tables + frame + b"".join(scans) + b"\xff\xd9")
    return files


class Image:
    """What a file's headers say, and its coefficient arrays once scans are accumulated."""

    def __init__(self):
        self.comment, self.quant, self.huffman = b"", {}, {}
        self.width = self.height = 0
        self.comps: list[tuple[int, int, int, int]] = []  # identifier, sampling, sampling, quantisation
        self.scans: list[tuple] = []

    def frame(self, body: bytes, size: int) -> None:
        """size: the file's bytes. Each block takes a bit at least, so a frame of more blocks is none."""
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if self.comps or bits != 8 or n not in (1, 3) or not self.height or not self.width or len(body) < 6 + 3 * n:
            raise ValueError("frame")
        self.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if len({c[0] for c in self.comps}) < n or not all(c[1] in (1, 2) and c[2] in (1, 2) for c in self.comps):
            raise ValueError("components")
        self.h, self.v = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        self.units = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.shape = [(self.units[1] * c[2], self.units[0] * c[1]) for c in self.comps]
        self.first = np.cumsum([0, *[a * b for a, b in self.shape]])
        if self.first[-1] > 8 * size:
            raise ValueError("more blocks than bits")

    def order(self, comps: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Blocks of a scan in order, their components' places in the scan, and blocks of a unit."""
        if len(comps) == 1:
            c = comps[0]
            high = -(-(-(-self.height * self.comps[c][2] // self.v)) // 8)
            wide = -(-(-(-self.width * self.comps[c][1] // self.h)) // 8)
            at = self.first[c] + (np.arange(high)[:, None] * self.shape[c][1] + np.arange(wide)).ravel()
            return at, np.zeros(len(at), np.int64), 1
        y, x = np.divmod(np.arange(self.units[0] * self.units[1]), self.units[0])
        cols, kinds = [], []
        for k, c in enumerate(comps):
            for i in range(self.comps[c][2]):
                for j in range(self.comps[c][1]):
                    cols.append(self.first[c] + (y * self.comps[c][2] + i) * self.shape[c][1] + x * self.comps[c][1] + j)
                    kinds.append(k)
        return np.stack(cols, axis=1).ravel(), np.tile(kinds, len(x)), len(cols)


def parse(files: list[bytes]) -> tuple[np.ndarray, list[Image | None]]:
    """Entropy-coded bytes of all files without escapes, and each file's headers with its scans' lanes."""
    raw = np.frombuffer(b"".join(files) + b"\xff\xd9\0\0", np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    escape = ff[after == 0] + 1
    marks = ff[(after != 0) & (after != 255)]
    kind = raw[marks + 1]
    ends = np.flatnonzero((kind < 0xD0) | (kind > 0xD7))
    keep = np.ones(len(raw), bool)
    keep[escape] = False
    shift = np.cumsum(~keep)
    text, images, base = raw.tobytes(), [], 0
    for f in files:
        end, at = base + len(f), base + 2
        im: Image | None = Image()
        tables: dict = {}
        interval = 0
        try:
            if f[:2] != b"\xff\xd8":
                raise ValueError("no JPEG")
            while at < end:
                if text[at] != 255:
                    raise ValueError("no marker")
                m = text[at + 1]
                if m == 0xD9:
                    break
                size = struct.unpack(">H", text[at + 2 : at + 4])[0]
                body, at = text[at + 4 : at + 2 + size], at + 2 + size
                if m == 0xFE:
                    im.comment = body
                elif m == 0xDB:
                    while body:
                        wide = body[0] >> 4
                        if wide > 1 or len(body) < 65 + 64 * wide:
                            raise ValueError("quantisation")
                        im.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                        body = body[65 + 64 * wide :]
                elif m == 0xC4:
                    while body:
                        n = sum(body[1:17])
                        if len(body) < 17 + n or sum(c << (16 - k) for k, c in enumerate(body[1:17], 1)) > 1 << 16:
                            raise ValueError("Huffman table")
                        tables[body[0]] = body[1 : 17 + n]
                        body = body[17 + n :]
                elif m == 0xC2:
                    im.frame(body, len(f))
                elif m in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                    raise ValueError("not progressive")
                elif m == 0xDD:
                    interval = struct.unpack(">H", body)[0]
                elif m == 0xDA:
                    n = body[0]
                    ids = [c[0] for c in im.comps]
                    comps = [ids.index(body[1 + 2 * i]) for i in range(n)]
                    lo, hi, a = body[1 + 2 * n : 4 + 2 * n]
                    ah, al = a >> 4, a & 15
                    if not 1 <= n <= 3 or len(set(comps)) < n or not lo <= hi <= 63 or (lo == 0) != (hi == 0) or (lo and n > 1) or al > 13 or ah not in (0, al + 1):
                        raise ValueError("scan")
                    chosen = tuple(tables.get((0x10 if lo else 0) | (body[2 + 2 * i] >> (0 if lo else 4) & 15), b"") for i in range(n))
                    if not all(chosen) and not (lo == 0 and ah):
                        raise ValueError("no Huffman table")
                    if len(body) != 4 + 2 * n or at >= end:
                        raise ValueError("scan's end")
                    k = int(np.searchsorted(marks, at))
                    j = int(ends[np.searchsorted(ends, k)])  # lanes are cut at the restart markers before it
                    starts = np.concatenate(([at], marks[k:j] + 2))
                    im.scans.append((tuple(comps), lo, hi, a >> 4, a & 15, interval, chosen, starts - shift[starts - 1]))
                    at = int(marks[j])
            if not im.comps:
                raise ValueError("no frame")
        except (ValueError, IndexError, struct.error):
            im = None
        images.append(im)
        base = end
    return raw[keep], images


_tables: dict[bytes, Table] = {}


def table(raw: bytes) -> Table:
    if raw not in _tables:
        if len(_tables) > 256:
            _tables.clear()
        _tables[raw] = Table(list(raw[:16]), raw[16:])
    return _tables[raw]


_HALF = np.array([0, *(1 << k for k in range(15))], np.int32)
_SPAN = np.array([(1 << k) - 1 for k in range(16)], np.int32)


def extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values of so many bits."""
    return bits - np.where(bits < _HALF[size], _SPAN[size], 0)


def after(w: np.ndarray, n: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The `more` bits that follow the first n of 32."""
    return (((w << n.astype(np.uint32)) >> np.uint32(1)) >> (31 - more).astype(np.uint32)).astype(np.int32)


#: What damaged entropy-coded bytes may raise: codes and sizes that no table has.
DAMAGE = (IndexError, ValueError, AttributeError, KeyError, ZeroDivisionError, OverflowError, struct.error)


def read(files: list[bytes]) -> list[tuple[Image, np.ndarray] | None]:
    """Headers and coefficients of each file, None for what is no readable progressive JPEG. Files decode together; where
    one is damaged so that this fails, halves of them do, down to the damaged one."""
    try:
        images, coef, base = accumulate(files)
    except DAMAGE:
        if len(files) == 1:
            return [None]
        half = len(files) // 2
        return read(files[:half]) + read(files[half:])
    return [(im, coef[a:z]) if im else None for im, a, z in zip(images, base, base[1:])]


def accumulate(files: list[bytes]) -> tuple[list[Image | None], np.ndarray, np.ndarray]:
    """Headers, coefficients of all files' blocks in zigzag order, and where each file's blocks start."""
    data, images = parse(files)
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
    window = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    base = np.cumsum([0, *[int(i.first[-1]) if i else 0 for i in images]])
    coef = np.zeros((int(base[-1]), 64), np.int32)
    flat = coef.ravel()
    orders: dict = {}
    most = max((len(i.scans) for i in images if i), default=0)
    for turn in range(most):
        groups: dict = {}
        for f, im in enumerate(images):
            if im and turn < len(im.scans):
                comps, lo, hi, ah, al, interval, chosen, starts = im.scans[turn]
                groups.setdefault((len(comps), lo, hi, ah, al, chosen), []).append((f, comps, interval, starts))
        for (_, lo, hi, ah, al, chosen), members in groups.items():
            blocks, kinds, begin, count, pos, at = [], [], [], [], [], 0
            for f, comps, interval, starts in members:
                im = images[f]
                shape = (im.width, im.height, tuple(im.comps), comps)
                if shape not in orders:
                    if len(orders) > 4096:
                        orders.clear()
                    orders[shape] = im.order(list(comps))
                order, kind, unit = orders[shape]
                per = interval * unit if interval else len(order)
                first = np.arange(0, len(order), per)[: len(starts)]
                blocks.append(order + base[f])
                kinds.append(kind)
                begin.append(first + at)
                count.append(np.minimum(per, len(order) - first))
                pos.append(starts[: len(first)] * 8)
                at += len(order)
            lanes = tuple(map(np.concatenate, (blocks, kinds, begin, count, pos)))
            # images of many shapes meet in one pass: lanes are all that counts
            (dc_scan if lo == 0 else refine_scan if ah else ac_scan)(window, flat, lanes, lo, hi, ah, al, [table(t) if t else None for t in chosen])
    return images, coef, base


def peek(window: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """At least 25 bits from each place, at the top of 32."""
    return window[np.minimum(pos >> 3, len(window) - 1)] << (pos & 7).astype(np.uint32)


def dc_scan(window, flat, lanes, lo, hi, ah, al, tables) -> None:
    blocks, kinds, begin, count, pos = lanes
    pos = pos.copy()
    looks = None if ah else np.stack([t.look for t in tables])
    last = np.zeros((len(begin), 4), np.int64)
    for i in range(int(count.max())):
        on = np.flatnonzero(count > i)
        b, k = blocks[begin[on] + i], kinds[begin[on] + i]
        w = peek(window, pos[on])
        if ah:
            flat[b * 64] |= (w >> np.uint32(31)).astype(np.int32) << al
            pos[on] += 1
            continue
        e = looks[k, w >> np.uint32(16)].astype(np.int32)
        n, s = e & 31, e >> 5
        extra = after(w, n, s)
        last[on, k] += extend(extra, s)
        flat[b * 64] = last[on, k] << al
        pos[on] += n + s


def ac_scan(window, flat, lanes, lo, hi, ah, al, tables) -> None:
    blocks, _, begin, count, pos = lanes
    look, pos, skip = tables[0].look, pos.copy(), np.zeros(len(begin), np.int64)
    for i in range(int(count.max())):
        on = np.flatnonzero(count > i)
        idle = skip[on] > 0
        skip[on[idle]] -= 1
        on = on[~idle]
        at, p, k = blocks[begin[on] + i] * 64, pos[on], np.full(len(on), lo)
        while len(on):
            w = peek(window, p)
            e = look[w >> np.uint32(16)].astype(np.int32)
            n, s, r = e & 31, e >> 5 & 15, e >> 9
            more = np.where(s > 0, s, np.where(r < 15, r, 0))
            extra = after(w, n, more)
            p = p + n + more
            k = k + r
            v = s > 0
            put = v & (k <= hi)
            flat[(at + k)[put]] = extend(extra, s)[put] << al
            k = np.where(v | (r == 15), k + 1, 64)
            done = (k > hi) | (n == 0)
            if done.any():
                pos[on[done]] = p[done]
                end = done & ~v & (r < 15)
                skip[on[end]] = (1 << r[end]) + extra[end] - 1
                go = ~done
                on, at, p, k = on[go], at[go], p[go], k[go]


def refine_scan(window, flat, lanes, lo, hi, ah, al, tables) -> None:
    blocks, _, begin, count, pos = lanes
    look, pos, skip = tables[0].look, pos.copy(), np.zeros(len(begin), np.int64)
    one = 1 << al
    for i in range(int(count.max())):
        on = np.flatnonzero(count > i)
        at, p, left = blocks[begin[on] + i] * 64, pos[on], skip[on]
        ended = left > 0
        run, put = np.full(len(on), -1), np.zeros(len(on), np.int64)
        for k in range(lo, hi + 1):
            ask = np.flatnonzero(~ended & (run < 0))
            if len(ask):
                w = peek(window, p[ask])
                e = look[w >> np.uint32(16)].astype(np.int32)
                n, s, r = e & 31, e >> 5 & 15, e >> 9
                more = np.where(s > 0, 1, np.where(r < 15, r, 0))
                extra = after(w, n, more)
                p[ask] += n + more
                run[ask] = r
                put[ask] = np.where(s > 0, np.where(extra > 0, one, -one), 0)
                stop = (s == 0) & (r < 15)
                ended[ask[stop]] = True
                left[ask[stop]] = (1 << r[stop]) + extra[stop]
            c = flat[at + k]
            old = c != 0
            x = np.flatnonzero(old)
            if len(x):
                bit = (peek(window, p[x]) >> np.uint32(31)).astype(np.int32)
                p[x] += 1
                flat[at[x] + k] = c[x] + np.where(bit > 0, np.sign(c[x]) * one, 0)
            x = np.flatnonzero(~old & ~ended)
            if len(x):
                here = x[run[x] == 0]
                flat[at[here] + k] = put[here]
                run[x] -= 1
        skip[on] = np.maximum(left - 1, 0)
        pos[on] = p


def payload_of(im: Image, coef: np.ndarray) -> bytes | None:
    """The payload that a file's coefficients hold; None for a file that says nothing of one, or is not of our shape."""
    if len(im.comment) < 8 or [c[1:3] for c in im.comps] != [(2, 2), (1, 1), (1, 1)]:
        return None
    size = struct.unpack(">Q", im.comment[:8])[0]
    if size > coef.size:
        return None
    order = coef[block_places(*im.units)]
    return BYTE[np.clip(order.ravel()[:size], -128, 128) + 128].tobytes()


def tensor(im: Image, coef: np.ndarray) -> np.ndarray:
    """(height, width, 3) RGB samples: inverse transform, chroma upsampling, colour conversion."""
    planes = []
    for (_, h, v, q), (high, wide), a, b in zip(im.comps, im.shape, im.first, im.first[1:]):
        x = (coef[a:b] * im.quant.get(q, np.ones(64, np.int32))).astype(np.float32) @ INVERSE
        x = x.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8)
        x = np.repeat(np.repeat(x, im.v // v, axis=0), im.h // h, axis=1)
        planes.append(np.clip(x[: im.height, : im.width] + 128, 0, 255))
    if len(planes) == 1:
        return np.repeat(np.rint(planes[0])[:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)), 0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[np.ndarray | None]:
    """RGB tensors of progressive JPEG files; None for what is none."""
    return [tensor(*x) if x else None for x in read(files)]


def decoded(media: DataFrame, column: str, names: tuple[str, str, str] = ("height", "width", "rgb")) -> DataFrame:
    """media with the height, width and full-resolution RGB bytes (row by row) of the JPEG column."""
    C.ship(media.sparkSession)
    i = media.columns.index(column)

    def make(b: pa.RecordBatch) -> list:
        rows = b.column(i).to_pylist()
        out = decode([r or b"" for r in rows])
        return [pa.array([None if t is None else t.shape[0] for t in out], pa.int32()), pa.array([None if t is None else t.shape[1] for t in out], pa.int32()), pa.array([None if t is None else t.tobytes() for t in out], pa.binary())]

    return C.append_columns(media, f"`{names[0]}` int, `{names[1]}` int, `{names[2]}` binary", make)


def feature(rgb: np.ndarray) -> str:
    """Mean of each channel, and their spread, to two places, from counts of the samples' values."""
    flat, v = rgb.reshape(-1, 3), np.arange(256)
    n = np.stack([np.bincount(flat[:, c], minlength=256) for c in range(3)])
    mean = (n * v).sum(axis=1) / len(flat)
    spread = np.sqrt(np.maximum((n * v * v).sum(axis=1) / len(flat) - mean**2, 0))
    return ",".join(f"{x:.2f}" for x in (*mean, *spread))


#: Bytes of payload or of files that are coded together.
TOGETHER = 1_000_000


def stored(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes and media of every text: the payload as a progressive JPEG, written to the shared folder and read
    from there. A text's payload is its UTF-8 with zero bytes up to a positive multiple of 64; null is the empty text."""
    C.ship(docs.sparkSession)
    rows = docs.select(key, text)

    def make(b: pa.RecordBatch) -> list:
        data, off = C.text_bytes(b.column(1))
        files: list[bytes] = []
        for i, j in C.chunks(off, TOGETHER):
            texts = [data[off[r] : off[r + 1]].tobytes() for r in range(i, j)]
            files += encode([t + bytes(max(1, -(-len(t) // UNIT)) * UNIT - len(t)) for t in texts])
        return [pa.array(np.diff(off)), pa.array(files, pa.binary())]

    return C.written(C.append_columns(rows, "n_bytes long, media binary", make).drop(text), "media", "zstd")  # restart markers make up a tenth of the bytes


def read_back(media: DataFrame) -> DataFrame:
    """media (with a column media) and what its files hold: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, the feature of the RGB tensor, height and width; null where a file is none of ours."""
    C.ship(media.sparkSession)
    i = media.columns.index("media")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def make(b: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in kinds]
        raw, off = C.text_bytes(b.column(i))
        for lo, hi in C.chunks(off, TOGETHER):
            files = [raw[off[r] : off[r + 1]].tobytes() for r in range(lo, hi)]
            for f, found in zip(files, read(files)):
                row = [None] * len(kinds)
                p = payload_of(*found) if found else None
                if p is not None:
                    t = tensor(*found)
                    row = [len(p), hashlib.sha256(p).hexdigest(), C.crc(p[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), feature(t), t.shape[0], t.shape[1]]
                for o, v in zip(out, row):
                    o.append(v)
        return [pa.array(o, k) for o, k in zip(out, kinds)]

    return C.append_columns(media, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int", make)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a progressive JPEG in a stored media column, read back from there."""
    return read_back(stored(C.read(spark, sf_dir, "documents"), "doc_id", "text")).drop("media")
