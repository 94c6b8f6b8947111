"""Token ids as a wavelet matrix per shard: one compressed file with access, counting and occurrence lookup.

A shard's ids are split bit by bit, highest first: each plane holds one bit of every id, in the order in which the
planes above have stably sorted the ids. rank on the planes walks an id down, select walks a position back up.
Planes are cut into blocks with the number of ones before each, and every block is compressed on its own, so a
lookup reads one block a plane. Bulk reading undoes the sorts plane by plane.

File: magic, length and JSON header, then document ids, document ends, and for each plane its directory and blocks.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from . import common as C

MAGIC = b"TWM1"
BLOCK = 1 << 18  # bits
#: Ids of one shard at most, but for a single longer document.
SHARD = 6_000_000
#: Blocks of a shard that stay unpacked between lookups, 48 KB each.
KEPT = 256
END = 0


def dump(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, nulls: int = 0) -> bytes:
    """A shard's file. ends: offset of the end of each document's ids; nulls: documents at its head that have no id."""
    n, levels = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1)
    body: list[bytes] = []
    at = 0

    def put(raw: bytes) -> tuple[int, int]:
        nonlocal at
        body.append(raw)
        at += len(raw)
        return at - len(raw), len(raw)

    head: dict = {"n": n, "levels": levels, "docs": len(doc_ids), "nulls": nulls, "block": BLOCK}
    head["doc_ids"] = put(pack.compress(np.diff(doc_ids.astype(np.int64), prepend=0).tobytes()))
    head["ends"] = put(pack.compress(ends.astype(np.int64).tobytes()))
    head["planes"] = []
    for k in range(levels - 1, -1, -1):
        one = (a >> k) & 1 != 0
        raw = np.packbits(one, bitorder="little").tobytes()
        cuts = range(0, len(raw), BLOCK // 8)
        blocks = [put(pack.compress(raw[c : c + BLOCK // 8])) for c in cuts]
        ones = np.add.reduceat(one, np.arange(0, n, BLOCK), dtype=np.int64) if n else np.zeros(0, np.int64)
        rank = [0, *np.cumsum(ones).tolist()]
        head["planes"].append({"zeros": n - rank[-1], "rank": rank, "blocks": blocks})
        a = np.concatenate((a[~one], a[one]))
    raw = zstandard.ZstdCompressor(level=3).compress(json.dumps(head).encode())
    return MAGIC + struct.pack("<Q", len(raw)) + raw + b"".join(body)


class Wavelet:
    """A shard's file, opened from bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<Q", raw[4:12])[0]
        self.unpack = zstandard.ZstdDecompressor()
        self.head = json.loads(self.unpack.decompress(raw[12 : 12 + size]))
        self.raw, self.base = memoryview(raw), 12 + size
        self.n, self.levels = self.head["n"], self.head["levels"]
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # the last used last

    def _part(self, where: list[int]) -> bytes:
        return self.unpack.decompress(self.raw[self.base + where[0] : self.base + where[0] + where[1]])

    def nulls(self) -> int:
        """Documents at the head that have no id; doc_ids has 0 for them."""
        return self.head["nulls"]

    def doc_ids(self) -> np.ndarray:
        return np.cumsum(np.frombuffer(self._part(self.head["doc_ids"]), np.int64))

    def ends(self) -> np.ndarray:
        return np.frombuffer(self._part(self.head["ends"]), np.int64)

    def _block(self, level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits as 64-bit words, and its ones before each word; the KEPT blocks last used stay unpacked."""
        if (level, b) not in self.kept:
            raw = self._part(self.head["planes"][level]["blocks"][b])
            words = np.frombuffer(raw + bytes(-len(raw) % 8), "<u8")
            before = np.zeros(len(words) + 1, np.uint32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            while len(self.kept) >= KEPT:
                self.kept.pop(next(iter(self.kept)))
            self.kept[level, b] = words, before
        else:
            self.kept[level, b] = self.kept.pop((level, b))
        return self.kept[level, b]

    def _ranks(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits of a plane, for each i."""
        rank, size = self.head["planes"][level]["rank"], self.head["block"]
        out = np.array(rank, np.int64)[i // size]
        inner = np.flatnonzero(i % size)
        if len(inner):
            by = inner[np.argsort(i[inner] // size, kind="stable")]
            cut = np.flatnonzero(np.diff(i[by] // size)) + 1
            for at in np.split(by, cut):
                words, before = self._block(level, int(i[at[0]] // size))
                place = i[at] % size
                w = np.minimum(place >> 6, len(words) - 1)
                # place may be the end of the last word
                mask = np.where(place >> 6 > w, ~np.uint64(0), (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
                out[at] += before[w] + np.bitwise_count(words[w] & mask)
        return out

    def _rank(self, level: int, i: int) -> int:
        return int(self._ranks(level, np.array([i]))[0])

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this kind in a plane."""
        size = self.head["block"]
        ones = np.array(self.head["planes"][level]["rank"])
        have = ones if bit else np.minimum(np.arange(len(ones)) * size, self.n) - ones
        b = int(np.searchsorted(have, k, "right")) - 1
        words, before = self._block(level, b)
        inside = before if bit else np.arange(len(before)) * 64 - before.astype(np.int64)
        w = int(np.searchsorted(inside, k - have[b], "right")) - 1
        bits = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little")
        return b * size + w * 64 + int(np.flatnonzero(bits == bit)[k - have[b] - inside[w]])

    def accesses(self, i: np.ndarray) -> np.ndarray:
        """The ids at these positions."""
        i, x = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level in range(self.levels):
            ones = self._ranks(level, i)
            bit = self._ranks(level, i + 1) - ones
            i = np.where(bit > 0, self.head["planes"][level]["zeros"] + ones, i - ones)
            x = x << 1 | bit
        return x

    def counts(self, tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often each token occurs among its positions lo to hi."""
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        for level in range(self.levels):
            a, b = self._ranks(level, lo), self._ranks(level, hi)
            zeros = self.head["planes"][level]["zeros"]
            one = tokens >> (self.levels - 1 - level) & 1 > 0
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return np.where(tokens >> self.levels > 0, 0, hi - lo)

    def access(self, i: int) -> int:
        """The id at position i."""
        return int(self.accesses(np.array([i]))[0])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a token among positions lo to hi end up below the last plane."""
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank(level, lo), self._rank(level, hi)
            zeros = self.head["planes"][level]["zeros"]
            lo, hi = (zeros + a, zeros + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token occurs among positions lo to hi."""
        hi = self.n if hi is None else max(0, min(hi, self.n))
        a, b = self._range(token, min(max(lo, 0), hi), hi)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of a token's k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.head["planes"][level]["zeros"] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order."""
        v = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            p = self.head["planes"][level]
            bits = np.unpackbits(np.frombuffer(b"".join(map(self._part, p["blocks"])), np.uint8), bitorder="little", count=self.n).view(bool)
            up = np.empty_like(v)
            up[~bits] = v[: p["zeros"]]
            up[bits] = v[p["zeros"] :] | v.dtype.type(1 << (self.levels - 1 - level))
            v = up
        return v


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def writer(folder: str, tokenizer: str, name: str):
    """Arrow function over (key, text) in order of key: writes shards and returns a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(tokenizer or bpe.public(name))
        part, shard = TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        none: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, shard
            key, size = np.concatenate(keys), np.concatenate(lens)
            raw = dump(np.concatenate(parts), key, np.cumsum(size), sum(none))
            store, path = filesystem(folder)
            store.create_dir(path, recursive=True)
            file, tmp = f"{path}/shard-{part:06d}-{shard:04d}.wm", f"{path}/.tmp-{uuid.uuid4().hex}"
            with store.open_output_stream(tmp) as out:
                out.write(raw)
            store.move(tmp, file)  # a task that runs again puts the same bytes in the same place
            row = [part, shard, file.rpartition("/")[2], len(key), int(size.sum()), len(raw)]
            keys.clear()
            parts.clear()
            lens.clear()
            none.clear()
            held, shard = 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "shard", "file", "docs", "ids", "bytes"])

        for b in batches:
            data, off = C.text_bytes(b.column(1))
            known = np.asarray(b.column(0).is_valid())
            key = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in C.chunks(off):
                ids, at = enc.chunk(data[off[i] : off[j]], off[i : j + 1] - off[i])
                keys.append(key[i:j])
                lens.append(np.diff(at) + 1)
                none.append(int((~known[i:j]).sum()))
                parts.append(np.insert(ids, at[1:], END).astype(np.int32))
                held += len(parts[-1])
                if held >= SHARD:
                    yield flush()
        if keys:
            yield flush()

    return C.lean(run)


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def reader(folder: str, lookups: bool):
    """Arrow function over (file, start): a row for each document of the shards. lookups: also by access and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_stream(f"{path}/{file}") as f:
                    w = Wavelet(f.read())
                ids, ends = w.ids().astype("<u4"), w.ends()
                begin = np.concatenate(([0], ends[:-1]))
                sums = [C.crc(ids[x:y]) for x, y in zip(begin.tolist(), ends.tolist())]
                cols = {"doc_id": pa.array(w.doc_ids(), mask=np.arange(len(ends)) < w.nulls()), "start": pa.array(begin + start), "n_tokens": pa.array(ends - begin), "ids_crc32": pa.array(sums, pa.int64())}
                if lookups:
                    first = w.accesses(begin)
                    cols |= {"first_id": pa.array(first), "n_first": pa.array(w.counts(first, begin, ends))}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return C.lean(run)


def write(docs: DataFrame, key: str, text: str, tokenizer: str | None = None, name: str = "byte_bpe_50k.json") -> tuple[str, DataFrame]:
    """Write all ids in ascending order of key: the folder, and a row for each shard with the ids before it.

    Null texts are empty; every document ends with id 0; rows with equal keys stay next to each other, in any order
    among themselves; rows with a null key come first and are returned with a null key; an empty table gives no shard and no rows.
    """
    spark: SparkSession = docs.sparkSession
    C.ship(spark)
    folder = f"{C.shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange(C.parts(spark), "k").sortWithinPartitions("k")
    meta = C.written(ordered.mapInArrow(writer(folder, tokenizer, name), "part long, shard long, file string, docs long, ids long, bytes long"), "shards")
    # ids before a shard: those of the parts before it, of which there are as many as tasks, and those before it in its part
    parts = meta.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("ids")
    return folder, meta.join(before, "part").select("file", (F.col("before") + own).alias("start"), "docs", "ids", "bytes")


def read_back(folder: str, shards: DataFrame, lookups: bool = False) -> DataFrame:
    """Of every document in the shards' files: doc_id, start, n_tokens and ids_crc32. lookups: also its first id, and how
    often that occurs in it, by access and rank."""
    n = C.parts(shards.sparkSession)
    return shards.select("file", "start").repartition(n).mapInArrow(reader(folder, lookups), ROWS + (", first_id long, n_first long" if lookups else ""))


def op10_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, from the shards' files."""
    return read_back(*write(C.read(spark, sf_dir, "documents"), "doc_id", "text"), lookups=True)
