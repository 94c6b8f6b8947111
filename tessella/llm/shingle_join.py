"""Near-duplicate join: documents whose sets of 5-word shingles have a Jaccard similarity of at least 3/4.

Method: signature trees. A document's set has a bitmap signature; nodes over signatures hold the OR of the bitmaps
below and the range of set sizes. Two nodes are followed only if their sizes can meet the threshold and the largest
overlap that their bitmaps allow reaches what the threshold asks of their smallest sets.

So that no tree spans the corpus, sets are first dealt to blocks by an exact prefix rule: two linked sets share one
of the first n - ceil(3n/4) + 1 shingles of each, in one order for all. The order is by how often a shingle's hash
slot occurs in the whole corpus (a table of fixed size), so common passages come last and blocks stay small. Equal
sets are one class and equal blocks one block. In each block the tree yields candidate pairs, in rounds: first a star
from one member in the first blocks of each class, so that a large group of copies costs one pair a member; then, in
blocks that still hold more than one component, all pairs of different components, the most alike first. A class knows
its first blocks, and a pair that these show to meet in an earlier block is left to that.

Pairs are tested where they meet. First the trees run on bitmaps alone, and only members of a pair that the bitmaps
allow come to their block again with their sets, as gaps between shortened hashes, two bytes a shingle. What two such
sets have in common bounds the overlap from above, and short of a margin for hashes that agree by chance it is the
overlap. Pairs between the two bounds are few: their sets are intersected at 48 bits. Sets are made from texts that
pass a filter of fixed size, so no set is moved for each pair that it is in and no round moves the corpus.

Defined results: words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; fewer than five words are one
shingle; null, empty and blank texts have no shingle and are linked with nothing, not even each other. Repeated ids
share what their rows have. Rows with a null id take part; a component is named by its smallest id, null if it has
none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 5
NUM, DEN = 3, 4
#: Bits of a signature, hash slots of the corpus order, and members that one task compares at once.
BITS = 2048
SLOTS = 1 << 18
MEMBERS = 1024
SPINE = 64
LEAF = 16
#: Blocks that a class knows itself to be in, and of these the first ones in which stars are tried.
KNOWN = 8
STARS = 2
#: Bits of a shortened hash beyond those that number a set's members.
MORE = 14
#: Bits of the filter that texts to verify pass.
FILTER = 1 << 26


def shingle_sets(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for i, j in C.chunks(off):
        h, at = C.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        if len(h) >= WIDTH:
            m = len(h) - WIDTH + 1
            s = h[:m] * C.STEP[0]
            for k in range(1, WIDTH):
                s = s + h[k : m + k] * C.STEP[k]
            s = C.mix(s)
        else:
            s = h
        for r in range(j - i):
            a, b = at[r], at[r + 1]
            if b - a >= WIDTH:
                yield i + r, np.unique(s[a : b - WIDTH + 1])
            elif b > a:
                yield i + r, C.mix((h[a:b] * C.STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield i + r, s[:0]


def signature(s: np.ndarray) -> np.ndarray:
    """A set's bitmap: the bit of each hash's first 11 bits."""
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> np.uint64(64 - 11)).astype(np.int64)] = 1
    return np.packbits(bits)


def width_of(n: int) -> int:
    return MORE + max(1, int(n - 1).bit_length())


def gaps(s: np.ndarray) -> bytes:
    """A sorted set as gaps between its shortened hashes, in two bytes each; 65535 stands for as many and goes on."""
    x = np.unique((s >> np.uint64(64 - width_of(len(s)))).astype(np.int64))
    gap = np.diff(x, prepend=-1) - 1
    more = gap // 65535
    out = np.full(int(more.sum()) + len(gap), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = gap - 65535 * more
    return out.tobytes()


def from_gaps(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortened hashes of many sets, and their offsets. raw: all gaps; at: the sets' offsets in them."""
    last = raw != 65535
    run = np.concatenate(([0], np.cumsum(raw.astype(np.int64) + last)))
    ends = np.concatenate(([0], np.cumsum(last)))[at]
    x = run[1:][last] - np.repeat(run[at[:-1]], np.diff(ends)) - 1
    return x, ends


def class_of(s: np.ndarray) -> int:
    """One number for equal sets."""
    return int(C.mix(C.mix(s + C.STEP[7]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


CLASSES = "id long, tx long, n long, cls long, slot int, counts binary"


def classify(labels: np.ndarray):
    """Arrow function over (id, tx, text): a row for each document, and how often each slot of the order occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int64)
        for b in batches:
            data, off = C.text_bytes(b.column(2))
            n, cls = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for r, s in shingle_sets(data, off):
                n[r] = len(s)
                if len(s):
                    cls[r] = class_of(s)
                    slots[(s >> np.uint64(64 - 18)).astype(np.int64)] += 1
            none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(cls), *none], names=["id", "tx", "n", "cls", "slot", "counts"])
        part, k = np.array_split(slots, len(labels)), len(labels)
        packed = [x.astype(np.int32 if slots.max() < 2**31 else np.int64).tobytes() for x in part]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 4, pa.array(labels.astype(np.int32)), pa.array(packed, pa.binary())], names=["id", "tx", "n", "cls", "slot", "counts"])

    return run


def add_counts(sizes: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, np.int32 if len(raw) == 4 * sizes[slot] else np.int64)
                total[slot] = total.get(slot, 0) + x.astype(np.int64)
        for slot, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slot", "counts"])

    return run


def deal(slots, labels: np.ndarray):
    """Arrow function over (text): each set's prefix, dealt to buckets; one row for each bucket and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        order = slots.value
        for b in batches:
            data, off = C.text_bytes(b.column(0))
            keys, cls, size = [], [], []
            for _, s in shingle_sets(data, off):
                n = len(s)
                if not n or (c := class_of(s)) in done:
                    continue
                done.add(c)
                p = n - -(-NUM * n // DEN) + 1
                count = order[(s >> np.uint64(64 - 18)).astype(np.int64)]
                keys.append(s[np.lexsort((s, count))[:p]] if p < n else s)
                cls.append(c)
                size.append(n)
            if not keys:
                continue
            lens = np.array([len(x) for x in keys])
            key = np.concatenate(keys)
            row = np.repeat(np.arange(len(keys)), lens)
            bucket = (C.mix(key) % np.uint64(len(labels))).astype(np.int64)
            by = np.lexsort((row, bucket))
            key, row, bucket = key[by], row[by], bucket[by]
            cut = np.searchsorted(bucket, np.arange(len(labels) + 1))
            cls, size = np.array(cls, np.int64), np.array(size, np.int32)
            out = [[], [], [], [], []]
            for k in np.flatnonzero(np.diff(cut)):
                rows, runs = np.unique(row[cut[k] : cut[k + 1]], return_counts=True)
                for o, v in zip(out, (labels[k], key[cut[k] : cut[k + 1]].tobytes(), cls[rows].tobytes(), small(size[rows]), small(runs))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(o, pa.binary()) for o in out[1:]]], names=["bucket", "keys", "cls", "sizes", "runs"])

    return run


def small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return x.astype(next(t for t in (np.uint8, np.uint16, np.int64) if x.max(initial=0) <= np.iinfo(t).max)).tobytes()


def unsmall(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 8: np.int64}[len(raw) // n]).astype(np.int64)


DEALT = "bucket int, keys binary, cls binary, sizes binary, runs binary"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From dealt prefixes to blocks: classes that share a prefix shingle and whose sizes may meet the threshold."""
    held: dict[int, list] = {}
    for b in batches:
        for k, *x in zip(*[b.column(i).to_pylist() for i in range(5)]):
            held.setdefault(k, []).append(x)
    seen: set[int] = set()
    for k in list(held):
        rows = held.pop(k)
        key = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        runs = np.concatenate([unsmall(r[3], len(r[1]) // 8) for r in rows])
        cls = np.repeat(np.concatenate([np.frombuffer(r[1], np.int64) for r in rows]), runs)
        size = np.repeat(np.concatenate([unsmall(r[2], len(r[1]) // 8) for r in rows]), runs)
        by = np.argsort(key, kind="stable")
        twice = key[by][1:] == key[by][:-1]
        some = np.zeros(len(key), bool)
        some[1:] |= twice
        some[:-1] |= twice
        by = by[some]  # shingles of one class alone, the most, are not sorted further
        by = by[np.lexsort((cls[by], size[by], key[by]))]
        key, cls, size = key[by], cls[by], size[by]
        if not len(key):
            continue
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, size = key[keep], cls[keep], size[keep]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (NUM * size[1:] > DEN * size[:-1])
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, len(key)))
        ident = C.mix(np.add.reduceat(C.mix(cls.view(np.uint64) + C.STEP[3]), start) + many.astype(np.uint64)).view(np.int64)
        start, many, ident = start[many > 1], many[many > 1], ident[many > 1]
        _, first = np.unique(ident, return_index=True)
        first = np.array([f for f in first if int(ident[f]) not in seen], np.int64)
        seen.update(map(int, ident[first]))
        if len(first):
            at = np.repeat(start[first] - np.concatenate(([0], np.cumsum(many[first])[:-1])), many[first]) + np.arange(many[first].sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ident[first], many[first])), pa.array(cls[at]), pa.array(size[at])], names=["block", "cls", "n"])


class Tree:
    """Signatures of one block under nodes of LEAF and then LEAF children, with size ranges and OR-combined bitmaps."""

    def __init__(self, size: np.ndarray, bits: np.ndarray):
        count = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.order = np.lexsort((bits[:, 0], count, size))
        bits, size, spare = bits[self.order], size[self.order], (size - count)[self.order]
        self.levels = [(bits, size, size, spare)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, sp = self.levels[-1]
            cut = np.arange(0, len(lo), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(sp, cut)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of node pairs: whether some sets below may be linked, and the largest overlap their bitmaps allow."""
        bits, lo, hi, spare = self.levels[level]
        most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64) + np.minimum(spare[i], spare[j])
        most = np.minimum(most, np.minimum(hi[i], hi[j]))
        # overlap * (DEN + NUM) >= NUM * (|a| + |b|) is the threshold
        ok = (most * (DEN + NUM) >= NUM * (lo[i] + lo[j])) & (DEN * hi[i] >= NUM * lo[j]) & (DEN * hi[j] >= NUM * lo[i])
        return ok, most

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Member pairs that the dual traversal cannot rule out, with their largest possible overlap."""
        top = len(self.levels) - 1
        work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, i, j = work.pop()
            if len(i) > 4096:
                work += [(level, i[a : a + 4096], j[a : a + 4096]) for a in range(0, len(i), 4096)]
                continue
            ok, most = self.possible(level, i, j)
            i, j, most = i[ok], j[ok], most[ok]
            if not level:
                other = i != j
                if other.any():
                    yield self.order[i[other]], self.order[j[other]], most[other]
            elif len(i):
                n = len(self.levels[level - 1][1])
                c = np.arange(LEAF)
                ii = np.repeat(i * LEAF, LEAF * LEAF) + np.tile(np.repeat(c, LEAF), len(i))
                jj = np.repeat(j * LEAF, LEAF * LEAF) + np.tile(c, len(j) * LEAF)
                keep = (ii < n) & (jj < n) & (ii <= jj)
                work.append((level - 1, ii[keep], jj[keep]))


def star(size: np.ndarray, bits: np.ndarray, luck: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Centres, each with the members that may be linked to it, until every member was one or the other."""
    tree = Tree(size, bits)
    luck = luck[tree.order]
    free = np.ones(len(size), bool)
    every = np.arange(len(size))
    for c in np.argsort(luck, kind="stable"):
        if free[c]:
            free[c] = False
            at = every[free]
            if not len(at):
                return
            ok, _ = tree.possible(0, np.full(len(at), c), at)
            at = at[ok]
            free[at] = False
            if len(at):
                yield int(tree.order[c]), tree.order[at]


class Block:
    """Rows of one block after another (or parts of them): classes, set sizes, components, known blocks, bitmaps, and
    where they came with them sets."""

    def __init__(self, t: pa.Table):
        self.key, self.part, self.cls, self.size, self.root = (t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(5))
        known = t.column(5).combine_chunks()
        n = np.asarray(known.value_lengths())
        self.known = np.full((len(n), KNOWN), np.iinfo(np.int64).max)
        self.known[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(known.flatten())
        self.bits = np.frombuffer(C.text_bytes(t.column(6))[0].tobytes(), np.uint64).reshape(len(self.key), -1)
        if t.num_columns > 7:
            raw, off = C.text_bytes(t.column(7))
            self.x, self.at = from_gaps(np.frombuffer(raw.tobytes(), np.uint16), off // 2)
            self.width = np.array([width_of(n) for n in self.size.tolist()], np.int64)

    def here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs are not known to meet in an earlier block."""
        ok = np.ones(len(i), bool)
        for lo in range(0, len(i), 1 << 14):
            a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            x, y = self.known[a], self.known[b]
            same = (x[:, :, None] == y[:, None, :]) & (x < self.key[a][:, None])[:, :, None]
            ok[lo : lo + (1 << 14)] = ~same.any(axis=(1, 2))
        return ok

    def linked(self, i: int, j: int) -> bool | None:
        """Whether two sets are linked; None where shortened hashes cannot tell."""
        if self.width[i] > self.width[j]:
            i, j = j, i
        x, y = self.x[self.at[i] : self.at[i + 1]], self.x[self.at[j] : self.at[j + 1]]
        n, m = int(self.size[i]), int(self.size[j])
        spare = min(n - len(x), m - len(y))
        if self.width[i] < self.width[j]:
            y = y >> (self.width[j] - self.width[i])
            y = y[np.concatenate(([True], y[1:] != y[:-1]))]
            spare = min(n - len(x), m - len(y))
        common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        need = -(-NUM * (n + m) // (DEN + NUM))
        if common + spare < need:
            return False
        # hashes of different shingles that agree: a Poisson count, of which this is the far tail
        chance = max(m - common, n - common, 0) * len(x) / 2.0 ** int(self.width[i])
        return True if common - 4 - int(np.ceil(chance + 8 * np.sqrt(chance))) >= need else None

    def star(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.full(len(at), c), at) for c, at in star(self.size[s], self.bits[s], C.mix(self.cls[s].view(np.uint64)))]
        i, j = (np.concatenate([f[k] for f in found]) + s.start if found else np.zeros(0, np.int64) for k in (0, 1))
        ok = self.here(i, j)
        return i[ok], j[ok]

    def rest(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different components, the most alike first."""
        i, j, fit = [], [], []
        for x, y, most in Tree(self.size[s], self.bits[s]).pairs():
            x, y = x + s.start, y + s.start
            ok = self.root[x] != self.root[y]
            ok[ok] = self.here(x[ok], y[ok])
            i.append(x[ok])
            j.append(y[ok])
            fit.append(most[ok] / (self.size[x[ok]] + self.size[y[ok]]))
        i, j, fit = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j, fit))
        by = np.lexsort((self.cls[j], self.cls[i], -fit))
        return i[by], j[by]

    def two(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of blocks of two members, as most are, that begin at these rows."""
        count = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        p, q = at, at + 1
        most = np.bitwise_count(self.bits[p] & self.bits[q]).sum(axis=1) + np.minimum(self.size[p] - count[p], self.size[q] - count[q])
        ok = (most * (DEN + NUM) >= NUM * (self.size[p] + self.size[q])) & (self.root[p] != self.root[q])
        ok[ok] = self.here(p[ok], q[ok])
        return p[ok], q[ok]

    def pairs(self, stars: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs to test, a block after another: stars, or all of different components."""
        cut = np.flatnonzero((self.key[1:] != self.key[:-1]) | (self.part[1:] != self.part[:-1])) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(self.key)]))
        yield self.two(lo[hi - lo == 2])
        for k in np.flatnonzero(hi - lo > 2):
            s = slice(int(lo[k]), int(hi[k]))
            if (self.root[s] != self.root[s.start]).any():
                yield self.star(s) if stars else self.rest(s)

    def tested(self, stars: bool) -> list[tuple[int, int, bool | None]]:
        """Links and undecided pairs; what a link joins is one component for the block's pairs after it."""
        out = []
        for i, j in self.pairs(stars):
            up: dict[int, int] = {}
            for a, b in zip(i.tolist(), j.tolist()):
                x, y = int(self.root[a]), int(self.root[b])
                while x in up:
                    x = up[x]
                while y in up:
                    y = up[y]
                if x != y and (link := self.linked(a, b)) is not False:
                    out.append((a, b, link))
                    if link:
                        up[max(x, y)] = min(x, y)
        return out


MET = "block long, part int, cls long"
FOUND = "a long, b long, link boolean"


def by_block(work):
    """Arrow function over rows sorted by (block, part): work on whole blocks, as many as come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            key, part = rest.column(0).to_numpy(), rest.column(1).to_numpy()
            if len(key) and (key[0] != key[-1] or part[0] != part[-1]):
                at = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1
                yield from work(Block(rest.slice(0, at)))
                rest = rest.slice(at)
        if rest is not None and rest.num_rows:
            yield from work(Block(rest))

    return C.lean(run)


def allowed(stars: bool):
    """Rows (block, part, cls) that are in a pair which the bitmaps allow."""

    def work(x: Block) -> Iterator[pa.RecordBatch]:
        at = [np.unique(np.concatenate(p)) for p in x.pairs(stars) if len(p[0])]
        if at:
            rows = np.unique(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([pa.array(x.key[rows]), pa.array(x.part[rows].astype(np.int32)), pa.array(x.cls[rows])], names=["block", "part", "cls"])

    return by_block(work)


def traverse(stars: bool):
    """Links, and pairs that need their whole sets (null), among rows with sets."""

    def work(x: Block) -> Iterator[pa.RecordBatch]:
        if told := x.tested(stars):
            i, j, link = zip(*told)
            a, b = x.cls[list(i)], x.cls[list(j)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(link, pa.bool_())], names=["a", "b", "link"])

    return by_block(work)


def of_sets(name: str, form):
    """Arrow function over (text): each class with its set in a form, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = C.text_bytes(b.column(0))
            found = {class_of(s): form(s) for _, s in shingle_sets(data, off) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["cls", name])

    return run


def six_bytes(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // 6, 8), np.uint8)
    x[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return x.view(np.uint64)[:, 0]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function over (a, b, set of a, set of b): whether each pair is a link."""
    for t in batches:
        ok = np.zeros(t.num_rows, bool)
        left, last = None, None
        for i in range(t.num_rows):
            a, b = t.column(2)[i].as_py(), t.column(3)[i].as_py()
            if a != last:
                left, last = unpacked(a), a
            right = unpacked(b)
            both = np.concatenate((left, right))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok[i] = DEN * common >= NUM * (len(both) - common)
        yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(ok)], names=["a", "b", "link"])


def passing(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """docs whose tx may be among hashes' (column tx): a bitmap of FILTER bits, whatever the number of hashes."""
    place = lambda c: F.pmod(F.col(c), F.lit(FILTER))
    maps = hashes.groupBy(F.bitmap_bucket_number(place("tx")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("tx"))).alias("map"))
    at = F.bitmap_bit_position(place("tx"))
    byte = F.conv(F.hex(F.substring("map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.withColumn("bucket", F.bitmap_bucket_number(place("tx"))).join(F.broadcast(maps), "bucket")
    return near.where(F.expr("1") == F.getbit(byte, F.pmod(at, F.lit(8)).cast("int"))).select(*docs.columns)


def exact(pairs: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """The links among pairs of classes, by their whole sets. named: cls and tx of a text of each class."""
    need = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    hashes = C.written(named.join(need, "cls", "left_semi").select("tx"), "needed")
    sets = C.written(passing(docs, hashes).select("text").mapInArrow(C.lean(of_sets("s", six_bytes)), "cls long, s binary").join(need, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a")
    two = left.join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    return C.written(two.mapInArrow(C.lean(verified), "a long, b long, link boolean").where("link").select("a", "b"), "links")


def grown(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b)."""
    if roots is None:
        return C.written(C.components(links), "roots")
    up = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    at = links.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    more = C.written(C.components(at), "roots")
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return C.written(moved.unionByName(more.join(roots, "node", "left_anti")), "roots")


def counted(spark: SparkSession, both: DataFrame, cells: np.ndarray) -> np.ndarray:
    """The corpus-wide counts of all slots: a table of fixed size, each part of it added up by one task."""
    lens = {int(k): len(x) for k, x in zip(cells, np.array_split(np.zeros(SLOTS), len(cells)))}
    rows = both.where("counts is not null").select("slot", "counts").repartition(len(cells), "slot").mapInArrow(add_counts(lens), "slot int, counts binary").collect()
    found = {r[0]: np.frombuffer(r[1], np.int64) for r in rows}
    return np.concatenate([found.get(int(k), np.zeros(lens[int(k)], np.int64)) for k in cells])


def met(docs: DataFrame, order: np.ndarray, n: int) -> DataFrame:
    """(block, cls, n): classes by the blocks in which they meet others."""
    spark = docs.sparkSession
    slots = spark.sparkContext.broadcast(order.astype(np.float32))
    dealt = docs.select("text").mapInArrow(C.lean(deal(slots, C.labels(spark, n))), DEALT).repartition(n, "bucket")
    return C.written(dealt.mapInArrow(C.lean(blocks), "block long, cls long, n long").dropDuplicates(["block", "cls"]), "members")


def parted(rows: DataFrame, big: DataFrame | None, stars: bool) -> DataFrame:
    """Rows with a part of their block. Blocks too large for a task (big) are dealt in parts by hash: for stars each with
    the same few members besides, so that stars meet; else by pairs of parts."""
    if big is None:
        return rows.withColumn("part", F.lit(0))
    luck = F.pmod(F.xxhash64("cls"), F.lit(1_000_003))
    split = F.ceil(F.col("count") / MEMBERS).cast("int")
    part = F.pmod(luck, split).cast("int")
    if stars:
        spine = luck < F.lit(1_000_003 * SPINE) / F.col("count")
        ps = F.when(spine, F.sequence(F.lit(0), split - 1)).otherwise(F.array(part))
    else:
        ps = F.transform(F.sequence(F.lit(0), split - 1), lambda k: F.least(k, part) * 100_000 + F.greatest(k, part))
    return rows.join(big, "block", "left").withColumn("part", F.explode(F.coalesce(ps, F.array(F.lit(0))))).drop("count")


def found(rows: DataFrame, info: DataFrame, docs: DataFrame, big: DataFrame | None, stars: bool, n: int) -> DataFrame:
    """Links and undecided pairs among rows (block, cls, n, root). info: cls, tx, bits and known blocks of the classes."""
    rows = parted(rows, big, stars)
    together = lambda df: df.repartition(n, "block", "part").sortWithinPartitions("block", "part")
    own = ["block", "part", "cls", "n", "root", "known", "bits"]
    wide = rows.join(info.select("cls", "known", "bits"), "cls").select(*own)
    some = C.written(together(wide).mapInArrow(allowed(stars), MET), "allowed")
    need = C.written(info.join(some.select("cls").distinct(), "cls", "left_semi"), "needed")
    C.free(info.sparkSession)
    short = passing(docs, need.select("tx")).select("text").mapInArrow(C.lean(of_sets("sig", gaps)), "cls long, sig binary")
    sets = need.select("cls", "known", "bits").join(short, "cls").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("known", "bits", "sig")])
    again = some.join(rows, ["block", "part", "cls"]).join(sets, "cls").select(*own, "sig")
    return C.written(together(again).mapInArrow(traverse(stars), FOUND).distinct(), "found")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row of docs."""
    spark: SparkSession = docs.sparkSession
    C.ship(spark)
    n = C.parts(spark)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tx"), F.col(text).alias("text"))
    cells = C.labels(spark, min(n, 64))
    both = C.written(docs.mapInArrow(C.lean(classify(cells)), CLASSES), "classes")
    every = both.where("counts is null").select("id", "tx", "n", "cls")
    members = met(docs, counted(spark, both, cells), n)
    C.free(spark)
    # classes that meet others: the first blocks that they are in, a text of each, and its bitmap
    known = C.written(members.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("block")), 1, KNOWN).alias("known")), "known")
    named = C.written(every.where("n > 0").join(known.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min("tx").alias("tx")), "named")
    bits = passing(docs, named.select("tx")).select("text").mapInArrow(C.lean(of_sets("bits", lambda s: signature(s).tobytes())), "cls long, bits binary")
    info = C.written(known.join(named, "cls").join(bits.groupBy("cls").agg(F.first("bits").alias("bits")), "cls"), "info")
    C.free(spark)
    big = members.groupBy("block").count().where(F.col("count") > MEMBERS)
    big = big if big.limit(1).count() else None
    early = known.select("cls", F.explode(F.slice("known", 1, STARS)).alias("block"))
    rows = members.join(early, ["cls", "block"]).withColumn("root", F.col("cls"))
    first = found(rows, info, docs, big, True, n)
    C.free(spark)
    roots = grown(None, first.where("link").select("a", "b"))
    # of the others only blocks of more than one component are left
    rows = C.written(members.join(roots, members["cls"] == roots["node"], "left").select("block", "cls", "n", F.coalesce("root", "cls").alias("root")), "rooted")
    live = rows.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    second = found(rows.join(live.select("block"), "block", "left_semi"), info, docs, big, False, n)
    C.free(spark)
    roots = grown(roots, second.where("link").select("a", "b"))
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    left = first.where("link is null").unionByName(second.where("link is null")).select("a", "b").distinct()
    left = left.join(root("a"), "a", "left").join(root("b"), "b", "left").where("not coalesce(a_root, a) <=> coalesce(b_root, b)")
    left = C.written(left.select("a", "b"), "undecided")
    roots = grown(roots, exact(left, docs, info.select("cls", "tx")))
    own = every.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    # a group is a component's root, or for sets that meet no other the class; without shingles the row is its own
    own = C.written(own.select("id", "n", F.coalesce("root", F.when(F.col("n") > 0, F.col("cls"))).alias("g")), "owned")
    least = own.where("g is not null").groupBy("g").agg(F.min("id").alias("component_id"))
    some = own.where("g is not null").join(least, "g").select("id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(own.where("g is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component."""
    return components(C.read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document of smallest id of each component stays; rows without an id stay as they are."""
    name = C.fresh(docs, "sj_id")
    later = components(docs).where("id <> component_id").select(F.col("id").alias(name)).distinct()
    return docs.join(later, docs["doc_id"] == later[name], "left_anti")
