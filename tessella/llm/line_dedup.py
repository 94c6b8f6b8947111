"""Line dedup: lines within one word's edit of an earlier line of the corpus are dropped; the earliest stays.

Method: a deletion-neighbourhood join. Two word sequences are one substitution apart if they are equal without the
word at one position, and one insertion apart if one is the other without a word. So lines emit their variants, the
line itself and the line without each of its words, as hashed keys; equal variants are joined, and what meets is
verified by comparing the lines' words. One edit leaves the first or the second half of a line as it is, so a first
pass joins only the hashes of lines and of their halves (also those of a line one word shorter): it finds exact
copies, of which the earliest stands for all, and the lines that share a half with another. Only these emit variants.

A line is a text's part between newlines; its words are [^\\x20\\x09-\\x0D]+, compared as they are. Lines are near
copies if one edit parts them and their similarity, 1 - 1 / (words of the longer), is SIMILARITY at least. Earliest
means the smallest document id, then the first line of the text.

A key that many lines share costs a batch two rows at most: what a batch can decide by itself it sends as decided,
to any task. Buckets are sorted and worked on one at a time, so a task's memory does not follow its partition.

Defined results: blank lines are neither compared nor dropped; null and empty texts have no lines and stay; rows
with a null id keep all their lines and drop no others; rows with equal ids are one document, whose decisions hold
by line number in each of them. A line counts as earlier whether or not it is dropped itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Similarity that near copies have at least; with one edit, lines of so many words can be near copies.
SIMILARITY = 0.75
WORDS = round(1 / (1 - SIMILARITY))
#: What a hash in the first pass is: a line's, a half's, or that of a line that its own batch has decided on.
OWN, HALF, COPY, SHARED = range(4)
CELL = "bucket int, sub int, key binary, doc binary, line binary"
KEYS = f"{CELL}, full binary, kind binary"
#: Packed variants, or one wanted line with its words.
VARIANTS = f"{CELL}, pos binary, d long, l int, words binary"
PAIRS = "doc long, line int, e_doc long, e_line int"


def line_words(data: np.ndarray, off: np.ndarray):
    """Words' places and hashes in order, and for each non-blank line: its row, number in the row, and range of words."""
    starts, ends, at = C.spans(~C.SPACE[data], off)
    h = C.span_hashes(data, starts, ends)
    nl = np.flatnonzero(data == 10)
    rows_nl = np.searchsorted(off, nl, "right") - 1
    # lines of all rows: each row opens one, each newline another
    before = np.searchsorted(nl, off[:-1])
    row = np.repeat(np.arange(len(off) - 1), np.bincount(rows_nl, minlength=len(off) - 1) + 1)
    first = np.searchsorted(row, np.arange(len(off) - 1))
    number = np.arange(len(row)) - first[row]
    begin = np.empty(len(row), np.int64)
    head = number == 0
    begin[head] = off[:-1]
    begin[~head] = nl[before[row[~head]] + number[~head] - 1] + 1
    lo = np.searchsorted(starts, begin)
    hi = np.append(lo[1:], len(starts))
    some = hi > lo
    return starts, ends, h, row[some], number[some], lo[some], hi[some]


def folded(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums by which any run of words is hashed, and the powers for it."""
    up, down = C.powers(len(h) + 1)
    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
    return s, up, down


class Lines:
    """Non-blank lines of a chunk: row, number, range and hash of their words, and the hashes of their halves."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.starts, self.ends, h, self.row, self.number, self.lo, self.hi = line_words(data, off)
        self.n = self.hi - self.lo
        self.s, _, self.down = folded(h)
        self.full = self.of(self.lo, self.hi)

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return C.mix((self.s[z] - self.s[a]) * self.down[a] + (z - a).astype(np.uint64))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these lines: which, and the key of a half.

        The length in a key is the shorter line's, so the halves of a line come twice: as they are, and as if the
        line had a word less, by which it meets lines that lack one of its words.
        """
        x = x[self.n[x] >= WORDS - 1]
        more = x[self.n[x] >= WORDS]
        half, less = self.lo + self.n // 2, self.lo + (self.n - 1) // 2
        rows, keys = [], []
        for side, fewer, r, cut in ((1, 0, x, half), (0, 0, x, half), (1, 1, more, less), (0, 1, more, less + 1)):
            a, z = (self.lo[r], cut[r]) if side else (cut[r], self.hi[r])
            rows.append(r)
            keys.append(C.mix(self.of(a, z) + (self.n[r] - fewer).astype(np.uint64) * C.STEP[9] + np.uint64(side)))
        return np.concatenate(rows), np.concatenate(keys)

    def variants(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these lines: which, the key of a variant, and the place of the word that it lacks (-1: none)."""
        more = x[self.n[x] >= WORDS]
        size = self.n[more]
        r = np.repeat(more, size)
        i = self.lo[r] + np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
        # words before the one left out, and those after it moved up by one place
        s, down = self.s, self.down
        key = (s[i] - s[self.lo[r]]) * down[self.lo[r]] + (s[self.hi[r]] - s[i + 1]) * down[self.lo[r]] * down[1]
        key = C.mix(key + (self.n[r] - 1).astype(np.uint64))
        return np.concatenate((x, r)), np.concatenate((self.full[x], key)), np.concatenate((np.full(len(x), -1), i - self.lo[r]))


class Cells:
    """Places that keys are dealt to: a label of the shuffle, and within it a cell that is worked on alone."""

    def __init__(self, spark: SparkSession):
        self.n = C.parts(spark)
        self.labels, self.subs = C.labels(spark, self.n), min(16, max(1, 800 // self.n))

    def deal(self, key: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        """A row for each cell, each column's values packed."""
        cell = (key % np.uint64(self.n * self.subs)).astype(np.int64)
        by = np.argsort(cell, kind="stable")
        cells, start = np.unique(cell[by], return_index=True)
        ends = np.append(start, len(by))
        packed = []
        for v in (key, *columns):
            raw = np.ascontiguousarray(v[by])
            packed.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cells), [None, pa.py_buffer((ends * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary()))
        place = [pa.array(self.labels[cells // self.subs].astype(np.int32)), pa.array((cells % self.subs).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*place, *packed], names=["bucket", "sub", *names])

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.n, "bucket").sortWithinPartitions("bucket", "sub")


def cells(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[list[np.ndarray]]:
    """The packed columns of one cell after another, unpacked."""
    held: list[pa.RecordBatch] = []
    at: tuple[int, int] | None = None

    def unpacked() -> list[np.ndarray]:
        return [np.concatenate([np.frombuffer(C.text_bytes(b.column(c + 2))[0].tobytes(), k) for b in held]) for c, k in enumerate(kinds)]

    for b in batches:
        bucket, sub = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            if hi > lo:
                if at != (bucket[lo], sub[lo]) and held:
                    yield unpacked()
                    held = []
                at = (bucket[lo], sub[lo])
                held.append(b.slice(lo, hi - lo))
    if held:
        yield unpacked()


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Where rows sorted by these keys have a new combination of them."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def keys_of(place: Cells):
    """Arrow function over (doc, text): hashes of lines, and of the halves of each distinct line of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = C.text_bytes(b.column(1))
            docs = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in C.chunks(off):
                x = Lines(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(x.row):
                    continue
                doc = docs[i + x.row]
                by = np.lexsort((x.number, doc, x.full))
                new = first_of(x.full[by])
                lead = by[new]
                first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
                copy = by[(doc[by] != doc[first]) | (x.number[by] != x.number[first])]
                r, key = x.halves(lead)
                # of a half that distinct lines of the batch share, two go on; all of these lines are wanted
                by = np.lexsort((x.full[r], key))
                r, key = r[by], key[by]
                keep = first_of(key, x.full[r])
                r, key = r[keep], key[keep]
                start = np.flatnonzero(first_of(key)) if len(key) else np.zeros(0, np.int64)
                size = np.diff(np.append(start, len(key)))
                nth = np.arange(len(key)) - np.repeat(start, size)
                shared = np.unique(r[np.repeat(size, size) > 1])
                r, key = r[nth < 2], key[nth < 2]
                rows = np.concatenate((lead, copy, shared, r))
                kind = np.repeat(np.array([OWN, COPY, SHARED, HALF], np.int8), [len(lead), len(copy), len(shared), len(r)])
                # what is decided goes anywhere
                decided = np.concatenate((copy, shared))
                key = np.concatenate((x.full[lead], C.mix(doc[decided].view(np.uint64) * C.STEP[2] + x.number[decided].astype(np.uint64)), key))
                full = np.where(kind == HALF, x.full[rows], np.uint64(0))
                yield place.deal(key, [doc[rows], x.number[rows].astype(np.int32), full, kind], ["key", "doc", "line", "full", "kind"])

    return run


def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From keys to copies (dropped) and to lines that share a half with another line (not dropped yet)."""
    for key, doc, line, full, kind in cells(batches, [np.uint64, np.int64, np.int32, np.uint64, np.int8]):
        done = np.flatnonzero((kind == COPY) | (kind == SHARED))
        by = np.flatnonzero((kind == OWN) | (kind == HALF))
        by = by[np.argsort(key[by], kind="stable")]
        twice = key[by][1:] == key[by][:-1]
        some = np.zeros(len(by), bool)
        some[1:] |= twice
        some[:-1] |= twice
        by = by[some]  # keys of one line, the most, are not sorted further
        by = by[np.lexsort((line[by], doc[by], full[by], kind[by], key[by]))]
        picks, copies = [done], [kind[done] == COPY]
        if len(by):
            k, f, h = key[by], full[by], kind[by] == HALF
            new = first_of(k, f, h)
            lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            picks.append(by[~h & ((doc[by] != doc[lead]) | (line[by] != line[lead]))])
            copies.append(np.ones(len(picks[-1]), bool))
            # halves: the first of each line, of keys that have two lines at least
            at = np.flatnonzero(new & h)
            pair = k[at][1:] == k[at][:-1]
            shared = np.zeros(len(at), bool)
            shared[1:] |= pair
            shared[:-1] |= pair
            picks.append(np.unique(by[at[shared]]))
            copies.append(np.zeros(len(picks[-1]), bool))
        pick = np.concatenate(picks)
        if len(pick):
            yield pa.RecordBatch.from_arrays([pa.array(doc[pick]), pa.array(line[pick]), pa.array(np.concatenate(copies))], names=["doc", "line", "copy"])


def joined(key: np.ndarray, pos: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that meet an earlier row by a variant, these earlier rows, and which rows are the first of their variant.

    Variants without the same place meet as substitutions; whole lines meet lines without a word as insertions.
    """
    by = np.lexsort((order, pos, key))
    k, p, o = key[by], pos[by], order[by]
    new = first_of(k, p)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    later, earlier = [], []
    hit = (p >= 0) & (o > o[lead])
    later.append(by[hit])
    earlier.append(by[lead[hit]])
    group = np.cumsum(first_of(k)) - 1
    count = group[-1] + 1 if len(by) else 0
    for whole in (True, False):  # the earliest whole line of a key against those without a word, and the other way
        side = np.flatnonzero((p < 0) == whole)
        low = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(low, group[side], o[side])
        who = np.full(count, -1)
        at = side[o[side] == low[group[side]]]
        who[group[at]] = at
        other = np.flatnonzero(((p < 0) != whole) & (low[group] < o))
        later.append(by[other])
        earlier.append(by[who[group[other]]])
    return np.concatenate(later), np.concatenate(earlier), by[new]


def dealer(place: Cells, key: int, text: int, wanted: int):
    """Arrow function over rows with key, text and wanted lines at these places: the variants of these lines, dealt to
    cells, and the lines' words. Of a variant only the first line of a batch goes on; later ones have met it, and come
    as variants of a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = C.text_bytes(b.column(text))
            docs = b.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            want = b.column(wanted)
            at = np.concatenate(([0], np.cumsum(np.asarray(want.value_lengths().fill_null(0)))))
            want = np.asarray(want.flatten()).astype(np.int64)
            for i, j in C.chunks(off):
                raw, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                x = Lines(raw, o)
                if not len(x.row):
                    continue
                width = int(x.number.max()) + 1
                mine = np.repeat(np.arange(j - i), np.diff(at[i : j + 1])) * width + np.minimum(want[at[i] : at[j]], width - 1)
                lines = np.flatnonzero(np.isin(x.row * width + x.number, mine))
                if not len(lines):
                    continue
                doc, number = docs[i + x.row], x.number.astype(np.int32)
                rank = np.empty(len(x.row), np.int64)
                rank[lines] = np.unique(np.stack((doc[lines], number[lines].astype(np.int64)), axis=1), axis=0, return_inverse=True)[1].ravel()
                r, k, pos = x.variants(lines)
                later, earlier, lead = joined(k, pos, rank[r])
                # a pair that met here meets again under a key of its own, as any pair does
                own = C.mix(doc[r[later]].view(np.uint64) * C.STEP[4] + number[r[later]].astype(np.uint64) * C.STEP[5] + np.arange(len(later), dtype=np.uint64))
                rows = np.concatenate((r[lead], r[later], r[earlier]))
                zero = np.zeros(len(later), np.int64)
                out = place.deal(np.concatenate((k[lead], own, own)), [doc[rows], number[rows], np.concatenate((pos[lead], zero, zero)).astype(np.int32)], ["key", "doc", "line", "pos"])
                none = pa.nulls(out.num_rows, pa.int64()), pa.nulls(out.num_rows, pa.int32()), pa.nulls(out.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*out.columns, *none], names=[*out.schema.names, "d", "l", "words"])
                words = [b" ".join(raw[x.starts[w] : x.ends[w]].tobytes() for w in range(x.lo[r], x.hi[r])) for r in lines.tolist()]
                blank = [pa.nulls(len(lines), t) for t in (pa.int32(), pa.int32(), *[pa.binary()] * 4)]
                yield pa.RecordBatch.from_arrays([*blank, pa.array(doc[lines]), pa.array(number[lines]), pa.array(words, pa.binary())], names=[*out.schema.names, "d", "l", "words"])

    return run


def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From dealt variants to pairs of lines of which one is earlier."""
    for key, doc, line, pos in cells(batches, [np.uint64, np.int64, np.int32, np.int32]):
        by = np.argsort(key, kind="stable")
        twice = key[by][1:] == key[by][:-1]
        some = np.zeros(len(by), bool)
        some[1:] |= twice
        some[:-1] |= twice
        by = by[some]
        if not len(by):
            continue
        _, order = np.unique(np.stack((doc[by], line[by].astype(np.int64)), axis=1), axis=0, return_inverse=True)
        later, earlier, _ = joined(key[by], pos[by], order.ravel())
        if len(later):
            x, y = by[later], by[earlier]
            yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(line[x]), pa.array(doc[y]), pa.array(line[y])], names=["doc", "line", "e_doc", "e_line"])


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two word sequences are near copies: equal, or one edit apart and of WORDS words at the longer."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(b) < WORDS:
        return a == b
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function over (doc, line, words, earlier words): the lines that are near copies."""
    for b in batches:
        ok = [one_edit(x.split(b" "), y.split(b" ")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield b.select(["doc", "line"]).filter(pa.array(ok, pa.bool_()))


def find(keyed: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line) of every dropped line, some of them more than once; lines are numbered from 0 in their text.
    key: a column of type long."""
    spark: SparkSession = keyed.sparkSession
    C.ship(spark)
    place = Cells(spark)
    hashed = keyed.select(key, text).where(F.col(key).isNotNull()).mapInArrow(keys_of(place), KEYS)
    met = C.written(place.dealt(hashed).mapInArrow(meeting, "doc long, line int, copy boolean"), "lines")
    wanted, doc = C.fresh(keyed, "ln_wanted"), C.fresh(keyed, "ln_doc")
    lines = met.where("not copy").groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line").alias(wanted))
    # all columns stay, so that this join and the last one read one shuffle of the texts
    near_ = keyed.join(lines, F.col(key) == F.col(doc)).drop(doc)
    dealt = C.written(near_.mapInArrow(dealer(place, keyed.columns.index(key), keyed.columns.index(text), len(keyed.columns)), VARIANTS), "variants")
    pairs = place.dealt(dealt.where("d is null").select("bucket", "sub", "key", "doc", "line", "pos")).mapInArrow(near, PAIRS).distinct()
    words = dealt.where("d is not null").select("d", "l", "words")
    side = lambda d, l, w: words.select(F.col("d").alias(d), F.col("l").alias(l), F.col("words").alias(w))
    both = pairs.join(side("doc", "line", "a"), ["doc", "line"]).join(side("e_doc", "e_line", "b"), ["e_doc", "e_line"])
    gone = both.select("doc", "line", "a", "b").mapInArrow(verified, "doc long, line int")
    return met.where("copy").select("doc", "line").unionByName(gone)


def without(docs: DataFrame, key: str = "doc_id", text: str = "text", count: tuple[str, str] | None = None) -> DataFrame:
    """docs whose texts lack the dropped lines. count: names for columns of lines before and after."""
    names = {x: C.fresh(docs, f"ln_{x}") for x in ("key", "doc", "gone", "mask")}
    k, doc, lines, mask = names.values()
    keyed = docs.withColumn(k, F.col(key).cast("long"))
    per = find(keyed, k, text).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line").alias(lines))

    def masked(b: pa.RecordBatch) -> list:
        """A byte for each line up to the last dropped one: 1 if it is dropped."""
        out = []
        for x in b.column(1).to_pylist():
            m = np.zeros(max(x) + 1, np.uint8)
            m[x] = 1
            out.append(m.tobytes())
        return [pa.array(out, pa.binary())]

    per = C.append_columns(per, f"`{mask}` binary", masked)
    both = keyed.join(per, F.col(k) == F.col(doc), "left").drop(k, doc)
    parts = F.split(F.col(text), "\n", -1)
    kept = F.filter(parts, lambda _, i: F.substring(F.col(mask), i + 1, F.lit(1)) != F.lit(b"\x01"))
    if count:
        both = both.withColumn(count[0], F.coalesce(F.size(parts), F.lit(0))).withColumn(count[1], F.col(count[0]) - F.coalesce(F.size(lines), F.lit(0)))
    return both.withColumn(text, F.when(F.col(mask).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop(lines, mask)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its lines, of the lines kept, and the text that stays."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = without(docs, count=("n_lines", "n_kept"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.col("text").alias("kept_text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: dropped lines leave the texts; a document of which nothing but blanks is left goes."""
    size = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")
    out = without(docs).where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", size).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)
