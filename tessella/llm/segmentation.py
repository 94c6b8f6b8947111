"""SentencePiece encoding and decoding by Gumbel top-k sampling without replacement.

A text's segmentations are the paths of a lattice whose edges are vocabulary pieces. Piece weights follow from the
model file's ranks by Zipf's law, as the file has merge ranks and no probabilities. Completion masses come from a
backward pass, so that every partial path knows the mass of all that complete it. A perturbed A* search then emits
segmentations in order of perturbed log-probability: the best path keeps its node's perturbed value all the way, each
edge not taken gets its value conditioned on that maximum, and the largest value on the frontier of all paths so far
is where the next segmentation branches off. The first k are a sample without replacement; the next value on the
frontier, kappa, gives each its inclusion score 1 - exp(-exp(log p - kappa)).

Spaces and newlines cut a text into units no piece crosses; a batch's distinct units get their lattice once, and all
units advance together. Noise is a hash of row key, unit, place and edge, so results do not depend on batches.

Defined results: null and empty texts have one empty segmentation; characters outside the vocabulary become byte
pieces, so decoding gives every text back, also texts with the space mark itself; texts with fewer than k
segmentations give fewer; without a further segmentation inclusion is 1; rows with equal keys and texts are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Weights: (rank + OFFSET) ** -POWER.
OFFSET, POWER = 10.0, 1.0
#: Bytes of text worked on at once: the lattice and the paths take about 200 times as much. Short stretches
#: spare memory and take more CPU.
MOST, SHORT = 1_500_000, 400_000
#: In place of a piece's id: bytes that only open pieces, and bytes that do not.
PREFIX, NONE = -2, -1


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        ids, rank = [], np.full(n, float(n))
        for i in range(n):
            if sp.IsByte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.bytes[i] = i, bytes([b])
            elif not (sp.IsControl(i) or sp.IsUnknown(i)) and (sp.get_score(i) > -1e8 or len(sp.id_to_piece(i)) == 1):
                self.bytes[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
                rank[i] = min(-sp.get_score(i), n)
                ids.append(i)
        w = (rank + OFFSET) ** -POWER
        self.weight = np.log(w / w[[*ids, *self.byte_id]].sum())
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.longest = int(self.length.max())
        # pieces, and what only opens pieces
        known = {self.bytes[i]: i for i in ids}
        for i in ids:
            for n in range(len(self.bytes[i]) - 1, 0, -1):
                known.setdefault(self.bytes[i][:n], PREFIX)
        raw = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum([len(x) for x in known])
        h = C.span_hashes(raw, np.concatenate(([0], ends[:-1])), ends)
        self.size = 1 << 19
        self.keys, self.ids = np.zeros(self.size, np.uint64), np.full(self.size, NONE, np.int32)
        for x, at, i in zip(h, (h >> np.uint64(45)).tolist(), known.values()):
            while self.ids[at] != NONE:
                at = (at + 1) % self.size
            self.keys[at], self.ids[at] = x, i
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.concatenate(([0], np.cumsum(self.length)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes; PREFIX for those of no piece that open one, NONE for others."""
        at = (h >> np.uint64(45)).astype(np.int64)
        out = self.ids[at]
        open_ = np.flatnonzero((out != NONE) & (self.keys[at] != h))
        out[open_], at = NONE, at[open_]
        while len(open_):
            at = (at + 1) % self.size
            found, hit = self.ids[at], self.keys[at] == h[open_]
            out[open_[hit]] = found[hit]
            go = ~hit & (found != NONE)
            open_, at = open_[go], at[go]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of piece ids: their bytes without the space that opens it."""
        n = self.length[ids]
        pos = np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat[pos][1:].tobytes()


_made: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _made:
        _made[path] = Vocabulary(path)
    return _made[path]


class Lattice:
    """Edges of distinct units: by position of their bytes, with length, piece and the log share of the mass."""

    def __init__(self, v: Vocabulary, data: np.ndarray, end: np.ndarray):
        """data: the units' bytes one after another; end: of each byte's unit."""
        n, self.longest = len(data), np.uint16(v.longest)
        up, down = C.powers(n + 1)
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.BYTE_EXACT[data] * up[:n])))
        head = (data & 0xC0) != 0x80
        found = []  # positions, length and pieces of edges, shorter ones first
        p = np.flatnonzero(head)
        before, scale, left = s[p], down[p], end[p] - p
        for size in range(1, v.longest + 1):
            if not len(p):
                break
            i = v.find(C.mix((s[p + size] - before) * scale + np.uint64(size)))
            hit = i >= 0
            found.append((p[hit], size, i[hit]))
            go = np.flatnonzero((i != NONE) & (left > size))
            p, before, scale, left = p[go], before[go], scale[go], left[go]
        # characters that are no piece go byte by byte
        heads = np.flatnonzero(head)
        width = np.diff(np.append(heads, n))
        known = np.zeros(n, bool)
        wide = np.zeros(n, np.int64)
        wide[heads] = width
        for p, size, _ in found:
            known[p[wide[p] == size]] = True
        alone = np.flatnonzero(~np.repeat(known[heads], width))
        found.append((alone, 1, v.byte_id[data[alone]]))
        # edges lie by how far their positions are from their unit's end, so that the backward pass takes stretches
        far = end - np.arange(n)
        order = np.argsort(far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far, kind="stable")
        cut = np.searchsorted(far[order], np.arange(1, int(far.max(initial=0)) + 2))
        self.count = np.zeros(n, np.int64)
        for p, _, _ in found:
            self.count[p] += 1
        count = self.count[order]
        start = np.cumsum(count) - count
        self.start = np.empty(n, np.int64)
        self.start[order] = start
        free = self.start.copy()
        self.length, self.piece, then = (np.empty(int(count.sum()), x) for x in (np.int64, np.int32, np.int64))
        for p, size, i in found:
            at = free[p]
            free[p] += 1
            self.length[at], self.piece[at] = size, i
            then[at] = np.where(p + size == end[p], n, p + size)
        w = v.weight[self.piece]
        # backward pass: all positions as far from their unit's end at once
        mass = np.full(n + 1, -np.inf)
        mass[n] = 0.0  # stands for the end of every unit
        self.share = np.zeros(len(then))
        for d in range(len(cut) - 1):
            own = slice(cut[d], cut[d + 1])
            some = count[own] > 0
            at, c, lead = order[own][some], count[own][some], start[own][some]
            if not len(at):
                continue
            e = slice(lead[0], lead[-1] + c[-1])
            lead -= lead[0]
            x = w[e] + mass[then[e]]
            top = np.maximum.reduceat(x, lead)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                mass[at] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, c)), lead))
            with np.errstate(invalid="ignore"):
                self.share[e] = x - np.repeat(mass[at], c)
        # what noise is mixed with, and what its exponential is multiplied by
        self.noise = self.length.astype(np.uint64) * C.STEP[12]
        self.inverse = np.exp(np.minimum(-self.share, 700.0))


def times(n: int, step: int) -> np.uint64:
    return np.uint64(n * int(C.STEP[step]) % 2**64)


def exponential(x: np.ndarray) -> np.ndarray:
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(exponential(x))


def walk(lat: Lattice, pos: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: np.ndarray):
    """One path through each unit from pos on: nodes in order of units, each with its edge and how far the second of its
    edges lies behind.

    An edge's perturbed value share + gumbel is -log(exponential / exp(share)), so the least quotient is the best edge,
    and a node's value needs no logarithm. Nodes go by falling number of edges, so that those with a j-th edge lie first.
    """
    p, on, steps = pos.copy(), np.flatnonzero(pos < end), []
    count = np.zeros(len(pos), np.int64)
    while len(on):
        c = lat.count[p[on]]
        on = on[np.argsort(lat.longest - c.astype(np.uint16), kind="stable")]
        at = p[on]
        chosen, behind = lat.start[at], np.full(len(on), np.inf)
        more = len(on) - np.cumsum(np.bincount(c))  # how many have over j edges
        # a node with one edge needs no noise
        many = int(more[1]) if len(more) > 1 else 0
        if many:
            lead = chosen[:many].copy()
            seed = C.mix(salt[on[:many]] + (at[:many] - begin[on[:many]]).astype(np.uint64) * C.STEP[11])
            best, second, nth = np.full(many, np.inf), np.full(many, np.inf), np.zeros(many, np.uint16)
            for j in range(len(more) - 1):
                n = min(many, int(more[j]))
                e = lead[:n] + j
                x = exponential(C.mix(seed[:n] + lat.noise[e]))
                x *= lat.inverse[e]
                np.copyto(nth[:n], j, where=x < best[:n])
                np.minimum(second[:n], np.maximum(best[:n], x), out=second[:n])
                np.minimum(best[:n], x, out=best[:n])
            chosen[:many] += nth
            np.subtract(second, best, out=behind[:many])
        steps.append((on, at, chosen, behind))
        count[on] += 1
        p[on] = at + lat.length[chosen]
        on = on[p[on] < end[on]]
    total = int(count.sum())
    first = np.cumsum(count) - count
    place, edge, gap = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
    for k, (on, at, chosen, behind) in enumerate(steps):
        w = first[on] + k
        place[w], edge[w], gap[w] = at, chosen, behind
    return np.repeat(np.arange(len(pos)), count), place, edge, gap


def others(lat: Lattice, at: np.ndarray, seed: np.ndarray, alts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The perturbed value of each node's best edge, and the values and edges of its best alternatives."""
    c = lat.count[at]
    lead = np.cumsum(c) - c
    e = per_row(lat.start[at], c)
    h = lat.share[e] + gumbel(C.mix(np.repeat(seed, c) + lat.noise[e]))
    lane = np.repeat(np.arange(len(at)), c)
    value, edge = np.full((len(at), alts + 1), -np.inf), np.zeros((len(at), alts + 1), np.int64)
    for a in range(alts + 1 if len(at) else 0):
        m = np.maximum.reduceat(h, lead)
        hit = np.flatnonzero((h == m[lane]) & np.isfinite(h))
        value[lane[hit], a], edge[lane[hit], a] = h[hit], e[hit]
        h[hit] = -np.inf
    return value[:, 0], value[:, 1:], edge[:, 1:]


def least(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least finite values of each row; x goes. at: where rows start, and the end."""
    some = np.flatnonzero(at[1:] > at[:-1])
    out = [np.zeros(0, np.int64)]
    for _ in range(k if len(some) else 0):
        low = np.minimum.reduceat(x, at[some])
        hit = np.flatnonzero((x == np.repeat(low, (at[1:] - at[:-1])[some])) & np.isfinite(x))
        hit = hit[np.unique(np.searchsorted(at, hit, "right"), return_index=True)[1]]
        out.append(hit)
        x[hit] = np.inf
    return np.sort(np.concatenate(out))


def highest(x: np.ndarray) -> np.ndarray:
    """Each row's maximum, for few columns."""
    out = x[:, 0].copy()
    for k in range(1, x.shape[1]):
        np.maximum(out, x[:, k], out=out)
    return out


def per_row(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """offsets[r], offsets[r] + 1, ... counts[r] of them, for every r."""
    return np.repeat(offsets - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def sample(v: Vocabulary, data: np.ndarray, off: np.ndarray, seeds: np.ndarray, k: int) -> list[tuple]:
    """For each of k draws: which rows have it, their piece ids and offsets of these, log-probability, inclusion."""
    n = len(off) - 1
    full = off[1:] > off[:-1]
    data = np.insert(data, off[:-1][full], 32)  # the space that opens each text
    off = off + np.concatenate(([0], np.cumsum(full)))
    head = (data == 32) | (data == 10)
    head[1:] |= data[:-1] == 10
    head[off[:-1][full]] = True
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(data))
    h = C.span_hashes(data, starts, ends)
    _, where, kind = np.unique(h, return_index=True, return_inverse=True)
    size = (ends - starts)[where]
    cum = np.cumsum(size)
    lat = Lattice(v, data[per_row(starts[where], size)], np.repeat(cum, size))
    begin, stop = (cum - size)[kind], cum[kind]
    first = np.searchsorted(starts, off)  # units of each row
    row_of = np.repeat(np.arange(n), np.diff(first))
    number = np.arange(len(starts)) - first[row_of]
    salt = seeds[row_of] + number.astype(np.uint64) * C.STEP[10]
    draws: list[tuple] = []
    # the frontier: nodes of all paths so far with what they may still give
    front: list[list] = [[] for _ in range(8)]  # row, path, index in path, unit, place, log p before, values, edges
    paths: list[tuple[np.ndarray, np.ndarray]] = []  # edges, offsets by row
    top = gumbel(C.mix(seeds + C.STEP[13]))
    todo = np.arange(n)
    for draw in range(k):
        if draw == 0:
            units, pos = np.arange(len(starts)), begin
            pre_edges, pre_off, done = np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(n)
            rows = row_of
        else:
            f_row, f_path, f_index, f_unit, f_place, f_before, f_value, f_edge = columns = [np.concatenate(x) for x in front]
            best = np.full(n, -np.inf)
            np.maximum.at(best, f_row, highest(f_value))
            hit = np.argwhere((f_value == best[f_row][:, None]) & np.isfinite(f_value))
            pick, col = np.full(n, -1), np.zeros(n, np.int64)
            pick[f_row[hit[:, 0]]], col[f_row[hit[:, 0]]] = hit[:, 0], hit[:, 1]
            todo = np.flatnonzero(pick >= 0)
            node, col = pick[todo], col[todo]
            edge, top = f_edge[node, col], best.copy()
            f_value[node, col] = -np.inf
            front = [[x] for x in columns]
            # what the branch shares with the path that it leaves, and its own first edge
            lens = np.zeros(n, np.int64)
            lens[todo] = f_index[node] + 1
            pre_off = np.concatenate(([0], np.cumsum(lens)))
            pre_edges = np.empty(int(pre_off[-1]), np.int64)
            for j, (pe, po) in enumerate(paths):
                mine = np.flatnonzero(f_path[node] == j)
                r, m = todo[mine], f_index[node[mine]]
                pre_edges[per_row(pre_off[r], m)] = pe[per_row(po[r], m)]
            pre_edges[pre_off[todo + 1] - 1] = edge
            done = np.zeros(n)
            done[todo] = f_before[node] + lat.share[edge]
            u = f_unit[node]
            rest = first[todo + 1] - u
            units = per_row(u, rest)
            pos = begin[units].copy()
            lead = np.cumsum(rest) - rest
            pos[lead] = f_place[node] + lat.length[edge]
            rows = row_of[units]
        salts = C.mix(salt[units] + times(draw, 14))
        unit, place, edge, behind = walk(lat, pos, begin[units], stop[units], salts)
        row = rows[unit]
        lp = lat.share[edge]
        node_at = np.searchsorted(row, np.arange(n + 1))
        # sums run row by row, so that their rounding does not depend on the batch
        run = np.empty(len(lp))
        for a, z in zip(node_at[:-1].tolist(), node_at[1:].tolist()):
            np.cumsum(lp[a:z], out=run[a:z])
        run += done[row]
        logp = done.copy()
        some = node_at[1:] > node_at[:-1]
        logp[some] = run[node_at[1:][some] - 1]
        lead = np.zeros(len(lp), bool)
        lead[node_at[:-1][some]] = True
        before = np.where(lead, done[row], np.concatenate(([0.0], run[:-1])) if len(run) else run)
        # what further draws and kappa can ask for: the nodes whose second edges have a row's highest values
        with np.errstate(divide="ignore"):
            open_ = least(np.log(behind) - before, node_at, k - draw)
        u, m, before = unit[open_], top[row[open_], None], before[open_, None]
        value, oh, oe = others(lat, place[open_], C.mix(salts[u] + (place[open_] - begin[units[u]]).astype(np.uint64) * C.STEP[11]), k)
        # values of the edges not taken, given that the taken one has the node's
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            gap = m - before - oh + np.log1p(-np.exp(np.minimum(oh - value[:, None], -1e-12)))
            val = m - np.maximum(gap, 0) - np.log1p(np.exp(-np.abs(gap)))
        val = np.where(np.isfinite(oh), val, -np.inf)
        pre = np.diff(pre_off)
        own = np.diff(node_at)
        both = np.zeros(n, np.int64)
        both[todo] = (pre + own)[todo]
        po = np.concatenate(([0], np.cumsum(both)))
        pe = np.empty(int(po[-1]), np.int64)
        pe[per_row(po[:-1], pre)] = pre_edges
        pe[per_row(po[:-1] + pre, own)] = edge
        index = np.arange(len(row)) - node_at[row] + pre[row]
        for f, x in zip(front, (row[open_], np.full(len(open_), draw), index[open_], units[u], place[open_], before[:, 0], val, oe)):
            f.append(x)
        paths.append((pe, po))
        draws.append((todo, lat.piece[pe], po, logp[todo], top[todo]))
    kappa = np.full(n, -np.inf)
    for r, val in zip(front[0], front[6]):
        if len(r):
            np.maximum.at(kappa, r, highest(val))
    out = []
    for todo, ids, po, lp, _ in draws:
        with np.errstate(over="ignore"):
            chance = -np.expm1(-np.exp(np.clip(lp - kappa[todo], -700, 50)))
        inclusion = np.where(np.isfinite(kappa[todo]), np.exp(np.round(np.log(np.maximum(chance, 1e-300)), 7)), 1.0)
        out.append((todo, ids, po, np.round(lp, 8) + 0.0, inclusion))
    return out


SAMPLES = "sample int, ids array<int>, log_prob double, inclusion double"


def runner(key: str, k: int, seed: int, model: str | None, digest: bool, most: int):
    """The Arrow function of segment: batches of key and text, so many bytes of text at once."""

    def run(batches):
        v = vocabulary(model or bpe.public(MODEL))
        for b in batches:
            data, off = C.text_bytes(b.column(1))
            salt = C.text_bytes(b.column(0).cast(pa.string()))
            lens = np.diff(salt[1])
            keyed = np.zeros(b.num_rows, np.uint64)
            some = lens > 0
            if some.any():
                keyed[some] = C.span_hashes(salt[0], salt[1][:-1][some], salt[1][1:][some])
            seeds = C.mix(keyed + times(seed, 15))
            for i, j in C.chunks(off, most):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                for nth, (rows, ids, at, lp, inc) in enumerate(sample(v, d, o, seeds[i:j], k), 1):
                    if not len(rows):
                        continue
                    keys = b.column(0).take(pa.array(rows + i))
                    n = at[rows + 1] - at[rows]
                    number = pa.array(np.full(len(rows), nth, np.int32))
                    if digest:
                        little = ids.astype("<u4")
                        sums = [C.crc(little[at[r] : at[r + 1]]) for r in rows]
                        same = [v.decode(ids[at[r] : at[r + 1]]) == d[o[r] : o[r + 1]].tobytes() for r in rows]
                        cols = [keys, number, pa.array(n), pa.array(sums, pa.int64()), pa.array(lp), pa.array(inc), pa.array(same)]
                        yield pa.RecordBatch.from_arrays(cols, names=[key, "sample", "n_pieces", "ids_crc32", "log_prob", "inclusion", "decoded"])
                    else:
                        mine = ids[per_row(at[rows], n)].astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(mine))
                        yield pa.RecordBatch.from_arrays([keys, number, lists, pa.array(lp), pa.array(inc)], names=[key, "sample", "ids", "log_prob", "inclusion"])

    return run


def segment(docs: DataFrame, key: str, text: str, k: int = 2, seed: int = 5, model: str | None = None, digest: bool = False, spare: bool = False) -> DataFrame:
    """key and, for each of up to k distinct segmentations, its number from 1, ids, log-probability and inclusion.

    digest: instead of ids, their number and CRC-32, and whether decoding them gives the text back. spare: with less memory.
    """
    C.ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rest = "sample int, n_pieces long, ids_crc32 long, log_prob double, inclusion double, decoded boolean" if digest else SAMPLES
    run = C.lean(runner(key, k, seed, model, digest, SHORT)) if spare else runner(key, k, seed, model, digest, MOST)
    return docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, {rest}")


def decoded(samples: DataFrame, ids: str = "ids", name: str = "text", model: str | None = None) -> DataFrame:
    """samples with the text of their ids; null ids give null, no ids the empty text."""
    C.ship(samples.sparkSession)
    i = samples.columns.index(ids)

    def make(b: pa.RecordBatch) -> list:
        v = vocabulary(model or bpe.public(MODEL))
        return [pa.array([None if x is None else v.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column(i).to_pylist()], pa.string())]

    return C.append_columns(samples, f"`{name}` string", make)


def op5_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document, with inclusion scores, decoded again."""
    return segment(C.read(spark, sf_dir, "documents"), "doc_id", "text", digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: two segmentations of every document that the mix took, as often as it took it."""
    return segment(docs, "doc_id", "text", spare=True)
