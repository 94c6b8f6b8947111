"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and their characters.

A text is a sequence of letter and digit runs, ASCII letters in lower case. A word's input is its hashed embedding
plus the mean of the embeddings of its byte 4-grams. The network reads windows of WINDOW words that overlap by half,
in both directions, and pools the states of each window by attention. A text's score is the calibrated score of its
highest window, over all windows of the whole text. Training is in numpy, over a bounded sample of labelled rows.

Defined results: null and empty texts, and texts without a word, score 0; without labelled rows of both kinds every
text scores 0; equal texts have equal scores, whatever their id; rows with a null label or text are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WORDS, GRAMS, DIM, HIDDEN = 1 << 15, 1 << 15, 8, 8
WINDOW, STRIDE = 32, 16
THRESHOLD = 0.3
#: Characters of texts that a sample may hold in all; the bound is a parameter of `sample`.
SAMPLE_CHARS = 60_000_000
#: Standard errors from which log-odds count.
LEAST = 2.0

_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[65:91] = _KEEP[97:123] = True
_KEEP[128:] = True
_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a chunk: table rows, 4-gram rows, offsets of these; then each word's number, and row offsets."""
    starts, ends, at = C.spans(_KEEP[data], off)
    h = C.span_hashes(data, starts, ends, C.BYTE_LOWER)
    uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[where], ends[where]
    n = e - s
    total = np.concatenate(([0], np.cumsum(n)))
    pos = np.repeat(s - total[:-1], n) + np.arange(total[-1])
    low = _LOW[data] if len(data) else np.full(1, 32, np.uint32)
    left = np.where(pos == np.repeat(s, n), 32, low[np.maximum(pos - 1, 0)]).astype(np.uint32)
    right = np.where(pos == np.repeat(e, n) - 1, 32, low[np.minimum(pos + 1, len(low) - 1)]).astype(np.uint32) if len(pos) else low[:0]
    mid = low[pos]
    # one gram for each byte: with the byte before and two after it, where spaces stand beyond the word
    last = np.repeat(e, n) - 1
    more = np.where(pos + 2 <= last, low[np.minimum(pos + 2, len(low) - 1)], 32) if len(pos) else low[:0]
    four = (left | mid << np.uint32(8) | right << np.uint32(16) | more.astype(np.uint32) << np.uint32(24)) * np.uint32(2654435761)
    gram = ((four ^ four >> np.uint32(15)) * np.uint32(2246822519)) >> np.uint32(32 - 15)
    return (uniq >> np.uint64(64 - 15)).astype(np.int64), gram.astype(np.int64), total, back, at


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and row of every window of texts whose words have these offsets."""
    n = np.diff(at)
    many = np.where(n == 0, 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1))
    row = np.repeat(np.arange(len(n)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = at[:-1][row] + nth * STRIDE
    return first, np.minimum(WINDOW, at[1:][row] - first), row


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters by name, and the network's passes. Gates are in the order update, reset, new."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.p = {"word": (rng.normal(0, 0.05, (WORDS, DIM))).astype(np.float32), "gram": (rng.normal(0, 0.05, (GRAMS, DIM))).astype(np.float32), "query": w(2 * HIDDEN), "out": w(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": w(DIM, 3 * HIDDEN), f"h{d}": w(HIDDEN, 3 * HIDDEN), f"g{d}": np.zeros(3 * HIDDEN, np.float32)}

    def run(self, gates: list[np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logit of each window. gates: both directions' inputs, (windows, WINDOW, 3 HIDDEN). keep: also what backward needs."""
        b, t, _ = gates[0].shape
        k = HIDDEN
        states = np.zeros((b, t, 2 * k), np.float32)
        kept: list = [[], []]
        for d, (g, order) in enumerate(zip(gates, (range(t), range(t - 1, -1, -1)))):
            u, h = self.p["h" + "fb"[d]], np.zeros((b, k), np.float32)
            for s in order:
                a = h @ u
                zr = sigmoid(g[:, s, : 2 * k] + a[:, : 2 * k])
                z, r = zr[:, :k], zr[:, k:]
                n = np.tanh(g[:, s, 2 * k :] + r * a[:, 2 * k :])
                m = mask[:, s, None]
                new = h + m * (1 - z) * (n - h)
                if keep:
                    kept[d].append((s, h, z, r, n, a[:, 2 * k :], m))
                h = new
                states[:, s, d * k : d * k + k] = h
        e = states @ self.p["query"] + (mask - 1) * 1e4
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,btk->bk", w, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, states, w, pooled, kept) if keep else logit

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss, and of the inputs x (windows, WINDOW, DIM)."""
        p, k = self.p, HIDDEN
        gates = [x @ p["x" + d] + p["g" + d] for d in "fb"]
        logit, states, w, pooled, kept = self.run(gates, mask, True)
        dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        grad = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
        dp = dl[:, None] * p["out"]
        dw = np.einsum("bk,btk->bt", dp, states)
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        grad["query"] = np.einsum("bt,btk->k", de, states)
        ds = w[:, :, None] * dp[:, None, :] + de[:, :, None] * p["query"]
        dx = np.zeros_like(x)
        for d, name in enumerate("fb"):
            u = p["h" + name]
            dg, du, dh = np.zeros_like(gates[d]), np.zeros_like(u), np.zeros((len(x), k), np.float32)
            for s, h, z, r, n, an, m in reversed(kept[d]):
                dh = dh + ds[:, s, d * k : d * k + k]
                live = m * dh
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da = np.concatenate((dz, dr, dn * r), axis=1)
                dg[:, s] = np.concatenate((dz, dr, dn), axis=1)
                du += h.T @ da
                dh = dh - live * (1 - z) + da @ u.T
            grad |= {"h" + name: du, "g" + name: dg.sum(axis=(0, 1)), "x" + name: np.einsum("btd,btg->dg", x, dg)}
            dx += dg @ p["x" + name].T
        return grad, dx


@dataclass
class Model:
    """Input tables already multiplied by the gates' weights, so a word costs one look-up.

    word, gram: by direction. odds: of 4-grams; peak: what a word's largest odds among its 4-grams add to the gates.
    """

    net: Net
    word: list[np.ndarray]
    gram: list[np.ndarray]
    odds: np.ndarray
    peak: list[np.ndarray]
    slope: float
    shift: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        best = np.full(len(off) - 1, -np.inf)
        for i, j in C.chunks(off, 1_000_000):
            word, gram, ends, back, at = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            if not len(back):
                continue
            n = np.diff(ends)[:, None].astype(np.float32)
            most = np.maximum.reduceat(self.odds[gram], ends[:-1])[:, None]
            ready = [(w[word] + np.add.reduceat(g[gram], ends[:-1], axis=0) / n + most * k).astype(np.float32) for w, g, k in zip(self.word, self.gram, self.peak)]
            first, size, row = windows(at)
            np.maximum.at(best, row + i, window_logits(self.net, ready, back, first, size))
        some = np.isfinite(best)
        return np.where(some, sigmoid(np.clip(self.slope * np.where(some, best, 0) + self.shift, -60, 60)), 0.0)


def window_logits(net: Net, ready: list[np.ndarray], back: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logits of windows whose words' gate inputs are ready."""
    out = np.empty(len(first), np.float32)
    for lo in range(0, len(first), 1024):
        f, z = first[lo : lo + 1024, None], size[lo : lo + 1024, None]
        steps = np.arange(int(z.max()))
        ids = back[np.minimum(f + steps, len(back) - 1)]
        out[lo : lo + 1024] = net.run([r[ids] for r in ready], (steps < z).astype(np.float32))
    return out


def highest(logits: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's highest window (its number, -1 for none) and its logit."""
    by = np.lexsort((-logits, row))
    lead = by[np.concatenate(([True], row[by][1:] != row[by][:-1]))] if len(by) else by
    top, val = np.full(n, -1), np.full(n, -np.inf)
    top[row[lead]], val[row[lead]] = lead, logits[lead]
    return top, val


def train(texts: list[str], labels: list[int], weight: tuple[float, float] = (1.0, 1.0), epochs: int = 10, seed: int = 11) -> Model | None:
    """Fit on four fifths of the rows; the other fifth calibrates scores.

    Three inputs are log-odds of the word and its 4-grams where these are beyond chance. They are cross-fitted: a
    text learned from sees odds of the other half, so the network learns how far odds can be trusted. The rest of
    the embeddings is learned. Windows are chosen as the model goes: each text is learned from at its highest
    window, and clean texts at random ones besides.

    weight: labelled rows that each clean and each toxic row of the sample stands for, for calibrated scores.
    """
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    word, gram, ends, back, at = tokens(data, off)
    if not len(back):
        return None
    first, size, row = windows(at)
    part = rng.permutation(len(y)) % 5 if len(y) >= 40 else rng.permutation(len(y)) % 4 + 1
    fit, fold = part > 0, np.where(part == 0, 2, part % 2)
    net = Net(seed)
    rows_of = np.repeat(np.arange(len(y)), np.diff(at))
    pair = np.unique(back.astype(np.int64) * len(y) + rows_of)
    n_gram = np.diff(ends)
    size_of = n_gram[pair // len(y)]
    pos = np.repeat(ends[pair // len(y)] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())
    gram_pair = np.unique(gram[pos] * len(y) + np.repeat(pair % len(y), size_of))

    def log_odds(pairs: np.ndarray, n: int, use: np.ndarray, least: float) -> np.ndarray:
        pairs = pairs[use[pairs % len(y)]]
        hit = y[pairs % len(y)] == 1
        pos, neg = (np.bincount((pairs // len(y))[h], minlength=n) for h in (hit, ~hit))
        odds = np.log((pos + 0.5) / (y[use].sum() + 1)) - np.log((neg + 0.5) / ((1 - y[use]).sum() + 1))
        sure = odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        return np.where((pos + neg >= 3) & (sure >= least), np.clip(odds, 0, 5) * np.clip(sure / 3, 0, 1), 0.0).astype(np.float32)

    inputs, tables = [], []
    for use in (fit & (fold == 1), fit & (fold == 0), fit):
        w, g = log_odds(pair, len(word), use, LEAST), log_odds(gram_pair, GRAMS, use, LEAST)
        tables.append((w, g))
        inputs.append(np.stack((w, np.add.reduceat(g[gram], ends[:-1]) / n_gram, np.maximum.reduceat(g[gram], ends[:-1])), axis=1).astype(np.float32))
    net.p["word"][:, :3] = net.p["gram"][:, :3] = 0
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    turn = 0

    def update(k: str, g: np.ndarray, rows=slice(None), rate: float = 0.01) -> None:
        m, v = moments[k]
        m[rows] = 0.9 * m[rows] + 0.1 * g
        v[rows] = 0.99 * v[rows] + 0.01 * g * g
        net.p[k][rows] -= rate * m[rows] / (1 - 0.9**turn) / (np.sqrt(v[rows] / (1 - 0.99**turn)) + 1e-6)

    def logits() -> np.ndarray:
        base = net.p["word"][word] + np.add.reduceat(net.p["gram"][gram], ends[:-1], axis=0) / n_gram[:, None]
        out = np.empty(len(first), np.float32)
        for f in range(3):
            vec = base.copy()
            vec[:, :3] += inputs[f]
            some = np.flatnonzero(fold[row] == f)
            out[some] = window_logits(net, [(vec @ net.p["x" + d] + net.p["g" + d]).astype(np.float32) for d in "fb"], back, first[some], size[some])
        return out

    for epoch in range(epochs):
        top, _ = highest(logits() if epoch else np.array([inputs[fold[r]][back[a : a + z]].sum() for a, z, r in zip(first, size, row)]), row, len(y))
        clean = np.flatnonzero(fit[row] & (y[row] == 0))
        order = rng.permutation(np.concatenate((top[(top >= 0) & fit], rng.choice(clean, min(len(clean), int(fit.sum())), replace=False))))
        for lo in range(0, len(order), 64):
            w = order[lo : lo + 64]
            turn += 1
            steps = np.arange(WINDOW)
            ids = back[np.minimum(first[w][:, None] + steps, len(back) - 1)]
            mask = (steps < size[w][:, None]).astype(np.float32)
            flat, inv = np.unique(ids, return_inverse=True)
            inv = inv.reshape(ids.shape)
            n = n_gram[flat]
            pos = np.repeat(ends[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            vec = net.p["word"][word[flat]] + np.add.reduceat(net.p["gram"][gram[pos]], np.cumsum(n) - n, axis=0) / n[:, None]
            x = vec[inv].astype(np.float32)
            x[:, :, :3] += np.stack(inputs)[fold[row[w]][:, None], ids]
            grad, dx = net.step(x, mask, y[row[w]])
            dx[:, :, :3] = 0
            dv = np.zeros((len(flat), DIM), np.float32)
            np.add.at(dv, inv.ravel(), (dx * mask[:, :, None]).reshape(-1, DIM))
            for k, g in grad.items():
                update(k, g, rate=0.01 if epoch < epochs * 0.6 else 0.003)
            for k, at_, g in (("word", word[flat], dv), ("gram", gram[pos], np.repeat(dv / n[:, None], n, axis=0))):
                rows, inv2 = np.unique(at_, return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, inv2, g)
                update(k, total, rows, 0.0005)
    _, val = highest(logits(), row, len(y))
    use = np.isfinite(val) & (~fit if (~fit).sum() and y[~fit].min() != y[~fit].max() else True)
    v, t = val[use], y[use]
    stands = np.where(t > 0, weight[1], weight[0])
    stands = stands / stands.mean()
    goal = np.where(t > 0, 1 - 1 / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    design = np.stack((v, np.ones(len(v))), axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(30):  # Newton's steps for two numbers, with smoothed targets and a small pull to (1, 0)
        p = sigmoid(np.clip(design @ ab, -30, 30))
        g = design.T @ (stands * (p - goal)) + 0.05 * (ab - [1, 0])
        h = (design * (stands * p * (1 - p) + 1e-4)[:, None]).T @ design + 0.05 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, g), -1, 1)
    slope, shift = max(0.05, float(ab[0])), float(ab[1])
    table, grams = net.p["word"].copy(), net.p["gram"].copy()
    np.maximum.at(table[:, 0], word, tables[2][0])
    grams[:, 1] = tables[2][1]
    return Model(net, [table @ net.p["x" + d] + net.p["g" + d] for d in "fb"], [grams @ net.p["x" + d] for d in "fb"], tables[2][1], [net.p["x" + d][2][None, :] for d in "fb"], slope, shift)


def sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, where: Column, per_class: int, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int], tuple[float, float]]:
    """About per_class labelled rows of each kind at most, picked by a hash of the key; the bound is the parameter.

    Texts of any length are learned from. Where one key has many rows, twice the bound are taken, and of each kind rows are
    taken in that order until they hold half of `chars`, one at least: what the driver holds follows from these bounds alone.
    """
    known = labels.where(where & F.col(label).isNotNull()).select(F.col(key), (F.col(label) > 0).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not counts:
        return [], [], (1.0, 1.0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    luck = F.pmod(F.xxhash64(F.col(key), F.lit("toxicity sample")), F.lit(1_000_003)) / 1_000_003
    picked = known.where(luck < share[F.col("y")]).orderBy(luck, "y").limit(4 * per_class)
    texts = docs.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    few = texts.join(F.broadcast(picked), key).select(F.col(key), F.col(text), "y", luck.alias("luck"), F.xxhash64(text).alias("tie"), F.char_length(text).alias("long")).orderBy("luck", "tie").limit(4 * per_class)
    by = Window.partitionBy("y").orderBy("luck", "tie")
    held = few.withColumns({"held": F.sum("long").over(by), "place": F.row_number().over(by)}).where((F.col("held") <= chars // 2) | (F.col("place") == 1))
    rows = held.select(F.col(key), F.col(text), "y").collect()
    rows.sort(key=lambda r: (str(r[0]), r[2], r[1]))
    y = [r[2] for r in rows]
    return [r[1] for r in rows], y, tuple(counts.get(k, 0) / max(1, y.count(k)) for k in (0, 1))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", where: Column | None = None, per_class: int = 900) -> Model | None:
    return train(*sample(docs, labels, text, key, label, F.lit(True) if where is None else where, per_class))


def score(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the score of every whole text and whether it reaches THRESHOLD, under the given names."""
    spark: SparkSession = docs.sparkSession
    C.ship(spark)
    held = spark.sparkContext.broadcast(model)
    i = docs.columns.index(text)

    def make(b: pa.RecordBatch) -> list:
        data, off = C.text_bytes(b.column(i))
        s = np.zeros(len(off) - 1) if held.value is None else held.value.scores(data, off)
        return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

    return C.append_columns(docs, f"`{names[0]}` double, `{names[1]}` int", make)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned from the labels outside fold 2 of crc32(doc_id) mod 4."""
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    model = fit(docs, labels, where=C.fold("doc_id", 4) != 2)
    return score(docs.select("doc_id", F.coalesce(C.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text")
