"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Features are byte 3-grams and 4-grams of the text with ASCII folded to lower case and everything that is
neither an ASCII letter nor a byte of a non-ASCII character turned into a space. Training is stochastic
gradient descent in numpy over a bounded sample of labelled rows; embedding and softmax are then multiplied
into one table of fixed size (BUCKETS x languages), which is all that is broadcast.

Defined results: null and empty texts and texts without a letter give ``und`` with score 0 and are rejected;
rows with a null label are not learned from; without any labelled row every text gives ``und`` with score 0;
equal texts give equal predictions, whatever their id; ties go to the language that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 16
DIM = 12
UNDETERMINED = "und"
#: Characters of texts that a sample may hold in all; the bound is a parameter of `sample`.
SAMPLE_CHARS = 60_000_000

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def ngrams(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 3-gram and the 4-gram that start at each byte, but for the last bytes."""
    b = _FOLD[data]
    out = []
    if len(b) > 2:
        three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        out.append((three * np.uint32(2654435761)) >> np.uint32(16))
        if len(b) > 3:
            four = (three[:-1] ^ (b[3:] << np.uint32(24))) * np.uint32(2246822519)
            out.append((four ^ (four >> np.uint32(15))) * np.uint32(3266489917) >> np.uint32(16))
    return out


def row_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares."""
    grams = ngrams(data)
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    at, n = np.unique(np.concatenate(grams), return_counts=True)
    return at.astype(np.int64), (n / n.sum()).astype(np.float32)


@dataclass
class Model:
    """table: a row of log-odds for each bucket; bias and temperature finish the softmax."""

    langs: list[str]
    table: np.ndarray
    seen: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    least_seen: float

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its calibrated probability and the share of known n-grams, of each row."""
        n, k = len(off) - 1, len(self.langs)
        logits, known, total = np.zeros((n, k), np.float64), np.zeros(n), np.zeros(n)
        for i, j in C.chunks(off):
            lo, hi = off[i], off[j]
            for size, grams in zip((3, 4), ngrams(data[lo:hi])):
                # an n-gram that crosses into the next row counts for neither
                ends = np.maximum(off[i + 1 : j + 1] - lo - size + 1, off[i:j] - lo)
                starts = off[i:j] - lo
                for c in range(k):
                    s = np.concatenate(([0.0], np.cumsum(self.table[c][grams], dtype=np.float64)))
                    logits[i:j, c] += s[np.minimum(ends, len(grams))] - s[np.minimum(starts, len(grams))]
                s = np.concatenate(([0], np.cumsum(self.seen[grams], dtype=np.int64)))
                known[i:j] += s[np.minimum(ends, len(grams))] - s[np.minimum(starts, len(grams))]
                total[i:j] += ends - starts
        z = (logits / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(n), best], known / np.maximum(total, 1)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 7, lost: float = 0.002) -> Model | None:
    """Fit on four fifths of the rows; temperature and rejection limits come from the other fifth.

    lost: the share of rightly predicted calibration rows that rejection may cost.
    """
    langs = sorted(set(labels))
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    rows = [row_features(np.frombuffer(x.encode(), np.uint8)) for x in texts]
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 10 else order
    fit = order[len(rows) // 5 :] if len(rows) >= 10 else order
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    seen = np.zeros(BUCKETS, bool)
    for i in fit:
        seen[rows[i][0]] = True
    top, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    top[:] = rng.normal(0, 0.3, top.shape)
    steps, t = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            at, w = rows[i]
            lr = rate * (1 - t / steps)
            t += 1
            v = w @ emb[at] if len(at) else np.zeros(DIM, np.float32)
            z = v @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            # a text's gradient is spread over its n-grams by their shares, so long texts need the scale
            emb[at] -= (lr * 20 * w)[:, None] * (top @ p)[None, :]
            top -= 0.2 * lr * np.outer(v, p)
            bias -= 0.02 * lr * p
    emb[~seen] = 0
    model = Model(langs, np.ascontiguousarray((emb @ top).T), seen, bias.astype(np.float64), 1.0, 0.0, 0.0)
    if len(held):
        raw = np.concatenate([np.frombuffer(texts[i].encode(), np.uint8) for i in held])
        off = np.concatenate(([0], np.cumsum([len(texts[i].encode()) for i in held])))
        nll = []
        grid = np.geomspace(0.1, 10, 25)
        for temp in grid:
            model.temperature = temp
            best, p, known = model.predict(raw, off)
            true = np.where(best == y[held], p, (1 - p) / max(k - 1, 1))
            nll.append(-np.log(np.maximum(true, 1e-9)).mean())
        model.temperature = float(grid[int(np.argmin(nll))])
        best, p, known = model.predict(raw, off)
        right = best == y[held]
        if right.any():
            # either limit may cost half of what both may
            model.least = float(np.quantile(p[right], lost / 2, method="lower"))
            model.least_seen = float(np.quantile(known[right], lost / 2, method="lower"))
    return model


def sample(docs: DataFrame, text: str, lang: str, key: str, where: Column, per_lang: int, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """About per_lang labelled rows of each language at most, picked by a hash of the key; the bound is the parameter.

    Texts of any length are learned from. Where one key has many rows, twice the bound are taken, and of each language
    rows are taken in that order until they hold its part of `chars`, one at least: what the driver holds follows from these bounds alone.
    """
    labelled = docs.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang)).count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    luck = F.pmod(F.xxhash64(F.col(key), F.lit("language sample")), F.lit(1_000_003)) / 1_000_003
    few = labelled.where(luck < share[F.col(lang)]).select(F.col(key), F.col(text), F.col(lang), luck.alias("luck"), F.xxhash64(text).alias("tie"), F.char_length(text).alias("long")).orderBy("luck", "tie").limit(2 * per_lang * len(counts))
    by = Window.partitionBy(lang).orderBy("luck", "tie")  # of each language an equal part of the characters
    held = few.withColumns({"held": F.sum("long").over(by), "place": F.row_number().over(by)}).where((F.col("held") <= chars // len(counts)) | (F.col("place") == 1))
    rows = held.select(F.col(key), F.col(text), F.col(lang)).collect()
    rows.sort(key=lambda r: (str(r[0]), r[2], r[1]))
    return [r[1] for r in rows], [r[2] for r in rows]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", where: Column | None = None, per_lang: int = 800) -> Model | None:
    return train(*sample(docs, text, lang, key, F.lit(True) if where is None else where, per_lang))


def identify(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the predicted language, its calibrated probability and whether it is rejected, under the given names."""
    spark: SparkSession = docs.sparkSession
    C.ship(spark)
    held = spark.sparkContext.broadcast(model)
    i = docs.columns.index(text)

    def make(b: pa.RecordBatch) -> list:
        m, col = held.value, b.column(i)
        data, off = C.text_bytes(col)
        n = len(off) - 1
        if m is None:
            return [pa.array([UNDETERMINED] * n), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
        letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)))
        some = letters[off[1:]] > letters[off[:-1]]
        for r in np.flatnonzero(~some & (off[1:] > off[:-1])):
            some[r] = any(map(str.isalpha, col[int(r)].as_py()))
        best, p, known = m.predict(data, off)
        rejected = ~some | (p < m.least) | (known < m.least_seen)
        names_ = np.array([*m.langs, UNDETERMINED], object)
        return [pa.array(names_[np.where(some, best, len(m.langs))], pa.string()), pa.array(np.where(some, p, 0.0)), pa.array(rejected)]

    return C.append_columns(docs, f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean", make)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned from the folds other than 1 of crc32(doc_id) mod 3."""
    docs = C.read(spark, sf_dir, "documents")
    model = fit(docs, where=C.fold("doc_id", 3) != 1)
    return identify(docs.select("doc_id", F.coalesce(C.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: learn from all labelled rows of docs and keep those that are not rejected."""
    bad, lang, score = (C.fresh(docs, x) for x in ("ld_rejected", "ld_lang", "ld_score"))
    return identify(docs, fit(docs), names=(lang, score, bad)).where(~F.col(bad)).drop(bad, lang, score)
