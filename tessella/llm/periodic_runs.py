"""Periodic runs of words: maximal stretches in which words q apart are identical.

For every lag the number of equal pairs is counted exactly: words that are frequent in a text by autocorrelation of their
places (FFT, rounded to whole numbers), rare ones by the differences of their places. Only a lag that has as many matches
left as a run of that period needs gets an island scan: matches that runs already found explain for multiples of their
period are taken off first, and a scan looks at one place in each stretch of the least length before it reads them all.

A run has at least LEAST words and two periods. Its period is the smallest of the stretch: a stretch that a multiple of
the period yields too has the same ends, so the first lag to yield it names it.

Defined results: null, empty and blank texts have no words and no runs; a text is never cut; repeated rows have equal
results; an empty table gives none; a column of a result's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST = 12


def numbered(words: list) -> np.ndarray:
    """Words as numbers, equal where the words are."""
    seen: dict = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def lag_counts(ids: np.ndarray) -> np.ndarray:
    """How many places hold the same word as the place so many words later, for lags 0 to half the length."""
    n = len(ids)
    most = n // 2
    out = np.zeros(most + 1, np.int64)
    if n < 2:
        return out
    freq = np.bincount(ids)
    size = 1 << int(2 * n - 1).bit_length()
    heavy = np.flatnonzero(freq.astype(np.float64) ** 2 > 8.0 * size * np.log2(size))  # where an FFT is the cheaper
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            f = np.fft.rfft((ids == w).astype(np.float64), size)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = np.flatnonzero(np.bincount(heavy, minlength=len(freq))[ids] == 0) if len(heavy) else np.arange(n)
    at = light[np.argsort(ids[light], kind="stable")]
    word = ids[at]
    near, k = np.arange(len(at)), 0
    while True:  # pairs of a word's k-th next places, among those that have one near enough
        k += 1
        near = near[: np.searchsorted(near, len(at) - k)]
        d = at[near + k] - at[near]
        ok = (word[near + k] == word[near]) & (d <= most)
        near = near[ok]
        if not len(near):
            break
        out += np.bincount(d[ok], minlength=most + 1)
    return out


def islands(ids: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of at least so many places that hold the word of the place q later: starts, ends."""
    n = len(ids) - q
    there = np.arange(least - 1, n, least)  # every such stretch covers one of these, and half its length to one side
    hit = there[ids[there] == ids[there + q]]
    half = least // 2
    if half and len(hit):
        up, down = np.minimum(hit + half, n - 1), np.maximum(hit - half, 0)
        hit = hit[((hit + half < n) & (ids[up] == ids[up + q])) | ((hit >= half) & (ids[down] == ids[down + q]))]
    if not len(hit):
        return hit, hit
    same = np.zeros(n + 2, np.int8)
    same[1:-1] = ids[:-q] == ids[q:]
    edge = np.diff(same)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ok = e - s >= least
    return s[ok], e[ok]


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    if len(ids) < LEAST:
        return []
    left = lag_counts(ids)
    need = np.maximum(np.arange(len(left)), LEAST - np.arange(len(left)))
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(left >= need).tolist():
        if not q or left[q] < need[q]:  # runs found meanwhile may explain its matches
            continue
        for s, e in zip(*(x.tolist() for x in islands(ids, q, int(need[q])))):
            if (s, e + q) not in found:
                found[s, e + q] = q
                k = np.arange(q, min(len(left), e + q - s), q)
                left[k] -= e + q - s - k
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    turn = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        turn[s + q] += 1
        turn[s + length] -= 1
    return np.cumsum(turn[:n]) == 0


def detected(docs: DataFrame, text: str = "text", found: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """docs with the array of a text's runs (start, length, period) and its words without repetitions, in place of text."""
    C.ship(docs.sparkSession)

    def make(b: pa.RecordBatch) -> list:
        flat, ends, texts = [], [0], []
        for t in b.column(b.schema.get_field_index(text)).cast(pa.large_binary()):
            words = (t.as_py() or b"").split()  # bytes split at exactly the six blanks
            ids = numbered(words)
            own = runs(ids)
            flat += own
            ends.append(len(flat))
            texts.append(b" ".join([words[i] for i in np.flatnonzero(kept(len(words), own))] if own else words))
        a = np.array(flat, np.int64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([pa.array(a[:, k]) for k in range(3)], ["start", "length", "period"])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(texts, pa.binary()).cast(pa.string())]

    return C.append_columns(docs, f"`{found}` array<struct<start: long, length: long, period: long>>, `{collapsed}` string", make)


def with_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which each tenth text, by crc32 of its key, repeats from some word on a stretch of the words that stood there."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    n, g = F.size("w").cast("long"), F.call_function("div", F.col("h"), F.lit(10).cast("long"))
    a = F.col("g") % n
    p = 1 + F.call_function("div", n - F.col("a"), 3 + F.col("g") % 8)
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    it = docs.select(F.struct(*docs.columns).alias("row"), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    it = it.withColumn("g", g).withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    return it.select(*[F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def digest(found: Column) -> Column:
    """The sha256 of `start,length,period` lines."""
    line = F.transform(found, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return F.sha2(F.array_join(line, "").cast("binary"), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detected(with_tails(C.read(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = docs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), digest(F.col("runs")).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("top.less")
    return out.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"), F.call_function("div", 1000 * length, F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
