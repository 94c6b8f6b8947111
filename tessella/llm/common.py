"""Shared pieces: reading tables, the shared work folder, Arrow helpers and vectorised text hashing.

All text work runs on whole Arrow batches: a batch's texts are one byte array with offsets, and words,
hashes and n-grams are computed by numpy over that array, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Bytes of text worked on at once; a text is never cut, so one longer text makes a longer chunk.
CHUNK = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors where the caller has not, and keep Arrow batches of long texts small.

    The batch setting is read when a plan runs, so it cannot be taken back here; a caller's own value is left alone.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    session.ship(spark)


shared_dir = session.shared_dir


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy", dictionary: bool = True) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    dictionary: whether columns are tried as dictionaries first, which is lost work where values hardly repeat."""
    path = shared(df.sparkSession, name)
    df.write.option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let go of what finished queries have left on disk: Spark deletes the shuffle files of plans that nobody holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: str = "doc_id", mod: int = 4) -> Column:
    """crc32 of the key as text, modulo mod; null for a null key, which is in no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def append_columns(df: DataFrame, fields: str, make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df with more columns: make returns the arrays of the new columns for a batch. fields: their DDL. As with
    withColumn, columns of df with these names are replaced; make still sees them."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    more = _parse_datatype_string(fields)
    names = {f.name.lower() for f in more.fields}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    schema = StructType([*[df.schema.fields[i] for i in keep], *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *make(b)], names=schema.names)

    return df.mapInArrow(lean(run), schema)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as UTF-8 bytes and row offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    n, at = len(col), col.offset
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def tidy() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks, and with it what it once held."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable) -> Callable:
    """An Arrow function that gives its memory back when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE_LOWER = _BYTE[_LOWER]
BYTE_EXACT = _BYTE
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        for k, p in ((0, _P), (1, _PINV)):
            a = np.full(n, p, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept bytes that do not cross a row: starts, ends, and offsets of each row's runs."""
    n = len(keep)
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = keep[cut]
    last[cut - 1] = keep[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_EXACT) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal wherever the bytes are equal."""
    up, down = powers(len(data) + 1)
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(table[data] * up[: len(data)], out=s[1:])
    return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = BYTE_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ in order, and offsets of each row's words."""
    starts, ends, at = spans(~SPACE[data], off)
    return span_hashes(data, starts, ends, table), at


def crc(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def labels(spark: SparkSession, n: int) -> np.ndarray:
    """n int labels that repartition(n, label) sends to n different partitions, in order of the partition."""
    k = F.col("id").cast("int")
    rows = spark.range(0, 30 * n + 200, 1, 1).select(k.alias("k"), F.pmod(F.hash(k), F.lit(n)).alias("p")).collect()
    place: dict[int, int] = {}
    for r in rows:
        place.setdefault(r[1], r[0])
    return np.array([place.get(p, next(iter(place.values()))) for p in range(n)], np.int32)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node reachable.

    Large-star and small-star turns until every node hangs on one root and no root on another; each turn is written to
    the shared folder.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "links")
    while True:
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up")))
        if not ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)").limit(1).count():
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(low, "u")
        small = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
