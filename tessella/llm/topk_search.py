"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are ordered by length and cut into buckets of consecutive vectors; a bucket is one packed row, and buckets
of like length (a level) are dealt to cells of bounded size. Thresholds come first: the longest bucket of each common
dimension, of fixed size, goes to all queries, and the k-th best score there is what a candidate must reach, so a
query needs no bucket whose longest vector is shorter than that score over its own length. Queries are dealt to blocks
by this need, and a block is sent to the levels that it needs and no others; a task holds one cell and one block.

There a query's running k-th score and the lengths give its local cosine threshold in a bucket: below 0 nothing can be
pruned by angle and the bucket is cut by length alone; at a high threshold the feasible range of the query's largest
coordinates cuts it. What is left is verified by exact integer products.

Defined results: vectors that are null, empty, hold null or non-finite components or have a null id take no part;
only vectors of equal dimension meet; repeated ids are rows of their own, except that no row with the query's id is
a candidate; ties go to the smaller id; fewer than k candidates give fewer rows; an empty table gives none.
Products are exact while a sum of component products stays within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BUCKET = 2048
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.85
FOCUS = 3
#: Levels of length a doubling, vectors of a cell, and queries of a block.
LEVELS, CELL, BLOCK = 8, 16384, 16384
#: Dimensions of which the longest bucket goes to all queries.
COMMON = 8
NONE = -(2**62)
PACKED = "ids binary, vectors binary, least binary, n int, dim int, level int, longest double"


#: Length from which products may leave 64 bits: such vectors are whole numbers in floats, and multiplied as such.
GIANT = 2.0**31


def scaled(scale: float):
    """Arrow function: floor(scale * component) of valid vectors, with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vec, query = b.column(0), b.column(1), b.column(2)
            ok = np.asarray(ids.is_valid()) & np.asarray(vec.is_valid())
            keep = np.flatnonzero(ok)
            vec = vec.take(pa.array(keep))
            ids, query = ids.take(pa.array(keep)), query.take(pa.array(keep))
            lens = np.asarray(vec.value_lengths().fill_null(0)).astype(np.int64)
            flat = vec.flatten()
            bad = ~np.asarray(flat.is_valid())
            x = np.asarray(flat.fill_null(0).cast(pa.float64()))
            bad |= ~np.isfinite(x)
            x = np.floor(np.where(bad, 0, x) * scale)
            off = np.concatenate(([0], np.cumsum(lens)))
            bads = np.concatenate(([0], np.cumsum(bad)))
            good = np.flatnonzero((bads[off[1:]] == bads[off[:-1]]) & (lens > 0))
            with np.errstate(over="ignore"):
                norm = np.array([float(np.sqrt((x[off[i] : off[i + 1]] ** 2).sum())) for i in good])
            giant = norm > GIANT
            rows = [x[off[i] : off[i + 1]].astype(np.float64 if big else np.int64).tobytes() for i, big in zip(good, giant)] if giant.any() else None
            if rows is None:
                ints = x.astype(np.int64)
                rows = [ints[off[i] : off[i + 1]].tobytes() for i in good]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), pa.array(rows, pa.binary()), pa.array(lens[good].astype(np.int32)), pa.array(norm, pa.float64()), query.take(pa.array(good)), pa.array(giant)], names=["id", "v", "dim", "norm", "query", "giant"])

    return run


def pack(size: int):
    """Arrow function over (id, v, dim, norm, level, least): consecutive rows of equal dimension and level as one packed
    row of at most size vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def packed(at: tuple[int, int]) -> pa.RecordBatch:
            rows = held.pop(at)
            ids, least = (np.array([r[c] for r in rows], np.int64).tobytes() for c in (0, 3))
            row = [[ids], [b"".join(r[1] for r in rows)], [least], [len(rows)], [at[0]], [at[1]], [max(r[2] for r in rows)]]
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["ids", "vectors", "least", "n", "dim", "level", "longest"])

        for b in batches:
            for i, v, dim, norm, level, least in zip(*[b.column(c).to_pylist() for c in range(6)]):
                rows = held.setdefault((dim, level), [])
                rows.append((i, v, norm, least))
                if len(rows) == size:
                    yield packed((dim, level))
        for at in sorted(held):
            yield packed(at)

    return C.lean(run)


def unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, dim)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where every partial sum fits their 53 bits."""
    if np.abs(q).max(initial=0) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


class Best:
    """The k best of each query so far. least: scores that are known to be reached."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.v, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.unit = vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.score = np.full((len(ids), k), NONE)
        self.who = np.zeros((len(ids), k), np.int64)
        self.least = least.copy()

    def offer(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores of some queries (rows) with some candidates (columns)."""
        r, c = np.nonzero((score >= self.least[rows][:, None]) & (ids[None, :] != self.ids[rows][:, None]))
        if not len(r):
            return
        touched = np.unique(rows[r])
        q = np.concatenate((rows[r], np.repeat(touched, self.k)))
        s = np.concatenate((score[r, c], self.score[touched].ravel()))
        i = np.concatenate((ids[c], self.who[touched].ravel()))
        by = np.lexsort((i, -s, q))
        q, s, i = q[by], s[by], i[by]
        start = np.searchsorted(q, touched)
        at = start[:, None] + np.arange(self.k)
        self.score[touched], self.who[touched] = s[at], i[at]
        self.least[touched] = np.maximum(self.least[touched], self.score[touched, self.k - 1])

    def search(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Offer a bucket's vectors, longest first."""
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        ids, c, norm = ids[order], c[order], norm[order]
        limit = self.norm * norm[0] * (1 + 1e-9) + 1e-6
        least = np.where(self.least > NONE, self.least.astype(np.float64), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(limit > 0, least / limit, -np.inf)
        live = np.flatnonzero(limit >= least)
        by_angle = live[cosine[live] >= COORDINATE_FROM]
        by_length = np.setdiff1d(live, by_angle, assume_unique=True)
        if len(by_angle):
            unit = c / np.maximum(norm, 1e-300)[:, None]
            for q in by_angle:
                t, keep = min(cosine[q], 1.0), np.ones(len(ids), bool)
                for f in self.focus[q]:
                    x = self.unit[q, f]
                    slack = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-7
                    if x > -t:
                        keep &= unit[:, f] >= x * t - slack
                    if x < t:
                        keep &= unit[:, f] <= x * t + slack
                at = np.flatnonzero(keep)
                if len(at):
                    self.offer(np.array([q]), ids[at], products(self.v[q : q + 1], c[at]))
        for lo in range(0, len(by_length), 256):
            some = by_length[lo : lo + 256]
            with np.errstate(invalid="ignore"):
                need = np.where(self.norm[some] > 0, (least[some] - 1e-6) / np.maximum(self.norm[some], 1e-300) * (1 - 1e-9), -np.inf)
            most = int(np.searchsorted(-norm, -np.min(need), "right"))
            self.offer(some, ids[:most], products(self.v[some], c[:most]))


def thresholds(longest, k: int):
    """Arrow function over (id, v, dim, norm): the k-th best score of each query in the longest bucket of its dimension,
    and the length that a candidate must have to reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {dim: unpacked(ids, vec, dim) for dim, ids, vec in longest.value}
        for b in batches:
            ids, dims, norm = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
            least = np.full(len(ids), NONE)
            for dim in np.unique(dims):
                if dim not in known or len(known[dim][0]) < k:
                    continue
                who, vec = known[dim]
                mine = np.flatnonzero(dims == dim)
                for lo in range(0, len(mine), 256):
                    at = mine[lo : lo + 256]
                    q = np.frombuffer(b"".join(b.column(1).take(pa.array(at)).to_pylist()), np.int64).reshape(-1, dim)
                    score = np.where(who[None, :] != ids[at][:, None], products(q, vec), NONE)
                    least[at] = np.partition(score, len(who) - k, axis=1)[:, len(who) - k]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((least > 0) & (norm > 0), (least - 1e-6) / norm * (1 - 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(len(ids), np.int32)), pa.array(least), pa.array(need)], names=["id", "v", "dim", "norm", "level", "least", "need"])

    return C.lean(run)


def search(vectors: DataFrame, key: str, vector: str, query: Column, k: int = 10, scale: float = 1024.0, bucket: int = BUCKET, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """The k best candidates of every row for which query holds: query_id, rank, vec_id, score."""
    spark: SparkSession = vectors.sparkSession
    C.ship(spark)
    ints = C.written(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(query, F.lit(False)).alias("q")).mapInArrow(C.lean(scaled(scale)), "id long, v binary, dim int, norm double, query boolean, giant boolean"), "vectors")
    every, total, asked = ints.agg(F.count("*"), F.count_if(~F.col("giant")), F.count_if(F.col("query") & ~F.col("giant"))).first()
    whole, ints = ints, ints.where("not giant").drop("giant")
    n = max(1, min(C.parts(spark), -(-total // bucket)))
    level = F.coalesce(F.floor(F.log2(F.nullif("norm", F.lit(0.0))) * LEVELS).cast("int"), F.lit(-(2**30)))
    ordered = ints.select("id", "v", "dim", "norm", level.alias("level"), F.lit(NONE).alias("least")).repartitionByRange(n, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    buckets = C.written(ordered.mapInArrow(pack(bucket), PACKED).withColumn("no", F.monotonically_increasing_id()), "buckets")
    levels = buckets.groupBy("dim", "level").agg(F.max("longest").alias("longest"), F.ceil(F.sum("n") / cell).cast("int").alias("cells"))
    longest = buckets.groupBy("dim").agg(F.sum("n").alias("n"), F.max_by(F.struct("ids", "vectors"), F.struct("longest", -F.col("no"))).alias("b")).orderBy(F.desc("n"), "dim").limit(COMMON)
    first = spark.sparkContext.broadcast([(r["dim"], bytes(r["b"]["ids"]), bytes(r["b"]["vectors"])) for r in longest.collect()])
    blocks = max(1, -(-asked // block))
    asks = ints.where("query").select("id", "v", "dim", "norm").mapInArrow(thresholds(first, k), "id long, v binary, dim int, norm double, level int, least long, need double")
    asks = C.written(asks.repartitionByRange(blocks, "need", "id").withColumn("block", F.spark_partition_id()), "queries")
    # the levels that hold a vector long enough for some query of a block
    needs = asks.groupBy("dim", "block").agg(F.min("need").alias("need"))
    meets = C.written(needs.join(levels, "dim").where(F.col("longest") >= F.col("need")).select("dim", "block", "level", "cells"), "meets")
    packed = asks.repartition(blocks, "block").sortWithinPartitions("block", "need", "id").select("id", "v", "dim", "norm", F.col("block").alias("level"), "least").mapInArrow(pack(1024), PACKED).withColumnRenamed("level", "block")
    columns = ["dim", "level", "cell", "block", "query", "ids", "vectors", "least", "longest"]
    grid = (
        buckets.join(meets, ["dim", "level"]).withColumn("cell", F.pmod(F.xxhash64("no"), F.col("cells")).cast("int")).withColumn("query", F.lit(False)).select(*columns)
        .unionByName(packed.join(meets, ["dim", "block"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("query", F.lit(True)).select(*columns))
    )

    def meet(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: -r["longest"])
        out: list[list[np.ndarray]] = [[], [], []]
        for a in (r for r in rows if r["query"]):
            best = Best(*unpacked(a["ids"], a["vectors"], a["dim"]), k, np.frombuffer(a["least"], np.int64))
            for c in (r for r in rows if not r["query"]):
                best.search(*unpacked(c["ids"], c["vectors"], c["dim"]))
            some = best.score > NONE
            for o, v in zip(out, (np.repeat(best.ids, k).reshape(-1, k), best.who, best.score)):
                o.append(v[some])
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    found = grid.groupBy("dim", "level", "cell", "block").applyInArrow(meet, "query_id long, vec_id long, score long")
    if every > total:
        found = found.unionByName(with_giants(whole, k))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def with_giants(vectors: DataFrame, k: int, cell: int = 2048) -> DataFrame:
    """The k best pairs of each query and cell in which one vector is a giant: exact products in whole numbers of any size, a
    block of queries against a cell of candidates. A score beyond 64 bits is given as the last number that they hold."""
    n = max(1, -(-vectors.count() // cell))
    where = lambda name: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    big, columns = F.col("giant"), ["id", "v", "dim", "giant"]
    asks, cands = vectors.where("query"), vectors
    grid = None
    for q, c in ((asks, cands.where(big)), (asks.where(big), cands.where(~big))):
        if c.limit(1).count() and q.limit(1).count():
            one = q.select(*columns, F.lit(True).alias("ask"), where("block"), every.alias("cell")).unionByName(c.select(*columns, F.lit(False).alias("ask"), every.alias("block"), where("cell")))
            one = one.withColumn("side", F.lit(0 if grid is None else 1))
            grid = one if grid is None else grid.unionByName(one)
    if grid is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    most = 2**63 - 1

    def meet(t: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        rows = t.to_pylist()
        whole = lambda r: np.array([int(x) for x in np.frombuffer(r["v"], np.float64 if r["giant"] else np.int64)], object)
        found = [(r["id"], whole(r)) for r in rows if not r["ask"]]
        for r in rows:
            if r["ask"]:
                v = whole(r)
                best = sorted((-max(-most - 1, min(most, int(np.dot(v, c)))), i) for i, c in found if i != r["id"])[:k]
                out += [(r["id"], i, -s) for s, i in best]
        return pa.table({name: pa.array([o[j] for o in out], pa.int64()) for j, name in enumerate(("query_id", "vec_id", "score"))})

    return grid.groupBy("dim", "side", "block", "cell").applyInArrow(meet, "query_id long, vec_id long, score long")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other rows of every hundredth embedding."""
    return search(C.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
