"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network routes each
pattern's words to its sources' quotas: the first pass over a pattern's words is free, every further repetition is
dearer than the one before, so repetition is used only where a quota needs it. Then documents of each pattern are
taken in an order seeded by their key until the pattern's flow is met. Patterns and sources are what the driver
sees; document sizes and the order are never gathered: the cut is found in a histogram of the order's hash, and
only the one hash bucket that holds the cut is ordered exactly.

Defined results: null or empty texts have size 0 and are not taken; a null source is a source of its own, last in
order; a row that belongs to no source is not taken; repeated rows count as often as they occur, and equal rows
may differ in what is taken of them at the cut alone; an empty table gives none. The document at the cut is taken
in part, so that a pattern's words are met exactly. Reruns agree.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CELLS = 4096


def use_cost(use: int) -> int:
    """Of a word's first, second, third ... use."""
    return use * use


def sized(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs without text and with the number of words of it under name."""
    C.ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = C.text_bytes(b.column(b.schema.get_field_index(text)))
            n = np.empty(len(off) - 1, np.int64)
            for i, j in C.chunks(off):
                _, _, at = C.spans(~C.SPACE[data[off[i] : off[j]]], off[i : j + 1] - off[i])
                n[i:j] = np.diff(at)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(n)], names=[*kept, name])

    run = C.lean(run)
    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(run, StructType([*[docs.schema[c] for c in kept], StructField(name, LongType())]))


def quotas(sizes: dict, weights: dict, total: float, most: float = 2.0) -> dict:
    """Each source's share of total by weight, at most `most` times its size; the excess goes to the others by weight."""
    target: dict = {}
    live, left = [s for s in sizes if weights[s] > 0], total
    while live:
        per = left / sum(weights[s] for s in live)
        full = [s for s in live if per * weights[s] > most * sizes[s]]
        if not full:
            target |= {s: per * weights[s] for s in live}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        live = [s for s in live if s not in target]
    return {s: target.get(s, 0.0) for s in sizes}


def route(patterns: dict[tuple, int], target: dict, repeat: int = 2) -> dict[tuple, dict]:
    """Words that each pattern sends to each of its sources: most quota met, then least cost.

    Successive cheapest paths; within a pattern uses are filled from the cheapest, as costs are convex.
    """
    nodes = [("p", p) for p in sorted(patterns, key=repr)] + [("s", s) for s in sorted(target, key=repr)]
    at = {x: i + 2 for i, x in enumerate(nodes)}
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(nodes) + 2)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, 0))
        cost.extend((w, -w))
        return len(to) - 2

    sends = {}
    for p, size in sorted(patterns.items(), key=repr):
        for k in range(repeat):
            arc(0, at["p", p], size, use_cost(k))
        for s in p:
            sends[p, s] = arc(at["p", p], at["s", s], size * repeat, 0)
    for s, t in sorted(target.items(), key=repr):
        arc(at["s", s], 1, int(round(t)), 0)
    while True:
        dist, via = {0: 0}, {}
        queue, queued = deque([0]), {0}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                if cap[e] > 0 and dist[a] + cost[e] < dist.get(to[e], 1 << 60):
                    dist[to[e]], via[to[e]] = dist[a] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if 1 not in dist:
            break
        path, v = [], 1
        while v != 0:
            path.append(via[v])
            v = to[via[v] ^ 1]
        flow = min(cap[e] for e in path)
        for e in path:
            cap[e] -= flow
            cap[e ^ 1] += flow
    flows: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), e in sends.items():
        flows[p][s] = cap[e ^ 1]
    return flows


def patterned(docs: DataFrame, key: str, member: str, seed: int, names: dict[str, str]) -> DataFrame:
    """docs with their membership pattern, their place in the seeded order, and the cell of the order it is in."""
    source = lambda s: F.coalesce(F.concat(F.lit("v"), s), F.lit("~"))
    docs = docs.withColumn(names["pattern"], F.array_sort(F.array_distinct(F.transform(member, source))))
    docs = docs.withColumn(names["luck"], F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    return docs.withColumn(names["cell"], F.shiftrightunsigned(names["luck"], 52).cast("int"))


def cut_cells(docs: DataFrame, size: str, plans: DataFrame, pattern: str, cell: str) -> DataFrame:
    """Of each pattern: the cell of the order in which its last pass is cut short, and the words before that cell.
    plans: pattern, whole, rest."""
    cells = docs.where(F.col(pattern).isNotNull()).groupBy(F.col(pattern).alias("p"), F.col(cell).alias("c")).agg(F.sum(size).alias("mass"))
    before = Window.partitionBy("p").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumn("before", F.coalesce(F.sum("mass").over(before), F.lit(0))).join(plans, "p")
    at = run.where("before <= rest and before + mass > rest")
    return at.groupBy("p").agg(F.min(F.struct("c", "before")).alias("x"), F.first("whole").alias("whole"), F.first("rest").alias("rest")).select("p", "x.c", "x.before", "whole", "rest")


def mix(docs: DataFrame, key: str, size: str, member: str, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17, taken: str = "taken") -> tuple[DataFrame, dict, dict]:
    """docs with the words taken of each (a column of that name is replaced), and the sizes and targets of the sources.

    member: an array of sources (may hold null). weights: of the sources in code point order, null last, repeating.
    """
    spark = docs.sparkSession
    docs = docs.drop(taken) if taken not in (key, size, member) else docs
    names = {x: C.fresh(docs, f"mix_{x}") for x in ("pattern", "cell", "luck", "cut", "before", "whole", "rest", "start")}
    pattern, cell, luck, cut, before, whole, rest, start = names.values()
    kept = docs.columns
    docs = patterned(docs, key, member, seed, names)
    mass = {tuple(r[0]): int(r[1]) for r in docs.where(F.col(pattern).isNotNull()).groupBy(pattern).agg(F.sum(size)).collect()}
    sizes: dict = {}
    for p, n in mass.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s == "~", s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = quotas(sizes, weight, share * sum(mass.values()), most)
    flow = route({p: n for p, n in mass.items() if p}, target, int(np.ceil(most)))
    # whole passes over the pattern, and the words of the last pass that is cut short
    plan = []
    for p, f in flow.items():
        sent = sum(f.values())
        plan.append((list(p), sent // mass[p] if mass[p] else 0, sent % mass[p] if mass[p] else 0))
    plans = spark.createDataFrame(plan, "p array<string>, whole long, rest long")
    # a row for each pattern, as the driver has seen them: small enough to be sent to all tasks, if Spark finds so
    cuts = cut_cells(docs, size, plans, pattern, cell)
    rows = [tuple(r) for r in cuts.collect()]
    cuts = spark.createDataFrame(rows, f"`{pattern}` array<string>, `{cut}` int, `{before}` long, `{whole}` long, `{rest}` long")
    joined = docs.join(cuts, pattern, "left")
    passes = F.coalesce(F.col(whole), F.lit(0)) * F.col(size)
    outside = joined.where(F.col(cut).isNull() | (F.col(cell) != F.col(cut)))
    outside = outside.withColumn(taken, passes + F.when(F.col(cell) < F.col(cut), F.col(size)).otherwise(F.lit(0)))
    # of one cell alone is the order needed
    by = Window.partitionBy(pattern).orderBy(luck, F.col(key), size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = joined.where(F.col(cell) == F.col(cut)).withColumn(start, F.col(before) + F.sum(size).over(by) - F.col(size))
    last = F.greatest(F.lit(0), F.least(F.col(size), F.col(rest) - F.col(start)))
    out = outside.select(*kept, F.col(taken).cast("long").alias(taken)).unionByName(inside.select(*kept, (passes + last).cast("long").alias(taken)))
    return out, {s: sizes[s] for s in order}, target


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to 150 % of their words."""
    docs = C.written(sized(C.read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", "size"), "sizes")
    out, sizes, target = mix(docs.withColumn("member", F.array("source")), "doc_id", "size", "member")
    per = spark.createDataFrame([(s, int(n), float(target[s])) for s, n in sizes.items()], "s string, source_size long, target double")
    named = out.withColumn("s", F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("~")))
    return named.join(per, "s").select("doc_id", "size", "source_size", "target", "taken", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of the mix, each as often as it is taken; one taken in part is taken whole.

    Texts are joined back only through the rows' own columns: sizes travel with the documents.
    """
    size, member, text, taken = (C.fresh(docs, f"mix_{x}") for x in ("size", "member", "text", "taken"))
    whole = sized(docs.withColumn(text, F.col("text")), text, size).withColumn(member, F.array("source"))
    out, _, _ = mix(C.written(whole, "sizes"), "doc_id", size, member, taken=taken)
    times = F.ceil(F.col(taken) / F.greatest(F.col(size), F.lit(1))).cast("int")
    return out.where(F.col(taken) > 0).withColumn(member, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
