"""Time-ordered target encoding: a row's key is rated by the earlier rows of other folds that share it.

A step-function validity table holds, for each key, cumulative counts that hold from an event's time plus a gap
(exclusive) to the next change (inclusive), with one component for each fold. Every key has time cells of its own, finer
the more events it has, so that a cell has few changes however hot the key is; a step is in each cell that it reaches
into. Cells of all keys of a level are numbered through, so that a cell's number alone says key and time. Counts before
a bin of some cells come from prefix sums in two levels (bins in a group of bins, groups in a key); within a bin they are
accumulated. Probes join the table on the cell with the range condition, and what holds is the key's count less the
component of the probe's own fold.

Nothing that grows goes through one task or the driver: events of one key and moment are combined before they are
shuffled, cells are small, and the step table is written, so that Spark can split a cell that very many probes ask for.

Defined results: lines whose sale is absent, null or without a time are dropped; null keys become -1, an ordinary id;
a parent that is null or of an unknown id is one shared value; repeated lines count as often as they occur; a sale id that
occurs in several rows of sales has a result for each of its times and clients; a dimension's repeated ids take their
least parent; any flag but `returned`, null too, is no return; empty tables give none. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from . import common as C

FOLDS = 5
#: Events of a key a cell, about: what a probe is compared with.
CELL = 16
#: A bin has 2^BIN cells: for each bin of a key there is a prefix sum.
BIN = 3
#: Groups of lines from which a moment counts as heavy: its events are combined before they are shuffled.
HEAVY = 4096
#: Parts in which the cells of keys are numbered.
SLOTS = 512
#: Rates are in millionths; a prior weighs as so many rows.
SCALE, WEIGHT, PRIOR = 1_000_000, 50, 500_000
#: Lines from which n and s are summed in columns of their own; fewer travel as one number, n * ONE + s.
MANY = 1 << 31
ONE = 1 << 32


@dataclass(frozen=True)
class Span:
    """Times lo .. lo + length, the gap added. A key of fineness f has cells of 2^(bits - f) microseconds.

    A key's number is 64 times the number of its first cell, plus its fineness.
    """

    lo: int
    length: int

    @property
    def bits(self) -> int:
        return max(1, self.length.bit_length())

    def cells(self, fine: Column) -> Column:
        """Number of the last cell of a key, its first cell being 0."""
        return F.call_function("shiftright", F.lit(self.length).cast("long"), F.lit(self.bits) - fine)

    def cell(self, key: Column, at: Column) -> Column:
        return first_of(key) + F.call_function("shiftright", at - F.lit(self.lo), F.lit(self.bits) - fine_of(key))


def first_of(key: Column) -> Column:
    return F.call_function("shiftright", key, F.lit(6))


def fine_of(key: Column) -> Column:
    return key.bitwiseAND(F.lit(63)).cast("int")


def fineness(events: Column, bits: int) -> Column:
    """The fineness at which a key of so many events has about CELL a cell."""
    return F.least(F.ceil(F.log2(F.greatest(events / CELL, F.lit(1.0)))), F.lit(bits)).cast("int")


def numbered(counts: DataFrame, span: Span) -> DataFrame:
    """Numbers of keys (id, c events): id, key. Cells are numbered in slots of keys, and slots one after the other."""
    inner = Window.partitionBy("slot").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # over SLOTS rows at most
    own = counts.withColumn("fine", fineness(F.col("c"), span.bits)).withColumn("cells", span.cells(F.col("fine")) + 1).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)))
    slots = own.groupBy("slot").agg(F.sum("cells").alias("cells")).select("slot", F.coalesce(F.sum("cells").over(outer), F.lit(0)).alias("before"))
    own = own.select("slot", "id", "fine", F.coalesce(F.sum("cells").over(inner), F.lit(0)).alias("first"))
    return own.join(slots, "slot").select("id", ((F.col("before") + F.col("first")) * 64 + F.col("fine")).alias("key"))


def wide(sums: list[str], folds: int) -> list[Column]:
    return [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in sums for f in range(folds)]


def summed(sums: list[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in sums]


def bin_of(key: Column, cell: Column) -> Column:
    """The first cell of a cell's bin."""
    first = first_of(key)
    return first + F.call_function("shiftleft", F.call_function("shiftright", cell - first, F.lit(BIN)), F.lit(BIN))


def grid(keys: DataFrame, span: Span) -> DataFrame:
    """Every bin of every key that has several, in groups of about the square root of their number: key, group, number in
    the key, bin."""
    fine, top = fine_of(F.col("key")), F.call_function("shiftright", span.cells(fine_of(F.col("key"))), F.lit(BIN))
    own = keys.where(fine > BIN).select("key", top.alias("top"), ((fine - BIN + 1) / 2).cast("int").alias("half"))
    groups = own.select("key", "top", "half", F.explode(F.expr("sequence(0L, shiftright(top, half))")).alias("group"))
    first = F.expr("shiftleft(`group`, half)")
    bins = groups.repartition("key", "group").select("key", "group", F.explode(F.sequence(first, F.least(first + F.expr("shiftleft(1L, half)") - 1, F.col("top")))).alias("number"))
    return bins.withColumn("bin", first_of(F.col("key")) + F.call_function("shiftleft", F.col("number"), F.lit(BIN)))


def steps(events: DataFrame, keys: DataFrame, sums: list[str], span: Span, gap: int = 0, folds: int = FOLDS) -> DataFrame:
    """The validity table of events (key, at, fold, heavy and sums): key, cell, after, until, and each sum by fold.

    heavy: events of which very many may share a key and a moment.
    keys: the key of every key. A step holds for times over `after` up to `until`.
    """
    each = [f"{c}{f}" for c in sums for f in range(folds)]
    events = events.withColumn("after", F.col("at") + F.lit(gap)).withColumn("bin", bin_of(F.col("key"), span.cell(F.col("key"), F.col("after"))))
    many = events.where("heavy").groupBy("bin", "key", "after", "fold").agg(*summed(sums))
    own = events.where("not heavy").select("bin", "key", "after", "fold", *sums).unionByName(many)
    # what came before each bin: sums over the bins of its group and over the groups before that
    made = events.where(fine_of(F.col("key")) > BIN).groupBy("bin").agg(*wide(sums, folds))
    made = grid(keys, span).join(made, "bin", "left").na.fill(0, each)
    inner = Window.partitionBy("key", "group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    tops = made.groupBy("key", "group").agg(*summed(each))
    tops = tops.select("key", "group", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"{c}_before") for c in each])
    made = made.select("key", "group", "number", "bin", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(c) for c in each])
    start = F.lit(span.lo) + F.call_function("shiftleft", F.col("number"), F.lit(span.bits + BIN) - fine_of(F.col("key")))
    # these hold from the bin's first moment on; their folds are numbered after the events'
    rows = F.explode(F.array(*[F.struct(F.lit(folds + f).alias("fold"), *[(F.col(f"{c}{f}") + F.col(f"{c}{f}_before")).alias(c) for c in sums]) for f in range(folds)]))
    before = made.where("number > 0").join(tops, ["key", "group"]).select("bin", "key", (start - 1).alias("after"), rows.alias("row")).select("bin", "key", "after", "row.*")
    rows = own.unionByName(before).repartition("bin").sortWithinPartitions("bin", "after").select("key", "after", "fold", *sums)
    schema = "key long, cell long, after long, until long, " + ", ".join(f"{c} long" for c in each)
    return rows.mapInArrow(C.lean(lambda batches: accumulated(batches, sums, span, folds)), schema)


def accumulated(batches: Iterator[pa.RecordBatch], sums_of: list[str], span: Span, folds: int) -> Iterator[pa.RecordBatch]:
    """Rows of bins in order of time, as steps: running sums of each fold, how long they hold, and the cells in which they
    do. A bin may lie in many batches: what goes from one to the next is its last row and its sums."""
    names = ["key", "cell", "after", "until", *[f"{c}{f}" for c in sums_of for f in range(folds)]]
    kept: tuple | None = None  # the last row: key, cell, after; its sums
    last = span.lo + span.length

    def bins(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cells of the rows' bins."""
        first = rows[0] >> 6
        start = first + ((rows[1] - first) >> BIN << BIN)
        return start, np.minimum(start + (1 << BIN) - 1, first + (np.int64(span.length) >> (span.bits - (rows[0] & 63))))

    def batch(rows: np.ndarray, until: np.ndarray, to: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        ok = np.flatnonzero(rows[2] < until)
        times = to[ok] - rows[1, ok] + 1
        at = np.repeat(ok, times)
        cell = rows[1, at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[0, at], cell, rows[2, at], until[at], *sums[:, at])], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        key, after, fold = (b.column(k).to_numpy().astype(np.int64) for k in range(3))
        m, before = b.num_rows, fold >= folds
        rows = np.stack([key, (key >> 6) + ((after + before - span.lo) >> (span.bits - (key & 63))), after])
        own = np.zeros((len(sums_of) * folds, m), np.int64)
        for k in range(len(sums_of)):
            own[k * folds + fold - folds * before, np.arange(m)] = b.column(3 + k).to_numpy()
        if kept is not None:
            rows, own = np.concatenate([kept[0], rows], axis=1), np.concatenate([kept[1], own], axis=1)
        start, end = bins(rows)
        new = start[1:] != start[:-1]
        sums = np.cumsum(own, axis=1)
        first = np.r_[0, np.flatnonzero(new) + 1]
        base = np.zeros((len(own), len(first)), np.int64)
        base[:, 1:] = sums[:, first[1:] - 1]
        sums -= np.repeat(base, np.diff(np.r_[first, rows.shape[1]]), axis=1)
        yield batch(rows[:, :-1], np.where(new, last, rows[2, 1:]), np.where(new, end[:-1], rows[1, 1:]), sums[:, :-1])
        kept = rows[:, -1:], sums[:, -1:]
    if kept is not None:
        yield batch(kept[0], np.array([last]), bins(kept[0])[1], kept[1])


def probed(df: DataFrame, table: DataFrame, level: str, sums: list[str], span: Span, folds: int = FOLDS) -> DataFrame:
    """df (with <level>_key, at, fold), its key replaced by <level>_<sum>: what holds at its time in folds not its own."""
    own = lambda c: reduce(lambda x, f: x + F.when(F.col("fold") != f, F.col(f"{c}{f}")).otherwise(0), range(folds), F.lit(0).cast("long"))
    t = table.withColumnRenamed("cell", "step_cell").drop("key")
    p = df.withColumn("cell", span.cell(F.col(f"{level}_key"), F.col("at")))
    on = (F.col("cell") == F.col("step_cell")) & (F.col("at") > F.col("after")) & (F.col("at") <= F.col("until"))
    kept = [c for c in df.columns if c != f"{level}_key"]
    return p.join(t, on, "left").select(*kept, *[F.coalesce(own(c), F.lit(0).cast("long")).alias(f"{level}_{c}") for c in sums])


def packed(sums: list[str]) -> list[Column]:
    """Columns n and s as sums has them."""
    return [F.col(c) for c in sums] if len(sums) > 1 else [(F.col("n") * F.lit(ONE) + F.col("s")).alias(sums[0])]


def part(both: str, c: str, sums: list[str]) -> Column:
    """n or s of the columns <both>_<sum>."""
    if len(sums) > 1:
        return F.col(f"{both}_{c}")
    return F.call_function("div", F.col(f"{both}_{sums[0]}"), F.lit(ONE)) if c == "n" else F.col(f"{both}_{sums[0]}") % ONE


def rate(level: str, prior: Column) -> Column:
    n, s = F.col(f"{level}_n"), F.col(f"{level}_s")
    return F.when(n < 1, prior).otherwise(F.call_function("div", F.lit(SCALE).cast("long") * s + F.lit(WEIGHT).cast("long") * prior, n + F.lit(WEIGHT).cast("long")))


def keyed(rows: DataFrame, dim: DataFrame, key: str, parent: str, at: str, above: str, span: Span) -> DataFrame:
    """For each key of rows its number and its parent's: key, <at>_key, <above>_key.

    A parent is named by the least id that has it; ids without one share a parent. A repeated id has its least parent.
    """
    own = rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("c"))
    up = dim.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(parent).alias("up")).where("id is not null")
    own = C.written(own.join(up, "id", "left"), f"encode-ids-{at}")
    tops = own.groupBy("up").agg(F.sum("c").alias("c"), F.min("id").alias("id"))
    tops = tops.join(numbered(tops.select("id", "c"), span), "id").select(F.col("up").alias("top"), F.col("key").alias(f"{above}_key"))
    ids = numbered(own.select("id", "c"), span).withColumnRenamed("key", f"{at}_key")
    own = own.join(ids, "id").join(tops, F.col("up").eqNullSafe(F.col("top")))
    return C.written(own.select(F.col("id").alias(key), f"{at}_key", f"{above}_key"), f"encode-{at}")


def encoded(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, gap: int = 0, folds: int = FOLDS) -> DataFrame:
    """Per sale, item and vendor: n_lines, n_returned, and history counts and rates of item, vendor and client, by the rates
    of kind, nation and segment, and these by the rate of all history. gap: microseconds that history must lie back."""
    spark = lines.sparkSession
    own = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(c)
    returned = F.when(F.col("flag") == "returned", 1).otherwise(0)
    groups = lines.where("sale_id is not null").groupBy("sale_id", own("item_id"), own("vendor_id")).agg(F.count("*").alias("n"), F.sum(returned).alias("s"))
    fold = (F.crc32(F.col("sale_id").cast("string").cast("binary")) % folds).cast("int")
    sold = sales.where("sale_id is not null and sold_at is not null").select("sale_id", own("client_id"), F.unix_micros(F.col("sold_at").cast("timestamp")).alias("at"), fold.alias("fold"))
    pairs = C.written(groups.join(sold, "sale_id"), "encode-pairs")
    C.free(spark)
    # what asks for no item or vendor is taken from the sales
    per_sale = C.written(pairs.groupBy("sale_id", "client_id", "at", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("groups")), "encode-per-sale")
    lo, hi, lines_of, sales_of = per_sale.agg(F.min("at"), F.max("at"), F.sum("n"), F.count("*")).first()
    if lo is None:
        lo = hi = lines_of = 0
    sums = ["n", "s"] if lines_of >= MANY else ["ns"]
    span = Span(lo, hi - lo + gap)
    # written, so that Spark knows its size and broadcasts it only where it is small
    busy = C.written(per_sale.groupBy("at").agg(F.sum("groups").alias("c")).where(F.col("c") > HEAVY).select("at"), "encode-busy")
    whole = spark.range(1).select(fineness(F.lit(sales_of), span.bits).cast("long").alias("all_key"))  # one key, whose first cell is 0

    client = keyed(per_sale, clients, "client_id", "segment", "client", "segment", span)
    item, vendor = (keyed(pairs, d, f"{x}_id", p, x, up, span) for d, x, p, up in ((items, "item", "kind", "kind"), (vendors, "vendor", "nation_id", "nation")))
    per_sale = marked(per_sale, busy).join(client, "client_id").crossJoin(F.broadcast(whole))
    per_sale = C.written(per_sale.select("sale_id", "client_id", "at", "fold", "heavy", "client_key", "segment_key", "all_key", *packed(sums)), "encode-sales")
    rows = marked(pairs, busy).join(item, "item_id").join(vendor, "vendor_id")
    rows = C.written(rows.select("sale_id", "item_id", "vendor_id", "client_id", "at", "fold", "heavy", "item_key", "kind_key", "vendor_key", "nation_key", *packed(sums)), "encode-rows")
    C.free(spark)

    low, high = {"item": item, "kind": item, "vendor": vendor, "nation": vendor}, {"client": client, "segment": client, "all": whole}
    tables = {}
    # a table a level, so that probes read their own level's steps only; its keys are those of the small tables
    for df, levels in ((rows, low), (per_sale, high)):
        for x, ids in levels.items():
            events = df.select(F.col(f"{x}_key").alias("key"), "at", "fold", "heavy", *sums)
            tables[x] = C.written(steps(events, ids.select(F.col(f"{x}_key").alias("key")).distinct(), sums, span, gap, folds), f"encode-steps-{x}", "snappy", False)
            C.free(spark)  # what one step has shuffled is let go before the next
    rows, per_sale = rows.drop("heavy"), per_sale.drop("heavy", *sums)
    for x in high:
        per_sale = probed(per_sale, tables[x], x, sums, span, folds)
    top = C.written(per_sale.drop("fold"), "encode-top")
    C.free(spark)
    for x in list(low)[:2]:
        rows = probed(rows, tables[x], x, sums, span, folds)
    rows = C.written(rows, "encode-half")
    C.free(spark)
    for x in list(low)[2:]:
        rows = probed(rows, tables[x], x, sums, span, folds)
    rows = rows.withColumnsRenamed({c: f"own_{c}" for c in sums})
    # the sale alone is the join's key, so that sorting takes one number; time and client are compared where sales meet
    same = lambda c: (F.col(c) <= F.col(f"top_{c}")) & (F.col(c) >= F.col(f"top_{c}"))
    top = top.withColumnsRenamed({c: f"top_{c}" for c in ("sale_id", "at", "client_id")})
    out = rows.join(top, (F.col("sale_id") == F.col("top_sale_id")) & same("at") & same("client_id"))
    out = out.select("sale_id", "item_id", "vendor_id", *[part(x, c, sums).alias(f"{x}_{c}") for x in ("own", *low, *high) for c in ("n", "s")])
    out = out.withColumn("all_rate", rate("all", F.lit(PRIOR).cast("long")))
    out = out.withColumns({f"{x}_rate": rate(x, F.col("all_rate")) for x in ("kind", "nation", "segment")})
    out = out.withColumns({f"{x}_rate": rate(x, F.col(f"{up}_rate")) for x, up in (("item", "kind"), ("vendor", "nation"), ("client", "segment"))})
    return out.select("sale_id", "item_id", "vendor_id", F.col("own_n").alias("n_lines"), F.col("own_s").alias("n_returned"), *[f"{x}_{c}" for x in ("item", "vendor", "client") for c in ("n", "rate")])


def marked(df: DataFrame, busy: DataFrame) -> DataFrame:
    """df with heavy: whether its moment is one of the busy ones."""
    return df.join(busy.withColumn("heavy", F.lit(True)), "at", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))


def op12_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.ship(spark)  # batches of numbers may be as long as Spark has them
    return encoded(*(C.read(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


#: crc32 of a text of ASCII, in SQL.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))))"""


def _sql() -> str:
    levels = (("all_", "1"), ("kind_", "kind"), ("nation_", "nation"), ("segment_", "segment"), ("item_", "item_id"), ("vendor_", "vendor_id"), ("client_", "client_id"))
    over = lambda v, part: f"coalesce(sum({v}) OVER (PARTITION BY {part} ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)"
    counts = ", ".join(f"CAST({over(v, k)} - {over(v, f'{k}, fold')} AS BIGINT) AS {x}{c}" for x, k in levels for c, v in (("n", "n_lines"), ("s", "n_returned")))
    by = lambda x, p: f"CASE WHEN {x}n < 1 THEN {p} ELSE (1000000 * {x}s + 50 * {p}) // ({x}n + 50) END AS {x}rate"
    return f"""WITH l AS (SELECT sale_id, coalesce(item_id, -1) AS item_id, coalesce(vendor_id, -1) AS vendor_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE flag = 'returned') AS BIGINT) AS n_returned FROM sale_lines GROUP BY ALL),
d AS (SELECT sale_id, sold_at, coalesce(client_id, -1) AS client_id, {CRC.format("CAST(sale_id AS VARCHAR)")} % 5 AS fold FROM sales WHERE sold_at IS NOT NULL),
j AS (SELECT l.*, sold_at, d.client_id, fold, kind, v.nation_id AS nation, segment FROM l JOIN d USING (sale_id) LEFT JOIN items i ON i.item_id = l.item_id LEFT JOIN vendors v ON v.vendor_id = l.vendor_id LEFT JOIN clients c ON c.client_id = d.client_id),
h AS (SELECT *, {counts} FROM j),
a AS (SELECT *, {by("all_", "500000")} FROM h),
b AS (SELECT *, {by("kind_", "all_rate")}, {by("nation_", "all_rate")}, {by("segment_", "all_rate")} FROM a)
SELECT sale_id, item_id, vendor_id, n_lines, n_returned, item_n, {by("item_", "kind_rate")}, vendor_n, {by("vendor_", "nation_rate")}, client_n, {by("client_", "segment_rate")} FROM b"""


ORACLE = _sql()
