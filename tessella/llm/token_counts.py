"""Delta-maintained token counts by source, language and tokenizer version.

Totals are additive, so they are never recounted: a batch of changes becomes signed rows (documents and tokens gained
or lost) in a ledger, and the totals after it are those before it plus the sums of its rows. Both are written under a
folder of the batch's own, and count only once its marker is there: the marker, written last and by a move that fails
where the place is taken, carries the batch's number, so of two writers that built on one state one starts anew, and a
batch that broke off leaves nothing. Committing an id again changes nothing.

The ledger is dealt to folders by a hash of the key, and a change reads only the folders that it touches. ``compact``
replaces the ledger by its net rows, as one more commit.

Changes: ``insert`` counts a document, ``delete`` takes back what is on record for its key, ``revise`` takes that back
and counts the new row, also under another source, language or tokenizer version.

Defined results: null and empty texts have no tokens but are documents; null sources and languages are groups of
their own; deleting an unknown key does nothing; inserting a key on record counts it again, as repeated rows do; rows
with a null key are counted but cannot be taken back; of several deletes or revisions of one key in a batch each row's
new counts are added but the old are taken back once. Groups whose documents all went stay away from the totals.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C

WORDS = "words"
BPE = "byte_bpe_50k"
LEDGER = "doc_id long, source string, lang string, version string, docs long, tokens long"
TOTALS = "source string, lang string, version string, docs long, tokens long"
#: Folders that the ledger is dealt to.
FOLDERS = 32


def counter(versions: dict[str, str | None]):
    """Arrow function over (op, doc_id, source, lang, text): tokens by every version. versions: tokenizer files; None counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {v: bpe.encoder(p if "/" in p else bpe.public(p)) for v, p in versions.items() if p}
        for b in batches:
            data, off = C.text_bytes(b.column(4))
            for v in versions:
                n = np.zeros(b.num_rows, np.int64)
                for i, j in C.chunks(off):
                    d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                    n[i:j] = np.diff(made[v].chunk(d, o)[1] if v in made else C.spans(~C.SPACE[d], o)[2])
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([v] * b.num_rows), pa.array(n)], names=["op", "doc_id", "source", "lang", "version", "tokens"])

    return C.lean(run)


class Rollup:
    """Totals kept in a folder of commits that driver and executors share. versions: tokenizer files; None counts words."""

    def __init__(self, spark: SparkSession, folder: str, versions: dict[str, str | None]):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), versions
        C.ship(spark)

    def _store(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _committed(self) -> list[dict]:
        """What the markers say, in order: batch, folder, first commit of the ledger, and whether it has rows."""
        fs, p = self._store(f"{self.folder}/commits")
        out = []
        for x in sorted(fs.listStatus(p) if fs.exists(p) else [], key=lambda x: x.getPath().getName()):
            with contextlib.closing(fs.open(x.getPath())) as stream:
                out.append(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        return out

    def _mark(self, number: int, said: dict) -> bool:
        """Move a marker to its place; False where another writer's has it."""
        sc = self.spark.sparkContext
        fs, made = self._store(f"{self.folder}/{said['folder']}/marker")
        with contextlib.closing(fs.create(made, True)) as stream:
            stream.write(bytearray(json.dumps(said).encode()))
        _, place = self._store(f"{self.folder}/commits/{number:012d}")
        fs.mkdirs(place.getParent())
        kind = sc._jvm.org.apache.hadoop.fs.Options.Rename
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), sc._jsc.hadoopConfiguration()).rename(made, place, sc._gateway.new_array(kind, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _ledger(self, done: list[dict], folders: list[int] | None = None) -> DataFrame:
        """Signed rows of these commits. folders: only keys of these."""
        live = [x["folder"] for x in done[done[-1]["start"] :] if x["rows"]] if done else []
        if not live:
            return self.spark.createDataFrame([], LEDGER)
        read = lambda f: self.spark.read.schema(f"{LEDGER}, folder int").parquet(f"{self.folder}/{f}/ledger")
        rows = reduce(DataFrame.unionByName, map(read, live))
        return (rows if folders is None else rows.where(F.col("folder").isin(folders))).drop("folder")

    def rows(self) -> DataFrame:
        """All signed rows on record."""
        return self._ledger(self._committed())

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens: kept by the last commit."""
        return self._totals(self._committed())

    def _totals(self, done: list[dict]) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self.folder}/{done[-1]['folder']}/totals") if done else self.spark.createDataFrame([], TOTALS)

    def _write(self, signed: DataFrame, at: str) -> bool:
        """Write rows to the ledger, one for each key and group; whether there are any."""
        sums = signed.groupBy("doc_id", "source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        folder = sums.withColumn("folder", F.pmod(F.hash("doc_id"), F.lit(FOLDERS)))
        folder.repartition(FOLDERS, "folder").write.partitionBy("folder").parquet(f"{self.folder}/{at}/ledger")
        fs, p = self._store(f"{self.folder}/{at}/ledger")
        return any(x.isDirectory() for x in fs.listStatus(p))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit changes (op, doc_id, source, lang, text) under an id; False where it was committed before."""
        changes = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
        new = changes.where(F.col("op").isin("insert", "revise")).mapInArrow(counter(self.versions), "op string, doc_id long, source string, lang string, version string, tokens long")
        new = new.select("doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("docs"), "tokens")
        gone = changes.where(F.col("op").isin("delete", "revise") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        while True:
            done = self._committed()
            if any(x["batch"] == batch for x in done):
                return False
            signed = new
            if done:
                touched = [r[0] for r in gone.select(F.pmod(F.hash("doc_id"), F.lit(FOLDERS))).distinct().collect()]
                old = self._ledger(done, touched).join(gone, "doc_id", "left_semi") if touched else self.spark.createDataFrame([], LEDGER)
                signed = signed.unionByName(old.withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))
            at = f"batches/{len(done):012d}-{uuid.uuid4().hex}"
            has = self._write(signed, at)
            after = self._totals(done)
            said = {"batch": batch, "folder": at, "start": done[-1]["start"] if done else 0, "rows": has}
            if has:
                after = after.unionByName(self._ledger([said | {"start": 0}]).select(after.columns))
            after.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0").write.parquet(f"{self.folder}/{at}/totals")
            if self._mark(len(done), said):
                return True

    def compact(self) -> bool:
        """Let the ledger start anew from its net rows; False where another commit came between."""
        done = self._committed()
        if not done:
            return False
        at = f"batches/{len(done):012d}-{uuid.uuid4().hex}"
        has = self._write(self._ledger(done), at)
        self._totals(done).write.parquet(f"{self.folder}/{at}/totals")
        return self._mark(len(done), {"batch": None, "folder": at, "start": len(done), "rows": has})


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after four batches: all are inserted, some first under a provisional source and some
    twice; the provisional ones are revised; the second copies are deleted; and the revision is delivered again."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, f"{C.shared_dir(spark)}/rollup-{uuid.uuid4().hex}", {WORDS: None, BPE: "byte_bpe_50k.json"})
    part = C.fold("doc_id", 16)
    of = lambda op, rows: rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", "text")
    provisional, copied = F.coalesce(part == 3, F.lit(False)), F.coalesce(part == 5, F.lit(False))
    # copies have keys of their own
    copies = docs.where(copied).withColumn("doc_id", F.xxhash64(F.lit("copy"), "doc_id"))
    first = docs.withColumn("source", F.when(provisional, "provisional").otherwise(F.col("source")))
    revised = of("revise", docs.where(provisional))
    rollup.commit("load", of("insert", first.unionByName(copies)))
    rollup.commit("sources", revised)
    rollup.commit("copies", of("delete", copies))
    rollup.commit("sources", revised)
    return rollup.totals()
