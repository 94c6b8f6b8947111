"""The incremental queries over an append-only event source, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def files(spark: SparkSession, path: str, glob: str | None = None, each: int | None = None) -> DataFrame:
    """Parquet files of events as a stream. glob: which tables of a folder, each a file or a folder of files; each: how many
    files a micro-batch takes."""
    r = spark.readStream.schema(SCHEMA)
    r = r.option("maxFilesPerTrigger", each) if each else r
    # a filter of names would be asked of the files in a table's folder; a pattern in the path is asked of the table
    return r.parquet(f"{path}/{{{glob}}}" if glob else path)


def source(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Events as a stream in event time with a day's tolerance."""
    s = files(spark, path, glob)
    return s.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")


def first_seen(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """Earliest time of each key so far."""
    return stream.groupBy(key).agg(F.min("ts").alias("first_seen"), F.count("*").alias("n_events"))


def funnel(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts by type in tumbling windows."""
    return stream.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame) -> DataFrame:
    """Events once each, while their copies come within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, and return the resulting table: the state after each micro-batch is a version
    of it in a folder that driver and executors share, never rows on the driver. In append mode the batches add up."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/v={epoch}")

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/result/v=*")
    last = (q.lastProgress or {}).get("batchId", 0)
    return spark.read.schema(stream.schema).parquet(f"{folder}/result/v={last}")


def upsert_batches(stream: DataFrame, path: str, key: str, at: str, checkpoint: str) -> None:
    """Latest row of each key kept in a table of versions: each micro-batch makes the next from the last, and one that is
    run again changes nothing."""
    from ..operators.merge import last_by
    from ..sources.versions import Versions

    table = Versions(stream.sparkSession, path)

    def merge(batch: DataFrame, epoch: int) -> None:
        table.update(lambda old: last_by(batch if old is None else batch.unionByName(old), [key], [F.col(at)]), token=f"epoch {epoch}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
