"""Follow-ups that fall due in a stream: per-key state with event-time timers.

A key's state is when it was written to, answered, and followed up. A first follow-up is due some days after the first
message, a second some days after the first follow-up, unless an answer or the follow-up itself comes before. The result
is a log of changes: a row whenever what is due of a key changes, with null where it is due no more; a key's last row
says what is due. Rows without a key are messages to nobody. A key that is finished (answered, or followed up twice) is remembered while its messages may still
come, and its state goes once it has been quiet for `keep` days.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

DAY = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("sent", "replied", "fu1", "fu2")
_STATE = StructType([*[StructField(c, LongType()) for c in (*FIELDS, "timer")], StructField("due", StringType())])


def wanted(sent: int | None, replied: int | None, fu1: int | None, fu2: int | None, first: int, second: int) -> tuple[str | None, int | None]:
    """What falls due next of a key, and when (milliseconds); None for nothing."""
    if sent is None or replied is not None or fu2 is not None:
        return None, None
    return ("fu1", sent + first) if fu1 is None else ("fu2", fu1 + second)


class Followups(StatefulProcessor):
    """Rows: kind (sent, replied, fu1, fu2) and at, in milliseconds. The first sent and reply count, the last follow-ups do."""

    def __init__(self, key: str, first_days: float = 4, second_days: float = 6, keep_days: float = 60):
        self.key, self.first, self.second, self.keep = key, int(first_days * DAY), int(second_days * DAY), int(keep_days * DAY)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("followup", _STATE)

    def _timer(self, old: int | None, new: int | None) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def _row(self, key: tuple, due: str | None, at: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "due": pd.Series([due], dtype="object"), "changed_at": [at]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *times, timer, due = self.state.get() if self.state.exists() else (None,) * 6
        now, seen = dict(zip(FIELDS, times)), 0
        for pdf in rows:
            for kind, best in (("sent", min), ("replied", min), ("fu1", max), ("fu2", max)):
                at = pdf["at"][pdf["kind"] == kind]
                if len(at):
                    own = int(best(at))
                    now[kind] = own if now[kind] is None else best(now[kind], own)
            seen = max(seen, int(pdf["at"].max()))
        mark = timerValues.getCurrentWatermarkInMs()
        next_, at = wanted(**now, first=self.first, second=self.second)
        if next_ is None and all(v is None for v in now.values()):
            return iter(())
        over = next_ if at is not None and at <= mark else None
        wait = at if next_ is not None and over is None else seen + self.keep if next_ is None else None
        self._timer(timer, wait)
        self.state.update((*(now[c] for c in FIELDS), wait, over))
        return iter([self._row(key, over, max(seen, mark, 0))] if over != due else ())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return iter(())
        *times, _, due = self.state.get()
        next_, at = wanted(*times, first=self.first, second=self.second)
        if next_ is None:
            if times[0] is not None and (times[1] is not None or times[3] is not None):
                self.state.clear()  # finished, and quiet since
            else:
                self.state.update((*times, None, due))
            return iter(())
        self.state.update((*times, None, next_))
        return iter([self._row(key, next_, int(expiredTimerInfo.getExpiryTimeInMs()))] if next_ != due else ())


def due(stream: DataFrame, key: str, first_days: float = 4, second_days: float = 6, keep_days: float = 60) -> DataFrame:
    """The log of changes of a stream of (key, kind, at) that has a watermark: key, due, changed_at in milliseconds.

    The session's state store must be RocksDB's; `drained` sees to that.
    """
    out = StructType([stream.schema[key], StructField("due", StringType()), StructField("changed_at", LongType())])
    # a test of the key alone would be asked before the watermark, which then would not see rows without a key: a clock's
    nobody = F.greatest(F.col(key).isNull(), F.col("at").isNull())
    # parts of a millisecond count as a whole one: nothing is due before its moment
    at = F.ceil(F.unix_micros(F.col("at")) / 1000).alias("at")
    rows = stream.where(~nobody).select(key, "kind", at, F.col("at").alias("event_time"))
    return rows.groupBy(key).transformWithStateInPandas(Followups(key, first_days, second_days, keep_days), outputStructType=out, outputMode="Update", timeMode="EventTime")


def drained(log: DataFrame, folder: str) -> DataFrame:
    """Run a log of changes over all that is there, appending it to a table in folder; a second run goes on from where the
    first ended. Returns the whole log. A micro-batch that is run again replaces its own rows."""
    spark = log.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/v={epoch}")

    try:
        q = log.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(StructType([*log.schema.fields, StructField("v", LongType())])).option("basePath", f"{folder}/log").parquet(f"{folder}/log/v=*")


def latest(log: DataFrame, key: str) -> DataFrame:
    """What is due of each key by the log's last word."""
    last = log.groupBy(key).agg(F.max_by("due", F.struct("v", "changed_at")).alias("due"))
    return last.where("due is not null")


def kinds(events: DataFrame) -> DataFrame:
    """Events as messages: a view opens, a high purchase answers, a high click is a follow-up, the highest the second too."""
    e, v = F.col("event_type"), F.col("value")
    kind = F.array_compact(F.array(F.when(e == "view", "sent"), F.when((e == "purchase") & (v > 95), "replied"), F.when((e == "click") & (v > 90), "fu1"), F.when((e == "click") & (v > 99), "fu2"), F.when(e == "clock", "clock")))
    return events.select("user_id", F.explode(kind).alias("kind"), "at")


def clocked(spark: SparkSession, events: DataFrame, folder: str, now: str, delay: str = "1 day") -> DataFrame:
    """A stream of events that ends with a tick of a clock, so that the watermark comes to stand at now."""
    from .events import SCHEMA

    tick = spark.sql(f"SELECT CAST(NULL AS BIGINT) AS event_id, TIMESTAMP_NTZ '{now}' + INTERVAL '{delay}' AS ts, CAST(NULL AS BIGINT) AS user_id, 'clock' AS event_type, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS STRING) AS props")
    tick.coalesce(1).write.mode("ignore").parquet(f"{folder}/clock")
    clock = spark.readStream.schema(SCHEMA).parquet(f"{folder}/clock")
    both = events.select(*clock.columns).unionByName(clock)
    return both.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
