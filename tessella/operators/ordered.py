"""Logic over ordered rows: lines of texts, events of keys, turns of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line from 0, value) of every line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "value"))


def nearest(rows: DataFrame, key: str, order: str, anchor: Column, usable: Column, value: str) -> DataFrame:
    """Anchor rows with the nearest usable value above and below."""
    w = Window.partitionBy(key).orderBy(order)
    held = F.when(usable & ~anchor, F.col(value))
    out = rows.withColumn("above", F.last(held, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("below", F.first(held, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return out.where(anchor)


def previous_two(rows: DataFrame, key: str, order: str, anchor: Column, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("prev1", F.lag(value, 1).over(w)).withColumn("prev2", F.lag(value, 2).over(w)).where(anchor)


def sections(rows: DataFrame, key: str, order: str, header: Column, value: str) -> DataFrame:
    """Rows under the last header above them, with the header's number; rows above the first have none."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("is_header", header)
    return out.withColumn("section", F.last(F.when(F.col("is_header"), F.col(value)), True).over(w)).withColumn("section_no", F.sum(F.col("is_header").cast("int")).over(w)).where(~F.col("is_header"))


def sentence_windows(df: DataFrame, key: str, text: str, size: int = 2) -> DataFrame:
    """Every run of `size` sentences; texts of fewer give one."""
    s = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.select(key, s.alias("s")).where(F.size("s") > 0)
    count = F.greatest(F.size("s") - (size - 1), F.lit(1))
    return rows.select(key, "s", F.explode(F.sequence(F.lit(0), count - 1)).alias("start")).select(key, "start", F.array_join(F.slice("s", F.col("start") + 1, size), " ").alias("window"))


def first_seen(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(at).alias("first_seen"))


def daily_delta(events: DataFrame, key: str, at: str) -> DataFrame:
    """Of every day: keys seen, those seen before, and new ones."""
    day = F.to_date(at)
    per = events.select(F.col(key), day.alias("day")).distinct()
    first = per.groupBy(key).agg(F.min("day").alias("first_day"))
    return per.join(first, key).groupBy("day").agg(F.count("*").alias("seen"), F.count_if(F.col("first_day") < F.col("day")).alias("known"), F.count_if(F.col("first_day") == F.col("day")).alias("appended"))


def day_nav(events: DataFrame, at: str) -> DataFrame:
    """Distinct days, newest first, each with its neighbours. One row a day is all that the window sees."""
    days = events.select(F.to_date(at).alias("day")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    return days.withColumn("previous", F.lag("day").over(w)).withColumn("next", F.lead("day").over(w)).orderBy(F.desc("day"))


def followups(log: DataFrame, now: Column, first_days: float = 4, second_days: float = 10) -> DataFrame:
    """Who is due: sent without reply and old enough for a first follow-up, or for a second after the first.

    log: key, sent_at, replied_at, fu1_at, fu2_at."""
    age = lambda c: (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(c).cast("timestamp"))) / F.lit(86400.0).cast("double")
    open_ = F.col("sent_at").isNotNull() & F.col("replied_at").isNull()
    one = open_ & F.col("fu1_at").isNull() & (age("sent_at") >= first_days)
    two = open_ & F.col("fu1_at").isNotNull() & F.col("fu2_at").isNull() & (age("fu1_at") >= second_days - first_days)
    return log.withColumn("due", F.when(one, "fu1").when(two, "fu2")).where(F.col("due").isNotNull())


def quota(plan: DataFrame, n: int, *order: Column) -> DataFrame:
    return plan.orderBy(*order).limit(n)


def replies(turns: DataFrame, key: str, order: str, who: str, own: str) -> DataFrame:
    """The first message after the first that is not from the sender, of threads with two or more."""
    first = turns.groupBy(key).agg(F.min(order).alias("opened"), F.count("*").alias("n"))
    later = turns.join(first, key).where((F.col(order) > F.col("opened")) & (F.col("n") >= 2) & (F.col(who) != own))
    return later.groupBy(key).agg(F.min(order).alias("reply_turn"))
