"""Boards, rollups, histograms and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that end a posting, and those that count as applied.
CLOSED = ["closed", "rejected"]
APPLIED = ["applied", "interview", "offer"]
BUCKETS = ["<70", "70-74", "75-79", "80-84", "85-89", "90+"]


def bucket(score: Column) -> Column:
    return F.when(score < 70, "<70").when(score < 75, "70-74").when(score < 80, "75-79").when(score < 85, "80-84").when(score < 90, "85-89").otherwise("90+")


def tone(score: Column, good: int = 75, fair: int = 68) -> Column:
    return F.when(score >= good, "good").when(score >= fair, "warn").otherwise("low")


def board(jobs: DataFrame, view: str = "default", day: str | None = None, starred: bool = False, least: int | None = None, sector: str | None = None, status: str | None = None, query: str | None = None, search: list[str] = ()) -> DataFrame:
    """Filtered board in order: newest first, then score, then starred; unscored rows never show."""
    out = jobs.where(F.col("score").isNotNull())
    if view == "default":
        out = out.where(~F.col("status").isin(CLOSED))
    elif view != "all":
        out = out.where(F.col("status") == view)
    if day:
        out = out.where(F.date_format("posted_at", "yyyy-MM-dd") == day)
    if starred:
        out = out.where("starred")
    if least is not None:
        out = out.where(F.col("score") >= least)
    if sector:
        out = out.where(F.col("sector") == sector)
    if status:
        out = out.where(F.col("status") == status)
    if query:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *search)), F.lit(query.lower())))
    return out.orderBy(F.desc_nulls_last("posted_at"), F.desc("score"), F.desc("starred"), "row_key")


def company_rollup(universe: DataFrame, people: DataFrame, jobs: DataFrame, now: str, stale_days: int = 7) -> DataFrame:
    """One row a company: counts of people and postings, priority status, latest dates, best score, archived flag."""
    p = people.groupBy("company_key").agg(F.count("*").alias("people_count"), F.count_if("contacted").alias("contacted_count"), F.max("last_event").alias("last_event"))
    s = F.col("status")
    j = jobs.groupBy("company_key").agg(
        F.count("*").alias("jobs_count"), F.count_if(s.isin(APPLIED)).alias("applied_count"), F.max("posted_at").alias("last_posted"), F.max("score").alias("max_score"),
        F.bool_or(s == "offer").alias("offer"), F.bool_or(s == "interview").alias("interview"), F.bool_and(s.isin(CLOSED)).alias("all_closed"),
    )
    both = p.join(j, "company_key", "full_outer").join(universe, "company_key", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (
        F.when(F.coalesce("offer", F.lit(False)), "offer").when(F.coalesce("interview", F.lit(False)), "interview").when(n("applied_count") > 0, "applied")
        .when(n("contacted_count") > 0, "contacted").when(n("jobs_count") > 0, "needs_contact").otherwise("neutral")
    )
    quiet = F.coalesce(F.col("last_event") < F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {stale_days} DAYS"), F.lit(True))
    archived = F.coalesce("all_closed", F.lit(False)) | ((status == "neutral") & quiet)
    return both.select("company_key", "company", "sector", n("people_count").alias("people_count"), n("jobs_count").alias("jobs_count"), n("applied_count").alias("applied_count"), n("contacted_count").alias("contacted_count"), status.alias("rollup_status"), "last_posted", "last_event", "max_score", archived.alias("archived"))


def scoreboard(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.agg(F.count("*").alias("total"), F.count_if(s.isin(APPLIED)).alias("applied"), F.count_if(s == "rejected").alias("dismissed"), F.count_if("starred").alias("starred"), F.count_if((s == "new") & F.col("score").isNotNull()).alias("to_review"))


def histogram(df: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """Counts of every named bucket, also the empty ones, with the modal bucket marked (the first of equals)."""
    spark = df.sparkSession
    every = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "seq int, bucket string")
    out = every.join(df.groupBy(value.alias("bucket")).count(), "bucket", "left").select("seq", "bucket", F.coalesce("count", F.lit(0)).alias("n"))
    top = out.agg(F.max_by("bucket", F.struct("n", -F.col("seq"))).alias("modal"))
    return out.crossJoin(F.broadcast(top)).select("seq", "bucket", "n", (F.col("bucket") == F.col("modal")).alias("modal"))


def top_labels(rows: DataFrame, label: str, display: str, holder: str, seq: str, n: int, shown: int = 6) -> DataFrame:
    """The n most frequent labels (ties to the first seen), each as first displayed, with its first holders in order
    and how many more there are."""
    per = rows.groupBy(label, holder).agg(F.count("*").alias("c"), F.min(seq).alias("s"), F.min_by(display, seq).alias("d"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(label).orderBy("s", holder))
    per = per.withColumn("rank", rank)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", F.col(holder).cast("string").alias("h"))))), lambda x: x["h"]), ", ")
    out = per.groupBy(label).agg(F.sum("c").alias("n"), F.min_by("d", "s").alias("display"), F.min("s").alias("first_seen"), F.count("*").alias("holders"), names.alias("shown"))
    return out.withColumn("more", F.greatest(F.col("holders") - shown, F.lit(0))).orderBy(F.desc("n"), "first_seen", label).limit(n)


def top_k(rows: DataFrame, group: str, label: str, seq: str, k: int) -> DataFrame:
    """The k most frequent labels of each group, ties to the first encountered."""
    from pyspark.sql import Window

    c = rows.groupBy(group, label).agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first_seen", label))).where(F.col("rank") <= k)
