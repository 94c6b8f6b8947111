"""Follow-up timers in a stream: against the batch rule, over restarts, with late answers, and what is left of state."""

import datetime

import oracle
import pytest

from tessella.plans import registry
from tessella.streaming import events as E
from tessella.streaming import followups as U

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 3, 1)


def put(spark, folder, rows):
    """rows: (user, type, value, days since the start)."""
    data = [(i, START + DAY * at, user, kind, value, "") for i, (user, kind, value, at) in enumerate(rows)]
    spark.createDataFrame(data, E.SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, keep=5):
    events = E.files(spark, f"{folder}/in", each=1).withColumn("at", E.F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    log = U.drained(U.due(U.kinds(events), "user_id", keep_days=keep), f"{folder}/out")
    return log, {r["user_id"]: r["due"] for r in U.latest(log, "user_id").collect()}


def kept(spark, folder):
    """Users that have state."""
    return {r["key"]["user_id"] for r in spark.read.format("statestore").option("stateVarName", "followup").load(f"{folder}/out/state").collect()}


def test_timers_answers_and_expiry(spark, tmp_path):
    f = str(tmp_path)
    put(spark, f, [(1, "view", 1.0, 0), (2, "view", 1.0, 0), (3, "view", 1.0, 0), (4, "click", 99.9, 0.5), (4, "view", 1.0, 0), (None, "view", 1.0, 0)])
    assert run(spark, f)[1] == {}
    put(spark, f, [(2, "purchase", 99.0, 3), (9, "error", 1.0, 5.5)])  # 2 answers before its timer; the watermark passes day 4
    log, due = run(spark, f)  # the stream was stopped and started between these
    assert due == {1: "fu1", 3: "fu1"} and {r["user_id"] for r in log.collect()} == {1, 3}
    put(spark, f, [(1, "click", 91.0, 5), (3, "purchase", 99.0, 5.2), (9, "error", 1.0, 7)])  # followed up; a late answer takes back what was due
    log, due = run(spark, f)
    assert due == {} and [r["due"] for r in log.where("user_id = 3").orderBy("v").collect()] == ["fu1", None]
    put(spark, f, [(9, "error", 1.0, 12.5)])
    assert run(spark, f)[1] == {1: "fu2"}
    put(spark, f, [(9, "error", 1.0, 30)])
    log, due = run(spark, f)
    assert due == {1: "fu2"} and kept(spark, f) == {1}  # 2 and 3 were answered, 4 was followed up twice: all long quiet
    again = sorted(map(tuple, log.collect()), key=repr)
    assert sorted(map(tuple, run(spark, f)[0].collect()), key=repr) == again  # nothing new, nothing twice


def test_slices_and_restarts_equal_the_batch(spark, tmp_path):
    sf, f = "/root/testdata/sf0.01", str(tmp_path)
    events = spark.read.parquet(f"{sf}/events.parquet")
    for lo, hi in (("2023-01-01", "2024-01-09"), ("2024-01-09", "2024-01-16"), ("2024-01-16", "2024-01-25"), ("2024-01-25", "2025-01-01")):
        events.where(f"ts >= '{lo}' and ts < '{hi}'").coalesce(1).write.mode("append").parquet(f"{f}/in")
        if hi != "2024-01-09":  # the first run has two micro-batches to take
            run(spark, f, 60)
    put(spark, f, [(None, "clock", None, -29)])  # a day after the 31st of January
    log, _ = run(spark, f, 60)
    oracle.check(U.latest(log, "user_id").toPandas(), sf, registry.ORACLE_SQL["stream_followups"])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    oracle.check(registry.QUERIES["stream_followups"](spark, sf).toPandas(), sf, registry.ORACLE_SQL["stream_followups"])


def test_query_over_a_folder_of_files_and_at_the_very_moment(spark, tmp_path):
    """The table is a folder of files, as Spark writes it; messages are due at the moment itself, not a part of a millisecond before."""
    now, us = datetime.datetime(2024, 1, 31), datetime.timedelta(microseconds=1)
    said = [(1, "view", 1.0, now - 4 * DAY), (2, "view", 1.0, now - 4 * DAY + us), (3, "view", 1.0, now - 5 * DAY), (4, "view", 1.0, now - 9 * DAY), (4, "click", 95.0, now - 6 * DAY), (5, "view", 1.0, now - 9 * DAY), (5, "click", 95.0, now - 6 * DAY + 300 * us)]
    rows = [(i, at, user, kind, value, "") for i, (user, kind, value, at) in enumerate(said)]
    spark.createDataFrame(rows, E.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["stream_followups"](spark, str(tmp_path)).toPandas()
    assert dict(zip(got["user_id"], got["due"])) == {1: "fu1", 3: "fu1", 4: "fu2"}
    oracle.check(got, str(tmp_path), registry.ORACLE_SQL["stream_followups"])
    assert registry.QUERIES["stream_first_seen"](spark, str(tmp_path)).count() == 5
