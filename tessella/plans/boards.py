"""Boards, rollups and joins over companies, postings and people, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as D
from ..functions import dates, text
from ..operators import joins, merge, ordered, rollups

Q: dict = {}
S: dict[str, str] = {}
WITH = "WITH " + D.SQL


def query(name: str, sql: str):
    def add(f):
        Q[name], S[name] = f, sql
        return f

    return add


def jobs(spark, d):
    """Postings with their company; every seventh is starred."""
    j = D.postings(spark, d).join(D.companies(spark, d), "company_key", "left")
    return j.withColumn("starred", F.col("row_key") % 7 == 0)


JOBS = WITH + ", jobs AS (SELECT p.*, c.company, c.sector, p.row_key % 7 = 0 AS starred FROM postings p LEFT JOIN companies c USING (company_key))"


@query(
    "company_rollup",
    WITH + """, p AS (SELECT company_key, count(*) AS people_count, count(*) FILTER (contacted) AS contacted_count, max(last_event) AS last_event FROM people GROUP BY 1),
j AS (SELECT company_key, count(*) AS jobs_count, count(*) FILTER (status IN ('applied','interview','offer')) AS applied_count, max(posted_at) AS last_posted, max(score) AS max_score,
  bool_or(status = 'offer') AS offer, bool_or(status = 'interview') AS interview, bool_and(status IN ('closed','rejected')) AS all_closed FROM postings GROUP BY 1),
b AS (SELECT *, coalesce(people_count, 0) AS pc, coalesce(jobs_count, 0) AS jc, coalesce(applied_count, 0) AS ac, coalesce(contacted_count, 0) AS cc FROM p FULL JOIN j USING (company_key) LEFT JOIN companies USING (company_key)),
s AS (SELECT *, CASE WHEN coalesce(offer, false) THEN 'offer' WHEN coalesce(interview, false) THEN 'interview' WHEN ac > 0 THEN 'applied' WHEN cc > 0 THEN 'contacted' WHEN jc > 0 THEN 'needs_contact' ELSE 'neutral' END AS rollup_status FROM b)
SELECT company_key, company, sector, pc AS people_count, jc AS jobs_count, ac AS applied_count, cc AS contacted_count, rollup_status, last_posted, last_event, max_score,
  coalesce(all_closed, false) OR (rollup_status = 'neutral' AND coalesce(last_event < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY, true)) AS archived FROM s""",
)
def company_rollup(spark, d):
    out = rollups.company_rollup(D.companies(spark, d), D.people(spark, d), D.postings(spark, d), D.EVENTS_NOW)
    return out.orderBy(F.desc_nulls_last("max_score"), "company_key")


BOARD = "SELECT row_key, company_key, company, sector, posted_at, score, status, starred FROM jobs WHERE score IS NOT NULL"
COLS = ["row_key", "company_key", "company", "sector", "posted_at", "score", "status", "starred"]


@query("board_default", JOBS + BOARD + " AND status NOT IN ('closed', 'rejected')")
def board_default(spark, d):
    return rollups.board(jobs(spark, d)).select(*COLS)


@query("board_filtered", JOBS + BOARD + " AND status NOT IN ('closed', 'rejected') AND score >= 55 AND sector = 'BUILDING' AND contains(lower(concat_ws(' ', company, sector)), '00')")
def board_filtered(spark, d):
    return rollups.board(jobs(spark, d), least=55, sector="BUILDING", query="00", search=["company", "sector"]).select(*COLS)


@query("board_of_a_day", JOBS + BOARD + " AND starred AND strftime(posted_at, '%Y-%m-%d') = (SELECT strftime(max(posted_at), '%Y-%m-%d') FROM jobs WHERE starred)")
def board_of_a_day(spark, d):
    """The newest day that has starred rows. The day is a one-row aggregate that the board is joined to."""
    j = jobs(spark, d)
    day = j.where("starred").agg(F.date_format(F.max("posted_at"), "yyyy-MM-dd").alias("day"))
    return j.where("score is not null and starred").join(F.broadcast(day), F.date_format("posted_at", "yyyy-MM-dd") == F.col("day")).select(*COLS)


@query("board_stats", JOBS + " SELECT count(*) AS total, count(*) FILTER (status IN ('applied','interview','offer')) AS applied, count(*) FILTER (status = 'rejected') AS dismissed, count(*) FILTER (starred) AS starred, count(*) FILTER (status = 'new' AND score IS NOT NULL) AS to_review FROM jobs")
def board_stats(spark, d):
    return rollups.scoreboard(jobs(spark, d))


@query("sector_counts", JOBS + " SELECT sector, count(*) AS n FROM jobs GROUP BY 1")
def sector_counts(spark, d):
    return jobs(spark, d).groupBy("sector").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sector")


@query("sector_average", JOBS + " SELECT sector, count(*) AS n, CAST(round_even(avg(score), 0) AS INTEGER) AS average, CASE WHEN round_even(avg(score), 0) >= 75 THEN 'good' WHEN round_even(avg(score), 0) >= 68 THEN 'warn' ELSE 'low' END AS tone FROM jobs GROUP BY 1")
def sector_average(spark, d):
    a = F.bround(F.avg("score"), 0).cast("int")
    return jobs(spark, d).groupBy("sector").agg(F.count("*").alias("n"), a.alias("average")).withColumn("tone", rollups.tone(F.col("average")))


@query(
    "fit_histogram",
    JOBS + """, h AS (SELECT CASE WHEN score < 70 THEN '<70' WHEN score < 75 THEN '70-74' WHEN score < 80 THEN '75-79' WHEN score < 85 THEN '80-84' WHEN score < 90 THEN '85-89' ELSE '90+' END AS bucket, count(*) AS c FROM jobs GROUP BY 1),
e AS (SELECT seq, b.bucket, coalesce(c, 0) AS n FROM (VALUES (0, '<70'), (1, '70-74'), (2, '75-79'), (3, '80-84'), (4, '85-89'), (5, '90+')) b(seq, bucket) LEFT JOIN h ON h.bucket = b.bucket)
SELECT seq, bucket, n, bucket = (SELECT bucket FROM e ORDER BY n DESC, seq LIMIT 1) AS modal FROM e""",
)
def fit_histogram(spark, d):
    return rollups.histogram(jobs(spark, d), rollups.bucket(F.col("score")), rollups.BUCKETS)


@query("funnel", JOBS + " SELECT s.stage, count(j.row_key) AS n FROM (VALUES ('to_review', 'new'), ('applied', 'applied'), ('interviewing', 'interview'), ('offer', 'offer')) s(stage, status) LEFT JOIN jobs j ON j.status = s.status GROUP BY 1")
def funnel(spark, d):
    counts = jobs(spark, d).agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in (("to_review", "new"), ("applied", "applied"), ("interviewing", "interview"), ("offer", "offer"))])
    return counts.unpivot([], ["to_review", "applied", "interviewing", "offer"], "stage", "n")


@query("pass_rate", JOBS + " SELECT count(*) FILTER (score >= 68) AS strong, count(*) FILTER (score >= 45 AND score < 68) AS fair, count(*) FILTER (score < 45) AS dropped, round_even(avg(nullif(score, 0)), 1) AS average, min(score) AS lowest, max(score) AS highest FROM jobs")
def pass_rate(spark, d):
    s = F.col("score")
    return jobs(spark, d).agg(F.count_if(s >= 68).alias("strong"), F.count_if(s.between(45, 67)).alias("fair"), F.count_if(s < 45).alias("dropped"), F.bround(F.avg(F.nullif(s, F.lit(0))), 1).alias("average"), F.min(s).alias("lowest"), F.max(s).alias("highest"))


@query("placeholder_companies", WITH + " SELECT company_key, company FROM companies c WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.company_key = c.company_key) AND EXISTS (SELECT 1 FROM postings p WHERE p.company_key = c.company_key)")
def placeholder_companies(spark, d):
    with_jobs = D.companies(spark, d).join(D.postings(spark, d), "company_key", "left_semi")
    return joins.placeholders(with_jobs, D.people(spark, d), "company_key").select("company_key", "company")


@query(
    "score_overlay",
    """WITH base AS (SELECT o_orderkey AS k, o_totalprice AS total FROM orders), over AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1)
SELECT k, coalesce(over.total, base.total) AS total, base.k IS NULL AS thin FROM base FULL JOIN over USING (k)""",
)
def score_overlay(spark, d):
    base = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    over = D.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return joins.overlay(base, over, "k", ["total"])


@query(
    "fallback_key_lookup",
    """WITH l AS (SELECT p_partkey, p_name, p_brand FROM part), r1 AS (SELECT l_partkey AS k, min(l_orderkey) AS v FROM lineitem GROUP BY 1),
r2 AS (SELECT p_name AS k, p_brand AS b, min(l_orderkey) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN r1.k IS NOT NULL THEN 1 WHEN r2.k IS NOT NULL THEN 2 END AS tier, coalesce(r1.v, r2.v) AS v FROM l LEFT JOIN r1 ON r1.k = p_partkey LEFT JOIN r2 ON r2.k = p_name AND r2.b = p_brand""",
)
def fallback_key_lookup(spark, d):
    part = D.table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    big = D.table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(part.withColumnsRenamed({"p_name": "r_name", "p_brand": "r_brand"}), F.col("l_partkey") == F.col("p_partkey")).withColumn("v", F.col("l_orderkey"))
    rules = [(F.col("p_partkey"), F.col("l_partkey")), (F.struct("p_name", "p_brand"), F.struct("r_name", "r_brand"))]
    return joins.tiers(part, big.drop("p_partkey"), rules, "l_orderkey", "v").select("p_partkey", "tier", "v")


@query("universe_union", WITH + " SELECT company_key, CAST(min(rank) AS INTEGER) AS source_rank FROM (SELECT company_key, 0 AS rank FROM people UNION ALL SELECT company_key, 1 FROM postings) GROUP BY 1")
def universe_union(spark, d):
    p, j = D.people(spark, d).select("company_key"), D.postings(spark, d).select("company_key")
    return p.withColumn("r", F.lit(0)).unionByName(j.withColumn("r", F.lit(1))).groupBy("company_key").agg(F.min("r").alias("source_rank"))


@query(
    "people_precedence_union",
    "WITH u AS (SELECT s_nationkey AS nation_key, s_name AS name, s_suppkey AS seq, 0 AS source_rank FROM supplier UNION ALL SELECT c_nationkey, c_name, c_custkey, 1 FROM customer UNION ALL SELECT n_nationkey, n_name, CAST(n_nationkey AS BIGINT), 2 FROM nation) SELECT nation_key, name, seq, CAST(source_rank AS INTEGER) AS source_rank FROM u QUALIFY row_number() OVER (PARTITION BY nation_key ORDER BY source_rank, seq) = 1",
)
def people_precedence_union(spark, d):
    pick = lambda t, k, n, s: D.table(spark, d, t).select(F.col(k).alias("nation_key"), F.col(n).alias("name"), F.col(s).cast("long").alias("seq"))
    parts = [pick("supplier", "s_nationkey", "s_name", "s_suppkey"), pick("customer", "c_nationkey", "c_name", "c_custkey"), pick("nation", "n_nationkey", "n_name", "n_nationkey")]
    return joins.precedence(parts, ["nation_key"], "seq").select("nation_key", "name", "seq", "source_rank")


@query("anti_already_sent", WITH + " SELECT company_key, company FROM companies WHERE company_key NOT IN (SELECT company_key FROM postings WHERE status IN ('applied', 'interview', 'offer'))")
def anti_already_sent(spark, d):
    sent = D.postings(spark, d).where(F.col("status").isin(rollups.APPLIED))
    return joins.placeholders(D.companies(spark, d), sent, "company_key").select("company_key", "company")


@query("semi_replied", WITH + " SELECT company_key, company, company_key IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS replied FROM companies")
def semi_replied(spark, d):
    replied = D.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("company_key"))
    return joins.flagged(D.companies(spark, d), replied, "company_key", "replied").select("company_key", "company", "replied")


@query(
    "people_with_postings",
    WITH + ", j AS (SELECT company_key, string_agg(CAST(row_key AS VARCHAR), ',' ORDER BY row_key) AS postings, count(*) AS n FROM postings GROUP BY 1) SELECT p.company_key, contacted, coalesce(postings, '') AS postings, coalesce(n, 0) AS n FROM people p LEFT JOIN j USING (company_key)",
)
def people_with_postings(spark, d):
    j = D.postings(spark, d).groupBy("company_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_key")), lambda x: x.cast("string")), ",").alias("postings"), F.count("*").alias("n"))
    return D.people(spark, d).join(j, "company_key", "left").select("company_key", "contacted", F.coalesce("postings", F.lit("")).alias("postings"), F.coalesce("n", F.lit(0)).alias("n"))


@query("domain_lookup", "SELECT s_suppkey, s_name, coalesce(r_name, 'unknown') AS domain FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def domain_lookup(spark, d):
    dim = D.table(spark, d, "nation").join(D.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return D.table(spark, d, "supplier").join(dim, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", F.coalesce("r_name", F.lit("unknown")).alias("domain"))


@query(
    "posting_rollup",
    WITH + """ SELECT company_key, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(source))), 1, 3), '; ') AS roles, max(posted_at) AS freshest, arg_max(row_key, (posted_at, -row_key)) AS freshest_key, bool_or(score >= 95) AS any_top, array_to_string(list_sort(list_distinct(list(status))), '|') AS statuses FROM postings GROUP BY 1""",
)
def posting_rollup(spark, d):
    return D.postings(spark, d).groupBy("company_key").agg(
        F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, 3), "; ").alias("roles"), F.max("posted_at").alias("freshest"),
        F.max_by("row_key", F.struct("posted_at", -F.col("row_key"))).alias("freshest_key"), F.bool_or(F.col("score") >= 95).alias("any_top"), F.array_join(F.array_sort(F.collect_set("status")), "|").alias("statuses"),
    )


@query(
    "age_buckets",
    WITH + ", a AS (SELECT date_diff('day', CAST(posted_at AS DATE), DATE '2001-08-02') AS age FROM postings) SELECT CASE WHEN age IS NULL THEN 'unknown' WHEN age <= 3 THEN '0-3d' WHEN age <= 7 THEN '4-7d' WHEN age <= 14 THEN '8-14d' ELSE 'older' END AS bucket, count(*) AS n FROM a GROUP BY 1",
)
def age_buckets(spark, d):
    age = dates.days_old(F.col("posted_at").cast("string"), F.to_date(F.lit(D.POSTINGS_NOW)))
    b = F.when(age.isNull(), "unknown").when(age <= 3, "0-3d").when(age <= 7, "4-7d").when(age <= 14, "8-14d").otherwise("older")
    return D.postings(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "drop_reasons",
    JOBS + " SELECT CASE WHEN sector IS NULL THEN 'no company' WHEN status IN ('closed', 'rejected') THEN 'closed' WHEN date_diff('day', CAST(posted_at AS DATE), DATE '2001-08-02') > 365 THEN 'stale' WHEN score < 45 THEN 'low score' ELSE 'kept' END AS drop_reason, count(*) AS n FROM jobs GROUP BY 1",
)
def drop_reasons(spark, d):
    age = dates.days_old(F.col("posted_at").cast("string"), F.to_date(F.lit(D.POSTINGS_NOW)))
    why = F.when(F.col("sector").isNull(), "no company").when(F.col("status").isin(rollups.CLOSED), "closed").when(age > 365, "stale").when(F.col("score") < 45, "low score").otherwise("kept")
    return jobs(spark, d).groupBy(why.alias("drop_reason")).agg(F.count("*").alias("n")).orderBy("drop_reason")


@query("stage_counts", WITH + " SELECT s.stage, count(p.row_key) AS n FROM (VALUES ('new'), ('applied'), ('interview'), ('offer'), ('rejected'), ('closed'), ('phone_screen')) s(stage) LEFT JOIN postings p ON p.status = s.stage GROUP BY 1")
def stage_counts(spark, d):
    stages = spark.createDataFrame([(s,) for s in ("new", "applied", "interview", "offer", "rejected", "closed", "phone_screen")], "stage string")
    n = D.postings(spark, d).groupBy(F.col("status").alias("stage")).agg(F.count("*").alias("n"))
    return stages.join(n, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


@query("source_share", WITH + " SELECT source, count(*) AS n, CAST(100 * count(*) FILTER (status = 'rejected') // count(*) AS BIGINT) AS rejected_pct FROM postings GROUP BY 1")
def source_share(spark, d):
    n = F.count("*")
    return D.postings(spark, d).groupBy("source").agg(n.alias("n"), F.floor(100 * F.count_if(F.col("status") == "rejected") / n).alias("rejected_pct"))


@query("day_list", WITH + " SELECT DISTINCT CAST(posted_at AS DATE) AS day FROM postings")
def day_list(spark, d):
    return D.postings(spark, d).select(F.to_date("posted_at").alias("day")).distinct().orderBy(F.desc("day"))


@query("day_nav", "WITH x AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT day, lag(day) OVER (ORDER BY day) AS previous, lead(day) OVER (ORDER BY day) AS next FROM x")
def day_nav(spark, d):
    return ordered.day_nav(D.table(spark, d, "events"), "ts")


@query("export_listagg", WITH + " SELECT c.company_key, c.company, string_agg(p.status || ':' || CAST(p.score AS VARCHAR), '; ' ORDER BY p.row_key) AS postings FROM companies c JOIN postings p USING (company_key) GROUP BY 1, 2")
def export_listagg(spark, d):
    j = D.postings(spark, d).join(D.companies(spark, d), "company_key")
    cell = F.concat("status", F.lit(":"), F.col("score").cast("string"))
    in_order = F.array_sort(F.collect_list(F.struct("row_key", cell.alias("cell"))))
    return j.groupBy("company_key", "company").agg(F.array_join(F.transform(in_order, lambda x: x["cell"]), "; ").alias("postings"))


@query(
    "unpivot_people",
    "SELECT n_regionkey AS region, CAST((rn - 1) // 3 AS INTEGER) AS sheet_row, CAST((rn - 1) % 3 + 1 AS INTEGER) AS person_no, n_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) WHERE trim(coalesce(n_name, '')) <> ''",
)
def unpivot_people(spark, d):
    """All nations as the persons of rows of three, and back."""
    from ..sources.files import unpivot_people as unpivot

    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    placed = D.table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.floor(n / 3).cast("int").alias("sheet_row"), (n % 3 + 1).alias("no"), "n_name")
    name = lambda k: F.max(F.when(F.col("no") == k, F.col("n_name"))).alias(f"Person {k} Name")
    return unpivot(placed.groupBy("region", "sheet_row").agg(*map(name, (1, 2, 3))), ["region", "sheet_row"], fields=("Name",))


@query("location_tree", "SELECT r_name AS country, n_name AS state, c_name AS city, r_name || ' > ' || n_name || ' > ' || c_name AS breadcrumb FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def location_tree(spark, d):
    """Countries and their states as a nested tree, to which all cities are joined; flattened, with a breadcrumb."""
    c, n, r = (D.table(spark, d, t) for t in ("customer", "nation", "region"))
    states = n.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("states"))
    tree = r.join(states, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("country"), F.explode("states").alias("s"))
    flat = c.join(tree, F.col("c_nationkey") == F.col("s.n_nationkey")).select("country", F.col("s.n_name").alias("state"), F.col("c_name").alias("city"))
    return flat.withColumn("breadcrumb", F.concat_ws(" > ", "country", "state", "city"))


@query("tracker_sorted", WITH + ", j AS (SELECT company_key, count(*) AS jobs_count, max(posted_at) AS last_posted FROM postings GROUP BY 1) SELECT company_key, company, jobs_count, last_posted FROM companies JOIN j USING (company_key)")
def tracker_sorted(spark, d):
    """Companies by their number of postings, by name among equals."""
    j = D.postings(spark, d).groupBy("company_key").agg(F.count("*").alias("jobs_count"), F.max("posted_at").alias("last_posted"))
    return D.companies(spark, d).join(j, "company_key").select("company_key", "company", "jobs_count", "last_posted").orderBy(F.desc("jobs_count"), F.lower("company"))


@query(
    "status_from_log",
    "WITH e AS (SELECT user_id, event_type AS stage, ts, event_id FROM events WHERE event_type <> 'view') SELECT user_id, arg_max(stage, (ts, event_id)) AS stage, max(ts) AS ts FROM e GROUP BY 1",
)
def status_from_log(spark, d):
    e = D.table(spark, d, "events").withColumnRenamed("event_type", "stage")
    return merge.latest_status(e, "user_id", "stage", "ts", "event_id", ["click", "purchase", "signup", "error"])


@query("first_seen", "SELECT user_id, min(ts) AS first_seen FROM events GROUP BY 1")
def first_seen(spark, d):
    return ordered.first_seen(D.table(spark, d, "events"), "user_id", "ts")


@query("daily_delta", "WITH p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), f AS (SELECT user_id, min(day) AS fd FROM p GROUP BY 1) SELECT day, count(*) AS seen, count(*) FILTER (fd < day) AS known, count(*) FILTER (fd = day) AS appended FROM p JOIN f USING (user_id) GROUP BY 1")
def daily_delta(spark, d):
    return ordered.daily_delta(D.table(spark, d, "events"), "user_id", "ts")


LOG = """WITH log AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS sent_at, min(ts) FILTER (event_type = 'purchase' AND value > 95) AS replied_at, max(ts) FILTER (event_type = 'click' AND value > 90) AS fu1_at, max(ts) FILTER (event_type = 'click' AND value > 99) AS fu2_at FROM events GROUP BY 1)"""


def outreach(spark, d):
    e, v = F.col("event_type"), F.col("value")
    return D.table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(e == "view", F.col("ts"))).alias("sent_at"), F.min(F.when((e == "purchase") & (v > 95), F.col("ts"))).alias("replied_at"), F.max(F.when((e == "click") & (v > 90), F.col("ts"))).alias("fu1_at"), F.max(F.when((e == "click") & (v > 99), F.col("ts"))).alias("fu2_at"))


@query(
    "followup_due",
    LOG + """, a AS (SELECT *, epoch(TIMESTAMP '2024-01-31' - sent_at) / 86400 AS s, epoch(TIMESTAMP '2024-01-31' - fu1_at) / 86400 AS f FROM log WHERE sent_at IS NOT NULL AND replied_at IS NULL)
SELECT user_id, sent_at, replied_at, fu1_at, fu2_at, CASE WHEN fu1_at IS NULL THEN 'fu1' ELSE 'fu2' END AS due FROM a WHERE (fu1_at IS NULL AND s >= 4) OR (fu1_at IS NOT NULL AND fu2_at IS NULL AND f >= 6)""",
)
def followup_due(spark, d):
    return ordered.followups(outreach(spark, d), dates.at(D.EVENTS_NOW)).select("user_id", "sent_at", "replied_at", "fu1_at", "fu2_at", "due")


@query("send_quota", LOG + ", a AS (SELECT * FROM log WHERE sent_at IS NOT NULL AND replied_at IS NULL) SELECT user_id, sent_at FROM a ORDER BY sent_at, user_id LIMIT 20")
def send_quota(spark, d):
    """The quota is the feature: the first twenty that still wait."""
    return ordered.quota(outreach(spark, d).where("sent_at is not null and replied_at is null").select("user_id", "sent_at"), 20, F.col("sent_at"), F.col("user_id"))


@query("reply_detection", "WITH f AS (SELECT conv_id, min(turn) AS t0, count(*) AS n FROM conversations GROUP BY 1) SELECT c.conv_id, min(turn) AS reply_turn FROM conversations c JOIN f USING (conv_id) WHERE turn > t0 AND n >= 2 AND role <> 'user' GROUP BY 1")
def reply_detection(spark, d):
    return ordered.replies(D.table(spark, d, "conversations"), "conv_id", "turn", "role", "user")


@query("business_hours", "SELECT event_type, count(*) AS n FROM events WHERE isodow(ts) <= 5 AND hour(ts) BETWEEN 9 AND 16 GROUP BY 1")
def business_hours(spark, d):
    return D.table(spark, d, "events").where(dates.business_hours(F.col("ts"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "freshness_buckets",
    """SELECT count(*) FILTER (s >= 0 AND s < 3600) AS h1, count(*) FILTER (s >= 0 AND s < 14400) AS h4, count(*) FILTER (s >= 0 AND s < 86400) AS h24, count(*) AS every FROM
(SELECT floor(epoch(TIMESTAMP '2024-01-30 12:00:00')) - floor(epoch(ts)) AS s FROM events)""",
)
def freshness_buckets(spark, d):
    now = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    v = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return D.table(spark, d, "events").agg(*[F.count_if(dates.fresh(v, b, now)).alias(n) for b, n in (("1h", "h1"), ("4h", "h4"), ("24h", "h24"), ("any", "every"))])


@query(
    "humanize_age",
    "WITH e AS (SELECT CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) AS BIGINT) AS s FROM events) SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'yesterday' ELSE (s // 86400) || 'd ago' END AS age, count(*) AS n FROM e GROUP BY 1",
)
def humanize_age(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    t = dates.ago(iso, dates.at(D.EVENTS_NOW))
    return D.table(spark, d, "events").groupBy(t.alias("age")).agg(F.count("*").alias("n"))


@query("json_props", "SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total, count(props->>'absent') AS absent FROM events GROUP BY 1")
def json_props(spark, d):
    p = F.from_json("props", "k BIGINT, absent STRING")
    return D.table(spark, d, "events").groupBy("event_type").agg(F.sum(p["k"]).alias("total"), F.count(p["absent"]).alias("absent"))


@query("company_names", r"""SELECT c_custkey, regexp_replace(trim(lower(c_name)), '\s+', ' ', 'g') AS key, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
 trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(c_name || ' Pty. Ltd'), '[.,&]', ' ', 'g'), '\s+', ' ', 'g')), '((^| )(pty|ltd|limited|pvt|private|inc|incorporated|llc|plc|corp|corporation|co|company|group))+$', '')) AS core FROM customer""")
def company_names(spark, d):
    c = F.col("c_name")
    return D.table(spark, d, "customer").select("c_custkey", text.company_key(c).alias("key"), text.slug(c).alias("slug"), text.company_core(F.concat(c, F.lit(" Pty. Ltd"))).alias("core"))


#: Names of suppliers' people: a first name and a last one spelled from the key.
PEOPLE = """p AS (SELECT s_suppkey, ['Ann', 'Bo', 'Cyril', 'Dee'][(s_suppkey % 4) + 1] AS first, translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') AS last FROM supplier)"""
FORMS = ["{first}.{last}", "{f}{last}@{domain}", "{first[0]}.{last}", "{first}{l}", "{first}"]


def _people(spark, d):
    key = F.col("s_suppkey")
    first = F.element_at(text.strings(["Ann", "Bo", "Cyril", "Dee"]), (key % 4 + 1).cast("int"))
    return D.table(spark, d, "supplier").select("s_suppkey", first.alias("first"), F.translate(key.cast("string"), "0123456789", "abcdefghij").alias("last"), F.element_at(text.strings(FORMS), (key % 5 + 1).cast("int")).alias("form"))


LOCAL = "CASE s_suppkey % 5 WHEN 0 THEN first || '.' || last WHEN 1 THEN first[1] || last WHEN 2 THEN first[1] || '.' || last WHEN 3 THEN first || last[1] ELSE first END"


@query("email_from_pattern", "WITH " + PEOPLE + f" SELECT s_suppkey, lower({LOCAL}) || '@example.com' AS address FROM p")
def email_from_pattern(spark, d):
    """Addresses by five patterns in both dialects."""
    name = F.concat("first", F.lit(" "), "last")
    return _people(spark, d).select("s_suppkey", text.email_from(name, F.lit("example.com"), F.col("form")).alias("address"))


_rules = " ".join(f"WHEN regexp_matches(v, '{rx}')" + (f" AND length(v) <= {most}" if most else "") + f" THEN '{form}'" for rx, most, form in text.LOCAL_PART_RULES)


@query("pattern_inference", "WITH " + PEOPLE + f", l AS (SELECT s_suppkey, lower({LOCAL}) AS v FROM p) SELECT s_suppkey, v AS local, CASE {_rules} END AS form FROM l")
def pattern_inference(spark, d):
    """The pattern that each address's local part looks like."""
    name = F.concat("first", F.lit(" "), "last")
    local = F.substring_index(text.email_from(name, F.lit("example.com"), F.col("form")), "@", 1)
    return _people(spark, d).select("s_suppkey", local.alias("local")).withColumn("form", text.email_pattern(F.col("local")))
