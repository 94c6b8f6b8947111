"""Domain tables over the supplied ones: companies, postings, people, roles, texts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moments that queries over events and over postings take as now.
EVENTS_NOW = "2024-01-31 00:00:00"
POSTINGS_NOW = "2001-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df by its key over several tasks a core: for rows that are short to read and long to work on, of which a file or two
    hold all."""
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *key)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_key"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation_key"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    code, rank, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    status = (
        F.when((code == "F") & (rank == "1-URGENT") & (price > 400000), "offer")
        .when((code == "F") & (rank == "1-URGENT"), "rejected")
        .when((code == "F") & (rank == "2-HIGH") & (price > 350000), "interview")
        .when((code == "O") & (rank == "1-URGENT"), "applied")
        .when(code == "F", "closed")
        .otherwise("new")
    )
    return o.select(F.col("o_orderkey").alias("row_key"), F.col("o_custkey").alias("company_key"), F.col("o_orderdate").alias("posted_at"), F.pmod(F.col("o_orderkey") * 37, F.lit(101)).cast("int").alias("score"), status.alias("status"), rank.alias("source"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person at each company that has events; contacted once they clicked or purchased."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("company_key")).agg(F.bool_or(F.col("event_type").isin("click", "purchase")).alias("contacted"), F.max("ts").alias("last_event"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting texts, one a part: place and pay, then requirements (of three in four), years, degree, papers, residence
    and skills, in wordings that follow from the part."""
    size, key = F.col("p_size"), F.col("p_partkey")
    pick = lambda by, *said: F.element_at(F.array(*map(F.lit, said)), (by % len(said) + 1).cast("int"))
    money = lambda x: x.cast("string")
    text = F.concat_ws(
        "\n", F.concat(F.lit("We are "), "p_brand", F.lit(". "), "p_name", F.lit(" role")),
        F.concat(pick(size, "Fully remote", "Hybrid work", "On-site", "In-office days", "No set place"), F.lit(", $"), money(size * 1000 + 40000), F.lit(" - $"), money(size * 1000 + 45000), F.lit(" a year")),
        F.when(key % 4 != 0, "Requirements:").otherwise("Duties:"),
        F.when(key % 3 == 0, F.concat(F.lit("at least "), money(size % 12 + 1), F.lit(" years of work"))).when(key % 3 == 1, F.concat(money(size % 15), F.lit("+ years with tools"))).otherwise("some years"),
        pick(key, "Bachelor's degree required", "Degree preferred", "No papers needed", "No papers needed", "No papers needed"),
        F.when(key % 7 == 0, "CPA or PRINCE2 holders").otherwise("Team work"),
        F.when(key % 11 == 0, "You must be a citizen").when(key % 11 == 1, "security clearance aside, gender identity does not matter").otherwise("All are welcome"),
        F.concat(F.lit("SQL, Excel and SAP ERP skills, "), "p_type"),
    )
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    return part.select(key.alias("id"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"), text.alias("text"))


def board_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """A board's postings and its side tables: what users did, application status, packages, first sightings."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    jobs = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_key"), F.col("c_name").alias("company"), F.col("o_orderpriority").alias("role_title"), F.lit("").alias("location"), F.col("c_mktsegment").alias("sector"),
        F.when(F.col("o_orderstatus") != "P", F.pmod(F.col("o_orderkey") * 37, F.lit(101)).cast("int")).alias("match_score"),
        F.when(low, "soon").when(urgent, F.concat(iso, F.lit("T09:30:00"))).otherwise(iso).alias("jd_posted_date"),
        F.concat("c_mktsegment", F.lit("; ; "), "o_orderpriority").alias("matched_evidence"), F.lit(None).cast("string").alias("gaps"), F.when(low, "low").otherwise("ok").alias("confidence"),
    )
    state = o.where(F.col("o_orderpriority") != "2-HIGH").select(F.col("o_orderkey").alias("row_key"), urgent.cast("int").alias("starred"), low.cast("int").alias("dismissed"), F.lit(None).cast("string").alias("notes"), F.when(urgent & (F.col("o_orderstatus") == "F"), iso).alias("applied_at"))
    status = o.where(urgent & (F.col("o_totalprice") > 300000)).select(F.col("o_orderkey").alias("row_key"), F.lit("interview").alias("app_status"))
    packages = l.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("row_key")).agg(F.concat(F.lit("r"), F.count("*").cast("string")).alias("resume_file"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ", ").alias("jd_terms_missing"))
    seen = l.groupBy(F.col("l_orderkey").alias("row_key")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_seen_date"))
    return jobs, state, status, packages, seen


#: The posting texts for DuckDB.
ADVERTS = """adverts AS (SELECT p_partkey AS id, p_brand AS company, p_name AS title, concat_ws(chr(10), 'We are ' || p_brand || '. ' || p_name || ' role',
 ['Fully remote', 'Hybrid work', 'On-site', 'In-office days', 'No set place'][(p_size % 5) + 1] || ', $' || CAST(p_size * 1000 + 40000 AS VARCHAR) || ' - $' || CAST(p_size * 1000 + 45000 AS VARCHAR) || ' a year',
 CASE WHEN p_partkey % 4 <> 0 THEN 'Requirements:' ELSE 'Duties:' END,
 CASE p_partkey % 3 WHEN 0 THEN 'at least ' || CAST(p_size % 12 + 1 AS VARCHAR) || ' years of work' WHEN 1 THEN CAST(p_size % 15 AS VARCHAR) || '+ years with tools' ELSE 'some years' END,
 CASE p_partkey % 5 WHEN 0 THEN 'Bachelor''s degree required' WHEN 1 THEN 'Degree preferred' ELSE 'No papers needed' END,
 CASE WHEN p_partkey % 7 = 0 THEN 'CPA or PRINCE2 holders' ELSE 'Team work' END,
 CASE p_partkey % 11 WHEN 0 THEN 'You must be a citizen' WHEN 1 THEN 'security clearance aside, gender identity does not matter' ELSE 'All are welcome' END,
 'SQL, Excel and SAP ERP skills, ' || p_type) AS text FROM part)"""
#: The board's tables for DuckDB, joined and shaped.
BOARD = """jobs AS (SELECT o_orderkey AS row_key, c_name AS company, o_orderpriority AS role_title, c_mktsegment AS sector, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey * 37) % 101 AS INTEGER) END AS match_score,
  CASE o_orderpriority WHEN '5-LOW' THEN 'soon' WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') || 'T09:30:00' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS jd FROM orders JOIN customer ON c_custkey = o_custkey),
state AS (SELECT o_orderkey AS row_key, o_orderpriority = '1-URGENT' AS starred, o_orderpriority = '5-LOW' AS dismissed, o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS applied FROM orders WHERE o_orderpriority <> '2-HIGH'),
status AS (SELECT o_orderkey AS row_key, 'interview' AS app_status FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000),
packages AS (SELECT l_orderkey AS row_key, 'r' || count(*) AS resume_file, list_sort(list_distinct(list(l_linestatus))) AS missing FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
seen AS (SELECT l_orderkey AS row_key, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen FROM lineitem GROUP BY 1),
board AS (SELECT row_key, company, role_title, sector, match_score, coalesce(starred, false) AS starred, coalesce(dismissed, false) AS dismissed, coalesce(applied, false) AS applied, resume_file IS NOT NULL AS has_resume,
  CASE WHEN coalesce(match_score, 0) >= 75 THEN 'high' WHEN coalesce(match_score, 0) >= 55 THEN 'mid' ELSE 'low' END AS score_tone, coalesce(app_status, CASE WHEN applied THEN 'applied' ELSE 'new' END) AS status,
  CAST(coalesce(len(missing), 0) AS INTEGER) AS n_missing, CASE WHEN jd = 'soon' THEN coalesce(first_seen, '') ELSE jd[1:10] END AS job_day, CASE WHEN jd = 'soon' THEN coalesce(first_seen, '') ELSE jd END AS posted_at
  FROM jobs LEFT JOIN state USING (row_key) LEFT JOIN status USING (row_key) LEFT JOIN packages USING (row_key) LEFT JOIN seen USING (row_key))"""


#: The same carriers for DuckDB, as the head of a WITH clause.
SQL = """companies AS (SELECT c_custkey AS company_key, c_name AS company, c_mktsegment AS sector, c_acctbal AS balance, c_nationkey AS nation_key FROM customer),
postings AS (SELECT o_orderkey AS row_key, o_custkey AS company_key, o_orderdate AS posted_at, CAST((o_orderkey * 37) % 101 AS INTEGER) AS score,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'offer'
       WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'rejected'
       WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_totalprice > 350000 THEN 'interview'
       WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'applied'
       WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'new' END AS status, o_orderpriority AS source FROM orders),
people AS (SELECT user_id AS company_key, bool_or(event_type IN ('click', 'purchase')) AS contacted, max(ts) AS last_event FROM events GROUP BY user_id)"""
