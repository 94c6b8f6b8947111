"""Queries over evidence, people and résumés."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as D
from ..functions import people as P
from ..operators import evidence as E

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return add


@query(
    "fetch_states",
    r"""WITH r AS (SELECT doc_id, text, source FROM documents), c AS (SELECT doc_id - 1 AS doc_id, text AS cached FROM documents),
s AS (SELECT r.doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) < 350 AS b, length(trim(regexp_replace(cached, '\s+', ' ', 'g'))) >= 350 AS hit, source FROM r LEFT JOIN c USING (doc_id))
SELECT CASE WHEN NOT b THEN 'present' WHEN hit THEN 'cache' WHEN source = 'src0' THEN 'fetchable' ELSE 'blank_no_fetchable_url' END AS fetch_state, count(*) AS n FROM s GROUP BY 1""",
)
def fetch_states(spark, d):
    docs = D.documents(spark, d).select("doc_id", "text", F.when(F.col("source") == "src0", "https://www.linkedin.com/jobs/view/1").otherwise("https://x.y").alias("url"))
    cache = docs.withColumn("doc_id", F.col("doc_id") - 1)  # every document is a row, and the next one is what its cache holds
    return E.fetch_state(docs, cache, "doc_id", "text", "url").groupBy("fetch_state").agg(F.count("*").alias("n"))


@query("better_description", "SELECT source, arg_max(doc_id, (CASE lang WHEN 'en' THEN 94 WHEN 'de' THEN 35 WHEN 'fr' THEN 8 ELSE 0 END + least(length(text) // 500, 12), -doc_id)) AS doc_id FROM documents GROUP BY 1")
def better_description(spark, d):
    status = F.create_map(*map(F.lit, ("en", "jd_full_official_jsonld", "de", "jd_partial_summary_only", "fr", "jd_unavailable_robots_blocked", "es", "other")))[F.col("lang")]
    docs = D.documents(spark, d).select("source", "doc_id", "text", status.alias("status"))
    return E.better(docs, "source", "status", "text", "doc_id").select("source", "doc_id")


WORDS = {"one": ["the", "of"], "two": ["der", "die"], "three": ["que", "la"]}


def _n(w: str) -> str:
    return f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)})"


@query(
    "density_sector",
    "WITH c AS (SELECT doc_id, " + ", ".join(f"{_n(a)} AS {k}a, {_n(b)} AS {k}b" for k, (a, b) in WORDS.items()) + " FROM documents), s AS (SELECT doc_id, " + ", ".join(f"CASE WHEN ({k}a > 0 AND {k}b > 0) OR {k}a + {k}b >= 4 THEN 10 * (CAST({k}a > 0 AS INT) + CAST({k}b > 0 AS INT)) + {k}a + {k}b ELSE 0 END AS {k}" for k in WORDS) + " FROM c) SELECT doc_id, CASE WHEN greatest(one, two, three) = 0 THEN NULL WHEN one >= two AND one >= three THEN 'one' WHEN two >= three THEN 'two' ELSE 'three' END AS sector FROM s",
)
def density_sector(spark, d):
    return D.documents(spark, d).select("doc_id", E.density_sector(F.col("text"), WORDS).alias("sector"))


@query("industry_codes", "SELECT p_partkey, CASE WHEN regexp_matches(c, '^(62|582|631)') THEN 'Technology / SaaS' WHEN regexp_matches(c, '^(64|65|66)') THEN 'Financial Services' WHEN regexp_matches(c, '^(86|212|325)') THEN 'Healthcare' WHEN regexp_matches(c, '^(47|45)') THEN 'Retail / E-commerce' WHEN regexp_matches(c, '^(35|06|19|36)') THEN 'Energy / Utilities' WHEN regexp_matches(c, '^(70|73|74|69|78)') THEN 'Consulting / Professional Services' ELSE '' END AS industry FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS c FROM part)")
def industry_codes(spark, d):
    return D.table(spark, d, "part").select("p_partkey", E.industry(F.col("p_partkey").cast("string")).alias("industry"))


@query("duplicate_openers", r"SELECT conv_id, lower(regexp_extract(text, '^\s*([^\s]+)', 1)) AS opener, count(*) AS n FROM conversations WHERE regexp_extract(text, '^\s*([^\s]+)', 1) <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_openers(spark, d):
    return E.duplicate_openers(D.table(spark, d, "conversations"), "conv_id", "text")


@query("capped_evidence", "WITH p AS (SELECT source, lang, min(doc_id) AS s FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s, lang) AS k FROM p) SELECT source, string_agg(lang, '|' ORDER BY k) AS langs FROM r WHERE k <= 3 GROUP BY 1")
def capped_evidence(spark, d):
    return E.capped(D.documents(spark, d), "source", "lang", "doc_id", 3).select("source", F.array_join("values", "|").alias("langs"))


@query("newest_or_all", "WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), m AS (SELECT max(day) AS a, max(day) FILTER (event_type = 'purchase') AS h FROM e) SELECT event_id, day FROM e, m WHERE event_type = 'purchase' AND (a > coalesce(h, DATE '0001-01-01') OR day = a)")
def newest_or_all(spark, d):
    e = D.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return E.newest_or_all(e, F.col("day"), F.col("event_type") == "purchase").select("event_id", "day")


@query("label_rollup", "WITH l AS (SELECT doc_id, lang AS label FROM documents), p(label, parent) AS (VALUES ('de', 'germanic'), ('en', 'germanic'), ('fr', 'romance'), ('es', 'romance')) SELECT label, count(*) AS n FROM (SELECT DISTINCT doc_id, label FROM l UNION SELECT DISTINCT doc_id, parent FROM l JOIN p USING (label)) GROUP BY 1")
def label_rollup(spark, d):
    parents = spark.createDataFrame([("de", "germanic"), ("en", "germanic"), ("fr", "romance"), ("es", "romance")], "label string, parent string")
    return E.rolled_up(D.documents(spark, d).select("doc_id", F.col("lang").alias("label")), parents).groupBy("label").agg(F.count("*").alias("n"))


@query("summaries")
def summaries(spark, d):
    return E.summary(D.documents(spark, d), "doc_id", "text", ["the", "que", "der"])


@query("page_evidence")
def page_evidence(spark, d):
    from ..sources.html import parsed

    p = parsed(D.table(spark, d, "pages"), "page_id", "html")
    return E.page_score(p, "visible", {"data": ["the of", "que", "the"], "talent": ["der", "und die"]}, {"data": 4, "talent": 3}, F.lit(0)).select("page_id", "evidence", "angle", "found", "confidence")


PARTS = """c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 11) / 10.0 END AS hard, CASE WHEN p_partkey % 7 <> 0 THEN (p_size % 5) / 4.0 END AS soft, p_partkey % 2 = 0 AS title, p_partkey % 3 = 0 AS education, p_size % 9 AS quantified, 300 + p_size * 10 AS words, CASE WHEN p_partkey % 5 <> 0 THEN (p_size % 3) / 2.0 END AS predicted FROM part)"""


@query(
    "self_check",
    "WITH " + PARTS + " SELECT id, CAST(round_even(round(CAST(100 * (0.55 * coalesce(hard, 1) + 0.10 * coalesce(soft, 1) + 0.10 * CAST(title AS INTEGER) + 0.05 * CAST(education AS INTEGER) + 0.10 * least(1, quantified / 5.0) + 0.05 * CAST(words BETWEEN 450 AND 650 AS INTEGER) + 0.05 * coalesce(predicted, 1)) AS DOUBLE), 9), 0) AS INTEGER) AS match_rate FROM c",
)
def self_check(spark, d):
    """Match rates of drafts whose seven parts follow from a part's key and size."""
    key, size = F.col("p_partkey"), F.col("p_size")
    parts = [F.when(key % 13 != 0, size % 11 / F.lit(10.0)), F.when(key % 7 != 0, size % 5 / F.lit(4.0)), key % 2 == 0, key % 3 == 0, size % 9, size * 10 + 300, F.when(key % 5 != 0, size % 3 / F.lit(2.0))]
    return D.table(spark, d, "part").select(key.alias("id"), E.self_check(*parts).alias("match_rate"))


#: People spelled from suppliers' keys: a first name, and a last one of letters.
NAMED = """p AS (SELECT s_suppkey AS id, ['Ann', 'Bo', 'Cyril', 'Dee'][(s_suppkey % 4) + 1] AS first, translate(CAST(s_suppkey + 10 AS VARCHAR), '0123456789', 'abcdefghij') AS low FROM supplier), n AS (SELECT *, upper(low[1]) || low[2:] AS last FROM p)"""


def named(spark, d):
    key = F.col("s_suppkey")
    first = F.element_at(F.array(*map(F.lit, ("Ann", "Bo", "Cyril", "Dee"))), (key % 4 + 1).cast("int"))
    return D.table(spark, d, "supplier").select(key.alias("id"), first.alias("first"), F.initcap(F.translate((key + 10).cast("string"), "0123456789", "abcdefghij")).alias("last"))


@query("pasted_people", "WITH " + NAMED + " SELECT id, first || ' ' || CASE WHEN id % 5 = 0 THEN last[1] || '.' ELSE last END AS name, 'Head of ' || last AS title, id % 5 = 0 AS needs_review FROM n")
def pasted_people(spark, d):
    """People found in pasted lists: names doubled, beside marks, with noise around, and some with an initial."""
    n = named(spark, d)
    name = F.concat("first", F.lit(" "), F.when(F.col("id") % 5 == 0, F.concat(F.left("last", F.lit(1)), F.lit("."))).otherwise(F.col("last")))
    shown = F.when(F.col("id") % 2 == 0, F.concat(name, name)).otherwise(name)
    text = F.concat_ws("\n", shown, F.lit("· 2nd"), F.lit("Connect"), F.lit("12 mutual connections"), F.concat(F.lit("Head of "), "last"), F.lit("Follow"))
    return P.pasted_people(n.select("id", text.alias("text")), "id", "text").select("id", "name", "title", "needs_review")


@query("names_from_slugs", "WITH " + NAMED + " SELECT id, first || ' ' || last AS name FROM n")
def names_from_slugs(spark, d):
    slug = F.concat(F.lit("https://www.linkedin.com/in/"), F.lower("first"), F.lit("-"), F.lower("last"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("-a1"), F.lpad(F.col("id").cast("string"), 6, "7"), F.lit("/"))).when(F.col("id") % 3 == 1, F.concat(F.lit("-"), "id")).otherwise("?x=1"))
    return named(spark, d).select("id", P.from_slug(slug).alias("name"))


def cvs(spark, d):
    """A résumé of each supplier's person: contact lines, two jobs and a degree."""
    n = named(spark, d)
    text = F.concat_ws(
        "\n", F.concat("first", F.lit(" "), "last"), F.concat(F.lower("first"), F.lit("."), F.lower("last"), F.lit("@x.org | +61 400 "), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(" 000")),
        F.concat(F.lit("linkedin.com/in/"), F.lower("last")), F.lit("Experience"), F.concat(F.lit("Analyst, "), "last"), F.concat(F.lit("Jan "), 2000 + F.col("id") % 20, F.lit(" - Present")), F.lit("Did things"),
        F.lit("Clerk, Globex"), F.lit("2015 - 2018"), F.lit("Education:"), F.lit("BSc 2011 to 2014"),
    )
    return n.select("id", text.alias("text"))


@query(
    "resume_parts",
    "WITH " + NAMED + ", t AS (SELECT id, unnest([{'section': 'education', 'entry': 1, 'value': 'BSc 2011 to 2014', 'span': '2011 - 2014'}, {'section': 'experience', 'entry': 0, 'value': 'Analyst, ' || last, 'span': ''}, {'section': 'experience', 'entry': 1, 'value': 'Jan ' || (2000 + id % 20) || ' - Present', 'span': (2000 + id % 20) || ' - Present'}, {'section': 'experience', 'entry': 1, 'value': 'Did things', 'span': ''}, {'section': 'experience', 'entry': 1, 'value': 'Clerk, Globex', 'span': ''}, {'section': 'experience', 'entry': 2, 'value': '2015 - 2018', 'span': '2015 - 2018'}]) AS r FROM n) SELECT id, r.section, CAST(r.entry AS BIGINT) AS entry, r.value, r.span FROM t",
)
def resume_parts(spark, d):
    s = P.resume_sections(cvs(spark, d), "id", "text").where("section <> 'header'")
    return s.select("id", "section", "entry", "value", P.date_span(F.col("value")).alias("span"))


@query("resume_contact", "WITH " + NAMED + " SELECT id, first || ' ' || last AS name, lower(first) || '.' || lower(last) || '@x.org' AS email, '+61 400 ' || printf('%03d', id % 1000) || ' 000' AS phone, 'linkedin.com/in/' || lower(last) AS profile FROM n")
def resume_contact(spark, d):
    return P.contact(cvs(spark, d), "id", "text")


@query(
    "domain_scores",
    "WITH " + NAMED + " SELECT id, CASE id % 4 WHEN 0 THEN 10 * (CASE WHEN length(low) >= 3 THEN 2 ELSE 1 END) + 30 + 8 WHEN 1 THEN 10 * (CASE WHEN length(low) >= 3 THEN 2 ELSE 1 END) WHEN 2 THEN 10 ELSE 0 END AS score FROM n",
)
def domain_scores(spark, d):
    """Candidate domains of companies named after people: the whole name, its words apart, one word, none."""
    n, key, low = named(spark, d), F.col("id"), F.lower("last")
    company = F.concat(F.lit("Acme "), "last", F.lit(" Pty Ltd"))
    found = F.when(key % 4 == 0, F.concat(F.lit("acme"), low, F.lit(".com.au"))).when(key % 4 == 1, F.concat(low, F.lit("-is-acme.com"))).when(key % 4 == 2, "acme.com").otherwise("zzz.org")
    return n.select("id", E.domain_score(company, F.lit("Zz"), found).alias("score"))
