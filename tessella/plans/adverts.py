"""Queries over posting texts, boards with users' state, and résumés."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as D
from ..functions import classify as K
from ..functions import dates, extract, phrases
from ..functions import text as T
from ..operators import matching, merge, state, substrings
from ..operators import resume as R

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_skills = ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b{s}\\b') THEN '{extract.shown(s)}' END" for s in extract.SKILLS)


@query(
    "advert_fields",
    "WITH " + D.ADVERTS + rf""" SELECT id, coalesce(nullif(trim(regexp_extract(text, '{extract.SALARY}')), ''), 'Not listed') AS salary,
 CASE WHEN text LIKE '%Fully remote%' THEN 'Remote' WHEN text LIKE '%Hybrid%' THEN 'Hybrid' WHEN text LIKE '%On-site%' OR text LIKE '%In-office%' THEN 'On-site' ELSE 'Unknown' END AS arrangement,
 array_to_string(list_filter([{_skills}], lambda x: x IS NOT NULL), ', ') AS skills FROM adverts""",
)
def advert_fields(spark, d):
    t = F.col("text")
    return D.adverts(spark, d).select("id", extract.salary(t).alias("salary"), extract.arrangement(t).alias("arrangement"), F.array_join(extract.skills(t), ", ").alias("skills"))


@query("place_split", "SELECT c_custkey, n_name || ', ' || r_name AS place, ['', 'Hybrid', 'Remote'][(c_custkey % 3) + 1] AS arrangement FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def place_split(spark, d):
    """Places written with their arrangement in brackets, taken apart again."""
    c, n, r = (D.table(spark, d, t) for t in ("customer", "nation", "region"))
    beside = F.element_at(T.strings(["", " (Hybrid)", " (remote)"]), (F.col("c_custkey") % 3 + 1).cast("int"))
    raw = F.concat("n_name", F.lit(", "), "r_name", beside)
    rows = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    where, how = extract.place(raw)
    return rows.select("c_custkey", where.alias("place"), how.alias("arrangement"))


REGION = "r AS (SELECT *, strpos(text, 'Requirements:') AS rp, CASE WHEN contains(text, 'Requirements:') THEN substr(text, strpos(text, 'Requirements:')) ELSE text END AS region FROM adverts)"
NEEDS = r"""y AS (SELECT *, list_max(list_transform(list_concat(regexp_extract_all(region, '(?i)\b(\d{1,2})\s*\+\s*years?\b', 1), regexp_extract_all(region, '(?i)\b(?:minimum|min\.?|at least)\s+(?:of\s+)?(\d{1,2})\s*\+?\s*years?\b', 1)), lambda x: CAST(x AS INTEGER))) AS need FROM r),
k AS (SELECT *, list_filter([CASE WHEN need > 5 THEN need || '+ years' END, CASE WHEN contains(region, 'CPA') THEN 'cpa' END, CASE WHEN contains(text, 'must be a citizen') THEN 'must be a citizen' END], lambda x: x IS NOT NULL) AS unmet,
  list_filter([CASE WHEN contains(region, 'Bachelor''s degree required') THEN 'bachelor''s' END, CASE WHEN regexp_matches(region, '(?i)\b(on-?site|in[-\s]office)\b') THEN 'onsite/relocation' END], lambda x: x IS NOT NULL) AS verify FROM y)"""


def _region(text):
    at = K.region_start(text)
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def _knockouts():
    """Of rows with their region: as a column it is found once, not in each of the tests."""
    return K.knockouts(F.col("text"), F.col("region"), years=5, certificates=["PRINCE2 Foundation"], sponsored=True)


@query(
    "knockouts",
    "WITH " + D.ADVERTS + ", " + REGION + ", " + NEEDS + r""" SELECT id, array_to_string(list_filter([CASE WHEN need IS NOT NULL THEN 'min_years:' || need || '+ years:' || CASE WHEN need <= 5 THEN 'met' ELSE 'unmet' END END,
 CASE WHEN contains(region, 'Bachelor''s degree required') THEN 'degree:bachelor''s:unknown' END, CASE WHEN contains(region, 'CPA') THEN 'certification:cpa:unmet' END, CASE WHEN contains(region, 'PRINCE2') THEN 'certification:prince2:met' END,
 CASE WHEN contains(text, 'must be a citizen') THEN 'work_authorization:must be a citizen:unmet' END, CASE WHEN regexp_matches(region, '(?i)\b(on-?site|in[-\s]office)\b') THEN 'onsite:onsite/relocation:unknown' END], lambda x: x IS NOT NULL), '; ') AS knockouts FROM k""",
)
def knockouts(spark, d):
    """Hard requirements of every posting, for a candidate of five years with one certificate who needs a sponsor."""
    said = F.transform(_knockouts(), lambda k: F.concat_ws(":", k["type"], k["detail"], k["status"]))
    return D.adverts(spark, d).withColumn("region", _region(F.col("text"))).select("id", F.array_join(said, "; ").alias("knockouts"))


SKILL_ALIASES = {"anvils": ["anvil"], "excel": ["excel"], "sap": ["sap erp", "sap"], "sql": ["sql"], "teamwork": ["team"], "widgets": ["widget"]}
SKILL_PROFILE = [("sql", True, False, False), ("excel", False, False, False), ("sap", False, False, True), ("teamwork", True, True, False), ("widgets", True, False, False), ("anvils", False, False, False)]
TRACKED = ["Steel Widget", "Anvil Maker"]


def _imp(alias: str, n: str = "1") -> str:
    return f"CASE WHEN strpos(lower(text), '{alias}') = 0 THEN 0 WHEN rp > 0 AND strpos(lower(text), '{alias}') >= rp THEN 2 * {n} ELSE {n} END"


def _sap(out: str) -> str:
    return f"CASE WHEN rp > 0 THEN {out} * 2 ELSE {out} END"


def _fit_hits(spark, d):
    """Postings with all that a score reads, and their label hits."""
    t, title = F.col("text"), F.col("title")
    a = D.adverts(spark, d).withColumn("start", K.region_start(t)).withColumn("region", F.when(F.col("start") > 0, F.substr(t, F.col("start"))).otherwise(t))
    a = a.withColumns({"k": _knockouts(), "hits": matching.alias_counts(t, SKILL_ALIASES)})
    open_ = lambda test: F.exists("k", lambda k: (k["status"] == "unmet") & test(k["type"]))
    out = F.get(F.filter("hits", lambda h: h["label"] == "sap"), F.lit(0))
    a = a.withColumns(
        {
            "unknown": F.size(K.acronyms(F.col("region"), known=["sql", "sap", "sap erp"])),
            "soft_weight": matching.soft_weight(title, t, F.col("region")),
            "lacked_weight": F.when(out.isNull(), 0).otherwise(matching.lacked(out["first_pos"], F.col("start"))),
            "unmet": open_(lambda kind: kind != "work_authorization"),
            "no_authorization": open_(lambda kind: kind == "work_authorization"),
            "senior": (F.col("start") > 0) & F.col("region").rlike(K.SENIOR_WORDS),
            "off_target": K.off_target(title, TRACKED),
            "in_region": F.col("start") > 0,
        }
    )
    per = ["unknown", "soft_weight", "lacked_weight", "unmet", "no_authorization", "senior", "off_target", "in_region"]
    hits = a.select("id", F.explode_outer("hits").alias("h"), "start", *per)
    hits = hits.select("id", "h.label", matching.importance(F.col("h.freq"), F.col("h.first_pos"), F.col("start")).alias("imp"), *per)
    return a, hits


@query(
    "fit_score",
    "WITH " + D.ADVERTS + ", " + REGION + ", " + NEEDS + rf""", i AS (SELECT *, {_imp("sql")} AS sql_, {_imp("excel")} AS excel_, {_imp("team")} AS team_, {_imp("widget")} AS widget_, {_imp("anvil")} AS anvil_,
  {_sap("2")} AS lacked, len(list_filter(list_distinct(regexp_extract_all(region, '\b([A-Z]{{2,5}})\b', 1)), lambda x: x NOT IN ({quoted([*K.ACRONYM_STOP, "SQL", "SAP"])}))) AS unknown,
  NOT regexp_matches(title, '\b(steel|widget|anvil|maker)\b') AS off FROM k),
w AS (SELECT *, sql_ + widget_ + 0.6 * (excel_ + anvil_) + lacked + 2 * unknown + 0.15 * team_ AS whole, sql_ + widget_ + 0.15 * team_ AS num FROM i),
f AS (SELECT *, (CASE WHEN contains(text, 'must be a citizen') THEN least(100 * num / (whole + 2), 25) WHEN len(unmet) > 0 THEN least(100 * num / (whole + 2), 35) ELSE 100 * num / (whole + 2) END) * CASE WHEN off THEN 0.7 ELSE 1 END AS raw FROM w),
g AS (SELECT *, CAST(round_even(round(CAST(raw AS DOUBLE), 9), 0) AS INTEGER) AS fit, list_filter([CASE WHEN sql_ > 0 THEN 'sql' END, CASE WHEN team_ > 0 THEN 'teamwork' END, CASE WHEN widget_ > 0 THEN 'widgets' END], lambda x: x IS NOT NULL) AS sup,
  list_filter([CASE WHEN anvil_ > 0 THEN 'anvils' END, CASE WHEN excel_ > 0 THEN 'excel' END, 'sap'], lambda x: x IS NOT NULL) AS lack FROM f),
c AS (SELECT *, CASE WHEN fit >= 68 THEN 'strong' WHEN fit >= 45 THEN 'fair' ELSE 'drop' END AS band, list_filter([CASE WHEN contains(text, 'must be a citizen') THEN 'work authorization required' WHEN len(unmet) > 0 THEN 'auto-reject risk: ' || array_to_string(unmet, '; ') END, CASE WHEN off THEN 'off-target role' END], lambda x: x IS NOT NULL) AS caps FROM g)
SELECT id, fit, CAST(round_even(round(CAST(100 * num / whole AS DOUBLE), 9), 0) AS INTEGER) AS coverage_pct, rp > 0 AND whole >= 4 AS enough, band, array_to_string(sup, ', ') AS supported, array_to_string(lack, ', ') AS lacking,
 CASE WHEN len(unmet) > 0 THEN 'AUTO-REJECT RISK (needs ' || array_to_string(unmet, ', ') || '); ' ELSE '' END || band || ' fit ' || fit || '% - data analyst; evidences ' || array_to_string(sup[1:3], ', ') || '; missing ' || array_to_string(lack[1:3], ', ')
  || CASE WHEN len(caps) > 0 THEN '; capped: ' || array_to_string(caps, ', ') ELSE '' END || CASE WHEN len(verify) > 0 THEN '; verify: ' || array_to_string(verify, ', ') ELSE '' END AS why FROM c""",
)
def fit_score(spark, d):
    """Every posting's score with its words: hits count twice from the requirements on; knockouts and titles cap it."""
    a, hits = _fit_hits(spark, d)
    profile = spark.createDataFrame(SKILL_PROFILE, "label string, supported boolean, soft boolean, excluded boolean")
    scored = matching.fit_score(hits, "id", profile, "unknown", "soft_weight")
    both = scored.join(a.select("id", "title", "text", "k", "senior", "off_target"), "id")
    listed = lambda c: F.filter(F.split(c, ", "), lambda x: x != "")
    why = matching.explained(F.col("band"), F.col("fit"), K.role_family(F.col("title"), F.col("text")), listed("supported"), listed("lacking"), F.col("k"), F.col("senior"), F.col("off_target"))
    return both.select("id", "fit", "coverage_pct", "enough", "band", "supported", "lacking", why.alias("why"))


NEW_PROFILE = [(label, True, False, False) if label == "anvils" else (label, *rest) for label, *rest in SKILL_PROFILE]
_AFTER = S["fit_score"]
for _was, _now in (
    ("0.6 * (excel_ + anvil_)", "0.6 * excel_ + anvil_"), ("sql_ + widget_ + 0.15 * team_ AS num", "sql_ + widget_ + anvil_ + 0.15 * team_ AS num"),
    ("list_filter([CASE WHEN sql_ > 0", "list_filter([CASE WHEN anvil_ > 0 THEN 'anvils' END, CASE WHEN sql_ > 0"), ("AS sup,\n  list_filter([CASE WHEN anvil_ > 0 THEN 'anvils' END, ", "AS sup,\n  list_filter(["),
):
    assert _was in _AFTER, _was
    _AFTER = _AFTER.replace(_was, _now)


@query("rescored_fit", f"SELECT f.id, fit, coverage_pct, enough, band, supported, lacking, contains(lower(text), 'anvil') AS recomputed FROM ({_AFTER}) f JOIN (WITH {D.ADVERTS} SELECT id, text FROM adverts) t ON t.id = f.id")
def rescored_fit(spark, d):
    """Scores once the profile has learned of anvils: only postings that name them are scored again."""
    _, hits = _fit_hits(spark, d)
    old, new = (spark.createDataFrame(p, "label string, supported boolean, soft boolean, excluded boolean") for p in (SKILL_PROFILE, NEW_PROFILE))
    stored = matching.fit_score(hits, "id", old, "unknown", "soft_weight")
    return matching.rescored(stored, hits, "id", old, new, "unknown", "soft_weight")


TERMS = {"working life": ["work", "role"], "experience": ["years of work", "years"], "spreadsheets": ["excel"], "planning": ["sap erp", "erp"]}
UNSUPPORTED = {"accounting papers": ["cpa"], "project papers": ["prince2"], "teams": ["teamwork", "team work"]}


def _hits(alias: str, text: str) -> str:
    # separators are doubled, so that hits beside each other both count
    return rf"len(regexp_extract_all(regexp_replace(lower({text}), '([^a-z0-9])', '\1\1', 'g'), '(^|[^a-z0-9]){alias.replace(' ', '  ')}([^a-z0-9]|$)'))"


def _term(label: str, names: list[str]) -> str:
    whole, below = ([_hits(a, t) for a in names] for t in ("text", "region"))
    alias = " ".join(f"WHEN {n} > 0 THEN '{a}'" for a, n in zip(names, whole))
    return f"SELECT id, '{label}' AS label, CASE WHEN rp > 0 AND {' + '.join(below)} > 0 THEN 2 ELSE 1 END AS weight, {' + '.join(whole)} AS freq, CASE {alias} END AS alias, unsupported FROM u"


@query(
    "term_weights",
    "WITH " + D.ADVERTS + ", " + REGION + ", u AS (SELECT *, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' + '.join(_hits(a, 'text') for a in names)} > 0 THEN '{label}' END" for label, names in sorted(UNSUPPORTED.items())) + "], lambda x: x IS NOT NULL), ', ') AS unsupported FROM r), t AS ("
    + " UNION ALL ".join(_term(*x) for x in TERMS.items()) + ") SELECT id, label, CAST(weight AS INTEGER) AS weight, CAST(freq AS INTEGER) AS freq, alias, unsupported FROM t WHERE freq > 0",
)
def term_weights(spark, d):
    """Each posting's terms: a term weighs two if any of its hits stands in the requirements; and labels nobody supports."""
    it = matching.term_weights(D.adverts(spark, d), "text", TERMS, UNSUPPORTED, K.region_start(F.col("text")))
    return it.select("id", F.explode("terms").alias("t"), "unsupported").select("id", "t.label", "t.weight", "t.freq", "t.alias", F.array_join("unsupported", ", ").alias("unsupported"))


@query(
    "person_drafts",
    r"""WITH p AS (SELECT vendor_id, coalesce(name, '') AS name, lower(coalesce(name, '')) AS nm, lower(regexp_extract(coalesce(name, ''), '^\s*(\S+)', 1)) AS first FROM vendors), d AS (SELECT client_id AS seq, replace(name, ' ', '-') AS slug FROM clients WHERE name IS NOT NULL)
SELECT vendor_id, name, arg_min(slug, seq) AS draft, min(seq) AS seq FROM p LEFT JOIN d ON (first <> '' AND contains(lower(slug), first)) OR contains(nm, replace(lower(slug), '-', ' ')) GROUP BY 1, 2""",
)
def person_drafts(spark, d):
    """Each vendor's person with the first client draft that names them."""
    people = D.table(spark, d, "vendors").select("vendor_id", F.coalesce("name", F.lit("")).alias("name"))
    drafts = D.table(spark, d, "clients").where("name is not null").select(F.col("client_id").alias("seq"), F.replace("name", F.lit(" "), F.lit("-")).alias("draft"))
    return substrings.first_contained(people, drafts, "name", "draft", "seq")


AUTH = """a AS (SELECT id, company, title, text, CASE id % 6 WHEN 0 THEN 'https://boards.greenhouse.io/x/jobs/' || id WHEN 1 THEN 'https://www.seek.com.au/job/' || id WHEN 2 THEN 'https://careers.acme.com/' || id WHEN 3 THEN 'https://acme.com/' || id WHEN 4 THEN '' ELSE 'https://gmail.com/x' END AS url,
 CASE WHEN id % 6 = 2 THEN 'acme.com' WHEN id % 6 = 4 AND id % 4 = 0 THEN 'gmail.com' ELSE '' END AS domain, CASE WHEN id % 9 = 0 THEN '' ELSE 'Perth' END AS location FROM adverts)"""


@query(
    "authenticity",
    "WITH " + D.ADVERTS + ", " + AUTH + """, s AS (SELECT *, 70 + CASE WHEN url = '' THEN -15 ELSE 10 END + CASE WHEN length(text) >= 350 THEN 10 ELSE 0 END + CASE WHEN location = '' THEN 0 ELSE 5 END
  + CASE WHEN domain = 'gmail.com' THEN -35 WHEN domain <> '' THEN 8 WHEN id % 6 = 3 THEN 5 WHEN id % 6 = 5 THEN 0 ELSE -5 END + CASE id % 6 WHEN 0 THEN 18 WHEN 1 THEN 22 WHEN 2 THEN 20 WHEN 3 THEN 20 WHEN 4 THEN 0 ELSE -8 END AS raw FROM a),
c AS (SELECT *, CAST(greatest(0, least(100, raw)) AS INTEGER) AS score FROM s)
SELECT id, score, CASE WHEN score < 30 THEN 'reject_suspicious' WHEN id % 6 IN (2, 3) AND score >= 80 THEN 'verified_company_source' WHEN id % 6 IN (0, 1) AND score >= 70 THEN 'trusted_alert_source' WHEN score >= 45 THEN 'needs_company_confirmation' ELSE 'reject_low_authenticity' END AS status,
 array_to_string(list_filter([CASE WHEN url = '' THEN 'missing job URL' END, CASE WHEN length(text) < 350 THEN 'short or missing JD text' END,
  CASE WHEN domain = 'gmail.com' THEN 'company_domain is a free email domain (gmail.com)' WHEN domain <> '' THEN NULL WHEN id % 6 = 3 THEN 'inferred company_domain from job URL (acme.com)' WHEN id % 6 = 5 THEN NULL ELSE 'company domain not provided' END,
  CASE id % 6 WHEN 0 THEN 'trusted ATS source' WHEN 1 THEN 'trusted job-board source (seek)' WHEN 2 THEN 'job URL host matches company domain' WHEN 3 THEN 'job URL host matches company domain' WHEN 5 THEN 'unrecognized job URL host (gmail.com)' END], lambda x: x IS NOT NULL), '; ') AS notes FROM c""",
)
def authenticity(spark, d):
    key = F.col("id") % 6
    url = (
        F.when(key == 0, F.concat(F.lit("https://boards.greenhouse.io/x/jobs/"), "id")).when(key == 1, F.concat(F.lit("https://www.seek.com.au/job/"), "id")).when(key == 2, F.concat(F.lit("https://careers.acme.com/"), "id"))
        .when(key == 3, F.concat(F.lit("https://acme.com/"), "id")).when(key == 4, "").otherwise("https://gmail.com/x")
    )
    domain = F.when(key == 2, "acme.com").when((key == 4) & (F.col("id") % 4 == 0), "gmail.com").otherwise("")
    posting = {"company": F.col("company"), "role": F.col("title"), "url": url, "text": F.col("text"), "domain": domain, "location": F.when(F.col("id") % 9 == 0, "").otherwise("Perth")}
    rated = K.authenticity(D.adverts(spark, d), posting)
    return rated.select("id", "score", "status", F.array_join("notes", "; ").alias("notes"))


PHRASES = "p AS (SELECT p_partkey AS id, ['manage', 'providing', 'carry out', 'use of the', 'paint', 'Monitoring', 'building'][(p_partkey % 7) + 1] || ' ' || p_name || ['', ' records', ' services', ' data'][(p_partkey % 4) + 1] AS phrase FROM part)"


@query(
    "bare_nouns",
    "WITH " + PHRASES + f""", w AS (SELECT id, phrase, string_split(lower(phrase), ' ') AS w FROM p), v AS (SELECT id, phrase, w, list_contains([{quoted(phrases.SKILL_VERBS)}], w[1]) OR (ends_with(w[1], 'ing') AND length(w[1]) > 4 AND (list_contains([{quoted(phrases.SKILL_VERBS)}], w[1][:-4]) OR list_contains([{quoted(phrases.SKILL_VERBS)}], w[1][:-4] || 'e'))) AS verb FROM w),
a AS (SELECT id, phrase, verb, CASE WHEN list_contains([{quoted(phrases.PARTICLES)}], w[2]) THEN w[3:] ELSE w[2:] END AS r FROM v), b AS (SELECT id, phrase, verb, CASE WHEN r[1] IN ('a', 'an', 'the') THEN r[2:] ELSE r END AS r FROM a)
SELECT id, phrase, CASE WHEN verb AND len(r) >= 2 AND NOT list_contains([{quoted(phrases.GENERIC_HEADS)}], r[-1]) AND length(array_to_string(r, ' ')) >= 6 THEN array_to_string(r, ' ') END AS alias FROM b""",
)
def bare_nouns(spark, d):
    """Aliases left of phrases whose leading verb is taken off."""
    key = F.col("p_partkey")
    verb = F.element_at(T.strings(["manage", "providing", "carry out", "use of the", "paint", "Monitoring", "building"]), (key % 7 + 1).cast("int"))
    tail = F.element_at(T.strings(["", " records", " services", " data"]), (key % 4 + 1).cast("int"))
    p = D.table(spark, d, "part").select(key.alias("id"), F.concat(verb, F.lit(" "), "p_name", tail).alias("phrase"))
    return p.select("id", "phrase", phrases.bare_noun(F.col("phrase")).alias("alias"))


@query(
    "page_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN o_orderdate < DATE '2000-01-01' THEN '' WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%-d %B %Y') WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE '' END AS page_date, 'Order ' || o_orderkey AS og_title
FROM orders""",
)
def page_dates(spark, d):
    """Dates found again in pages that state them as a property, in words, shortly, or not at all; in words only dates of this
    century are known."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    head = F.when(key % 4 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('">'))).otherwise("")
    said = F.when(key % 4 == 1, F.concat(F.lit("posted on "), F.date_format(day, "d MMMM yyyy"))).when(key % 4 == 2, F.concat(F.lit("since "), F.date_format(day, "MMM d, yyyy"))).otherwise("undated")
    page = F.concat(F.lit("<html><head>"), head, F.lit('<meta property="og:title" content="Order '), key.cast("string"), F.lit('"></head><body>'), said, F.lit("</body></html>"))
    rows = D.table(spark, d, "orders").select("o_orderkey", page.alias("html"))
    return rows.select("o_orderkey", extract.page_date(F.col("html"), T.strip_tags(F.col("html"))).alias("page_date"), extract.open_graph(F.col("html"))["title"].alias("og_title"))


@query(
    "mail_checks",
    """WITH a AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'noreply@acme.com.au' WHEN 1 THEN 'logo' || s_suppkey || '@2x.png' WHEN 2 THEN 'info' || s_suppkey || '@mail.acme.com.au' WHEN 3 THEN 'x@example.com' ELSE 'ann@other.org' END AS address, printf('%08d', s_suppkey) AS n FROM supplier)
SELECT s_suppkey, address, s_suppkey % 5 IN (0, 1, 3) AS bad, s_suppkey % 5 IN (0, 2) AS of_site, '03 ' || n[1:4] || ' ' || n[5:8] AS phone FROM a""",
)
def mail_checks(spark, d):
    key = F.col("s_suppkey")
    address = F.when(key % 5 == 0, "noreply@acme.com.au").when(key % 5 == 1, F.concat(F.lit("logo"), key, F.lit("@2x.png"))).when(key % 5 == 2, F.concat(F.lit("info"), key, F.lit("@mail.acme.com.au"))).when(key % 5 == 3, "x@example.com").otherwise("ann@other.org")
    n = F.lpad(key.cast("string"), 8, "0")
    text = F.concat(F.lit("call 03 "), F.left(n, F.lit(4)), F.lit("-"), F.right(n, F.lit(4)), F.lit(" now"))
    a = D.table(spark, d, "supplier").select("s_suppkey", address.alias("address"), text.alias("text"))
    return a.select("s_suppkey", "address", extract.bad_mail(F.col("address")).alias("bad"), extract.mail_of_site(F.col("address"), F.lit("https://www.acme.com.au/contact")).alias("of_site"), F.get(extract.phones(F.col("text")), F.lit(0)).alias("phone"))


@query("posting_days", """WITH a AS (SELECT o_orderkey, o_orderdate AS t, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-07-25') AS d FROM orders)
SELECT o_orderkey, CASE WHEN d < 0 THEN strftime(t, '%b %d') WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || 'd ago' WHEN d < 30 THEN (d // 7) || 'w ago' WHEN d < 365 THEN (d // 30) || 'mo ago' ELSE strftime(t, '%b %Y') END AS posted FROM a""")
def posting_days(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return D.table(spark, d, "orders").select("o_orderkey", dates.relative_day(iso, F.to_date(F.lit("2001-07-25"))).alias("posted"))


@query("just_posted", "SELECT event_type, count(*) FILTER (floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-15 12:00:00') AND epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch(ts)) < 1800) AS just_posted, count(*) AS n FROM events GROUP BY 1")
def just_posted(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return D.table(spark, d, "events").groupBy("event_type").agg(F.count_if(dates.just_posted(iso, F.to_timestamp(F.lit("2024-01-15 12:00:00")))).alias("just_posted"), F.count("*").alias("n"))


NOW = "2001-07-25 12:00:00"
SHOWN = ["row_key", "company", "role_title", "sector", "match_score", "starred", "dismissed", "applied", "has_resume", "score_tone", "status", "job_day", "posted_at"]


def _board(spark, d):
    return state.shaped(state.joined(*D.board_tables(spark, d)))


def _shown(rows):
    return rows.select(*SHOWN, F.size("missing_list").alias("n_missing"))


@query("state_board", "WITH " + D.BOARD + " SELECT * FROM board WHERE match_score IS NOT NULL AND NOT applied AND NOT dismissed")
def state_board(spark, d):
    """The board that users open: scored, not applied to, not dismissed."""
    return _shown(state.board(_board(spark, d), F.to_timestamp(F.lit(NOW))))


@query(
    "state_board_filtered",
    "WITH " + D.BOARD + """ SELECT * FROM board WHERE match_score >= 20 AND applied = false AND sector = 'FURNITURE' AND status = 'new' AND contains(lower(company || ' ' || role_title || '  ' || sector), '00') AND CASE WHEN contains(posted_at, 'T') THEN epoch(TIMESTAMP '2001-07-25 12:00:00' - CAST(posted_at AS TIMESTAMP)) >= 0 AND epoch(TIMESTAMP '2001-07-25 12:00:00' - CAST(posted_at AS TIMESTAMP)) < 86400
 WHEN posted_at = '' THEN false ELSE epoch(TIMESTAMP '2001-07-25 12:00:00' - CAST(posted_at AS TIMESTAMP)) < 172800 END""",
)
def state_board_filtered(spark, d):
    """Every kind of filter at once, dismissed rows included: those posted within a day of now."""
    return _shown(state.board(_board(spark, d), F.to_timestamp(F.lit(NOW)), show_dismissed=True, least=20, sector="FURNITURE", status="new", query="00", fresh="24h"))


@query("state_board_starred", "WITH " + D.BOARD + " SELECT * FROM board WHERE match_score IS NOT NULL AND starred AND NOT dismissed")
def state_board_starred(spark, d):
    return _shown(state.board(_board(spark, d), F.to_timestamp(F.lit(NOW)), view="starred"))


@query(
    "state_board_counts",
    "WITH " + D.BOARD + ", c AS (SELECT count(*) AS all_total, count(*) FILTER (applied) AS all_applied, count(*) FILTER (dismissed) AS all_dismissed, count(*) FILTER (starred) AS all_starred, count(*) FILTER (NOT applied AND NOT dismissed) AS all_to_review FROM board WHERE match_score IS NOT NULL) SELECT row_key, c.* FROM board, c WHERE match_score >= 90 AND NOT applied AND NOT dismissed",
)
def state_board_counts(spark, d):
    """Rows of a filtered board beside the counts over all rows."""
    rows = _board(spark, d)
    return state.with_counts(state.board(rows, F.to_timestamp(F.lit(NOW)), least=90).select("row_key"), rows)


GROUPS = "g AS (SELECT company_key, company, min(posted_at) AS added_key, max(score) AS max_score, count(*) FILTER (status IN ('applied', 'interview', 'offer')) AS applied_count, max(posted_at) AS last_activity FROM companies JOIN postings USING (company_key) GROUP BY 1, 2)"


def _groups(spark, d):
    p = D.postings(spark, d).groupBy("company_key").agg(F.min("posted_at").alias("added_key"), F.max("score").alias("max_score"), F.count_if(F.col("status").isin("applied", "interview", "offer")).alias("applied_count"), F.max("posted_at").alias("last_activity"))
    return D.companies(spark, d).select("company_key", "company").join(p, "company_key")


def _tracker(sort: str) -> None:
    query(f"tracker_by_{sort}", "WITH " + D.SQL + ", " + GROUPS + " SELECT * FROM g")(lambda spark, d: state.tracker(_groups(spark, d), sort))


for _sort in state.SORTS:
    _tracker(_sort)

KINDS = {"click": "applied", "purchase": "unapplied", "view": "dismissed", "signup": "restored", "error": "crashed"}


@query(
    "event_fold",
    "WITH e AS (SELECT user_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + """ END AS kind, ts, event_id FROM events)
SELECT user_id, coalesce(arg_max(kind = 'applied', (ts, event_id)) FILTER (kind IN ('applied', 'unapplied')), false) AS applied, coalesce(arg_max(kind = 'dismissed', (ts, event_id)) FILTER (kind IN ('dismissed', 'restored')), false) AS dismissed, max(ts) AS changed_at FROM e WHERE kind <> 'crashed' GROUP BY 1""",
)
def event_fold(spark, d):
    """State left by a log to which a second half of events was appended; kinds that are none are refused."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    e = D.table(spark, d, "events").select("user_id", kind.alias("event_type"), "ts", "event_id")
    half = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return state.folded(state.append_events(state.append_events(e.limit(0), e.where(half)), e.where(~half)), "user_id", "event_type", "ts", "event_id")


@query(
    "stage_moves",
    "WITH e AS (SELECT user_id, event_type AS stage, event_id FROM events), k AS (SELECT user_id, arg_max(stage, event_id) FILTER (stage IN ('view', 'click', 'purchase')) AS stage, count(*) FILTER (stage NOT IN ('view', 'click', 'purchase')) AS refused FROM e GROUP BY 1) SELECT user_id, coalesce(stage, 'lead') AS stage, refused FROM k",
)
def stage_moves(spark, d):
    """Stages after a stream of changes, and how many of each key's were refused as their stage is no part of the flow."""
    e = D.table(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), "event_id")
    start = e.select("user_id").distinct().withColumn("stage", F.lit("lead"))
    out, refused = state.moved(start, e, "user_id", "stage", "event_id", ["view", "click", "purchase"])
    return out.join(refused.groupBy("user_id").agg(F.count("*").alias("refused")), "user_id", "left").select("user_id", "stage", F.coalesce("refused", F.lit(0)).alias("refused"))


@query(
    "people_migration",
    "SELECT c_custkey AS person_key, CAST(c_nationkey AS VARCHAR) AS company_key, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS company_name, c_name AS name, c_mktsegment AS title, '' AS email, coalesce(outreach_status, 'not_contacted') AS outreach_status, '' AS notes FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS outreach_status FROM events GROUP BY 1) ON user_id = c_custkey",
)
def people_migration(spark, d):
    """People moved once into an empty table; moving them again changes nothing."""
    none = F.lit(None).cast("string")
    people = D.table(spark, d, "customer").select(F.col("c_custkey").alias("person_key"), F.col("c_nationkey").cast("string").alias("company_key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.lit("").alias("verified_email"), none.alias("created_at"))
    log = D.table(spark, d, "events").groupBy(F.col("user_id").alias("person_key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("outreach_status"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("updated_at"))
    names = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("company_key"), F.col("n_name").alias("company_name"))
    empty = spark.createDataFrame([], "person_key long, company_key string, company_name string, name string, title string, email string, outreach_status string, notes string, created_at string, updated_at string")
    once = state.migrated(empty, people, log, names)
    return state.migrated(once, people.withColumn("name", F.lit("again")), log, names).drop("created_at", "updated_at")


@query(
    "conflict_update",
    "WITH n AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1), l AS (SELECT n.o_custkey, o_orderpriority AS name, o_orderstatus AS stage FROM n JOIN orders ON o_orderkey = k) SELECT coalesce(user_id, o_custkey) AS id, coalesce(l.name, 'known') AS name, CASE WHEN user_id IS NULL THEN l.stage ELSE 'kept' END AS stage FROM (SELECT DISTINCT user_id FROM events) FULL JOIN l ON o_custkey = user_id",
)
def conflict_update(spark, d):
    """Known keys take a new name and keep their stage; unknown ones are added whole."""
    table = D.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().withColumns({"name": F.lit("known"), "stage": F.lit("kept")})
    new = D.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("stage"), F.col("o_orderkey").alias("seq"))
    return state.on_conflict(table, new, "id", ["name"], "seq")


@query(
    "named_universe",
    "WITH u AS (SELECT s_nationkey AS k, s_name AS name, 0 AS r, s_suppkey AS q FROM supplier UNION ALL SELECT c_nationkey, c_name, 1, c_custkey FROM customer) SELECT k AS nation_key, arg_min(name, (r, q)) AS name, CAST(min(r) AS INTEGER) AS source_rank FROM u GROUP BY 1",
)
def named_universe(spark, d):
    s = D.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation_key"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    c = D.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation_key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    return state.named_universe([s, c], "nation_key", "name", "seq")


@query("company_filter", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON lower(trim(replace(s_name, 'Supplier', ' customer '))) = lower(trim(replace(c_name, 'Customer', 'CUSTOMER ')))")
def company_filter(spark, d):
    """Rows of two tables that meet by a name's key: trimmed, in lower case, inner blanks as they are."""
    s = D.table(spark, d, "supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit(" customer ")).alias("s"))
    c = D.table(spark, d, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer"), F.lit("CUSTOMER ")).alias("c"))
    return s.join(c, F.lower(F.trim("s")) == F.lower(F.trim("c"))).select("s_suppkey", "c_custkey")


@query("qa_sample", "SELECT doc_id, source FROM documents ORDER BY md5('qa:' || doc_id), doc_id LIMIT 25")
def qa_sample(spark, d):
    """25 documents to look at: the number is the feature, and a seed picks them."""
    return state.qa_sample(D.documents(spark, d).select("doc_id", "source"), "doc_id", 25, "qa")


@query("onboarding", "WITH " + D.SQL + ", n AS (SELECT company_key, count(*) FILTER (status = 'new') AS n FROM postings GROUP BY 1) SELECT company_key, CASE WHEN contacted IS NULL OR NOT contacted THEN 'NEEDS_RESUME' WHEN coalesce(n, 0) = 0 THEN 'NEEDS_POSITIONS' ELSE 'READY' END AS onboarding FROM companies LEFT JOIN people USING (company_key) LEFT JOIN n USING (company_key)")
def onboarding(spark, d):
    n = D.postings(spark, d).groupBy("company_key").agg(F.count_if(F.col("status") == "new").alias("n"))
    rows = D.companies(spark, d).select("company_key").join(D.people(spark, d), "company_key", "left").join(n, "company_key", "left")
    return rows.select("company_key", state.onboarding(F.col("contacted"), F.col("n")).alias("onboarding"))


@query(
    "posting_dedupe",
    r"""WITH p AS (SELECT l_orderkey AS k, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS q, CASE l_returnflag WHEN 'A' THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS iso, l_linestatus AS source FROM lineitem)
SELECT k AS company, coalesce(arg_min(iso, (q, iso)) FILTER (iso <> ''), '') AS posted_at_iso, 'line ' || coalesce(min(q) FILTER (iso <> ''), min(q)) AS posted_relative, string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM p GROUP BY 1""",
)
def posting_dedupe(spark, d):
    """Postings of one company and title: the first is the base, a missing date comes with its relative text from the
    first that has one, sources are united."""
    seq = F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 10**6 + F.col("l_suppkey")
    iso = F.when(F.col("l_returnflag") == "A", "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    l = D.table(spark, d, "lineitem").select(
        F.lit("clerk").alias("role_title"), F.struct(seq.alias("q"), iso.alias("iso")).alias("seq"), iso.alias("posted_at_iso"), F.concat(F.lit("line "), seq.cast("string")).alias("posted_relative"),
        F.lit("").alias("posting_url"), F.col("l_linestatus").alias("source"), F.concat(F.col("l_orderkey").cast("string"), F.lit(" Pty Ltd")).alias("company_name"),
    )
    out = merge.postings(l, "company_name", "role_title", "seq")
    return out.select(F.regexp_replace("company_name", " Pty Ltd", "").cast("long").alias("company"), "posted_at_iso", "posted_relative", "source")


@query(
    "people_dedupe",
    "WITH p AS (SELECT c_custkey AS seq, ['Ann', 'Bo', 'Cy'][(c_custkey % 3) + 1] || ' ' || regexp_replace(c_mktsegment, '[^A-Za-z]', ' ', 'g') AS name, CASE WHEN c_acctbal < 5000 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS email, 's' || (c_nationkey % 3) AS source FROM customer) SELECT regexp_replace(lower(name), '[^a-z]+', '', 'g') AS k, coalesce(arg_min(email, seq) FILTER (email <> ''), '') AS email, string_agg(DISTINCT source, ',' ORDER BY source) AS source, min(seq) AS seq FROM p GROUP BY 1",
)
def people_dedupe(spark, d):
    """People whose names have the same letters, merged: first values that are not blank, all sources."""
    c = D.table(spark, d, "customer")
    name = F.concat(F.element_at(T.strings(["Ann", "Bo", "Cy"]), (F.col("c_custkey") % 3 + 1).cast("int")), F.lit(" "), F.regexp_replace("c_mktsegment", "[^A-Za-z]", " "))
    p = c.select(F.col("c_custkey").alias("seq"), name.alias("name"), F.when(F.col("c_acctbal") < 5000, "").otherwise(F.col("c_custkey").cast("string")).alias("email"), F.concat(F.lit("s"), F.col("c_nationkey") % 3).alias("source"))
    return merge.people(p, "name", "seq", "source").select("k", F.coalesce("email", F.lit("")).alias("email"), "source", "seq")


@query("ranked_candidates", r"""WITH c AS (SELECT page_id, regexp_extract(lower(url), '^https?://(?:www\.)?([^/:?#]+)', 1) AS host, CASE page_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 75 WHEN 2 THEN 35 ELSE 55 END + CASE WHEN page_id % 3 = 0 THEN 12 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 3 ELSE 0 END AS score FROM pages)
SELECT page_id, page_id % 7 AS posting, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY page_id % 7 ORDER BY score DESC, page_id) AS INTEGER) AS rank FROM c""")
def ranked_candidates(spark, d):
    """Candidate addresses of a posting, the likeliest first: by kind, by a career path, by words of the title."""
    key = F.col("page_id")
    host = F.when(key % 4 == 0, "jobs.lever.co").when(key % 4 == 1, "acme.com").when(key % 4 == 2, "www.seek.com.au").otherwise("other.org")
    url = F.concat(F.lit("https://"), host, F.when(key % 3 == 0, "/careers/").otherwise("/p/"), F.when(key % 5 == 0, "data").otherwise("x"), F.lit("-"), key)
    c = D.table(spark, d, "pages").select("page_id", (key % 7).alias("posting"), url.alias("url"), F.lit("Data role").alias("title"))
    from ..operators import evidence

    return evidence.ranked(c, "posting", "url", "title", "page_id", F.lit("acme.com")).select("page_id", "posting", "score", "rank")


@query("people_flat", "SELECT n_name AS company_name, s_name AS name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS INTEGER) AS place, array_to_string([CAST(s_suppkey AS VARCHAR), s_name], ';') AS guessed FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey >= 5")
def people_flat(spark, d):
    """People nested in accepted companies as flat rows, lists as text."""
    from ..sources.files import flat_people

    s = D.table(spark, d, "supplier").join(D.table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    person = F.struct("s_suppkey", F.col("s_name").alias("name"), F.array(F.col("s_suppkey").cast("string"), "s_name").alias("guessed"))
    nested = s.groupBy("n_nationkey", F.col("n_name").alias("company_name")).agg(F.array_sort(F.collect_list(person)).alias("people"))
    nested = nested.withColumn("status", F.when(F.col("n_nationkey") >= 5, "accepted").otherwise("rejected"))
    return flat_people(nested, ["company_name"], "people", "status").select("company_name", "name", "place", "guessed")


EXPERIENCE = """o AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)"""


@query(
    "resume_experience",
    "WITH " + EXPERIENCE + """ SELECT k, CAST(n AS INTEGER) AS slot, 'Clerk ' || n AS role, CASE n % 3 WHEN 0 THEN 'Acme, Perth' ELSE 'Acme ' || n END AS company, y || ' - Present' AS dates, 'kept books of ' || o_orderkey || '|wrote notes' AS bullets FROM o""",
)
def resume_experience(spark, d):
    """Experience read back from section lines in three layouts: all on one line, dates on the next, and dated titles
    with the company below."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = D.spread(D.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey")
    o = orders.select(F.col("o_custkey").alias("k"), "o_orderkey", n.alias("n"), F.year("o_orderdate").cast("string").alias("y"))
    role, span = F.concat(F.lit("Clerk "), "n"), F.concat("y", F.lit(" - Present"))
    one = F.array(F.concat(role, F.lit(" | Acme "), "n", F.lit("   "), span))
    two = F.array(F.concat(role, F.lit(" - Acme "), "n"), span)
    below = F.array(F.concat(role, F.lit("  |  "), span), F.lit("Acme, Perth"))
    head = F.when(F.col("n") % 3 == 1, one).when(F.col("n") % 3 == 2, two).otherwise(below)
    said = F.concat(head, F.array(F.concat(F.lit("- kept books of "), "o_orderkey"), F.lit("• wrote notes")))
    lines = o.select("k", "n", F.posexplode(said).alias("i", "value")).select("k", F.struct("n", "i").alias("line"), "value")
    return R.experiences(lines, "k").select("k", "slot", "role", "company", "dates", F.array_join("bullets", "|").alias("bullets"))


@query("resume_education", "SELECT c_custkey AS k, 1 AS slot, 'Bachelor of Trade ' || c_mktsegment AS degree, 'University of ' || n_name AS school, '2011 - 2014' AS year, (c_custkey % 30 + 60) || '/100' AS gpa, CASE WHEN c_custkey % 2 = 0 THEN 'WAM' ELSE '' END AS gpa_label FROM customer JOIN nation ON n_nationkey = c_nationkey")
def resume_education(spark, d):
    """Education read back from one combined line, or from lines under the degree's."""
    c = D.table(spark, d, "customer").join(D.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    key = F.col("c_custkey")
    degree, school = F.concat(F.lit("Bachelor of Trade "), "c_mktsegment"), F.concat(F.lit("University of "), "n_name")
    grade = F.concat((key % 30 + 60).cast("string"), F.lit("/100"))
    one = F.array(F.concat_ws(", ", degree, school, F.lit("Feb 2011 - Nov 2014"), F.concat(F.lit("WAM: "), grade)))
    more = F.array(degree, school, F.lit("2011 - 2014"), grade)
    lines = c.select(key.alias("k"), F.posexplode(F.when(key % 2 == 0, one).otherwise(more)).alias("line", "value"))
    return R.education(lines, "k").select("k", F.col("slot").cast("int").alias("slot"), "degree", "school", "year", "gpa", "gpa_label")


@query("resume_projects", "SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS slot, 'Project ' || l_partkey AS name, 'cut cost by ' || CAST(l_quantity AS INTEGER) || '|It ran well for all of its users.' AS bullets FROM lineitem")
def resume_projects(spark, d):
    l = D.table(spark, d, "lineitem")
    said = F.array(F.concat(F.lit("Project "), "l_partkey"), F.concat(F.lit("- cut cost by "), F.col("l_quantity").cast("int")), F.lit("It ran well for all of its users."))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = l.select(F.col("l_orderkey").alias("k"), *order, F.posexplode(said).alias("i", "value")).select("k", F.struct(*order, "i").alias("line"), "value")
    return R.projects(lines, "k").select("k", F.col("slot").cast("int").alias("slot"), "name", F.array_join("bullets", "|").alias("bullets"))


BULLETS = r"b AS (SELECT conv_id, turn, text, regexp_matches(lower(text), '" + "|".join(p.replace("'", "''").replace(".", r"\.") for p in [*R.BANNED, "tion"]) + r"') AS bad, lower(regexp_extract(text, '^\s*([^\s]+)', 1)) AS opener FROM conversations WHERE trim(coalesce(text, '')) <> '')"


@query(
    "facts_bank",
    "WITH " + BULLETS.replace("|tion", "") + ", c AS (SELECT *, bool_or(NOT bad) OVER (PARTITION BY conv_id) AS any_clean FROM b), f AS (SELECT conv_id, opener, min(turn) AS turn, arg_min(text, turn) AS text FROM c WHERE NOT bad OR NOT any_clean GROUP BY 1, 2) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS fact, opener, length(text) AS n, least(count(*) OVER (PARTITION BY conv_id), 5) AS budget FROM f",
)
def facts_bank(spark, d):
    """Each conversation's turns as a slot of facts: no banned wording, one of each opening word, five at most used."""
    out = R.facts(D.table(spark, d, "conversations"), ["conv_id"], "turn", "text")
    return out.select("conv_id", "fact", "opener", F.length("text").cast("long").alias("n"), F.col("budget").cast("long").alias("budget"))


@query(
    "bank_flaws",
    "WITH c AS (SELECT conv_id, turn, text, role, lower(regexp_extract(text, '^\\s*([^\\s]+)', 1)) AS opener FROM conversations), d AS (SELECT conv_id, opener FROM c WHERE opener <> '' GROUP BY 1, 2 HAVING count(*) > 1), s AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1 HAVING count(*) < 4) SELECT DISTINCT conv_id, 'unknown label' AS flaw, role AS detail FROM c WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id, 'duplicate opener', opener FROM d UNION ALL SELECT conv_id, 'pool smaller than budget', n || ' of 4' FROM s UNION ALL "
    + "SELECT DISTINCT conv_id, 'banned phrase', p FROM (SELECT conv_id, CASE " + " ".join("WHEN contains(lower(text), '{0}') THEN '{0}'".format(p.replace("'", "''")) for p in R.BANNED) + " END AS p FROM c) WHERE p IS NOT NULL",
)
def bank_flaws(spark, d):
    """What is wrong with each conversation as a bank of facts whose evidences are the roles."""
    c = D.table(spark, d, "conversations").select("conv_id", "text", F.array("role").alias("evidences"), F.lit(4).alias("budget"))
    known = spark.createDataFrame([("user",), ("assistant",)], "label string")
    return R.flaws(c, ["conv_id"], "text", "evidences", known, "label")


@query(
    "profile_groups",
    "WITH h AS (SELECT DISTINCT source, lang AS label FROM documents), p(label, parent) AS (VALUES ('de', 'germanic'), ('en', 'germanic'), ('fr', 'romance'), ('es', 'romance')), g(label, grp) AS (VALUES ('de', 'one'), ('en', 'one'), ('fr', 'two'), ('es', 'two'), ('germanic', 'family'), ('romance', 'family'), ('slavic', 'family')), own AS (SELECT * FROM h UNION SELECT source, parent FROM h JOIN p USING (label)) SELECT s.source, g.label, g.grp AS \"group\", own.label IS NOT NULL AS supported FROM (SELECT DISTINCT source FROM h) s CROSS JOIN g LEFT JOIN own ON own.source = s.source AND own.label = g.label",
)
def profile_groups(spark, d):
    """Labels that a source has, directly or through a child, and those of the groups that it lacks."""
    parents = spark.createDataFrame([("de", "germanic"), ("en", "germanic"), ("fr", "romance"), ("es", "romance")], "label string, parent string")
    groups = spark.createDataFrame([("de", "one"), ("en", "one"), ("fr", "two"), ("es", "two"), ("germanic", "family"), ("romance", "family"), ("slavic", "family")], "label string, group string")
    return R.profile(D.documents(spark, d), "source", "lang", parents, groups)


@query(
    "prospect_groups",
    "WITH p AS (SELECT c_nationkey AS k, count(*) AS n, list(c_custkey ORDER BY lower(c_name), c_custkey) AS l FROM customer GROUP BY 1) SELECT n_nationkey AS company_key, n_name AS company_name, CAST(n_regionkey = 1 AS INTEGER) AS priority, CAST(coalesce(n, 0) AS INTEGER) AS prospect_count, array_to_string(coalesce(l, []), ',') AS prospects FROM nation LEFT JOIN p ON k = n_nationkey",
)
def prospect_groups(spark, d):
    """Nations as companies, those of one region first, each with its customers as prospects."""
    companies = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("company_key"), "n_name", (F.col("n_regionkey") == 1).alias("first"))
    prospects = D.table(spark, d, "customer").select(F.col("c_nationkey").alias("company_key"), F.col("c_custkey").alias("prospect"), F.col("c_name").alias("name"))
    out = state.prospect_groups(companies, prospects, "company_key", "n_name", "first")
    return out.select("company_key", "company_name", "priority", "prospect_count", F.array_join(F.transform("prospects", lambda p: p["prospect"].cast("string")), ",").alias("prospects"))


@query("marked_adverts")
def marked_adverts(spark, d):
    """Posting texts as HTML, with the terms of their own evidence marked."""
    kind = F.regexp_extract("text", r"skills, (\w+)", 1)
    return D.adverts(spark, d).select("id", T.highlight_evidence(F.col("text"), F.concat(F.lit("SQL/Excel; "), kind, F.lit("; c++ & r, "), F.col("title"))).alias("html"))
