"""Queries over documents and pages: URLs, tokens, aliases, classification, scores, duplicates, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as D
from ..functions import classify as K
from ..functions import text as T
from ..functions import urls as U
from ..operators import entity, grouping, joins, matching, merge, ordered, rollups

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return add


HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*')), ':.*$', ''), '^www\.', '')"
PATH = r"rtrim(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', ''), '^[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/')"


@query("url_forms", rf"""WITH p AS (SELECT page_id, trim(url) AS url FROM pages) SELECT page_id, {HOST} AS host, lower(rtrim(regexp_replace(url, '#.*$', ''), '/')) AS merge_url, rtrim(regexp_replace(url, '#.*$', ''), '/') AS norm_url,
lower({HOST} || {PATH} || CASE WHEN regexp_extract(url, '[?&]id=([^&#]+)', 1) <> '' THEN '?id=' || regexp_extract(url, '[?&]id=([^&#]+)', 1) ELSE '' END) AS dedupe_url FROM p""")
def url_forms(spark, d):
    u = F.col("url")
    return D.table(spark, d, "pages").select("page_id", U.host(u).alias("host"), U.merge_url(u).alias("merge_url"), U.norm_url(u).alias("norm_url"), U.dedupe_url(u).alias("dedupe_url"))


@query("registrable_domain", rf"""WITH h AS (SELECT page_id, {HOST} AS h FROM pages), l AS (SELECT page_id, h, string_split(h, '.') AS p FROM h) SELECT page_id, CASE WHEN len(p) <= 2 THEN h WHEN length(p[-1]) = 2 AND p[-2] IN ('com','net','org','gov','edu','co') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain, ['ats', 'aggregator', 'company', 'possible'][(page_id % 4) + 1] AS kind FROM l""")
def registrable_domain(spark, d):
    """Domains of pages, and the kind of four sorts of addresses."""
    kinds = T.strings(["https://boards.greenhouse.io/x/jobs/", "https://www.seek.com.au/job/", "https://jobs.acme.com/", "https://acme.org/"])
    url = F.concat(F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int")), "page_id")
    return D.table(spark, d, "pages").select("page_id", U.registrable(F.col("url")).alias("domain"), U.source_kind(url, F.lit("acme.com")).alias("kind"))


@query("pages_by_url", rf"""WITH p AS (SELECT page_id, html, lower(rtrim(regexp_replace(trim(url), '#.*$', ''), '/')) AS k FROM pages) SELECT k, page_id, length(html) AS n FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(html) DESC, page_id) = 1""")
def pages_by_url(spark, d):
    p = D.table(spark, d, "pages").select(U.merge_url(F.col("url")).alias("k"), "page_id", F.length("html").cast("long").alias("n"))
    return merge.best_by(p, "k", "n", "page_id").select("k", "page_id", "n")


@query("page_title", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?i)<a\s')) AS n_links FROM pages")
def page_title(spark, d):
    return D.table(spark, d, "pages").select("page_id", T.strip_tags(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s"), F.lit(0))).cast("long").alias("n_links"))


@query("page_parse")
def page_parse(spark, d):
    from ..sources.html import parsed

    return parsed(D.table(spark, d, "pages"), "page_id", "html").select("page_id", "title", "description", F.size("links").alias("n_links"), F.length("visible").alias("n_visible"))


ALIASES = {"the": ["the"], "connectors": ["and", "that"], "german": ["der", "und"], "french": ["que", "le la"], "absent": ["sql"]}
FLAT = {a: label for label, names in ALIASES.items() for a in names}
STRIP = "list_filter(string_split_regex(lower(text), '[^a-z0-9]'), lambda w: w <> '')"


def _count(a: str) -> str:
    # separators are doubled, so that hits beside each other both count
    return rf"len(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([^a-z0-9])', '\1\1', 'g'), '(^|[^a-z0-9]){a.replace(' ', '  ')}([^a-z0-9]|$)'))"


@query("alias_frequency", "WITH c AS (SELECT doc_id, u.label, u.freq FROM documents, LATERAL (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {' + '.join(_count(a) for a in v)})" for k, v in ALIASES.items()) + ") t(label, freq)) u) SELECT doc_id, label, CAST(freq AS BIGINT) AS freq FROM c WHERE freq > 0")
def alias_frequency(spark, d):
    hits = matching.alias_frequencies(F.col("text"), ALIASES)
    return D.documents(spark, d).select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.label", F.col("h.freq").cast("long").alias("freq"))


@query("alias_automaton", S["alias_frequency"])
def alias_automaton(spark, d):
    df = matching.automaton_hits(D.documents(spark, d).select("doc_id", "text"), "text", FLAT)
    return df.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.label", F.col("h.freq").cast("long").alias("freq"))


def words(spark, d):
    """Tokens with their order over the corpus."""
    w = D.documents(spark, d).select("doc_id", "lang", "source", F.posexplode(T.tokens(F.col("text"))).alias("pos", "w"))
    return w.withColumn("seq", F.col("doc_id") * 1_000_000 + F.col("pos"))


WORDS = "w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, doc_id * 1000000 + generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) - 1 AS seq FROM documents)"


@query(
    "top_skills",
    "WITH " + WORDS + """, p AS (SELECT w, source, count(*) AS c, min(seq) AS s FROM w WHERE length(w) >= 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s, source) AS rank FROM p),
a AS (SELECT w, sum(c) AS n, min(s) AS first_seen, count(*) AS holders, string_agg(source, ', ' ORDER BY rank) FILTER (rank <= 6) AS shown FROM r GROUP BY 1)
SELECT w, CAST(n AS BIGINT) AS n, w AS display, first_seen, holders, shown, greatest(holders - 6, 0) AS more FROM a ORDER BY n DESC, first_seen, w LIMIT 25""",
)
def top_skills(spark, d):
    """The report's top 25 labels with their holders."""
    w = words(spark, d).where(F.length("w") >= 4).withColumn("display", F.col("w"))
    return rollups.top_labels(w, "w", "display", "source", "seq", 25)


@query("priors_topk", "WITH " + WORDS + ", c AS (SELECT lang, w, count(*) AS n, min(seq) AS first_seen FROM w GROUP BY 1, 2) SELECT lang, w, n, first_seen, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, first_seen, w) AS INTEGER) AS rank FROM c QUALIFY rank <= 8")
def priors_topk(spark, d):
    return rollups.top_k(words(spark, d), "lang", "w", "seq", 8)


@query("modal_pattern", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, lang AS modal FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def modal_pattern(spark, d):
    c = D.documents(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return merge.first_by(c, ["source"], [-F.col("n"), F.col("lang")]).select("source", F.col("lang").alias("modal"))


@query("unknown_acronyms", r"SELECT doc_id, x.a AS acronym FROM documents, LATERAL (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z]{2,5})(?:$|[^\p{L}\p{N}_])', 1)) AS a) x WHERE x.a NOT IN (" + ", ".join(f"'{a}'" for a in K.ACRONYM_STOP) + ")")
def unknown_acronyms(spark, d):
    return D.documents(spark, d).select("doc_id", F.explode(K.acronyms(F.col("text"))).alias("acronym"))


def _case(rules, test) -> str:
    return "CASE " + " ".join(f"WHEN {test(r[-1])} THEN '{r[0]}'" for r in rules)


@query("sector_classify", "SELECT doc_id, " + _case(K.SECTORS, lambda ws: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")") + " ELSE 'other' END AS sector FROM documents")
def sector_classify(spark, d):
    return D.documents(spark, d).select("doc_id", K.sector(F.col("text")).alias("sector"))


TITLES = "t AS (SELECT p_partkey, ['Senior', 'Junior', 'Lead', 'Head of', 'Graduate', ''][(p_partkey % 6) + 1] || ' ' || p_name AS title FROM part)"


def titles(spark, d):
    """Roles: a part's name behind a grade that follows from its key."""
    grade = F.element_at(T.strings(["Senior", "Junior", "Lead", "Head of", "Graduate", ""]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return D.table(spark, d, "part").select("p_partkey", F.concat(grade, F.lit(" "), F.col("p_name")).alias("title"))


@query("seniority", "WITH " + TITLES + r" SELECT p_partkey, CASE WHEN regexp_matches(lower(title), '\bhead of\b') THEN 'director' WHEN regexp_matches(lower(title), '\bsenior\b') THEN 'senior' WHEN regexp_matches(lower(title), '\blead\b') THEN 'lead' WHEN regexp_matches(lower(title), '\bjunior\b') THEN 'entry' WHEN regexp_matches(lower(title), '\bgraduate\b') THEN 'graduate' ELSE 'mid' END AS level, CASE WHEN contains(lower(title), 'uat') THEN 'business_analyst' ELSE 'data_analyst' END AS family FROM t")
def seniority(spark, d):
    t = F.col("title")
    return titles(spark, d).select("p_partkey", K.seniority(t).alias("level"), K.role_family(t, F.lit("")).alias("family"))


@query("title_tokens", "WITH " + TITLES + ", k AS (SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9&]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.SENIORITY_WORDS + T.FILLER_WORDS) + ")))) AS w FROM t) SELECT p_partkey, array_to_string(w, ' ') AS tokens FROM k")
def title_tokens(spark, d):
    return titles(spark, d).select("p_partkey", F.array_join(T.title_tokens(F.col("title")), " ").alias("tokens"))


@query(
    "for_me_view",
    "WITH " + TITLES + r""", k AS (SELECT *, regexp_extract_all(lower(title), '[a-z0-9&]+') AS w, CASE WHEN regexp_matches(lower(title), '\bhead of\b') THEN 5 WHEN regexp_matches(lower(title), '\b(senior|lead)\b') THEN 3 WHEN regexp_matches(lower(title), '\b(junior|graduate)\b') THEN 1 ELSE 2 END AS r FROM t)
SELECT p_partkey, title, list_contains(w, 'steel') OR list_contains(w, 'green') AS on_target, CAST(r AS INTEGER) AS seniority_rank, r > 3 AS over_level FROM k""",
)
def for_me_view(spark, d):
    """Roles rated against tracked titles; in reach first."""
    tracked = ["Senior Steel", "Green Engineer"]
    p = spark.createDataFrame([(t,) for t in tracked], "tracked string")
    profile = p.agg(F.array_distinct(F.flatten(F.collect_list(T.anchor_tokens(F.col("tracked"))))).alias("anchors"), F.greatest(F.lit(2), F.max(K.seniority_rank(F.col("tracked")))).alias("cap"))
    t = F.col("title")
    out = titles(spark, d).crossJoin(F.broadcast(profile)).select("p_partkey", "title", F.arrays_overlap(T.anchor_tokens(t), F.col("anchors")).alias("on_target"), K.seniority_rank(t).alias("seniority_rank"), (K.seniority_rank(t) > F.col("cap")).alias("over_level"))
    # in reach first, then the newest (here: the highest key), then the dearest score (here: none)
    return out.orderBy(~F.col("on_target") | F.col("over_level"), F.desc("p_partkey"))


@query(
    "token_containment",
    "WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), bw AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM b), dw AS (SELECT doc_id, unnest(w) AS t FROM d) SELECT item_id, doc_id, count(*) AS common, n AS size FROM bw JOIN dw USING (t) GROUP BY item_id, doc_id, n HAVING count(*) >= 0.8 * n",
)
def token_containment(spark, d):
    """Documents that hold four fifths of a benchmark item's tokens."""
    own = lambda t, k: D.table(spark, d, t).select(k, F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    b, w = own("benchmark", "item_id"), own("documents", "doc_id")
    return matching.contained(b, w, "item_id", "doc_id", "w", 0.8)


UP = "u AS (SELECT source || ':' || lang AS key, doc_id AS seq, text AS job_text, source AS location, lang AS notes, doc_id % 2 AS src FROM documents)"


@query(
    "upsert_merge",
    "WITH " + UP + """, e AS (SELECT * FROM u WHERE src = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), a AS (SELECT * FROM e UNION ALL SELECT * FROM u WHERE src = 1), f AS (SELECT key, min((src, seq)) AS m FROM u GROUP BY 1)
SELECT key, arg_max(length(trim(job_text)), (length(trim(job_text)), -src, -seq)) AS text_length, min(location) AS location, arg_max(notes, (src, seq)) AS notes, count(*) AS n FROM a GROUP BY key""",
)
def upsert_merge(spark, d):
    u = D.documents(spark, d).select(F.concat("source", F.lit(":"), "lang").alias("key"), F.col("doc_id").alias("seq"), F.col("text").alias("job_text"), F.col("source").alias("location"), F.col("lang").alias("notes"))
    old, new = u.where("seq % 2 = 0"), u.where("seq % 2 = 1")
    out = merge.upsert(old, new, "key", "seq")
    n = new.groupBy("key").agg(F.count("*").alias("c"))
    had = old.select("key").distinct().withColumn("h", F.lit(1))
    return out.join(n, "key", "left").join(had, "key", "left").select("key", F.length(F.trim("job_text")).cast("long").alias("text_length"), "location", "notes", (F.coalesce("c", F.lit(0)) + F.coalesce("h", F.lit(0))).alias("n"))


@query("dedupe_first", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_first(spark, d):
    return merge.first_by(D.documents(spark, d).select("text", "doc_id"), ["text"], [F.col("doc_id")])


@query("dedupe_fill", "SELECT md5(text) AS k, arg_min(lang, doc_id) AS lang, string_agg(DISTINCT source, '|' ORDER BY source) AS source, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_fill(spark, d):
    return merge.fill(D.documents(spark, d).select(F.md5(F.col("text").cast("binary")).alias("k"), "lang", "source", "doc_id"), ["k"], "doc_id", "source").select("k", "lang", "source", "doc_id")


@query("dedupe_maxconf", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1")
def dedupe_maxconf(spark, d):
    return merge.best_by(D.documents(spark, d).select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@query("exact_duplicates", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return D.documents(spark, d).groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


@query("labels_rollup", "SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS toxic, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def labels_rollup(spark, d):
    return D.documents(spark, d).select("doc_id", "source").join(D.table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("quality"), 6).alias("quality"))


def rows_of_titles(spark, d):
    """Postings for duplicate rules: parts by brand, titled by name and type, some at a place, some with a link that others
    share, a brand's or another's; the signature is the title's words and the size's."""
    p, key = D.spread(D.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice"), "p_partkey"), F.col("p_partkey")
    title = F.concat("p_name", F.lit(" "), "p_type")
    url = F.when(key % 5 == 0, F.concat(F.lit("https://parts.example/"), (key / 15).cast("long").cast("string"))).otherwise("")
    place = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("hall "), (F.col("p_size") % 4).cast("string")))
    sig = F.concat(T.tokens(title), F.array(F.concat(F.lit("size"), (F.col("p_size") % 2).cast("string"))))
    return p.select(key.alias("seq"), url.alias("url"), F.col("p_brand").alias("owner"), F.lower(title).alias("title"), place.alias("location"), sig.alias("sig"), F.col("p_retailprice").alias("price"))


@query("duplicate_groups")
def duplicate_groups(spark, d):
    """First-fit groups over all parts, by all three rules."""
    return grouping.first_fit(rows_of_titles(spark, d).drop("price"))


@query("survivor_merge")
def survivor_merge(spark, d):
    r = rows_of_titles(spark, d)
    g = grouping.first_fit(r.drop("price"))
    rows = r.select("seq", "owner", "title", "price").join(g.hint("merge"), "seq")  # few bytes as a file, many as rows
    return merge.survivors(rows.drop("reason"), "group_seq", "seq", F.col("price"), "title", [], ["owner"]).select("group_seq", "primary_seq", "title", "owner", "n")


@query("duplicate_review")
def duplicate_review(spark, d):
    """Every part with its group, and whether it is the group's primary or a duplicate, and why."""
    r = rows_of_titles(spark, d)
    g = grouping.first_fit(r.drop("price"))
    primary = r.select("seq", "price").join(g.hint("merge"), "seq").groupBy("group_seq").agg(F.max_by("seq", F.struct("price", -F.col("seq"))).alias("primary_seq"))
    return entity.review(r.select("seq", "owner", "title"), g, primary).select("seq", "owner", "title", "group_seq", "primary_seq", "role", "reason")


@query("similar_titles")
def similar_titles(spark, d):
    """Pairs of classes of parts with near-identical titles."""
    return entity.similar_pairs(rows_of_titles(spark, d), "seq", "owner", "title", "location")


@query(
    "title_classes",
    "WITH r AS (SELECT p_partkey AS seq, p_brand AS owner, lower(p_name || ' ' || p_type) AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'hall ' || (p_size % 4) END AS location FROM part) SELECT seq, min(seq) OVER w AS class_key, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY owner, title, location)",
)
def title_classes(spark, d):
    """The class of each part: rows of equal owner, title and place."""
    return entity.title_classes(rows_of_titles(spark, d), "seq", "owner", "title", "location").drop("among")


@query("company_resolution")
def company_resolution(spark, d):
    """Suppliers' names resolved against companies."""
    typed = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.regexp_replace("s_name", "Supplier", "Customer").alias("name"))
    cand = D.companies(spark, d).select(F.col("company_key").alias("seq"), "company_key", F.concat("company", F.lit(" Pty Ltd")).alias("company"))
    return entity.resolve(typed, cand)


@query("fuzzy_suggestions")
def fuzzy_suggestions(spark, d):
    """The customers most like each supplier."""
    typed = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"))
    cand = D.table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("company_key"), F.col("c_name").alias("company"))
    return entity.suggestions(typed, cand)


@query("line_sections", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), h AS (SELECT *, length(value) < 20 AS is_header FROM l),
s AS (SELECT *, last_value(CASE WHEN is_header THEN value END IGNORE NULLS) OVER w AS section, sum(CAST(is_header AS INTEGER)) OVER w AS section_no FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)) SELECT doc_id, CAST(line AS INTEGER) AS line, section, CAST(section_no AS BIGINT) AS section_no FROM s WHERE NOT is_header""")
def line_sections(spark, d):
    l = ordered.lines(D.documents(spark, d), "doc_id", "text")
    return ordered.sections(l, "doc_id", "line", F.length("value") < 20, "value").select("doc_id", "line", "section", "section_no")


@query("nearest_line", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), n AS (SELECT *, length(value) < 12 AS anchor, CASE WHEN length(value) >= 30 THEN length(value) END AS v FROM l),
x AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, first_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM n) SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(above AS INTEGER) AS above, CAST(below AS INTEGER) AS below FROM x WHERE anchor""")
def nearest_line(spark, d):
    l = ordered.lines(D.documents(spark, d), "doc_id", "text").withColumn("n", F.length("value"))
    return ordered.nearest(l, "doc_id", "line", F.col("n") < 12, F.col("n") >= 30, "n").select("doc_id", "line", "above", "below")


@query("sentence_windows", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents), w AS (SELECT doc_id, s, unnest(generate_series(1, greatest(len(s) - 1, 1))) AS i FROM s WHERE len(s) > 0)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS start, array_to_string(s[i:i + 1], ' ') AS "window" FROM w""")
def sentence_windows(spark, d):
    return ordered.sentence_windows(D.documents(spark, d), "doc_id", "text")


@query("set_cover")
def set_cover(spark, d):
    """Facts chosen for each document by the labels that it asks for."""
    facts = spark.createDataFrame([("one", 2, 0, ["the"]), ("one", 2, 1, ["connectors", "the"]), ("one", 2, 2, ["german"]), ("two", 1, 0, ["french"]), ("two", 1, 1, ["german", "french"])], "slot string, budget int, fact int, evidences array<string>")
    hits = alias_frequency(spark, d).select("doc_id", "label", F.least("freq", F.lit(3)).cast("int").alias("imp"))
    return entity.set_cover(facts, hits, "doc_id")


@query("stream_first_seen", "SELECT user_id, min(ts) AS first_seen, count(*) AS n_events FROM events GROUP BY 1")
def stream_first_seen(spark, d):
    from ..streaming import events as E

    return E.drained(E.first_seen(E.source(spark, d, "events.parquet")), _checkpoint(spark))


@query("stream_funnel", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_funnel(spark, d):
    from ..streaming import events as E

    out = E.drained(E.funnel(E.source(spark, d, "events.parquet")), _checkpoint(spark))
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n")


@query(
    "stream_followups",
    """WITH log AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS sent_at, min(ts) FILTER (event_type = 'purchase' AND value > 95) AS replied_at, max(ts) FILTER (event_type = 'click' AND value > 90) AS fu1_at, max(ts) FILTER (event_type = 'click' AND value > 99) AS fu2_at FROM events WHERE user_id IS NOT NULL GROUP BY 1),
a AS (SELECT *, epoch(TIMESTAMP '2024-01-31' - sent_at) / 86400 AS s, epoch(TIMESTAMP '2024-01-31' - fu1_at) / 86400 AS f FROM log WHERE sent_at IS NOT NULL AND replied_at IS NULL)
SELECT user_id, CASE WHEN fu1_at IS NULL THEN 'fu1' ELSE 'fu2' END AS due FROM a WHERE (fu1_at IS NULL AND s >= 4) OR (fu1_at IS NOT NULL AND fu2_at IS NULL AND f >= 6)""",
)
def stream_followups(spark, d):
    """What is due of each user once a stream's timers have run to the end of the month."""
    from ..streaming import events as E
    from ..streaming import followups as U

    folder = _checkpoint(spark)
    log = U.due(U.kinds(U.clocked(spark, E.files(spark, d, "events.parquet"), folder, D.EVENTS_NOW)), "user_id")
    return U.latest(U.drained(log, folder), "user_id")


RULES = {"number": r"[0-9]+", "that one": r"that ([a-z]+)", "pair": r"([a-z]+), ([a-z]+)"}


@query(
    "custom_rules",
    r"""SELECT doc_id, u.rule, u.found FROM documents, LATERAL (SELECT * FROM (VALUES ('number', regexp_extract(text, '(?i)[0-9]+', 0), regexp_matches(text, '(?i)[0-9]+')),
('that one', regexp_extract(text, '(?i)that ([a-z]+)', 1), regexp_matches(text, '(?i)that ([a-z]+)')),
('pair', '(''' || regexp_extract(text, '(?i)([a-z]+), ([a-z]+)', 1) || ''', ''' || regexp_extract(text, '(?i)([a-z]+), ([a-z]+)', 2) || ''')', regexp_matches(text, '(?i)([a-z]+), ([a-z]+)'))) v(rule, found, met)) u WHERE u.met""",
)
def custom_rules(spark, d):
    """The first match of each of a user's rules in every text."""
    from ..functions.extract import custom_rules as found

    return D.documents(spark, d).select("doc_id", F.explode(found(F.col("text"), RULES)).alias("rule", "found"))


@query("section_lines", S["line_sections"].replace("CAST(section_no AS BIGINT)", "CAST(section_no AS INTEGER)"))
def section_lines(spark, d):
    """line_sections as SQL writes it: by a table function over lines that a lateral one makes."""
    from ..functions import tables

    tables.register(spark)
    D.documents(spark, d).createOrReplaceTempView("tessella_documents")
    lines = "SELECT CAST(doc_id AS STRING) AS key, l.line, l.value FROM tessella_documents, LATERAL text_lines(text) l"
    return spark.sql(f"SELECT CAST(key AS BIGINT) AS doc_id, line, section, section_no FROM line_sections(TABLE({lines}) PARTITION BY key ORDER BY line)")


def _checkpoint(spark) -> str:
    """A new folder for a stream's state and result, in the folder that driver and executors share."""
    import uuid

    from ..session import shared_dir

    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
