"""Texts weighed as evidence: fetch states and their weights, keyword density, summaries, page and draft checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Texts that say there is none, and the least length of a description.
BLANK = ["n/a", "na", "none", "not listed", "no description", "see link", "tbd"]
LEAST = 350
#: Weights of a description's provenance.
PROVENANCE = {"jd_full_input": 100, "jd_full_official_ats_api": 98, "jd_full_official_jsonld": 94, "jd_full_official_page_text": 82, "jd_full_aggregator_match": 62, "jd_partial_summary_only": 35, "jd_partial_possible_mismatch": 20, "jd_unavailable_robots_blocked": 8, "jd_unavailable_fetch_error": 6, "jd_unavailable_no_description": 5, "jd_unavailable_no_candidates": 3}
#: Industry codes by prefix, in order; phrases of a value proposition; generic wording.
INDUSTRY = [("Technology / SaaS", ["62", "582", "631"]), ("Financial Services", ["64", "65", "66"]), ("Healthcare", ["86", "212", "325"]), ("Retail / E-commerce", ["47", "45"]), ("Energy / Utilities", ["35", "06", "19", "36"]), ("Consulting / Professional Services", ["70", "73", "74", "69", "78"])]
PROPOSITION = ["we provide", "platform", "helps", "solution", "mission", "leading", "enables", "designed to", "dedicated to"]
#: Weights of the self-check, in the order hard, soft, title, education, quantified, length, predicted.
CHECK = [0.55, 0.10, 0.10, 0.05, 0.10, 0.05, 0.05]


def is_blank(c: Column) -> Column:
    t = T.squeeze(c)
    return (F.length(t) < LEAST) | F.lower(t).isin(BLANK)


def fetch_state(rows: DataFrame, cache: DataFrame, key: str, text: str, url: str) -> DataFrame:
    """rows with the state of their text (present, from the cache, to be fetched, or out of reach), cached texts put in."""
    c = cache.select(key, F.col(text).alias("cached"))
    hit = ~is_blank(F.col("cached")) & F.col("cached").isNotNull()
    out = rows.join(c, key, "left").withColumn("was_blank", is_blank(F.col(text)))
    state = F.when(~F.col("was_blank"), "present").when(hit, "cache").when(F.coalesce(F.col(url), F.lit("")).rlike(r"(?i)linkedin\.com/jobs.*/jobs/view/\d+|linkedin\.com/jobs/view/\d+"), "fetchable").otherwise("blank_no_fetchable_url")
    return out.withColumn("fetch_state", state).withColumn(text, F.when(F.col("fetch_state") == "cache", F.col("cached")).otherwise(F.col(text))).drop("cached", "was_blank")


def provenance_score(status: Column, description: Column) -> Column:
    weight = F.create_map(*[F.lit(x) for kv in PROVENANCE.items() for x in kv])[status]
    return F.coalesce(weight, F.lit(0)) + F.least(F.floor(F.length(F.coalesce(description, F.lit(""))) / 500), F.lit(12))


def better(candidates: DataFrame, key: str, status: str, description: str, seq: str) -> DataFrame:
    """The best description of each key; a later one replaces it only if strictly better."""
    s = candidates.withColumn("score", provenance_score(F.col(status), F.col(description)))
    rest = [c for c in s.columns if c != key]
    return s.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("score", -F.col(seq))).alias("r")).select(key, "r.*")


#: What an address counts by its kind, and paths of career pages.
ADDRESS = {"ats": 80, "company": 75, "possible": 55, "aggregator": 35}
CAREER_PATHS = ["career", "job", "vacanc", "position", "opportunit", "work-with-us", "join-us"]


def ranked(candidates: DataFrame, key: str, url: str, title: str, seq: str, domain: Column) -> DataFrame:
    """Candidate addresses of each key with their score and rank: by kind, a career path, and the title's words in it;
    the first of equals first."""
    from ..functions import urls as U

    kind, path = U.source_kind(F.col(url), domain), F.lower(F.regexp_extract(url, r"^[^/]*//[^/?#]*([^?#]*)", 1))
    points = F.coalesce(F.create_map(*[F.lit(x) for kv in ADDRESS.items() for x in kv])[kind], F.lit(0))
    in_path = F.array_intersect(F.array_distinct(T.tokens(F.col(title))), F.array_distinct(T.tokens(F.concat(path, F.lit(" "), U.host(F.col(url))))))
    score = points + F.when(path.rlike("|".join(CAREER_PATHS)), 12).otherwise(0) + F.least(F.size(in_path) * 3, F.lit(15))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), seq))
    return candidates.withColumn("score", score.cast("int")).withColumn("rank", rank)


def real_signal(c: Column, generic: list[str]) -> Column:
    import re

    return (F.length(c) >= 30) & ~F.lower(c).rlike("|".join(map(re.escape, generic)))


def valid_email(c: Column) -> Column:
    return c.contains("@") & ~F.lower(c).rlike("^(invalid|unverified)")


def industry(code: Column) -> Column:
    out = None
    for name, prefixes in INDUSTRY:
        test = code.rlike("^(" + "|".join(prefixes) + ")")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("")


def density_sector(c: Column, keywords: dict[str, list[str]]) -> Column:
    """The sector of most keyword hits: two distinct ones or four in all at least; ten a distinct one, one a hit."""
    low = F.lower(F.coalesce(c, F.lit("")))
    rated = []
    for i, (name, words) in enumerate(keywords.items()):
        counts = F.array(*[((F.length(low) - F.length(F.replace(low, F.lit(w.lower()), F.lit("")))) / len(w)).cast("int") for w in words])
        distinct, total = F.size(F.filter(counts, lambda x: x > 0)), F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        rated.append(F.when((distinct >= 2) | (total >= 4), F.struct((10 * distinct + total).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("sector"))))
    return F.array_max(F.filter(F.array(*rated), lambda x: x.isNotNull()))["sector"]


def summary(df: DataFrame, key: str, text: str, words: list[str] = PROPOSITION) -> DataFrame:
    """The two best of a text's sentences of more than five words: by keywords, the first three one point more."""
    s = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?]) +"), lambda x: F.trim(x)), lambda x: F.size(F.split(x, r"\s+")) > 5)
    rows = df.select(key, F.posexplode(s).alias("n", "sentence"))
    low = F.lower("sentence")
    score = sum((low.contains(w).cast("int") for w in words), F.lit(0)) + F.when(F.col("n") < 3, 1).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "n"))
    top = rows.withColumn("score", score).where("score > 0").withColumn("rank", rank).where("rank <= 2")
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]), " ").alias("value_prop"))


def page_score(df: DataFrame, text: str, angles: dict[str, list[str]], weights: dict[str, int], bonus: Column) -> DataFrame:
    """Evidence of a page: two points a phrase, one a word, by angle and weight; the angle of most, and confidence."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    per = {a: sum((F.when(low.contains(t), 2 if " " in t else 1).otherwise(0) for t in terms), F.lit(0)) for a, terms in angles.items()}
    total = sum((weights.get(a, 1) * c for a, c in per.items()), F.lit(0)) + bonus
    best = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("order"), F.lit(a).alias("angle")) for i, (a, c) in enumerate(per.items())]))["angle"]
    return df.withColumn("evidence", total).withColumn("angle", best).withColumn("found", F.col("evidence") >= 5).withColumn("confidence", F.when(F.col("evidence") >= 16, "high").when(F.col("evidence") >= 8, "medium").when(low != "", "low").otherwise(""))


def domain_score(company: Column, candidate: Column, domain: Column) -> Column:
    """Ten a token of the company's name found, thirty for the whole name, eight for the country, at most seventy."""
    target = F.lower(F.concat_ws(" ", candidate, domain))
    toks = F.filter(F.split(T.company_core(company), " "), lambda t: F.length(t) >= 3)
    brand = F.regexp_replace(T.company_core(company), "[^a-z0-9]", "")
    hits = F.size(F.filter(toks, lambda t: target.contains(t)))
    score = 10 * hits + F.when((brand != "") & F.regexp_replace(target, "[^a-z0-9]", "").contains(brand), 30).otherwise(0) + F.when(domain.endswith(".au"), 8).otherwise(0)
    return F.when(F.size(toks) == 0, 0).otherwise(F.least(score, F.lit(70)))


def self_check(hard: Column, soft: Column, title: Column, education: Column, quantified: Column, words: Column, predicted: Column, target: int = 5, band: tuple[int, int] = (450, 650)) -> Column:
    """Match rate of a draft from seven parts; coverages are shares from 0 to 1, null where there is nothing to cover."""
    parts = [F.coalesce(hard, F.lit(1.0)), F.coalesce(soft, F.lit(1.0)), title.cast("int"), education.cast("int"), F.least(F.lit(1.0), quantified / F.lit(target)), words.between(*band).cast("int"), F.coalesce(predicted, F.lit(1.0))]
    return F.bround(F.round(100 * sum((w * p for w, p in zip(CHECK, parts)), F.lit(0.0)), 9), 0).cast("int")


def duplicate_openers(bullets: DataFrame, key: str, text: str) -> DataFrame:
    """First words that open more than one bullet of a key."""
    opener = F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1))
    return bullets.withColumn("opener", opener).where("opener <> ''").groupBy(key, "opener").agg(F.count("*").alias("n")).where("n > 1")


def capped(rows: DataFrame, key: str, value: str, seq: str, most: int) -> DataFrame:
    """Ordered distinct values of a key, the first so many: a list meant to be short, taken from per-value minima."""
    per = rows.groupBy(key, value).agg(F.min(seq).alias("s"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("s", value))
    return per.withColumn("rank", rank).where(F.col("rank") <= most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def rolled_up(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Labels with the parents that they imply, each once."""
    up = labels.join(F.broadcast(parents), "label").select(*[c for c in labels.columns if c != "label"], F.col("parent").alias("label"))
    return labels.unionByName(up.select(*labels.columns)).distinct()


def newest_or_all(rows: DataFrame, day: Column, where: Column) -> DataFrame:
    """Rows of the newest day that satisfy a condition; if none do, all rows that satisfy it. The decision is a one-row
    aggregate of the same plan, so nothing runs twice on the driver."""
    newest = rows.agg(F.max(day).alias("newest_day"), F.max(F.when(where, day)).alias("newest_hit"))
    return rows.crossJoin(F.broadcast(newest)).where(where & ((F.col("newest_day") > F.coalesce(F.col("newest_hit"), F.lit("0001-01-01").cast("date"))) | (day == F.col("newest_day")))).drop("newest_day", "newest_hit")
