"""Résumés as tables: experience, projects and education from section lines, and the facts built from them.

Every step is a window over a section's lines: what kind of line it is, which entry it opens or belongs to, then one
aggregate an entry. Input rows: key, line (order) and value, of one section; blank lines are left out before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns of date spans, separators, bullets, degrees, institutions and scores.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SPAN = rf"(?i)((?:{MONTHS}|Q[1-4])[\w\s,]*\d{{0,4}}\s*(?:–|-|to)\s*(?:{MONTHS}|Q[1-4]|Present|Current|Now)[\w\s,]*\d{{0,4}}|\b\d{{4}}\s*(?:–|-|to)\s*(?:\d{{4}}|Present|Current|Now)\b)"
HEADER_JOINT = r"\s+[-–|·•∙│]\s+|\s+\bat\b\s+"
ROLE_JOINT = r"(?:\s+[-–|·•∙│]\s+|\s*,\s*)"
BULLET = r"^[•‣◦⁃∙\-\*–—•]\s*"
DEGREES = r"(?i)\b(Bachelor|Master|Doctor|PhD|MBA|BEng|BSc|BE|BA|BComm|BCom|MCom|MEng|MSc|Diploma|Certificate|Associate|Honours|Hons|Grad\s?Dip|PostGrad|Graduate)\b"
INSTITUTIONS = r"(?i)\b(University|College|Institute|School|TAFE|Polytechnic|Academy)\b"
LABELLED = r"(?i)\b(GPA|WAM|CGPA)\b[\s:]*([0-9.]+(?:/[0-9.]+)?)"
SCORE = r"\b(\d{1,3}(?:\.\d+)?)\s*/\s*(100|10|7|4)\b"
FIELD_JOINT = r"\s*[,·•∙│|]\s*|\t+"
#: Verbs that open a bullet, never a company's name.
BULLET_VERBS = [
    "mentored", "assigned", "reviewed", "built", "led", "managed", "developed",
    "designed", "created", "analysed", "analyzed", "reduced", "increased",
    "improved", "delivered", "implemented", "coordinated", "supported",
    "maintained", "automated", "unblocked", "drove", "owned", "shipped",
    "launched", "migrated", "optimised", "optimized", "engineered", "deployed",
    "collaborated", "partnered", "presented", "researched", "tested", "wrote",
    "processed", "validated", "reconciled", "configured", "trained", "achieved",
]
#: Wording that no draft may hold.
BANNED = [
    "leverag", "spearhead", "passionate", "synerg", "results-driven",
    "results driven", "proven track record", "dynamic professional",
    "team player", "go-getter", "think outside", "utilize", "utilis",
    "responsible for", "duties included", "i am excited", "i believe my",
    "cutting-edge", "cutting edge", "seamless", "delve", "in today's",
    "fast-paced", "best-in-class", "world-class", "honed", "esteemed",
    "keen eye",
]
BUDGET = 5


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def trimmed(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def bound(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, evaluated once: what stands in a higher-order function Spark evaluates anew wherever it is named."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def capitals(w: Column) -> Column:
    """Whether half of the words open with a capital or no letter."""
    caps = F.size(F.filter(w, lambda x: F.left(x, F.lit(1)).rlike(r"^(\p{Lu}|\P{L})")))
    return (F.size(w) > 0) & (caps >= F.greatest(F.lit(1), F.floor(F.size(w) / 2)))


def titleish(c: Column) -> Column:
    """Whether half of a phrase's words open with a capital or no letter."""
    return bound(words(c), capitals)


def only_dates(c: Column) -> Column:
    return c.rlike(SPAN) & (F.length(trimmed(F.regexp_replace(c, SPAN, ""), " |–-,•")) < 8)


def opens_entry(c: Column) -> Column:
    """Whether a line is shaped like the head of an entry: a date span alone, or role and company with a joint."""

    def two(w: Column, dated: Column) -> Column:
        first = trimmed(F.lower(F.coalesce(F.get(w["right"], F.lit(0)), F.lit(""))), ".,")
        return (F.size(w["left"]) <= 6) & (F.size(w["right"]) <= 6) & ~first.isin(BULLET_VERBS) & (dated | (capitals(w["left"]) & capitals(w["right"])))

    def halves(p: Column, dated: Column) -> Column:
        both = bound(F.struct(words(p["left"]).alias("left"), words(p["right"]).alias("right")), lambda w: two(w, dated))
        return F.when((p["left"] == "") | (p["right"] == ""), dated).otherwise(both)

    def judged(s: Column) -> Column:
        sides = lambda x: F.struct(F.trim(F.get(x, F.lit(0))).alias("left"), F.trim(F.coalesce(F.get(x, F.lit(1)), F.lit(""))).alias("right"))
        named = bound(F.split(trimmed(s["plain"], " -–|,"), HEADER_JOINT, 2), lambda x: bound(sides(x), lambda p: halves(p, s["dated"])))
        commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
        shaped = ~c.rlike(r"[.:;]$") & (commas < 2) & c.rlike(HEADER_JOINT) & (F.size(words(c)) <= 14)
        return (s["dated"] & (F.length(trimmed(s["plain"], " |–-,•")) < 8)) | (shaped & named)

    return ~c.rlike(BULLET) & bound(F.struct(c.rlike(SPAN).alias("dated"), F.regexp_replace(c, SPAN, "").alias("plain")), judged)


def head_parts(c: Column) -> Column:
    """Role, company and dates of an entry's head, a struct; a year alone is a date."""

    def rest(s: Column) -> Column:
        at = F.when(s["span"] != "", s["span"]).otherwise(s["year"])
        return bound(at, lambda a: F.when(a == "", c).otherwise(F.trim(F.concat(F.left(c, F.position(a, c) - 1), F.lit(" "), F.substr(c, F.position(a, c) + F.length(a))))))

    def named(s: Column) -> Column:
        dates = F.when(s["span"] != "", F.trim(s["span"])).otherwise(s["year"])
        sides = lambda x: F.struct(F.trim(F.get(x, F.lit(0))).alias("role"), F.trim(F.coalesce(F.get(x, F.lit(1)), F.lit(""))).alias("company"), dates.alias("dates"))
        return bound(F.split(trimmed(rest(s), " |–-,"), ROLE_JOINT, 2), sides)

    return bound(F.struct(F.regexp_extract(c, SPAN, 1).alias("span"), F.regexp_extract(c, r"\b\d{4}\b", 0).alias("year")), named)


def company_line(c: Column) -> Column:
    """Whether a line is 'Company, City' rather than a bullet."""
    first = trimmed(F.lower(F.coalesce(F.get(words(c), F.lit(0)), F.lit(""))), ".,")
    return F.size(words(c)).between(1, 6) & c.contains(",") & ~F.rtrim(c).rlike(r"[.:;]$") & ~first.isin(BULLET_VERBS) & titleish(c)


def experiences(lines: DataFrame, key: str, line: str = "line", value: str = "value") -> DataFrame:
    """key, slot (from 1), role, company, dates, bullets of a section of experience.

    A line of dates under a head without any belongs to it. A dated title without company takes the company from the
    next line: an undated entry, whose bullets become its own, or the first of its bullets where that names one.
    """
    l = lines.select(key, line, value, opens_entry(F.col(value)).alias("opens"))
    l = l.select("*", F.when(F.col("opens"), only_dates(F.col(value))).alias("dated"), F.when(F.col("opens"), head_parts(F.col(value))).alias("head"))
    l = l.select(key, line, value, "opens", "dated", "head.role", "head.company", "head.dates")
    before = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("opens"), F.struct("dated", "dates")), True).over(before)
    joins = F.col("opens") & F.col("dated") & last.isNotNull() & ~last["dated"] & (last["dates"] == "")
    l = l.withColumn("joins", F.coalesce(joins, F.lit(False)))
    run = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("opens") & ~F.col("joins")
    l = l.withColumn("entry", F.sum(head.cast("int")).over(run)).where("entry > 0")
    bullet = F.trim(F.regexp_replace(value, BULLET, ""))
    said = F.array_sort(F.collect_list(F.when(~F.col("opens") & (bullet != ""), F.struct(F.col(line).alias("n"), bullet.alias("b")))))
    e = l.groupBy(key, "entry").agg(
        F.min_by(F.struct("role", "company", "dates"), F.when(head, F.col(line))).alias("h"), F.min_by("dates", F.when(F.col("joins"), F.col(line))).alias("under"),
        F.transform(said, lambda x: x["b"]).alias("bullets"),
    )
    e = e.select(key, "entry", "h.role", "h.company", F.when(F.col("h.dates") != "", F.col("h.dates")).otherwise(F.coalesce("under", F.lit(""))).alias("dates"), "bullets")
    order = Window.partitionBy(key).orderBy("entry")
    bare = (F.col("dates") != "") & (F.col("company") == "") & (F.size("bullets") == 0)
    e = e.withColumn("next", F.lead(F.struct("role", "company", "dates", "bullets")).over(order)).withColumn("bare", bare)
    e = e.withColumn("takes", F.coalesce(F.col("bare") & (F.col("next.dates") == "") & (F.col("next.role") != ""), F.lit(False)))
    e = e.withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False))).where("not taken")
    promoted = ~F.col("takes") & (F.col("dates") != "") & (F.col("company") == "") & F.coalesce(company_line(F.get("bullets", F.lit(0))), F.lit(False))
    joined = F.when(F.col("next.company") != "", F.concat_ws(", ", "next.role", "next.company")).otherwise(F.col("next.role"))
    return e.select(
        key, F.row_number().over(order).alias("slot"), "role", F.when(F.col("takes"), joined).when(promoted, F.get("bullets", F.lit(0))).otherwise(F.col("company")).alias("company"), "dates",
        F.when(F.col("takes"), F.col("next.bullets")).when(promoted, F.slice("bullets", F.lit(2), F.greatest(F.size("bullets") - 1, F.lit(0)))).otherwise(F.col("bullets")).alias("bullets"),
    )


def projects(lines: DataFrame, key: str, line: str = "line", value: str = "value") -> DataFrame:
    """key, slot, name, bullets: a short line that is no sentence opens a project; others are its bullets."""
    v = F.col(value)
    marked = v.rlike(BULLET)
    opens = ~marked & (F.size(words(v)) <= 8) & ~v.rlike(r"[.:;]$")
    run = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = lines.select(key, line, opens.alias("opens"), F.trim(F.regexp_replace(v, BULLET, "")).alias("said"), v.alias("v")).withColumn("slot", F.sum(F.col("opens").cast("int")).over(run)).where("slot > 0")
    said = F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct(F.col(line).alias("n"), F.col("said").alias("b")))))
    return l.groupBy(key, "slot").agg(F.max(F.when(F.col("opens"), F.col("v"))).alias("name"), F.transform(said, lambda x: x["b"]).alias("bullets"))


def score_of(c: Column) -> tuple[Column, Column]:
    """A grade and its label: a labelled one first, else one out of a common whole."""
    label, bare = F.regexp_extract(c, LABELLED, 2), F.replace(F.regexp_extract(c, SCORE, 0), F.lit(" "), F.lit(""))
    return F.when(label != "", label).otherwise(bare), F.upper(F.regexp_extract(c, LABELLED, 1))


def education(lines: DataFrame, key: str, line: str = "line", value: str = "value") -> DataFrame:
    """key, slot, degree, school, year, gpa, gpa_label: a line that names a degree opens an entry, whose missing fields
    the lines under it fill: a grade, else dates, else the school."""
    from ..functions.people import date_span

    v = F.col(value)
    run = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(Window.partitionBy(key).orderBy(line)) == 1
    l = lines.select(key, line, value).withColumn("opens", v.rlike(DEGREES) | first)
    l = l.withColumn("slot", F.sum(F.col("opens").cast("int")).over(run))
    gpa, label = score_of(v)
    plain = F.trim(F.regexp_replace(F.regexp_replace(v, LABELLED, ""), SCORE, ""))
    years = date_span(plain)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, SPAN, ""), rf"(?i)\b({MONTHS})[a-z]*\b", ""), r"\b(19|20)\d{2}\b", "")
    parts = F.filter(F.transform(F.split(rest, FIELD_JOINT), lambda x: trimmed(x, " -–|·•∙")), lambda x: x != "")
    degree = F.get(F.filter(parts, lambda x: x.rlike(DEGREES)), F.lit(0))
    school = F.get(F.filter(parts, lambda x: x.rlike(INSTITUTIONS) & ((x != degree) | degree.isNull())), F.lit(0))
    left = F.filter(parts, lambda x: (x != F.coalesce(degree, F.lit(""))) & (x != F.coalesce(school, F.lit(""))))
    whole = F.when(degree.isNotNull(), F.concat_ws(", ", F.concat(F.array(degree), left))).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    l = l.select(key, "slot", line, "opens", v.alias("v"), gpa.alias("gpa"), label.alias("label"), years.alias("years"), whole.alias("degree"), F.coalesce(school, F.lit("")).alias("school"))
    head = lambda c: F.max(F.when(F.col("opens"), F.col(c)))
    under = ~F.col("opens")
    # a line under the head fills one field: what it is taken for follows from what the head lacks
    h = l.groupBy(key, "slot").agg(*[head(c).alias(f"h_{c}") for c in ("gpa", "label", "years", "degree", "school")])
    l = l.join(h, [key, "slot"])
    grade = under & (F.col("gpa") != "") & (F.col("h_gpa") == "")
    nth = lambda test: F.row_number().over(Window.partitionBy(key, "slot", test).orderBy(line))
    l = l.withColumn("grade", grade).withColumn("grade", F.col("grade") & (nth(F.col("grade")) == 1))
    l = l.withColumn("dates", ~F.col("grade") & under & (F.col("years") != "") & (F.col("h_years") == "")).withColumn("dates", F.col("dates") & (nth(F.col("dates")) == 1))
    l = l.withColumn("place", ~F.col("grade") & ~F.col("dates") & under & (F.col("years") == "") & (F.col("h_school") == ""))
    pick = lambda test, c: F.coalesce(F.min_by(c, F.when(F.col(test), F.col(line))), F.lit(""))
    out = l.groupBy(key, "slot", "h_gpa", "h_label", "h_years", "h_degree", "h_school").agg(pick("grade", "gpa").alias("g"), pick("grade", "label").alias("gl"), pick("dates", "years").alias("y"), pick("place", "v").alias("s"))
    own = lambda h, x: F.when(F.col(h) != "", F.col(h)).otherwise(F.col(x))
    return out.select(key, "slot", F.col("h_degree").alias("degree"), own("h_school", "s").alias("school"), own("h_years", "y").alias("year"), own("h_gpa", "g").alias("gpa"), F.when(F.col("h_gpa") != "", F.col("h_label")).otherwise(F.col("gl")).alias("gpa_label"))


def banned(c: Column, phrases: list[str] = BANNED) -> Column:
    """The first banned phrase, in the list's order, that a text holds; null without one."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in phrases])


def facts(bullets: DataFrame, slot: list[str], order: str, text: str) -> DataFrame:
    """Bullets fit for a slot: without banned wording (all of them where none is), the first of each opening word, with
    the slot's budget; a slot's order starts at 1."""
    own = Window.partitionBy(*slot)
    b = bullets.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("clean", banned(F.col(text)).isNull())
    b = b.withColumn("some", F.max("clean").over(own)).where("clean or not some")
    b = b.withColumn("opener", F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1)))
    once = b.groupBy(*slot, "opener").agg(F.min_by(F.struct(order, text), order).alias("r")).select(*slot, "opener", "r.*")
    n = F.row_number().over(own.orderBy(order))
    return once.select(*slot, n.alias("fact"), "opener", text, F.least(F.count("*").over(own), F.lit(BUDGET)).alias("budget"))


def flaws(bank: DataFrame, slot: list[str], text: str, evidences: str, known: DataFrame, label: str, budget: str = "budget") -> DataFrame:
    """What is wrong with a bank of facts, a row each: unknown labels, banned wording, equal openers, too small a pool."""
    rows = bank.select(*slot, F.explode(evidences).alias(label)).join(known.select(label), label, "left_anti")
    unknown = rows.select(*slot, F.lit("unknown label").alias("flaw"), F.col(label).alias("detail"))
    wording = bank.select(*slot, F.lit("banned phrase").alias("flaw"), banned(F.col(text)).alias("detail")).where("detail is not null")
    opener = F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1))
    equal = bank.select(*slot, opener.alias("detail")).where("detail <> ''").groupBy(*slot, "detail").count().where("count > 1").select(*slot, F.lit("duplicate opener").alias("flaw"), "detail")
    small = bank.groupBy(*slot).agg(F.count("*").alias("n"), F.max(budget).alias("b")).where("n < b").select(*slot, F.lit("pool smaller than budget").alias("flaw"), F.concat_ws(" of ", "n", "b").alias("detail"))
    return unknown.unionByName(wording).unionByName(equal).unionByName(small).distinct()


def profile(hits: DataFrame, key: str, label: str, parents: DataFrame, groups: DataFrame) -> DataFrame:
    """Labels found for a key, with the parents that they imply, and for each its group and whether the key has it: all
    labels of groups that stand nowhere in the key's are its unsupported ones."""
    from .evidence import rolled_up

    own = rolled_up(hits.select(key, F.col(label).alias("label")).distinct(), parents).withColumn("supported", F.lit(True))
    every = hits.select(key).distinct().crossJoin(F.broadcast(groups.select("label", "group")))
    return every.join(own, [key, "label"], "left").select(key, "label", "group", F.coalesce("supported", F.lit(False)).alias("supported"))


def best_slot(bank: DataFrame, slot: list[str], evidences: str, wanted: Column) -> DataFrame:
    """The slot whose facts hold most of the wanted labels, the first of equals: one row."""
    held = bank.select(*slot, F.size(F.array_intersect(evidences, wanted)).alias("slot_hits")).groupBy(*slot).agg(F.sum("slot_hits").alias("slot_hits"))
    first = F.max_by(F.struct(*slot), F.struct("slot_hits", *[-F.col(s) for s in slot])).alias("best")
    return held.agg(first, F.max("slot_hits").alias("hits")).select("best.*", "hits")


def skill_line(labels: Column, most: int = 12) -> Column:
    """Labels as a skills line, the first so many."""
    return F.array_join(F.slice(labels, 1, most), " | ")


def summary_clauses(labels: Column, family: Column) -> Column:
    """'Family with A, B and C.' or the family alone."""
    return F.when(F.size(labels) == 0, F.concat(F.initcap(F.replace(family, F.lit("_"), F.lit(" "))), F.lit("."))).otherwise(F.concat(F.initcap(F.replace(family, F.lit("_"), F.lit(" "))), F.lit(" with "), T.and_list(F.slice(labels, 1, 3)), F.lit(".")))
