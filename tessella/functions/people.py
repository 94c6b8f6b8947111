"""Names of people, pasted lists of them, and résumé text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from . import text as T

DEGREE = r"·?\s*(?:1st|2nd|3rd)\b"
#: Lines of pasted lists that say nothing about a person.
NOISE = r"(?i)^(?:|connect|message|follow|pending|view profile|.*mutual connections?.*|.*followers?.*|status is (?:online|offline))$"
#: Section headers of résumés.
SECTIONS = {"summary": ["summary", "profile", "about"], "experience": ["experience", "work experience", "employment", "employment history"], "education": ["education", "qualifications"], "skills": ["skills", "technical skills", "key skills"], "projects": ["projects", "personal projects"]}
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+"
SPAN = rf"(?i)((?:{MONTH})?(?:19|20)\d{{2}}\s*(?:-|–|—|to)\s*(?:(?:{MONTH})?(?:19|20)\d{{2}}|present|current|now))"


def from_slug(url: Column) -> Column:
    """A name from a profile address, without the parts that a colliding slug is given."""
    parts = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"linkedin\.com/in/([^/?#]+)", 1), "-")
    kept = F.filter(parts, lambda p: ~((F.length(p) >= 6) & p.rlike(r"\d") & p.rlike("[A-Za-z]")) & ~p.rlike(r"^\d+$"))
    kept = F.when(F.size(kept) == 0, parts).otherwise(kept)
    return F.array_join(F.transform(kept, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), " ")


def clean_name(c: Column) -> Column:
    """Without degree marks, credentials after a comma and emphasis; once where it is written twice."""
    n = F.regexp_replace(F.regexp_replace(c, DEGREE, ""), r",.*$|[*_|]|\(.*?\)", " ")
    n = F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), r"(?i)\s+is open to work\s*$", "")
    return F.regexp_replace(n, r"^(.+?)\s*\1$", "$1")


def proper_case(c: Column) -> Column:
    """A name all in capitals, or all in small letters, with a capital for each run of letters (O'Neil, Smith-Jones)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    title = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")
    one_case = c.rlike(r"\p{L}") & ((F.upper(c) == c) | (F.lower(c) == c))
    return F.when(one_case, title).otherwise(c)


def plain_name(c: Column) -> Column:
    """A cleaned name in proper case, without diacritics."""
    return T.unmarked(proper_case(clean_name(c)))


def initials_only(c: Column) -> Column:
    """Whether a name's last part is an initial, so that it needs review."""
    return c.rlike(r"(?:^|\s)[A-Za-z]\.?$") | c.rlike("(?i)^linkedin member$")


def pasted_people(df: DataFrame, key: str, text: str) -> DataFrame:
    """People of pasted lists: around each degree mark the nearest saying line above (name) and below (title).

    The first of equal names of a list counts; names of initials are marked for review.
    """
    l = ordered.lines(df, key, text).withColumn("value", F.trim("value"))
    anchor = F.col("value").rlike(DEGREE)
    found = ordered.nearest(l, key, "line", anchor, ~F.col("value").rlike(NOISE), "value")
    inline = F.trim(F.regexp_replace("value", DEGREE + ".*$", ""))
    name = clean_name(F.when(inline != "", inline).otherwise(F.col("above")))
    out = found.select(key, "line", name.alias("name"), F.coalesce("below", F.lit("")).alias("title")).where("name is not null and name <> ''")
    from ..operators.merge import first_by

    once = first_by(out.withColumn("slug", F.regexp_replace(F.lower("name"), "[^a-z]+", "_")), [key, "slug"], [F.col("line")])
    return once.select(key, "line", "name", "title", initials_only(F.col("name")).alias("needs_review"))


def date_span(c: Column) -> Column:
    """'2019 - 2021', '2019 - Present', '2019' or '' from a text with dates."""
    span = F.regexp_extract(c, SPAN, 1)
    chunk = F.when(span != "", span).otherwise(c)
    years = F.regexp_extract_all(chunk, F.lit(r"((?:19|20)\d{2})"), F.lit(1))
    open_ = chunk.rlike("(?i)present|current|now")
    return F.when(F.size(years) >= 2, F.concat(F.get(years, F.lit(0)), F.lit(" - "), F.element_at(years, -1))).when((F.size(years) == 1) & open_, F.concat(F.get(years, F.lit(0)), F.lit(" - Present"))).when(F.size(years) == 1, F.get(years, F.lit(0))).otherwise("")


def resume_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, entry, line, value): lines under their section; lines before any are its header. An entry is
    opened by each line with a date span."""
    l = ordered.lines(df, key, text).withColumn("value", F.trim("value")).where("value <> ''")
    word = F.lower(F.regexp_replace("value", r"[:\s]+$", ""))
    kind = None
    for name, words in SECTIONS.items():
        kind = F.when(word.isin(words), name) if kind is None else kind.when(word.isin(words), name)
    l = l.withColumn("kind", kind)
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = l.withColumn("section", F.coalesce(F.last("kind", True).over(w), F.lit("header"))).where("kind is null")
    e = Window.partitionBy(key, "section").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select(key, "section", F.sum(F.col("value").rlike(SPAN).cast("int")).over(e).alias("entry"), "line", "value")


def contact(df: DataFrame, key: str, text: str) -> DataFrame:
    """Name, e-mail, phone and profile from a résumé's first 15 lines."""
    head = F.array_join(F.slice(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), 1, 15), "\n")
    names = F.filter(F.transform(F.split(head, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"\d|@") & (F.size(F.split(x, r"\s+")) <= 5) & x.rlike(r"^\p{Lu}") & ~F.lower(x).isin([w for ws in SECTIONS.values() for w in ws]))
    return df.select(key, F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("name"), F.regexp_extract(head, r"[\w.+-]+@[\w-]+\.[\w.]+", 0).alias("email"), F.trim(F.regexp_extract(head, r"\+?\d[\d\s()-]{7,}\d", 0)).alias("phone"), F.regexp_extract(head, r"(?i)linkedin\.com/in/[\w-]+", 0).alias("profile"))
