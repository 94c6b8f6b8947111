"""Fields of posting texts and pages: pay, work arrangement, skills, places, phones, page properties and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import urls as U

#: Skills looked for in a posting, in this order.
SKILLS = [
    "sql", "python", "r", "power bi", "powerbi", "tableau", "excel",
    "dbt", "azure", "aws", "gcp", "spark", "hadoop", "snowflake", "databricks",
    "machine learning", "deep learning", "nlp", "statistics",
    "data modelling", "data modeling", "data warehouse", "etl", "elt",
    "looker", "qlik", "scikit-learn", "tensorflow", "pytorch",
    "pandas", "numpy", "matplotlib", "seaborn", "plotly",
    "git", "github", "gitlab", "jira", "confluence", "agile", "scrum",
    "salesforce", "sap", "oracle", "mongodb", "postgresql", "mysql",
    "bigquery", "redshift", "sharepoint", "alteryx", "ssis",
]
#: Patterns of pay, of arrangements in a text and beside a place, of phone numbers.
SALARY = r"\$[\d,]+(?:\.\d+)?(?:\s*[kKmM])?(?:\s*[-–—]\s*\$?[\d,]+(?:\.\d+)?(?:\s*[kKmM])?)?"
ARRANGEMENT = r"(?i)\b(remote|hybrid|on[-\s]?site|in[-\s]?office)\b"
BESIDE_PLACE = r"(?i)\(?(Remote|Hybrid|On[-\s]?site|In[-\s]?office)\)?"
IN_BRACKETS = r"(?i)\s*\((?:Remote|Hybrid|On[-\s]?site|In[-\s]?office)\)"
PHONE = r"(?:(?:\+?61|0)[\s().-]*)?(?:[2378][\s().-]*\d{4}[\s().-]*\d{4}|4\d{2}[\s().-]*\d{3}[\s().-]*\d{3})"
#: What no contact address holds, starts with or ends in.
BAD_MAIL = ["sentry", "wixpress", "cloudflare", "localhost", "invalid", "example", "test."]
BAD_MAIL_STARTS = ["noreply@", "no-reply@", "donotreply@", "do-not-reply@", "name@", "email@"]
BAD_MAIL_ENDS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".css", ".js"]
#: Properties that hold a page's date, in order, and forms of dates in its text.
DATE_PROPERTIES = ["article:published_time", "article:modified_time", "og:updated_time", "date", "publishdate", "pubdate"]
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE_FORMS = [r"\b20\d{2}-\d{2}-\d{2}\b", rf"\b{MONTHS}[a-z]*\s+\d{{1,2}},?\s+20\d{{2}}\b", rf"\b\d{{1,2}}\s+{MONTHS}[a-z]*\s+20\d{{2}}\b"]


def shown(skill: str) -> str:
    return skill.upper() if len(skill) <= 3 else skill.title()


def salary(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), SALARY, 0)
    return F.when(found != "", F.trim(found)).otherwise("Not listed")


def arrangement(text: Column, location: Column | None = None) -> Column:
    words = F.regexp_extract(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(location, F.lit("")) if location is not None else F.lit("")), ARRANGEMENT, 1)
    w = F.lower(words)
    return F.when(w == "", "Unknown").when(w.contains("remote"), "Remote").when(w.contains("hybrid"), "Hybrid").otherwise("On-site")


def skills(text: Column, wanted: list[str] = SKILLS) -> Column:
    """Skills that a text names as words, in the list's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.array(*[F.when(low.rlike(r"\b" + re.escape(s) + r"\b"), F.lit(shown(s))) for s in wanted])
    return F.filter(named, lambda s: s.isNotNull())


def place(raw: Column) -> tuple[Column, Column]:
    """'Brisbane, QLD (Hybrid)' as place and arrangement ('' without one)."""
    c = F.coalesce(raw, F.lit(""))
    return F.trim(F.regexp_replace(c, IN_BRACKETS, "")), F.initcap(F.regexp_extract(c, BESIDE_PLACE, 1))


def phones(text: Column) -> Column:
    """Phone numbers, spaced alike, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PHONE})"), F.lit(1))
    plain = F.transform(found, lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), r"(?<=\d)[().-]+(?=\d)", " "))
    return F.array_distinct(plain)


def bad_mail(address: Column) -> Column:
    """Whether an address is a placeholder, a machine's, or a file name."""
    e = F.lower(address)
    return e.rlike("|".join(map(re.escape, BAD_MAIL))) | e.rlike("^(" + "|".join(map(re.escape, BAD_MAIL_STARTS)) + ")") | e.rlike("(" + "|".join(map(re.escape, BAD_MAIL_ENDS)) + ")$")


def mail_of_site(address: Column, site: Column) -> Column:
    """Whether an address is under a site's domain."""
    own, domain = U.registrable(site), F.lower(F.element_at(F.split(address, "@"), -1))
    return (own != "") & (domain != "") & ((U.registrable(domain) == own) | domain.endswith(F.concat(F.lit("."), own)))


def open_graph(html: Column) -> Column:
    """Map of a page's og: properties; the last of equal names counts."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)(<meta[^>]+property=["']og:[^"']+["'][^>]+content=["'][^"']+["'])"""), F.lit(1))
    pairs = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r"""(?i)property=["']og:([^"']+)["']""", 1).alias("k"), F.regexp_extract(t, r"""(?i)content=["']([^"']+)["']$""", 1).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag by its name or property; '' without one."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), rf"""(?i)<meta[^>]+(?:name|property)=["']{re.escape(name)}["'][^>]+content=["']([^"']+)["']""", 1)


def page_date(html: Column, text: Column) -> Column:
    """A page's date as written: from its properties, else the first form of date that its text has; else ''."""
    said = [F.left(T.squeeze(F.nullif(meta(html, p), F.lit(""))), F.lit(40)) for p in DATE_PROPERTIES]
    seen = [F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + rx, 0) for rx in DATE_FORMS]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in said], *[F.nullif(T.squeeze(x), F.lit("")) for x in seen], F.lit(""))


def custom_rules(text: Column, rules: dict[str, str]) -> Column:
    """Map of the first match of each named pattern that a text has, in any case of letters: the whole match, or a pattern's
    one group, or its groups as a tuple is written. Patterns are Java's; null is an empty text."""
    t, pairs = F.coalesce(text, F.lit("")), []
    for name, pattern in rules.items():
        rx, n = f"(?i){pattern}", re.compile(pattern).groups
        groups = [F.regexp_extract(t, rx, k) for k in range(1, n + 1)]
        one = F.regexp_extract(t, rx, 0) if n == 0 else groups[0] if n == 1 else F.concat(F.lit("('"), F.concat_ws("', '", *groups), F.lit("')"))
        pairs.append(F.when(F.regexp_instr(t, F.lit(rx)) > 0, F.struct(F.lit(name).alias("name"), one.alias("found"))))
    return F.map_from_entries(F.array_compact(F.array(*pairs)))
