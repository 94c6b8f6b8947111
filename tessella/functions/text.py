"""Names, titles, tokens, tags and e-mail patterns as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal suffixes of company names, and suffixes left out of a company's token set.
LEGAL_SUFFIXES = ["pty", "ltd", "limited", "pvt", "private", "inc", "incorporated", "llc", "plc", "corp", "corporation", "co", "company", "group"]
TOKEN_SUFFIXES = ["pty", "ltd", "limited", "inc", "llc", "plc", "corp", "corporation", "co", "company", "australia", "australian", "group"]
MATCHING_SUFFIX = r"\b(pty\s+ltd|pty\s+limited|ltd|limited|inc|incorporated|co|company|group|corp|corporation|plc|services)\b"
WORD_DROPS = ["pty", "ltd", "limited", "inc", "group", "australia", "australian", "anz", "co", "company", "corp", "corporation"]
TITLE_DROPS = ["full", "time", "part", "contract", "temporary", "permanent"]
#: Relevance words. Seniority and filler are left out of titles; generic roles anchor nothing.
SENIORITY_WORDS = ["vp", "vice", "president", "chief", "ceo", "cto", "cfo", "director", "head", "manager", "mgr", "principal", "staff", "senior", "snr", "sr", "lead", "junior", "jnr", "entry", "associate", "graduate", "grad", "trainee", "intern", "internship"]
FILLER_WORDS = ["the", "a", "an", "of", "and", "or", "to", "for", "in", "at", "with", "remote", "hybrid", "onsite", "contract", "permanent", "fulltime", "parttime", "full", "part", "time", "new", "role", "job", "position", "officer", "i", "ii", "iii", "iv"]
GENERIC_ROLES = ["engineer", "engineering", "developer", "programmer", "consultant", "specialist", "architect", "advisor", "technician"]


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def compat_form(s: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC); Spark has no such function."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def ascii_lower(s: pd.Series) -> pd.Series:
    """Lower case without what decomposition leaves outside ASCII."""
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower(), na_action="ignore")


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Lower case, decomposed, combining marks dropped, white space squeezed."""

    def one(x: str) -> str:
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn").lower().split())

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def unmarked(s: pd.Series) -> pd.Series:
    """Decomposed, combining marks dropped; case and white space stay."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn"), na_action="ignore")


def clean_text(c: Column) -> Column:
    """Compatibility composition, white space squeezed; null as ''."""
    return squeeze(compat_form(c))


def company_letters(c: Column) -> Column:
    """A company's letters and digits without common suffixes, by which registries are matched."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), MATCHING_SUFFIX, ""), "[^a-z0-9]", "")


def company_words(c: Column) -> Column:
    """A company's words but for those that say nothing, as an array."""
    return F.filter(tokens(c), lambda x: ~x.isin(WORD_DROPS))


def file_slug(c: Column) -> Column:
    """A name for files: '&' as 'and', joined by hyphens, at most ninety characters."""
    return slug(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit(" and ")), "-", 90)


def company_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def slug(c: Column, joint: str = "_", most: int | None = None) -> Column:
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", joint), F.lit(joint))
    return s if most is None else F.rtrim(F.left(s, F.lit(most)), F.lit(joint))


def company_core(c: Column) -> Column:
    """Lower case without punctuation and trailing legal suffixes; a name of suffixes alone is ''."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[.,&]", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(s, "((^| )(" + "|".join(LEGAL_SUFFIXES) + "))+$", ""))


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def company_tokens(c: Column) -> Column:
    """The set of a name's tokens but for suffixes, sorted, as text."""
    return F.array_join(F.array_sort(F.array_except(F.array_distinct(tokens(c)), strings(TOKEN_SUFFIXES))), " ")


def title_text(c: Column) -> Column:
    t = tokens(F.regexp_replace(c, "&", " and "))
    return F.array_join(F.filter(t, lambda x: ~x.isin(TITLE_DROPS)), " ")


def location_text(c: Column, stop: list[str] = ()) -> Column:
    return F.array_join(F.slice(F.array_sort(F.array_except(F.array_distinct(tokens(c)), strings(list(stop)))), 1, 4), " ")


def title_tokens(c: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(tokens(c, "[a-z0-9&]+")), strings(SENIORITY_WORDS + FILLER_WORDS)))


def anchor_tokens(c: Column) -> Column:
    return F.array_except(title_tokens(c), strings(GENERIC_ROLES))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; of none, 1."""
    own = F.size(F.array_distinct(a))
    return F.when(own == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / own)


def split_list(c: Column, by: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")


def strip_tags(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def first_last(c: Column) -> tuple[Column, Column]:
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda p: F.regexp_replace(F.lower(p), "[^a-z]", "")), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def email_from(name: Column, domain: Column, pattern: Column) -> Column:
    """An address by pattern, in either dialect; '' where the pattern asks for a name part that is missing."""
    first, last = first_last(name)
    out = pattern
    for mark, value in (("{first[0]}", F.left(first, F.lit(1))), ("{last[0]}", F.left(last, F.lit(1))), ("{first}", first), ("{last}", last), ("{f}", F.left(first, F.lit(1))), ("{l}", F.left(last, F.lit(1))), ("{domain}", domain)):
        out = F.replace(out, F.lit(mark), value)
    out = F.when(out.contains("@"), out).otherwise(F.concat(out, F.lit("@"), domain))
    lacks = (first == "") | (F.coalesce(domain, F.lit("")) == "") | (pattern.contains("{last") & (last == ""))
    return F.when(lacks, "").otherwise(F.lower(out))


#: Rules in order, as later ones overlap earlier ones: pattern of the local part, longest, format.
LOCAL_PART_RULES = [
    (r"^[a-z]+\.[a-z]+$", None, "{first}.{last}@{domain}"),
    (r"^[a-z]\.[a-z]{2,}$", None, "{first[0]}.{last}@{domain}"),
    (r"^[a-z]{2,}\.[a-z]$", None, "{first}.{last[0]}@{domain}"),
    (r"^[a-z][a-z]{2,}$", 8, "{first[0]}{last}@{domain}"),
    (r"^[a-z]{3,}[a-z]$", 7, "{first}{last[0]}@{domain}"),
    (r"^[a-z]{2,}$", 8, "{first}@{domain}"),
    (r"^[a-z]{5,}$", None, "{first}{last}@{domain}"),
]


def email_pattern(local: Column) -> Column:
    v = F.replace(local, F.lit("*"), F.lit(""))
    out = None
    for rule, most, form in LOCAL_PART_RULES:
        test = v.rlike(rule) if most is None else v.rlike(rule) & (F.length(v) <= most)
        out = F.when(test, form) if out is None else out.when(test, form)
    return out


def highlight(c: Column, terms: list[str]) -> Column:
    """A text as HTML with terms marked, the longest first; lines end in breaks."""
    import re

    longest = sorted((t for t in terms if len(t) >= 2), key=lambda t: (-len(t), t))
    return _broken(_safe(c) if not longest else F.regexp_replace(_safe(c), _WHOLE[0] + "|".join(map(re.escape, longest)) + _WHOLE[1], "<mark>$1</mark>"))


def highlight_evidence(c: Column, evidence: Column) -> Column:
    """A text as HTML with the terms of its own row's evidence marked: what stands between semicolons, and the parts of that
    between slashes, ampersands and commas, of two characters or more, the longest first."""
    chunks = F.transform(F.split(F.coalesce(evidence, F.lit("")), ";"), lambda x: F.trim(x))
    parts = F.transform(F.flatten(F.transform(chunks, lambda x: F.split(x, "[/&,]"))), lambda x: F.trim(x))
    terms = F.filter(F.array_distinct(F.concat(chunks, parts)), lambda t: F.char_length(t) >= 2)
    by_length = F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    literal = F.transform(by_length, lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}_])", r"\\$1"))
    pattern = F.concat(F.lit(_WHOLE[0]), F.array_join(literal, "|"), F.lit(_WHOLE[1]))
    return _broken(F.when(F.size(terms) == 0, _safe(c)).otherwise(F.regexp_replace(_safe(c), pattern, F.lit("<mark>$1</mark>"))))


#: Around alternatives that stand as whole words, in any case of letters.
_WHOLE = r"(?iu)(?<!\w)(", r")(?!\w)"


def _safe(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _broken(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def and_list(c: Column) -> Column:
    """A, B and C."""
    n = F.size(c)
    return F.when(n == 0, "").when(n == 1, F.get(c, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(c, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(c, -1)))


def undoubled(c: Column) -> Column:
    """A text that is a text written twice, once."""
    return F.regexp_replace(F.trim(c), r"^(.+?)\s*\1$", "$1")


def at_sentence(c: Column, most: int) -> Column:
    """At most so many characters, cut after the last sentence that ends in them if one does."""
    head = F.left(c, F.lit(most))
    cut = F.regexp_extract(head, r"^(?s)(.*[.!?])(\s|$)", 1)
    return F.when(F.length(c) <= most, c).when(cut != "", cut).otherwise(F.rtrim(head))


def hidden_emails(c: Column) -> Column:
    """Addresses written as base64 runs."""
    runs = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9+/]{16,}={0,2})"), F.lit(1))
    clear = F.transform(runs, lambda x: F.try_to_binary(x, F.lit("base64")).cast("string"))
    return F.filter(clear, lambda x: x.isNotNull() & x.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"))


def emails(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})"), F.lit(1)))
