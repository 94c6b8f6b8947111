"""Rule-based classification of titles and texts as column expressions; rules apply in the order written."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import urls as U

#: Sectors by substring, the first that matches.
SECTORS = [
    ("energy", ["energy", "electricity", "gas", "utilities", "renewables", "solar"]),
    ("health", ["health", "hospital", "medical", "clinical", "aged care", "pharma", "ndis"]),
    ("government", ["government", "council", "department of", "agency", "public sector", "defence"]),
    ("finance", ["bank", "finance", "financial", "insurance", "super", "wealth", "fintech", "payments"]),
    ("retail", ["retail", "ecommerce", "e-commerce", "consumer", "fmcg", "supermarket"]),
    ("technology", ["software", "saas", "tech", "it services", "cloud", "data", "ai"]),
    ("telecom", ["telecom", "telco", "network", "broadband", "mobile"]),
    ("transport_logistics", ["logistics", "transport", "freight", "supply chain", "airline", "rail"]),
    ("education", ["university", "education", "training", "school", "rto", "edtech"]),
    ("professional_services", ["consulting", "advisory", "accounting", "legal", "recruitment"]),
]
#: Seniority by word, the first that matches; else mid, 2.
SENIORITY = [
    ("exec", 6, ["vp", "vice president", "chief", "ceo", "cto", "cfo", "c-level"]),
    ("director", 5, ["director", "head of"]),
    ("manager", 4, ["manager", "mgr"]),
    ("principal", 4, ["principal", "staff"]),
    ("senior", 3, ["senior", "snr", "sr"]),
    ("lead", 3, ["lead"]),
    ("entry", 1, ["junior", "jnr", "entry", "associate"]),
    ("graduate", 1, ["graduate", "grad", "trainee"]),
    ("intern", 0, ["intern", "internship"]),
]
#: Recruiters by substring; agency terms; phrases that hide the employer; scam wording; free mail hosts.
RECRUITERS = ["hays", "robert half", "michael page", "hudson", "talenza", "bluefin", "clicks it", "halcyon knights", "randstad", "kelly services", "hudson rpo", "morgan mckinley", "the onset", "the recruitment company", "people group", "u&u", "people2people", "balance recruitment", "ignite", "paxus", "candle", "finite group", "ambit", "perigon"]
AGENCY = ["recruitment", "recruiter", "recruiting", "staffing", "talent", "hays", "randstad", "michael page", "peoplebank", "finite", "paxus", "robert half", "hudson", "ignite", "ambition", "halcyon knights", "six degrees", "sharp & carter", "sharp and carter", "corestaff", "mind recruitment"]
HIDDEN_EMPLOYER = [r"\bour client\b", r"\bconfidential\b", r"\bundisclosed\b", r"\bclient is\b", r"\bon behalf of\b", r"\bleading client\b"]
SCAM = [r"\bwhatsapp\b", r"\btelegram\b", r"\bsignal app\b", r"\bpay (a|the)?\s*(fee|deposit|registration)\b", r"\btraining fee\b", r"\bcrypto\b", r"\binvestment opportunity\b", r"\bno experience required\b.*\bhigh income\b", r"\bwork from home\b.*\bweekly pay\b", r"\babn only\b"]
FREE_MAIL = ["gmail.com", "hotmail.com", "outlook.com", "yahoo.com", "icloud.com", "live.com", "proton.me", "protonmail.com"]
#: Role families by substring of the title, in order.
FAMILIES = [
    ("data_scientist", ["data scientist", "machine learning engineer", "ml engineer", "ai analyst", "ai engineer", "research scientist"]),
    ("business_analyst", ["business analyst", "ict business analyst", "systems analyst"]),
    ("engineering_bi", ["data engineer", "integration developer", "etl developer", "pipeline engineer"]),
    ("commercial_analytics", ["pricing", "sales analyst", "product analyst", "planning analyst", "food & beverage", "commercial analyst", "finance analyst", "fp&a"]),
    ("reporting_bi", ["reporting", "insights", " bi ", "business intelligence"]),
]
#: Headers that open a text's requirements.
REGION = ["requirements", "what you’ll bring", "about you", "qualifications", "must have", "essential", "skills and experience", "what we’re looking for", "to be successful"]
#: Patterns of stated years, certificates, presence, degrees, residence, and of diversity statements.
YEARS_PLUS = r"(?i)\b(\d{1,2})\s*\+\s*years?\b"
YEARS_LEAST = r"(?i)\b(?:minimum|min\.?|at least)\s+(?:of\s+)?(\d{1,2})\s*\+?\s*years?\b"
#: Acronyms that never count as a tool.
ACRONYM_STOP = ["AU", "NZ", "US", "USA", "UK", "EU", "AUS", "ANZ", "APAC", "EMEA", "CEO", "CFO", "CIO", "CTO", "COO", "HR", "PR", "IT", "QA", "RD", "KPI", "KPIS", "OKR", "OKRS", "SLA", "ROI", "EOI", "FAQ", "ASAP", "FYI", "PDF", "DOC", "URL", "WFH", "FTE", "EOD", "TBC", "TBD", "AKA", "ETC", "AND", "OR", "THE", "FOR", "YOU", "OUR", "WE", "ALL", "ANY", "NEW", "VIC", "NSW", "QLD", "WA", "SA", "ACT", "NT", "CBD", "GMT", "AEST", "AEDT", "DEI", "EEO", "LGBT", "LGBTQ", "ESG", "CSR", "NDIS", "TAFE"]
CERTIFICATES = r"(?i)\b(cpa|cfa|pmp|cscp|aws certified|azure (?:certified|administrator)|cissp|prince2|itil|six sigma|comptia|security\+)(?![a-z0-9])"
ONSITE = r"(?i)\b(on-?site|in[-\s]office|in person|relocat\w+|\d\s*days?\s*(?:per week\s*)?(?:in (?:the )?office|on-?site))\b"


DEGREE = r"(?i)\b(?:bachelor'?s?|master'?s?|phd|doctorate|degree|tertiary qualification)\b"
DEGREE_NEEDED = r"(?i)\b(required|essential|must have|mandatory)\b"
DEGREE_SOFT = r"(?i)\b(preferred|desirable|advantageous|nice to have|a plus|or equivalent|equivalent experience)\b"
RESIDENCE = r"(?i)\b(australian citizen|security clearance|agsva|baseline clearance|nv1|nv2|must be a citizen|permanent resident only|pr or citizen)\b"
DIVERSITY = r"(?i)\b(gender identity|sexual orientation|veteran|protected characteristic|marital status)\b"
SENIOR_WORDS = r"(?i)\b(senior|lead|principal|head of)\b"
#: Words of titles by which no two roles are alike.
TITLE_STOP = ["senior", "junior", "lead", "principal", "head", "associate", "staff", "the", "and", "of", "in", "a", "an", "to", "for", "with", "at", "i", "ii", "iii", "iv", "v"]


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def ladder(c: Column, rules: list[tuple], value, test, default) -> Column:
    out = None
    for r in rules:
        out = F.when(test(c, r[-1]), value(r)) if out is None else out.when(test(c, r[-1]), value(r))
    return out.otherwise(default)


def low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def sector(c: Column) -> Column:
    return ladder(low(c), SECTORS, lambda r: r[0], lambda x, w: x.rlike(any_of(w)), "other")


def _word(x: Column, words: list[str]) -> Column:
    return x.rlike(r"\b(" + any_of(words) + r")\b")


def seniority(c: Column) -> Column:
    return ladder(low(c), SENIORITY, lambda r: r[0], _word, "mid")


def seniority_rank(c: Column) -> Column:
    return ladder(low(c), SENIORITY, lambda r: r[1], _word, 2)


def role_family(title: Column, text: Column) -> Column:
    t = low(title)
    blob = F.concat(t, F.lit(" "), low(text))
    has = lambda x, words: x.rlike(any_of(words))
    return (
        F.when(has(t, FAMILIES[0][1]) | (has(t, ["machine learning", "deep learning"]) & ~t.contains("analyst")), "data_scientist")
        .when(has(t, FAMILIES[1][1]), "business_analyst")
        .when(has(t, FAMILIES[2][1]) | (has(t, ["automation", "developer"]) & t.contains("data")), "engineering_bi")
        .when(has(t, FAMILIES[3][1]), "commercial_analytics")
        .when(has(t, FAMILIES[4][1]), "reporting_bi")
        .when(t.contains("product owner") | has(blob, ["user acceptance testing", "uat", "process mapping", "requirements gathering"]), "business_analyst")
        .otherwise("data_analyst")
    )


def is_recruiter(company: Column) -> Column:
    return low(company).rlike(any_of(RECRUITERS))


def required_years(text: Column) -> Column:
    """The highest stated minimum of years, or null."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx), F.lit(1)) for rx in (YEARS_PLUS, YEARS_LEAST)])
    return F.array_max(F.transform(found, lambda x: x.cast("int")))


def region_start(text: Column) -> Column:
    """1-based place of the requirements' header, 0 without one."""
    words = any_of(REGION).replace("’", "[’']")
    return F.regexp_instr(text, F.lit(r"(?im)(?:^[\s\-*\d.)]*(?:" + words + r")[\s\-*\d.)]*(?:\n|:|\s*$)|(?:" + words + r")\s*:)"))


def acronyms(text: Column, known: list[str] = ()) -> Column:
    """Tool-like acronyms in order of first appearance that are neither common nor known."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{2,5})\b"), F.lit(1)))
    out = F.array_except(found, T.strings(ACRONYM_STOP))
    return F.filter(out, lambda x: ~F.lower(x).isin(list(known))) if known else out


KNOCKOUT = "struct<type:string,detail:string,required_value:int,status:string>"


def knockouts(text: Column, region: Column, years: int | None = None, certificates: list[str] | None = None, degree: bool = False, sponsored: bool = False) -> Column:
    """Hard requirements as an array of (type, detail, required_value, status), in a fixed order.

    region: the text from its requirements on. Status: met, unmet, or unknown where the candidate states nothing. Only
    a candidate who needs a sponsor is asked for residence, and not by a text that names it beside diversity.
    """
    none = F.lit(None).cast("int")
    kb = lambda kind, detail, value, status: F.struct(F.lit(kind).alias("type"), detail.alias("detail"), value.alias("required_value"), status.alias("status"))
    empty = F.array().cast(f"array<{KNOCKOUT}>")
    found = lambda test, k: F.when(test, F.array(k)).otherwise(empty)
    need = required_years(region)
    by_years = F.lit("unknown") if years is None else F.when(F.lit(years) >= need, "met").otherwise("unmet")
    windows = F.regexp_extract_all(region, F.lit(r"(?s)(" + DEGREE + r".{0,50})"), F.lit(1))
    needed = F.filter(windows, lambda w: w.rlike(DEGREE_NEEDED) & ~w.rlike(DEGREE_SOFT))
    named = F.lower(F.regexp_extract(F.get(needed, F.lit(0)), DEGREE, 0))
    certs = F.array_distinct(F.transform(F.regexp_extract_all(region, F.lit(CERTIFICATES), F.lit(1)), lambda c: F.lower(c)))
    own = T.strings([x.lower() for x in certificates or []])
    has = lambda c: F.when(F.exists(own, lambda x: x.contains(c)), "met").otherwise("unmet") if certificates else F.lit("unknown")
    out = [
        found(need.isNotNull(), kb("min_years", F.concat(need.cast("string"), F.lit("+ years")), need, by_years)),
        found(F.size(needed) > 0, kb("degree", named, none, F.lit("met" if degree else "unknown"))),
        F.transform(certs, lambda c: kb("certification", c, none, has(c))),
    ]
    if sponsored:
        asked, at = F.regexp_extract(text, RESIDENCE, 1), F.regexp_instr(text, F.lit(RESIDENCE))
        first = F.greatest(F.lit(1), at - 60)
        around = F.substr(text, first, at - first + F.length(asked) + 60)
        out.append(found((asked != "") & ~around.rlike(DIVERSITY), kb("work_authorization", F.lower(asked), none, F.lit("unmet"))))
    out.append(found(region.rlike(ONSITE), kb("onsite", F.lit("onsite/relocation"), none, F.lit("unknown"))))
    return F.concat(*out)


def significant(title: Column) -> Column:
    """A title's words that tell roles apart."""
    return F.array_except(F.array_distinct(F.filter(F.split(low(title), "[^a-z]+"), lambda w: w != "")), T.strings(TITLE_STOP))


def off_target(title: Column, keywords: list[str]) -> Column:
    """Whether a title shares no word with any of the keywords; never where either side has none."""
    if not keywords:
        return F.lit(False)
    tracked = F.array_distinct(F.flatten(F.array(*[significant(F.lit(k)) for k in keywords])))
    own = significant(title)
    return (F.size(own) > 0) & ~F.arrays_overlap(own, tracked)


def status_is_open(status: Column) -> Column:
    """Whether a status does not start as a rejection."""
    return ~F.lower(F.coalesce(status, F.lit(""))).startswith("reject")


def _rated(company: Column, role: Column, url: Column, text: Column, domain: Column, location: Column, skills: Column, notes: Column, platform: Column) -> dict[str, Column]:
    """What a posting's authenticity is rated by. A missing domain is inferred from an unknown host, which then matches
    itself, as postings were always rated."""
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    h = U.host(url)
    board, ats = U.under(h, U.BOARD_HOSTS), U.under(h, U.ATS_HOSTS)
    inferred = F.when(full(domain), F.lower(domain)).when((h != "") & ~board & ~ats & ~U.registrable(url).isin(FREE_MAIL), U.registrable(url)).otherwise("")
    words = F.lower(F.concat_ws(" ", company, role, text, skills, notes))
    agency_words = F.lower(F.concat_ws(" ", company, platform, notes, F.left(F.coalesce(text, F.lit("")), F.lit(1200))))
    return {
        "company": full(company), "role": full(role), "url": full(url), "long": (F.length(F.coalesce(text, F.lit(""))) >= 350) | full(skills), "location": full(location),
        "domain": full(domain), "free": full(domain) & F.lower(domain).isin(FREE_MAIL), "host": h, "board": board, "ats": ats, "inferred": inferred,
        "match": (h != "") & (inferred != "") & ((h == inferred) | h.endswith(F.concat(F.lit("."), inferred))),
        "agency": agency_words.rlike(any_of(AGENCY) + "|" + "|".join(HIDDEN_EMPLOYER)), "scam": words.rlike("(?s)" + "|".join(SCAM)), "words": words,
    }


POSTING = ("company", "role", "url", "text", "domain", "location", "skills", "notes", "platform")


def authenticity(df: DataFrame, posting: dict[str, Column], score: str = "score", status: str = "status", notes: str = "notes") -> DataFrame:
    """df with a posting's score from 0 to 100, its status, and what spoke for or against it in the order of the rating.

    posting: columns of POSTING; a missing one is blank. What it is rated by is computed in a projection of its own, the
    score in a second and status and notes in a third, so that no test is inlined again and again.
    """
    lead = "rated_"
    while any(c.lower().startswith(lead) for c in df.columns):
        lead += "_"
    facts = _rated(*[posting.get(c, F.lit("")) for c in POSTING])
    words, own = facts.pop("words"), posting.get("domain", F.lit(""))
    hits = F.filter(F.array(*[F.when(words.rlike("(?s)" + rx), F.lit(rx)) for rx in SCAM]), lambda r: r.isNotNull())
    df = df.withColumns({f"{lead}{k}": v for k, v in facts.items()} | {f"{lead}own": F.lower(F.coalesce(own, F.lit(""))), f"{lead}hits": hits})
    x = {k: F.col(f"{lead}{k}") for k in (*facts, "own", "hits")}
    h, board, ats, match = x["host"], x["board"], x["ats"], x["match"]
    pick = lambda test, yes, no: F.when(test, yes).otherwise(no)
    sum_ = (
        F.lit(50) + pick(x["company"], 10, -25) + pick(x["role"], 10, -25) + pick(x["url"], 10, -15) + pick(x["long"], 10, 0) + pick(x["location"], 5, 0)
        + F.when(x["free"], -35).when(x["domain"], 8).when((h != "") & ~board & ~ats, pick(x["inferred"] != "", 5, 0)).otherwise(-5)
        + F.when(match, 20).when(board, 22).when(ats, 18).when(h != "", -8).otherwise(0) + pick(x["agency"], -12, 0) + pick(x["scam"], -55, 0)
    )
    df = df.withColumn(f"{lead}score", F.greatest(F.lit(0), F.least(F.lit(100), sum_)))
    n = F.col(f"{lead}score")
    found = (
        F.when(x["scam"] | (n < 30) | ~x["company"] | ~x["role"], "reject_suspicious")
        .when(x["agency"], "agency_or_recruiter_listing")
        .when(match & (n >= 80), "verified_company_source")
        .when((board | ats) & (n >= 70), "trusted_alert_source")
        .when(n >= 45, "needs_company_confirmation")
        .otherwise("reject_low_authenticity")
    )
    kind = F.when(U.under(h, ["linkedin.com"]), "linkedin").when(U.under(h, ["seek.com.au"]), "seek").otherwise("trusted job board")
    said = F.array(
        F.when(~x["company"], "missing company name"), F.when(~x["role"], "missing role title"), F.when(~x["url"], "missing job URL"), F.when(~x["long"], "short or missing JD text"),
        F.when(x["free"], F.concat(F.lit("company_domain is a free email domain ("), x["own"], F.lit(")"))).when(x["domain"], None)
        .when((h != "") & ~board & ~ats, F.when(x["inferred"] != "", F.concat(F.lit("inferred company_domain from job URL ("), x["inferred"], F.lit(")")))).otherwise("company domain not provided"),
        F.when(match, "job URL host matches company domain").when(board, F.concat(F.lit("trusted job-board source ("), kind, F.lit(")"))).when(ats, "trusted ATS source").when(h != "", F.concat(F.lit("unrecognized job URL host ("), h, F.lit(")"))),
        F.when(x["agency"], "agency/recruiter or end-employer-unclear listing"),
        F.when(F.size(x["hits"]) > 0, F.concat(F.lit("suspicious wording: "), F.array_join(F.slice(x["hits"], 1, 3), ", "))),
    )
    df = df.withColumns({score: n, status: found, notes: F.array_compact(said)})
    fine = F.array(F.lit("no authenticity issues found"))
    return df.withColumn(notes, F.when(F.size(notes) == 0, fine).otherwise(F.col(notes))).drop(*[c for c in df.columns if c.startswith(lead)])
