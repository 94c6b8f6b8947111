"""Hosts, domains and the three canonical forms of a URL, which differ and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under which a two-letter country code takes a third.
SECOND_LEVEL = ["com", "net", "org", "gov", "edu", "co"]
#: Query parameters that name a posting.
KEPT_PARAMS = ["gh_jid", "jobId", "job_id", "req_id", "requisitionId", "id"]
#: Hosts of applicant systems and of job boards.
ATS_HOSTS = ["myworkdayjobs.com", "workdayjobs.com", "greenhouse.io", "lever.co", "ashbyhq.com", "smartrecruiters.com", "workable.com", "bamboohr.com", "jobvite.com", "icims.com", "successfactors.com", "taleo.net", "oraclecloud.com", "pageuppeople.com", "recruitee.com", "comeet.com", "breezy.hr", "pinpointhq.com", "jobadder.com"]
BOARD_HOSTS = ["linkedin.com", "seek.com.au", "indeed.com", "jora.com", "ethicaljobs.com.au", "apsjobs.gov.au", "careers.vic.gov.au", "iworkfor.nsw.gov.au", "smartjobs.qld.gov.au"]


def host(c: Column) -> Column:
    """Host in lower case without scheme, user, port and www."""
    rest = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^(?i)[a-z][a-z0-9+.-]*://", "")
    name = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(name, "@"), -1)), r":.*$", ""), r"^www\.", "")


def registrable(c: Column) -> Column:
    """The host's last two labels, or three under a country's second-level label."""
    p = F.split(host(c), r"\.")
    n = F.size(p)
    last, second = F.element_at(p, -1), F.try_element_at(p, F.lit(-2))
    three = (n >= 3) & (F.length(last) == 2) & second.isin(SECOND_LEVEL)
    return F.when(n <= 2, host(c)).when(three, F.array_join(F.slice(p, -3, 3), ".")).otherwise(F.array_join(F.slice(p, -2, 2), "."))


def under(h: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    return h.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def norm_url(c: Column) -> Column:
    """Side-table key: posting id, else the URL without fragment and trailing slashes."""
    u = F.trim(F.coalesce(c, F.lit("")))
    ident = F.regexp_extract(u, r"/jobs/view/(\d+)", 1)
    return F.when(ident != "", F.concat(F.lit("linkedin:"), ident)).otherwise(F.rtrim(F.regexp_replace(u, r"#.*$", ""), F.lit("/")))


def merge_url(c: Column) -> Column:
    """Merge key: as norm_url, in lower case; the query stays."""
    return F.lower(norm_url(c))


def row_key(url: Column, company: Column, title: Column) -> Column:
    from .text import company_key

    return F.when(F.trim(F.coalesce(url, F.lit(""))) != "", merge_url(url)).otherwise(F.concat(F.lit("ct:"), company_key(company), F.lit("|"), company_key(title)))


def _param(query: Column, name: str) -> Column:
    return F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)


def dedupe_url(c: Column) -> Column:
    """Dedupe key: posting ids of known boards, else host and path with the kept parameters in order."""
    u = F.trim(F.coalesce(c, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(u, r"^(?i)[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    h = host(u)
    path = F.rtrim(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+", "/"), r"^$", "/"), F.lit("/"))
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    plain = F.concat(h, path)
    view, job = F.regexp_extract(path, r"/jobs/view/(\d+)", 1), F.regexp_extract(path, r"/job/(\d+)", 1)
    here = F.when(view != "", view).when(_param(query, "currentJobId") != "", _param(query, "currentJobId")).otherwise(_param(query, "jobId"))
    kept = F.array(*[F.when(_param(query, k) != "", F.concat(F.lit(k + "="), _param(query, k))) for k in sorted(KEPT_PARAMS)])
    kept = F.array_join(F.filter(kept, lambda x: x.isNotNull()), "&")
    out = (
        F.when(h.endswith("linkedin.com") & (here != ""), F.concat(F.lit("linkedin:"), here))
        .when(h.endswith("seek.com.au") & (job != ""), F.concat(F.lit("seek:"), job))
        .when(h.contains("indeed.") & (_param(query, "jk") != ""), F.concat(F.lit("indeed:"), _param(query, "jk")))
        .when(h.endswith("linkedin.com") | h.endswith("seek.com.au") | h.contains("indeed."), F.lower(plain))
        .otherwise(F.lower(F.when(kept != "", F.concat(plain, F.lit("?"), kept)).otherwise(plain)))
    )
    return F.when(u == "", "").otherwise(out)


def source_kind(url: Column, domain: Column | None = None) -> Column:
    h = host(url)
    own = F.lit(False) if domain is None else (h == F.lower(domain)) | h.endswith(F.concat(F.lit("."), F.lower(domain)))
    return F.when(h == "", "unknown").when(under(h, ATS_HOSTS), "ats").when(own, "company").when(under(h, BOARD_HOSTS), "aggregator").otherwise("possible")


def ats_api(url: Column) -> Column:
    """The vendor's public API address of a posting, where the URL names one; else null."""
    g = lambda rx, i: F.regexp_extract(url, rx, i)
    green, lever = r"greenhouse\.io/([^/?#]+)/jobs/(\d+)", r"jobs\.lever\.co/([^/?#]+)/([0-9a-f-]{36})"
    smart, work = r"smartrecruiters\.com/([^/?#]+)/(\d+)", r"apply\.workable\.com/([^/?#]+)/j/([A-Z0-9]+)"
    return (
        F.when(url.rlike(green), F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), g(green, 1), F.lit("/jobs/"), g(green, 2)))
        .when(url.rlike(lever), F.concat(F.lit("https://api.lever.co/v0/postings/"), g(lever, 1), F.lit("/"), g(lever, 2)))
        .when(url.rlike(smart), F.concat(F.lit("https://api.smartrecruiters.com/v1/companies/"), g(smart, 1), F.lit("/postings/"), g(smart, 2)))
        .when(url.rlike(work), F.concat(F.lit("https://apply.workable.com/api/v1/accounts/"), g(work, 1), F.lit("/jobs/"), g(work, 2)))
    )
