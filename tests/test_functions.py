import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import classify, dates, text, urls
from tessella.operators.matching import Automaton, alias_pattern


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "url,host,root,dedupe,norm",
    [
        ("HTTPS://user@WWW.Foo.com.au:80/a//b/?utm=1&id=7#top", "foo.com.au", "foo.com.au", "foo.com.au/a/b?id=7", "HTTPS://user@WWW.Foo.com.au:80/a//b/?utm=1&id=7"),
        ("www.linkedin.com/jobs/view/123?x=1", "linkedin.com", "linkedin.com", "linkedin:123", "linkedin:123"),
        ("https://au.indeed.com/viewjob?jk=ab12", "au.indeed.com", "indeed.com", "indeed:ab12", "https://au.indeed.com/viewjob?jk=ab12"),
        ("https://www.seek.com.au/job/55?ref=a", "seek.com.au", "seek.com.au", "seek:55", "https://www.seek.com.au/job/55?ref=a"),
        ("", "", "", "", ""),
        (None, "", "", "", ""),
    ],
)
def test_urls(spark, url, host, root, dedupe, norm):
    assert one(spark, url, urls.host) == host
    assert one(spark, url, urls.registrable) == root
    assert one(spark, url, urls.dedupe_url) == dedupe
    assert one(spark, url, urls.norm_url) == norm


def test_names(spark):
    assert one(spark, "  Acme,  Pty. Ltd ", text.company_core) == "acme"
    assert one(spark, "Pty Ltd", text.company_core) == ""
    assert one(spark, "Acme & Co Group", text.company_tokens) == "acme"
    assert one(spark, None, text.slug) == ""
    assert one(spark, "Data & AI (Full Time)", text.title_text) == "data and ai"
    assert one(spark, "Zürich Straße ﬁ", text.ascii_lower) == "zurich strae fi"
    assert one(spark, "ABABab ABABab", text.undoubled) == "ABABab"
    assert one(spark, "First one. Second two. Third", lambda c: text.at_sentence(c, 20)) == "First one."
    assert one(spark, "mail a@b.co and A@B.co", text.emails) == ["a@b.co"]
    assert one(spark, "x am9obkBleGFtcGxlLmNvbQ== y", text.hidden_emails) == ["john@example.com"]
    assert one(spark, "Jane Q. Doe", lambda c: text.email_from(c, F.lit("x.com"), F.lit("{first}{last[0]}@{domain}"))) == "janed@x.com"
    assert one(spark, "Jane", lambda c: text.email_from(c, F.lit("x.com"), F.lit("{first}.{last}@{domain}"))) == ""
    assert one(spark, "use SQL and sql.", lambda c: text.highlight(c, ["sql"])) == "use <mark>SQL</mark> and <mark>sql</mark>."


def test_lists(spark):
    s = lambda *x: spark.createDataFrame([(list(x),)], "x array<string>").select(text.and_list(F.col("x"))).first()[0]
    assert (s(), s("a"), s("a", "b", "c")) == ("", "a", "a, b and c")
    e = spark.range(1).select(text.jaccard(text.strings([]), text.strings([])), text.containment(text.strings([]), text.strings(["a"]))).first()
    assert tuple(e) == (0.0, 1.0)


@pytest.mark.parametrize(
    "value,bucket,ok",
    [("2024-01-30T23:30:00", "1h", True), ("2024-01-30T22:30:00", "1h", False), ("2024-02-01T00:00:00", "24h", False), ("2024-02-03", "24h", True), ("2024-01-29", "24h", False), ("2024-01-30", "4h", False), ("nonsense", "24h", False), ("nonsense", "any", True), (None, "1h", False)],
)
def test_fresh(spark, value, bucket, ok):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    assert one(spark, value, lambda c: dates.fresh(c, bucket, now)) is ok


@pytest.mark.parametrize("value,want", [("3 days ago", "2024-01-28"), ("two weeks ago", "2024-01-17"), ("yesterday", "2024-01-30"), ("today", "2024-01-31"), ("5h ago", "2024-01-31"), ("whenever", None)])
def test_relative(spark, value, want):
    got = one(spark, value, lambda c: dates.relative_date(c, F.to_date(F.lit("2024-01-31"))))
    assert got == (want and datetime.date.fromisoformat(want))


def test_classes(spark):
    assert one(spark, "Head of Senior Things", classify.seniority) == "director"
    assert one(spark, "leader", classify.seniority) == "mid"
    assert one(spark, "gaslight", classify.sector) == "energy"
    assert one(spark, None, classify.sector) == "other"
    assert one(spark, "at least 3 years, 10+ years", classify.required_years) == 10
    assert one(spark, "5 years", classify.required_years) is None
    assert one(spark, "intro\nRequirements:\nSQL", classify.region_start) == 7
    assert one(spark, "SQL AND AWS sql AWS", classify.acronyms) == ["SQL", "AWS"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="rab &/.(é", max_size=25))
def test_automaton_is_the_pattern(t):
    import re

    aliases = {"r": "R", "ab": "AB", "b": "B", "a b": "A B"}
    found = Automaton(aliases).find(t)
    for a, label in aliases.items():
        starts = [m.start() for m in re.finditer(f"(?={alias_pattern(a)})", t.lower())]
        starts = [i for i in starts if not (i and t.lower()[i - 1].isascii() and t.lower()[i - 1].isalnum())]
        assert found.get(label, (0, 0))[0] == len(starts)


def test_strict_alias():
    m = Automaton({"r": "R"}, ("r",))
    for t, n in (("r", 1), ("R, python", 1), ("r&d", 0), ("a/r", 1), ("(r)", 0), ("r\nr", 2), ("our", 0)):
        assert m.find(t).get("R", (0, 0))[0] == n
