import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import classify, dates, extract, phrases
from tessella.operators import entity, evidence, joins, matching, merge, ordered, resume, state
from tessella.sources import files


def collect(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_days_and_times(spark):
    now = F.to_timestamp(F.lit("2024-03-10 12:00:00"))
    iso = ["2024-03-10T11:59:30", "2024-03-10T11:31:00Z", "2024-03-10T09:00:00", "2024-03-10", "2024-03-09", "2024-03-01T00:00:00", "junk", "", None]
    assert column(spark, iso, lambda c: dates.ago(c, now)) == ["just now", "29m ago", "3h ago", "today", "yesterday", "9d ago", "", "", ""]
    assert column(spark, iso, lambda c: dates.just_posted(c, now)) == [True, True] + [False] * 7
    assert column(spark, ["2024-03-10T11:00:00", "2024-03-10T11:00:01", "2024-03-10T13:00:00", "2024-03-09", "2024-03-08", "2024-03-11", "x"], lambda c: dates.fresh(c, "1h", now)) == [False, True] + [False] * 5
    assert column(spark, ["2024-03-09", "2024-03-08", "2024-03-11", "2024-03-09T12:00:00"], lambda c: dates.fresh(c, "24h", now)) == [True, False, True, False]
    today = F.to_date(F.lit("2024-03-10"))
    days = ["2024-03-12", "2024-03-10T23:00:00", "2024-03-09", "2024-03-05", "2024-02-20", "2023-12-01", "2020-05-06", "soon, they say", "", None]
    assert column(spark, days, lambda c: dates.relative_day(c, today)) == ["Mar 12", "today", "yesterday", "5d ago", "2w ago", "3mo ago", "May 2020", "soon, they", "", ""]


def test_extractors(spark):
    assert column(spark, ["$80,000 - $95k plus", "pay: none", None], extract.salary) == ["$80,000 - $95k", "Not listed", "Not listed"]
    assert column(spark, ["Work on site", "fully REMOTE", "a hybrid role", "in-office", "x", None], extract.arrangement) == ["On-site", "Remote", "Hybrid", "On-site", "Unknown", "Unknown"]
    assert column(spark, ["R, Power BI and scikit-learn; sqlite", None], extract.skills) == [["R", "Power Bi", "Scikit-Learn"], []]
    assert column(spark, ["Brisbane, QLD (Hybrid)", "Perth", None], lambda c: F.struct(*extract.place(c))) == [("Brisbane, QLD", "Hybrid"), ("Perth", ""), ("", "")]
    assert column(spark, ["call (03) 9123-4567 or +61 412 345 678"], extract.phones) == [["03) 9123 4567", "+61 412 345 678"]]
    assert column(spark, ["noreply@a.com", "x@sentry.io", "a@b.PNG", "ann@acme.com"], extract.bad_mail) == [True, True, True, False]
    page = '<meta property="og:title" content="One"><meta property="og:title" content="Two"><meta name="date" content=" 2024-01-02  x"><p>3 Mar 2020</p>'
    assert column(spark, [page, "", None], extract.open_graph) == [{"title": "Two"}, {}, {}]
    assert column(spark, [page, "<p>on 3 Mar 2020 or March 4, 2021</p>", "<p>2022-05-06</p>", None], lambda c: extract.page_date(c, c)) == ["2024-01-02 x", "March 4, 2021", "2022-05-06", ""]


def test_phrases(spark):
    said = ["provide patient care", "managing stock levels", "carry out the site work plan", "ensure compliance", "manage staff", "paint walls", "use of a microscope lens", "monitoring", "provide customer service", "", None]
    want = ["patient care", "stock levels", None, None, None, None, "microscope lens", None, None, None, None]
    assert column(spark, said, phrases.bare_noun) == want
    assert column(spark, ["manage the ward rounds"], lambda c: phrases.bare_noun(c, F.array(F.lit("ward rounds")))) == [None]


def test_residence_is_asked_of_those_who_need_a_sponsor(spark):
    texts = ["You must be a citizen.", "Veteran status, gender identity: security clearance", "none"]
    kinds = lambda sponsored: column(spark, texts, lambda c: F.transform(classify.knockouts(c, c, sponsored=sponsored), lambda k: k["type"]))
    assert kinds(False) == [[], [], []] and kinds(True) == [["work_authorization"], [], []]
    assert column(spark, ["Senior Data Analyst", "Chef", "Senior", "", None], lambda c: classify.off_target(c, ["data engineer"])) == [False, True, False, False, False]
    assert column(spark, ["Rejected late", "open", None], classify.status_is_open) == [False, True, True]


def test_confidence_needs_requirements(spark):
    rows = [(k, "sql", 6, 0, 0.15, 0, False, False, False, False, k == "found") for k in ("found", "lost")]
    hits = spark.createDataFrame(rows, "key string, label string, imp int, unknown int, soft_weight double, lacked_weight int, unmet boolean, no_authorization boolean, senior boolean, off_target boolean, in_region boolean")
    profile = spark.createDataFrame([("sql", True, False, False)], "label string, supported boolean, soft boolean, excluded boolean")
    assert {r["key"]: r["enough"] for r in matching.fit_score(hits, "key", profile, "unknown", "soft_weight").collect()} == {"found": True, "lost": False}


def test_contained_is_the_join_on_tokens(spark):
    import random

    rng = random.Random(3)
    pick = lambda n: sorted({rng.choice("abcdefghijklmnop") for _ in range(n)})
    items, texts = [(i, pick(rng.randint(0, 9))) for i in range(40)], [(i, pick(rng.randint(0, 14))) for i in range(80)]
    got = matching.contained(spark.createDataFrame(items, "i int, w array<string>"), spark.createDataFrame(texts, "t int, w array<string>"), "i", "t", "w", 0.8)
    want = [(i, t, len(set(a) & set(b)), len(a)) for i, a in items for t, b in texts if a and len(set(a) & set(b)) >= 0.8 * len(a)]
    assert collect(got, "i", "t") == sorted(want)


def test_overlay_adds_thin_rows(spark):
    base = spark.createDataFrame([(1, 10.0), (2, None)], "k int, v double")
    over = spark.createDataFrame([(2, 5.0), (3, 7.0)], "k int, v double")
    assert collect(joins.overlay(base, over, "k", ["v"]), "k") == [(1, 10.0, False), (2, 5.0, False), (3, 7.0, True)]


def board_rows(spark):
    s = "row_key int, company string, role_title string, location string, sector string, match_score int, applied_at string, starred int, dismissed int, resume_file string, notes string, app_status string, jd_posted_date string, first_seen_date string, matched_evidence string, gaps string, jd_terms_missing string, confidence string"
    base = dict(company="Acme", role_title="Clerk", location="Perth", sector="energy", match_score=60, applied_at=None, starred=0, dismissed=0, resume_file=None, notes=None, app_status=None, jd_posted_date="2024-03-10T11:30:00", first_seen_date="2024-03-01", matched_evidence="a; ;b", gaps=None, jd_terms_missing="x, y", confidence="ok")
    cases = [{}, {"match_score": None}, {"applied_at": "2024-03-02"}, {"dismissed": 1}, {"starred": 1, "match_score": 80}, {"jd_posted_date": "soon", "app_status": "interview"}, {"starred": None, "company": "Globex", "jd_posted_date": None, "first_seen_date": None}]
    return state.shaped(spark.createDataFrame([(i, *(base | c).values()) for i, c in enumerate(cases)], s))


def test_board_filters(spark):
    rows, now = board_rows(spark), F.to_timestamp(F.lit("2024-03-10 12:00:00"))
    keys = lambda **f: [r["row_key"] for r in state.board(rows, now, **f).collect()]
    assert keys() == [4, 0, 5, 6] and keys(show_dismissed=True) == [4, 0, 3, 5, 6]
    assert keys(view="applied") == [2] and keys(view="starred") == [4] and keys(view="to_review") == [4, 0, 5, 6]
    assert keys(fresh="1h") == [4, 0] and keys(day="2024-03-01") == [5] and keys(day="all", least=70) == [4]
    assert keys(status="interview") == [5] and keys(query="GLOB") == [6] and keys(sector="health") == [] and keys(starred=True) == [4]
    one = {r["row_key"]: r for r in rows.collect()}
    assert one[5]["job_day"] == "2024-03-01" and one[5]["status"] == "interview" and one[2]["status"] == "applied" and one[0]["evidence_list"] == ["a", "b"] and one[4]["score_tone"] == "high"
    assert tuple(state.board_counts(rows).first()) == (6, 1, 1, 1, 4)


def test_tracker_sorts(spark):
    g = spark.createDataFrame([(1, "beta", "2024-01-01", 50, 2, "2024-02-01"), (2, "Alpha", "2024-01-03", None, 5, "2024-01-05"), (3, None, "2024-01-02", 90, 0, None)], "company_key int, company string, added_key string, max_score int, applied_count int, last_activity string")
    keys = lambda *a: [r["company_key"] for r in state.tracker(g, *a).collect()]
    assert keys("company") == [3, 2, 1] and keys("company", "desc") == [1, 2, 3]
    assert keys("added") == [2, 3, 1] and keys("added", "asc") == [1, 3, 2] and keys("fit") == [3, 1, 2] and keys("applied") == [2, 1, 3]
    assert keys() == keys("activity") == keys("no such key") == [1, 2, 3]


def test_state_changes(spark):
    table = spark.createDataFrame([(1, "lead", "n1"), (2, "won", "n2")], "id int, stage string, name string")
    changes = spark.createDataFrame([(1, "meeting", 1), (1, "bogus", 2), (2, None, 3)], "id int, stage string, seq int")
    out, refused = state.moved(table, changes, "id", "stage", "seq", state.STAGE_FLOW)
    assert collect(out, "id") == [(1, "meeting", "n1"), (2, "won", "n2")] and refused.count() == 2
    new = spark.createDataFrame([(2, "lead", "again", 1), (2, "lead", "last", 2), (3, "lead", "new", 1)], "id int, stage string, name string, seq int")
    assert collect(state.on_conflict(table, new, "id", ["name"], "seq"), "id") == [(1, "lead", "n1"), (2, "won", "last"), (3, "lead", "new")]
    at = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([], "row_key int, event_type string, at timestamp, seq int")
    acts = spark.createDataFrame([(1, "applied", at, 1), (1, "unapplied", at, 2), (1, "dismissed", at, 3), (2, "applied", at, 4), (2, "noise", at, 5)], log.schema)
    full = state.append_events(log, acts)
    assert full.count() == 4 and [r[:3] for r in collect(state.folded(full, "row_key", "event_type", "at", "seq"), "row_key")] == [(1, False, True), (2, True, False)]


def test_migration_and_rebuild(spark, tmp_path):
    people = spark.createDataFrame([("p1", "c1", "Ann", "Clerk", "a@x", "d1"), ("p2", "c2", "Bo", None, None, "d2")], "person_key string, company_key string, name string, role string, verified_email string, created_at string")
    log = spark.createDataFrame([("p1", "contacted", "hi", "d3")], "person_key string, outreach_status string, notes string, updated_at string")
    names = spark.createDataFrame([("c1", "Acme")], "company_key string, company_name string")
    empty = spark.createDataFrame([], "person_key string, company_key string, company_name string, name string, title string, email string, outreach_status string, notes string, created_at string, updated_at string")
    once = state.migrated(empty, people, log, names)
    assert [r[:8] for r in collect(once, "person_key")] == [("p1", "c1", "Acme", "Ann", "Clerk", "a@x", "contacted", "hi"), ("p2", "c2", "c2", "Bo", None, None, "not_contacted", "")]
    assert collect(state.migrated(once, people.withColumn("name", F.lit("x")), log, names), "person_key") == collect(once, "person_key")
    folder = f"file://{tmp_path}"
    names.write.parquet(f"{folder}/users")
    for n in (1, 2):
        assert state.rebuilt(spark, {"jobs": spark.range(n)}, folder, kept=("users",)) == {"jobs": n}
    assert spark.read.parquet(f"{folder}/users").count() == 1
    with pytest.raises(ValueError):
        state.rebuilt(spark, {"users": names}, folder, kept=("users",))


def lines(spark, *texts):
    return spark.createDataFrame([(k, i, v) for k, t in enumerate(texts) for i, v in enumerate(x.strip() for x in t.split("\n") if x.strip())], "k int, line int, value string")


def test_resume_experience_layouts(spark):
    one = "before any head\nData Analyst | Acme   Jan 2021 – Present\n- built things\nmore prose\nClerk - Globex\n2015 - 2018\n• kept books"
    two = "Data Intern    Feb 2020 - Nov 2020 |\nCultural Group, Melbourne\n- wrote reports"
    three = "Analyst  |  2019 - 2020\nAcme Holdings | Perth Office\n- did it"
    got = collect(resume.experiences(lines(spark, one, two, three, "no head here"), "k"), "k", "slot")
    assert got[:2] == [(0, 1, "Data Analyst", "Acme", "Jan 2021 – Present", ["built things", "more prose"]), (0, 2, "Clerk", "Globex", "2015 - 2018", ["kept books"])]
    assert got[3:] == [(2, 1, "Analyst", "Acme Holdings, Perth Office", "2019 - 2020", ["did it"])]
    assert got[2][3:] == ("Cultural Group, Melbourne", "Feb 2020 - Nov 2020 ", ["wrote reports"]) or got[2][3:] == ("Cultural Group, Melbourne", "Feb 2020 - Nov 2020", ["wrote reports"])


def test_resume_education_and_projects(spark):
    one = "Bachelor of Science, University of Perth, 2011 - 2014, GPA: 3.5/4\nMaster of Data\nCurtin University\n2015 - 2016\n79/100"
    got = collect(resume.education(lines(spark, one), "k"), "k", "slot")
    assert got == [(0, 1, "Bachelor of Science", "University of Perth", "2011 - 2014", "3.5/4", "GPA"), (0, 2, "Master of Data", "Curtin University", "2015 - 2016", "79/100", "")]
    p = collect(resume.projects(lines(spark, "- stray\nMy Tool\n- did a\nIt is used by many people every day.\nOther Tool"), "k"), "k", "slot")
    assert p == [(0, 1, "My Tool", ["did a", "It is used by many people every day."]), (0, 2, "Other Tool", [])]


def test_facts_and_flaws(spark):
    b = spark.createDataFrame([("s", 1, "Built A"), ("s", 2, "built B"), ("s", 3, "Spearheaded C"), ("s", 4, " "), ("t", 1, "utilized D")] + [("u", i, f"w{i} x") for i in range(8)], "slot string, n int, text string")
    got = [(r["slot"], r["fact"], r["text"], r["budget"]) for r in resume.facts(b, ["slot"], "n", "text").orderBy("slot", "fact").collect()]
    assert got[:2] == [("s", 1, "Built A", 1), ("t", 1, "utilized D", 1)] and len(got) == 10 and got[2][3] == 5
    bank = spark.createDataFrame([("s", "Built A", ["SQL"], 3), ("s", "built B", ["Foo"], 3), ("t", "A team player", ["SQL"], 1)], "slot string, text string, evidences array<string>, budget int")
    known = spark.createDataFrame([("SQL",)], "label string")
    assert collect(resume.flaws(bank, ["slot"], "text", "evidences", known, "label"), "slot", "flaw") == [("s", "duplicate opener", "built"), ("s", "pool smaller than budget", "2 of 3"), ("s", "unknown label", "Foo"), ("t", "banned phrase", "team player")]
    assert tuple(resume.best_slot(bank.withColumn("n", F.when(F.col("slot") == "s", 1).otherwise(2)), ["n"], "evidences", F.array(F.lit("SQL"))).first()) == (1, 1)


def test_merges(spark):
    p = spark.createDataFrame([("Acme Pty Ltd", "Clerk", "", "", "", "b", 1), ("ACME", "clerk", "2024-01-02", "2 days ago", "u", "a", 2), ("Acme Group", "Clerk", "", "", "", "a", 3)], "company_name string, role_title string, posted_at_iso string, posted_relative string, posting_url string, source string, seq int")
    got = collect(merge.postings(p, "company_name", "role_title", "seq").select("company_name", "posted_at_iso", "posted_relative", "posting_url", "source"), "company_name")
    assert got == [("Acme Group", "", "", "", "a"), ("Acme Pty Ltd", "2024-01-02", "2 days ago", "u", "a,b")]
    q = spark.createDataFrame([("Ann Lee", "", "x", 1), ("ann-lee", "a@x", "", 2), ("123", "b@x", "y", 3)], "name string, email string, source string, seq int")
    assert [(r["k"], r["email"], r["source"]) for r in merge.people(q, "name", "seq", "source").collect()] == [("annlee", "a@x", "x")]
    posting = spark.createDataFrame([(80, "x" * 650, "acme.com", "https://jobs.acme.com/1"), (None, None, None, None)], "s int, t string, d string, u string")
    assert sorted(r[0] for r in posting.select(merge.source_quality(F.col("s"), F.col("t"), F.col("d"), F.col("u"))).collect()) == [0, 80 + 2 + 10 + 8 + 12]


def test_set_cover_by_brute_force(spark):
    facts = [("one", 2, 0, ["a"]), ("one", 2, 1, ["b", "a"]), ("one", 2, 2, ["c"]), ("two", 1, 0, ["d"]), ("two", 1, 1, ["c", "d"])]
    hits = [(k, l, n) for k in range(6) for l, n in zip("abcd", [(k * 3) % 4, (k * 5) % 4, (k + 1) % 4, k % 3]) if n]
    want = []
    for k in sorted({h[0] for h in hits}):
        worth = {l: n for q, l, n in hits if q == k}
        for slot in ("one", "two"):
            rest, covered = [f for f in facts if f[0] == slot], set()
            for _ in range(rest[0][1]):
                gain = [sum(worth.get(e, 0) for e in set(f[3]) - covered) for f in rest]
                at = gain.index(max(gain))
                want.append((k, slot, rest[at][2], gain[at]))
                covered |= set(rest.pop(at)[3])
    got = entity.set_cover(spark.createDataFrame(facts, "slot string, budget int, fact int, evidences array<string>"), spark.createDataFrame(hits, "k int, label string, imp int"), "k")
    assert collect(got, "k", "slot", "fact") == sorted(want)


def test_sources_of_pages_and_files(spark, tmp_path):
    page = '<script>window.data["x"] = {"results": [{"company": "Acme", "title": "Clerk"}]}; </script>'
    card = '<article data-automation="normalJob"><a href="/job/7"></a><b data-automation="jobTitle">Clerk</b><i data-automation="jobCompany"> Acme </i><u data-automation="jobLocation">Perth</u><s data-automation="jobListingDate">2d ago</s></article>'
    df = spark.createDataFrame([(1, page), (2, card + '<article data-automation="normalJob">none</article>'), (3, None)], "id int, html string")
    got = files.embedded_json(df, "html", 'window.data["x"]', "results array<struct<company string, title string>>").orderBy("id").collect()
    assert got[0]["data"]["results"][0]["company"] == "Acme" and got[1]["data"] is None and got[2]["data"] is None
    assert collect(files.article_cards(df, "html"), "id") == [(2, "Clerk", "Acme", "Perth", "2d ago", "/job/7")]
    reg = spark.createDataFrame([("x", "Acme", "7"), ("Globex", None, "")], "first string, `Company Name` string, Employees string")
    assert collect(files.registry(reg, {"name": ["company name", "name"], "employees": ["employees"]}, "name"), "name") == [("Acme", "7"), ("Globex", None)]
    text = 'Name,COMPANY,Email\n"Lee, Ann",Acme,a@x\n,Acme,b@x\nBo,Globex\n'
    rows, counts = files.import_text(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "t", ["company", "name", "email"], ["company", "name"], "id")
    assert [r[2:] for r in collect(rows, "n")] == [("Acme", "Lee, Ann", "a@x"), ("Globex", "Bo", "")] and collect(counts, "id") == [(1, 2, 1)]
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p><w:r><w:t xml:space="preserve">One &amp; </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:document>')
    (tmp_path / "b.md").write_text("# md")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.documents_text(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.docx": "One & two\nThree", "b.md": "# md", "c.docx": None, "d.pdf": None}


def test_side_files(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "acme_match_report.json").write_text(json.dumps({"job_url": "u", "gaps": ["a", "b"]}))
    assert collect(files.reports(spark, f"{at}/*_match_report.json", "job_url string, gaps array<string>", ["gaps"]), "stem") == [("u", "a, b", "acme")]
    for n in (1, 2):
        files.append_json(spark.createDataFrame([("k", n)], "k string, n int"), f"{at}/side")
    side = spark.read.schema("k string, n int").json(f"{at}/side")
    assert collect(files.keyed_last(side, "k", "n"), "k") == [("k", 2)]
    for n in (3, 2):
        files.replaced(spark.range(n).toDF("x"), f"{at}/whole")
        assert files.current(spark, f"{at}/whole").count() == n
    nested = spark.createDataFrame([("a", None, [("x", ["1", "2"])]), ("b", "rejected", [("y", [])]), ("c", "accepted", None)], "k string, status string, people array<struct<name string, mails array<string>>>")
    assert collect(files.flat_people(nested, ["k"], "people", "status"), "k") == [("a", 0, "x", "1;2")]


def test_ranked_addresses(spark):
    c = spark.createDataFrame([(1, 1, "https://jobs.lever.co/acme/x", "Data Clerk"), (1, 2, "https://acme.com/careers/data-clerk", "Data Clerk"), (1, 3, "https://www.seek.com.au/job/1", "Data Clerk"), (1, 4, "", "Data Clerk")], "k int, n int, url string, title string")
    assert [(r["n"], r["score"]) for r in evidence.ranked(c, "k", "url", "title", "n", F.lit("acme.com")).orderBy("rank").collect()] == [(2, 75 + 12 + 6), (1, 80), (3, 35 + 12), (4, 0)]


def test_stream_results_are_tables(spark, sf):
    from tessella.plans import texts

    a, b = (texts.Q["stream_first_seen"](spark, sf) for _ in range(2))
    assert collect(a, "user_id") == collect(b, "user_id")


def test_page_parse_by_hand(spark, sf):
    import html
    import re

    from tessella.sources.html import parsed

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    text = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in parsed(pages, "page_id", "html").collect():
        raw = text[r["page_id"]]
        assert r["title"] == " ".join(html.unescape(re.search(r"<title>(.*?)</title>", raw, re.S)[1]).split())
        assert r["links"] == [html.unescape(x) for x in re.findall(r'<a [^>]*?href="([^"]*)"', raw)]


def test_summaries_by_hand(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words = ["the", "que", "der"]
    want = {}
    for r in docs.collect():
        s = [x.strip(" ") for x in re.split(r"(?<=[.!?]) +", r["text"] or "")]
        s = [x for x in s if len(re.split(r"\s+", x)) > 5]
        rated = sorted(((-(sum(w in x.lower() for w in words) + (i < 3)), i, x) for i, x in enumerate(s)), key=lambda t: t[:2])
        top = [x for score, _, x in rated if score < 0][:2]
        if top:
            want[r["doc_id"]] = " ".join(top)
    assert {r["doc_id"]: r["value_prop"] for r in evidence.summary(docs, "doc_id", "text", words).collect()} == want


def test_windows_of_sentences(spark):
    w = ordered.sentence_windows(spark.createDataFrame([(1, "A b. C d! E?")], "k int, t string"), "k", "t")
    assert collect(w, "start") == [(1, 0, "A b. C d!"), (1, 1, "C d! E?")]




def test_registered_functions(spark):
    from tessella.functions import register, text, urls

    names = register.register_functions(spark)
    values = ["Acme  Pty. Ltd", " Globex & Co ", "https://user@www.Seek.com.au:80/job/1", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    df.createOrReplaceTempView("registered_values")
    got = spark.sql("SELECT i, company_key(v), slugify(v), company_core(v), url_host(v) FROM registered_values ORDER BY i").collect()
    c = F.col("v")
    want = df.orderBy("i").select("i", text.company_key(c), text.slug(c), text.company_core(c), urls.host(c)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(names) == 11
    assert spark.sql("SELECT is_job_board('https://au.indeed.com/x'), round(text_similarity('abcd', 'abce'), 2)").first()[:] == (True, 0.75)


def test_names_and_normalisers(spark):
    from tessella.functions import people, text

    assert column(spark, ["O'NEIL smith", "JOSÉ O'NEIL", "smith-jones", "Ann Lee", "ann lee, CPA is open to work", None], people.plain_name)[:4] == ["O'NEIL smith", "Jose O'Neil", "Smith-Jones", "Ann Lee"]
    assert column(spark, ["ＡＢ　ｃ  d", None], text.clean_text) == ["AB c d", ""]
    assert column(spark, ["Acme Group Services Pty  Ltd", None], text.company_letters) == ["acme", ""]
    assert column(spark, ["Acme Australian Energy Co", None], text.company_words) == [["acme", "energy"], []]
    assert column(spark, ["R&D Team / Lead" + "x" * 100], text.file_slug) == ["r-and-d-team-lead" + "x" * 73]
    assert column(spark, ["<b>C++ & SQL</b>\nsql"], lambda c: text.highlight(c, ["sql", "c++ &amp;"])) == ["&lt;b&gt;<mark>C++ &amp;</mark> <mark>SQL</mark>&lt;/b&gt;<br><mark>sql</mark>"]
