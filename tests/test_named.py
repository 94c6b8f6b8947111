"""Functions that no query's SQL reaches, against plain Python."""

import html
import random
import re

from pyspark.sql import functions as F

from tessella.functions import classify, extract, text, urls
from tessella.operators import entity, evidence, matching, merge, ordered
from tessella.operators import resume as R
from tessella.operators import state
from tessella.plans import registry
from tessella.sources import files
from tessella.sources import html as pages
from tessella.streaming import events as E


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def marked(body, told):
    terms = set()
    for chunk in (told or "").split(";"):
        for t in (chunk.strip(), *(x.strip() for x in re.split("[/&,]", chunk))):
            if len(t) >= 2:
                terms.add(t)
    safe = html.escape(body or "", quote=False)
    if terms:
        rx = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
        safe = re.sub(rf"(?<!\w)({rx})(?!\w)", r"<mark>\1</mark>", safe, flags=re.I)
    return safe.replace("\n", "<br>")


def test_highlight_by_rows_evidence(spark):
    r = random.Random(1)
    words = ["sql", "SQL", "c++", "r", "<b>", "power bi", "power", "a.b", "x\ny", "é", "data-set", "(q)"]
    rows = [(i, " ".join(r.choice(words) for _ in range(8)), r.choice([None, "", ";", "sql; power bi", "SQL/c++ & r, power", "a.b; data", "(q);é!,x"])) for i in range(80)] + [(99, None, "sql")]
    df = spark.createDataFrame(rows, "i int, t string, e string")
    got = {x["i"]: x["h"] for x in df.select("i", text.highlight_evidence(F.col("t"), F.col("e")).alias("h")).collect()}
    assert got == {i: marked(t, e) for i, t, e in rows}


def test_marked_adverts(spark, sf):
    from tessella import tables as D

    want = {r["id"]: marked(r["text"], f"SQL/Excel; {re.search(r'skills, (\w+)', r['text'])[1]}; c++ & r, {r['title']}") for r in D.adverts(spark, sf).collect()}
    assert {r["id"]: r["html"] for r in registry.QUERIES["marked_adverts"](spark, sf).collect()} == want


def test_import_of_quoted_newlines(spark):
    body = 'Company,Name,Note\r\nAcme,"Ann ""A"" Lee","two\nlines, and a comma"\n\nGlobex,Bo,plain\n,Nobody,x\nOpen,"never closed,y\nNext,Zoe,z'
    rows, counts = files.import_text(spark.createDataFrame([(1, body)], "id int, t string"), "t", ["company", "name", "note"], ["company", "name"], "id")
    got = [tuple(r)[2:] for r in rows.orderBy("n").collect()]
    assert got[:2] == [("Acme", 'Ann "A" Lee', "two\nlines, and a comma"), ("Globex", "Bo", "plain")] and got[-1] == ("Next", "Zoe", "z")
    assert [tuple(r) for r in counts.collect()] == [(1, 4, 1)]


def test_page_parts(spark):
    page = '<html><head><title> A  B </title><meta name="Description" content="d1"><meta property="og:title" content="t"><meta name="description" content="d2"><script type="application/ld+json">{"a": 1}</script></head><body>x<a href="/u">one <b>two</b></a><a>none</a> y<a href="/v">z</a></body></html>'
    got = {r["k"]: r for r in pages.parsed(spark.createDataFrame([(1, page), (2, None)], "k int, h string"), "k", "h").collect()}
    one = got[1]
    assert [tuple(a) for a in one["anchors"]] == [("/u", "one two"), ("/v", "z")] and one["meta"] == {"description": "d2", "og:title": "t"} and one["json_ld"] == ['{"a": 1}']
    assert (one["title"], one["links"]) == ("A B", ["/u", "/v"]) and got[2]["anchors"] == [] and got[2]["meta"] == {}


def test_prospect_groups_in_order(spark):
    c = spark.createDataFrame([("a", "beta", False), ("b", "Alpha", False), ("c", "zed", True), ("d", "", False)], "k string, n string, p boolean")
    p = spark.createDataFrame([("a", 2, "Bo"), ("a", 1, "ann"), ("x", 3, None)], "k string, prospect int, name string")
    got = state.prospect_groups(c, p, "k", "n", "p").collect()
    assert [r["k"] for r in got] == ["c", "b", "a", "d", "x"] and [r["prospect_count"] for r in got] == [0, 0, 2, 0, 1]
    assert [x["prospect"] for x in got[2]["prospects"]] == [1, 2] and got[4]["company_name"] == "x"


def test_fixed_columns_sink_and_append(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1, "extra")], "x string, y int, z string")
    files.write_csv(df, at, ["y", "x"])
    files.write_csv(df, at, ["y", "x"], mode="append")
    assert sorted(map(tuple, files.read_csv(spark, at).select("y", "x").collect())) == [("1", "a"), ("1", "a")]


def test_small_rules(spark):
    assert column(spark, ["acme recruitment", "Hays", "Acme", None], classify.is_recruiter)[2:] == [False, False]
    assert [tuple(r) for r in merge_once(spark)] == [("old",), ("new",)]
    assert ordered_two(spark) == [("b", "a")]


def merge_once(spark):
    df = spark.createDataFrame([(1, "old"), (2, None)], "i int, o string")
    return df.orderBy("i").select(merge.set_once(F.col("o"), F.lit("new"))).collect()


def ordered_two(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "2 days ago")], "k int, line int, value string")
    out = ordered.previous_two(df, "k", "line", F.col("value").rlike("ago"), "value")
    return [(r["prev1"], r["prev2"]) for r in out.collect()]


def test_overlay_of_aliases(spark):
    a = spark.createDataFrame([("sql", "database")], "alias string, label string")
    b = spark.createDataFrame([("sql", "query language"), ("r", "statistics")], "alias string, label string")
    assert sorted(map(tuple, matching.overlay_aliases(a, b).collect())) == [("r", "statistics"), ("sql", "database")]


def test_body_gate(spark):
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(0, base), (1, base[:390] + "x" * 10), (2, base[:300]), (3, base[::-1]), (4, "short"), (5, "short"), (6, base[:200] + "y" + base[200:])]
    df = spark.createDataFrame(rows, "k int, t string")
    got = sorted((x["a"], x["b"]) for x in entity.body_gate(df, "k", "t", F.lit(0)).collect())
    assert got == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and entity.similarity(a[1], b[1]) > 0.97]


def test_deduplicated_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 1, "view", 1.0, ""), (1, None, 1, "view", 1.0, ""), (2, None, 1, "view", 1.0, "")], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = E.drained(E.deduplicated(E.source(spark, str(tmp_path / "in"))), str(tmp_path / "out"), mode="append")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2]


def test_table_functions_equal_the_frames(spark, sf):
    from tessella.functions.register import register_functions

    assert {"text_lines", "line_sections", "pasted_rows"} <= set(register_functions(spark))
    texts = [(1, "Clerk | Acme | Perth\n\n Analyst \nGlobex\n3 days ago\nLead\nInitech\nposted today\nyesterday"), (2, None), (3, "ago"), (4, "a | b\nA short head\n" + "x" * 30)]
    df = spark.createDataFrame(texts, "key int, t string")
    df.selectExpr("cast(key as string) as key", "t").createOrReplaceTempView("pasted_texts")
    lines = "SELECT key, l.line, l.value FROM pasted_texts, LATERAL text_lines(t) l"
    sort = lambda rows: sorted(map(tuple, rows), key=repr)
    assert sort(spark.sql(lines).selectExpr("cast(key as int)", "line", "value").collect()) == sort(ordered.lines(df, "key", "t").collect())
    got = spark.sql(f"SELECT cast(key as int), line, role_title, company, location FROM pasted_rows(TABLE({lines}) PARTITION BY key ORDER BY line)")
    assert sort(got.collect()) == sort(files.pasted_rows(df, "key", "t").collect())
    got = spark.sql(f"SELECT cast(key as int), line, value, section, section_no FROM line_sections(TABLE({lines}) PARTITION BY key ORDER BY line)")
    want = ordered.sections(ordered.lines(df, "key", "t"), "key", "line", F.length("value") < 20, "value").select("key", "line", "value", "section", F.col("section_no").cast("int"))
    assert sort(got.collect()) == sort(want.collect())


def test_custom_rules(spark):
    rules = {"year": r"\b(?:19|20)\d\d\b", "name": r"by (\w+)", "both": r"(\w+)=(\d+)", "none": "zzz"}
    said = ["By Ann, 1999 and 2001, a=1 b=2", None, "by ", "x=5"]
    got = column(spark, said, lambda c: extract.custom_rules(c, rules))
    want = []
    for s in said:
        found = {k: re.findall(p, s or "", flags=re.I) for k, p in rules.items()}
        want.append({k: m[0] if isinstance(m[0], str) else str(m[0]) for k, m in found.items() if m})
    assert got == want
