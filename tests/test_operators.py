import random

import pytest

from pyspark.sql import functions as F

from tessella.functions.text import company_core
from tessella.operators import alike, entity, grouping, joins, matching, merge, ordered
from tessella.sources import files


def collect(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_upsert(spark):
    s = "key string, seq int, job_text string, location string, notes string"
    old = spark.createDataFrame([("a", 1, "short", "", "n1"), ("a", 2, "longer text", "x", "n2"), ("b", 3, "same", None, "keep"), (None, 4, "nul", "l", "n")], s)
    new = spark.createDataFrame([("a", 1, " tiny ", "y", ""), ("b", 2, "eman", "z", None), ("c", 3, " new ", "", "c1"), ("c", 4, "newer one", "w", "c2")], s)
    got = {r["key"]: (r["job_text"], r["location"], r["notes"]) for r in merge.upsert(old, new, "key", "seq").collect()}
    assert got == {"a": ("longer text", "x", ""), "b": ("same", "z", None), None: ("nul", "l", "n"), "c": ("newer one", "w", "c2")}


def test_upsert_is_idempotent(spark):
    s = "key string, seq int, job_text string, location string, notes string"
    old = spark.createDataFrame([("a", 1, "x", "", "n")], s)
    new = spark.createDataFrame([("a", 1, "yy", "l", "m")], s)
    once = merge.upsert(old, new, "key", "seq").select("key", F.lit(1).alias("seq"), "job_text", "location", "notes")
    assert collect(merge.upsert(once, new, "key", "seq"), "key") == collect(merge.upsert(old, new, "key", "seq"), "key")


def test_state_survives_ingest(spark):
    s = "key string, name string, status string, seq int"
    table = spark.createDataFrame([("a", "Old", "contacted", 0)], s)
    new = spark.createDataFrame([("a", "New", None, 1), ("b", "B", None, 2), ("b", "B2", None, 3)], s)
    got = collect(merge.ingest(table, new, "key", ["name"], "seq", {"status": "not_contacted"}).select("key", "name", "status"), "key")
    assert got == [("a", "New", "contacted"), ("b", "B", "not_contacted")]


def test_inserts(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    n = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert collect(merge.insert_or_ignore(t, n, "k"), "k") == [("a", 1), ("b", 3)]
    assert collect(merge.insert_or_replace(t, n.withColumn("s", F.col("v")), "k", "s"), "k") == [("a", 2), ("b", 3)]


def test_survivors(spark):
    rows = spark.createDataFrame([(1, 1, 5, "short", "SQL; Python", "b"), (1, 2, 9, "", "sql||R", "a"), (2, 3, 1, "t", "", "c")], "g int, seq int, q int, text string, skills string, src string")
    got = {r["g"]: (r["primary_seq"], r["text"], r["skills"], r["src"], r["n"]) for r in merge.survivors(rows, "g", "seq", F.col("q"), "text", ["skills"], ["src"]).collect()}
    assert got == {1: (2, "short", "SQL; Python; R", "a; b", 2), 2: (3, "t", "", "c", 1)}


def test_tiers_and_sidecar(spark):
    left = spark.createDataFrame([(1, "u1", "c"), (2, None, "c"), (3, "u9", "z")], "id int, url string, name string")
    right = spark.createDataFrame([("u1", "x", 1, "A"), ("u2", "c", 2, "B"), ("u3", "c", 3, "C")], "r_url string, r_name string, seq int, v string")
    got = collect(joins.tiers(left, right, [(F.col("url"), F.col("r_url")), (F.col("name"), F.col("r_name"))], "seq", "v").select("id", "tier", "v"), "id")
    assert got == [(1, 1, "A"), (2, 2, "B"), (3, None, None)]
    raw = spark.createDataFrame([("a", "long text"), ("b", "x"), ("c", "y")], "k string, t string")
    side = spark.createDataFrame([("a", "short", 1), ("b", "old", 1), ("b", "replaced", 2)], "k string, t string, n int")
    assert collect(joins.sidecar(raw, side, "k", "t", "n").select("k", "t", "outcome"), "k") == [("a", "long text", "kept"), ("b", "replaced", "replaced"), ("c", "y", "unmatched")]


def duplicate(c, p):
    """Why a candidate is a duplicate of an earlier row, or ''."""
    if c["url"] and c["url"] == p["url"]:
        return "same url"
    if not c["owner"] or c["owner"] != p["owner"]:
        return ""
    alike = entity.similarity(c["title"], p["title"])
    if (not c["location"] or not p["location"] or c["location"] == p["location"]) and alike >= 0.92:
        return "same company and location, near-identical title"
    a, b = set(c["sig"]), set(p["sig"])
    return "same company and title, overlapping text" if alike >= 0.86 and a and b and len(a & b) / len(a | b) >= 0.45 else ""


def first_fit_by_hand(rows):
    groups, out = [], []
    for r in rows:
        hit, why = None, ""
        for g in groups:
            why = next((w for m in g if (w := duplicate(r, m))), "")
            if why:
                hit = g
                break
        if hit is None:
            groups.append([r])
        else:
            hit.append(r)
        out.append((r["seq"], (hit or [r])[0]["seq"], why))
    return out


FIT = "seq long, url string, owner string, title string, location string, sig array<string>"


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pick = lambda xs, n: [rng.choice(xs) for _ in range(n)]
    words = ["senior", "data", "analyst", "engineer", "date", "analysts", "sr", "lead", ""]
    urls = (["", "", "u1", "u2"], [""], [""] * 9 + ["u1"])[seed]
    rows = [dict(seq=3 * i + 1, url=rng.choice(urls), owner=rng.choice(["a", "a", "b", ""]), title=" ".join(pick(words, rng.randint(0, 4))), location=rng.choice(["", "x", "y"]), sig=pick("abcdef", rng.randint(0, 4))) for i in range(220)]
    df = spark.createDataFrame([tuple(r.values()) for r in rng.sample(rows, len(rows))], FIT).repartition(3)
    got = collect(grouping.first_fit(df), "seq")
    assert got == first_fit_by_hand(rows)
    if seed == 0:
        assert {x[2] for x in got} == {"", *grouping.REASONS}  # every rule is met


def test_first_fit_is_not_transitive(spark):
    # b resembles a, c resembles b but not a: c joins through b; rows of one URL meet whoever owns them; groups never merge
    rows = [(1, "", "o", "senior data analyst melbourne", "", []), (2, "", "o", "senior data analyst melbourn", "", []), (3, "u", "o", "other", "", []), (4, "u", "p", "unlike", "", []), (5, None, None, None, None, None), (6, None, None, None, None, None)]
    df = spark.createDataFrame(rows, FIT)
    assert collect(grouping.first_fit(df).select("seq", "group_seq"), "seq") == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)]
    assert grouping.first_fit(df.limit(0)).count() == 0


def test_groups_of_parts(spark, sf):
    from tessella.plans import texts

    rows = [r.asDict() for r in texts.rows_of_titles(spark, sf).drop("price").orderBy("seq").collect()]
    want = first_fit_by_hand(rows)
    assert collect(texts.duplicate_groups(spark, sf), "seq") == want and {w[2] for w in want} <= {"", *grouping.REASONS}
    told = {r["seq"]: (r["group_seq"], r["role"]) for r in texts.duplicate_review(spark, sf).collect()}
    assert {k: v[0] for k, v in told.items()} == {w[0]: w[1] for w in want}
    assert sum(v[1] == "primary" for v in told.values()) == len({w[1] for w in want})


def test_resolution(spark):
    typed = spark.createDataFrame([(1, "acme"), (2, "Acme Limited"), (3, "Globex Corporatoin Holdings"), (4, "Nobody")], "seq int, name string")
    cand = spark.createDataFrame([(1, "k1", "ACME"), (2, "k2", "Globex Corporation Holdings")], "seq int, company_key string, company string")
    assert collect(entity.resolve(typed, cand).select("seq", "match_type", "company_key"), "seq") == [(1, "exact", "k1"), (2, "suffix", "k1"), (3, "fuzzy", "k2"), (4, "new", "nobody")]


def near_names(rng, n):
    """Names a few edits from one of three stems, at any place."""
    out = []
    for _ in range(n):
        w = list(rng.choice(["cold anvil promo", "old brass ring 🙂 economy", "acme holdings of nowhere"]))
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice(([], [rng.choice("abco ")], [w[p], rng.choice("abco ")]))
        out.append("".join(w))
    return out


def expanded(pairs, members, least):
    """All pairs of rows that pairs of classes and their membership stand for, with their ratios."""
    rows, out = {}, []
    for key, cls, _, among in members:
        rows.setdefault((cls, among), []).append(key)
    of = {cls: keys for (cls, _), keys in rows.items()}
    for (_, among), keys in rows.items():
        out += [(a, b, 1.0) for a in keys for b in keys if a < b and among]
    for a, b, forward, back, a_n, b_n in pairs:
        assert (len(of[a]), len(of[b])) == (a_n, b_n)
        both = [(x, y, forward) if x < y else (y, x, back) for x in of[a] for y in of[b]]
        out += [x for x in both if x[2] >= least]
    return sorted(out)


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(3)
    names = ["cold anvil promo", "old anvil promo", "a", "a", "", None, "x" * 230, "y" + "x" * 229, "x" * 231, "aaaa", "aaaab", "baaaa", *near_names(rng, 150)]
    names += rng.choices(names, k=40)
    rows = [(i, rng.choice("op"), t, rng.choice(["", "here", "there", None])) for i, t in enumerate(names)]
    df = spark.createDataFrame(rows, "seq long, owner string, title string, location string")
    near = lambda x, y: x == "" or y == "" or (x is not None and x == y)
    want = [(a[0], b[0], entity.similarity(b[2], a[2])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and near(a[3], b[3])]
    args = ("seq", "owner", "title", "location")
    members = list(map(tuple, entity.title_classes(df, *args).collect()))
    for least in (0.92, 0.86, 0.6):
        got = expanded(map(tuple, entity.similar_pairs(df, *args, least).collect()), members, least)
        assert got == sorted(x for x in want if x[2] >= least) and len({x[0] for x in got}) > 20


def test_similar_titles(spark, sf):
    from tessella.plans import texts

    df = texts.rows_of_titles(spark, sf)
    rows = df.select("seq", "owner", "title", "location").collect()
    near = lambda x, y: x == "" or y == "" or x == y
    want = [(a[0], b[0], entity.similarity(b[2], a[2])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and near(a[3], b[3])]
    members = list(map(tuple, entity.title_classes(df, "seq", "owner", "title", "location").collect()))
    assert expanded(map(tuple, texts.similar_titles(spark, sf).collect()), members, 0.92) == sorted(x for x in want if x[2] >= 0.92)


def test_few_candidates_are_measured(spark):
    """Of random titles hardly any pair that is not near-identical is measured."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    titles = {" ".join(rng.sample(words, 3)) for _ in range(1500)}
    titles |= {t.replace("a", "e", 1) for t in titles}
    df = spark.createDataFrame([("o", t) for t in titles], "o string, t string")
    found, met = alike.pairs(df, "o", "t", 0.92).count(), alike.met(df, "o", "t", 0.92).count()
    assert 500 < found <= met <= 3 * found


def test_suggestions_rank_every_candidate(spark, monkeypatch):
    monkeypatch.setattr(entity, "TYPED", 7)
    monkeypatch.setattr(entity, "CANDIDATES", 16)
    rng = random.Random(4)
    names = ["The Acme", "Zlobex", "", None, "z" * 80, *near_names(rng, 20)]
    known = ["Acme Pty Ltd", "Globex Inc", "Pty Ltd", "z" * 79 + " q", *near_names(rng, 70)]
    typed = spark.createDataFrame(list(enumerate(names)), "seq int, name string")
    cand = spark.createDataFrame([(i, f"k{i}", x) for i, x in enumerate(known)], "seq int, company_key string, company string")
    core = lambda df, c: [r[0] for r in df.orderBy("seq").select(company_core(F.col(c))).collect()]
    of, to = core(typed, "name"), core(cand, "company")
    best = [sorted((-entity.similarity(a, b), j) for j, b in enumerate(to))[:5] for a in of]
    got = collect(entity.suggestions(typed, cand).select("seq", "rank", "company_key", "similarity"), "seq", "rank")
    assert got == [(i, k + 1, f"k{j}", round(-s, 6)) for i, top in enumerate(best) for k, (s, j) in enumerate(top)]
    assert got[0][2] == "k0" and got[5][2] == "k1"
    # resolution: the best of all, wherever the core differs
    fuzzy = {r["seq"]: r["company_key"] for r in entity.resolve(typed, cand).where("match_type = 'fuzzy'").collect()}
    assert fuzzy == {i: f"k{top[0][1]}" for i, (a, top) in enumerate(zip(of, best)) if a and a not in to and -top[0][0] >= 0.90}


def test_resolution_where_both_ends_differ(spark):
    typed = spark.createDataFrame([(1, "Xlobex Corporation Holdingz")], "seq int, name string")
    cand = spark.createDataFrame([(1, "k1", "Globex Corporation Holdings")], "seq int, company_key string, company string")
    assert collect(entity.resolve(typed, cand).select("match_type", "company_key"), "match_type") == [("fuzzy", "k1")]


def test_similarity_keeps_order():
    assert entity.similarity("tide", "diet") == 0.25 and entity.similarity("diet", "tide") == 0.5


def test_fit_caps(spark):
    base = dict(unknown=0, soft_weight=0.15, lacked_weight=0, unmet=False, no_authorization=False, senior=False, off_target=False)
    cases = {"plain": {}, "unmet": {"unmet": True}, "auth": {"no_authorization": True, "unmet": True}, "senior": {"senior": True}, "off": {"off_target": True}, "none": {}}
    rows = [(k, None if k == "none" else "sql", 6, *(base | v).values()) for k, v in cases.items()]
    hits = spark.createDataFrame(rows, "key string, label string, imp int, unknown int, soft_weight double, lacked_weight int, unmet boolean, no_authorization boolean, senior boolean, off_target boolean")
    profile = spark.createDataFrame([("sql", True, False, False)], "label string, supported boolean, soft boolean, excluded boolean")
    got = {r["key"]: r["fit"] for r in matching.fit_score(hits, "key", profile, "unknown", "soft_weight").collect()}
    assert got == {"plain": 75, "unmet": 35, "auth": 25, "senior": 64, "off": 52, "none": 0}


def test_two_matchers_agree(spark):
    aliases = {"R": ["r"], "SQL": ["sql", "structured query"], "C": ["c++"]}
    texts = ["r, sql", "R&D structured query sql", "c++ and C", "our", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    native = {r["id"]: {h["label"]: h["freq"] for h in r["h"]} for r in df.select("id", matching.alias_counts(F.col("text"), aliases, ("r",)).alias("h")).collect()}
    flat = {a: k for k, v in aliases.items() for a in v}
    auto = {r["id"]: {h["label"]: h["freq"] for h in r["hits"]} for r in matching.automaton_hits(df, "text", flat, strict=("r",)).collect()}
    assert native == auto == {0: {"R": 1, "SQL": 1}, 1: {"SQL": 2}, 2: {"C": 1}, 3: {}, 4: {}, 5: {}}


def test_ordered(spark):
    l = ordered.lines(spark.createDataFrame([(1, "Head\na\nb\nTail\nc")], "k int, t string"), "k", "t")
    got = collect(ordered.sections(l, "k", "line", F.col("value").isin("Head", "Tail"), "value").select("line", "section", "section_no"), "line")
    assert got == [(1, "Head", 1), (2, "Head", 1), (4, "Tail", 2)]
    w = ordered.sentence_windows(spark.createDataFrame([(1, "A. B! C?"), (2, "x"), (3, None)], "k int, t string"), "k", "t")
    assert collect(w, "k", "start") == [(1, 0, "A. B!"), (1, 1, "B! C?"), (2, 0, "x")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Title,Employer,extra\n\"Two\nlines\",\"He said \"\"hi\"\"\",1\n,,\n".encode())
    df = files.canonical(files.read_csv(spark, str(tmp_path / "a.csv")))
    r = df.first()
    assert (r["role_title"], r["company"], r["extra"], r["job_url"]) == ("Two lines", 'He said "hi"', "1", "")
    m = files.front_matter(spark.createDataFrame([("---\nto: a: b\nto: c\n---\nBody\n",), ("no head",)], "t string"), "t").collect()
    assert (m[0]["meta"], m[0]["body"], m[1]["meta"], m[1]["body"]) == ({"to": "c"}, "Body", {}, "no head")
    html = '<ul><li>jobPosting:77 <h3 class="base-search-card__title">A &amp; B</h3><h4 class="base-search-card__subtitle"> <a>Co</a></h4><span class="job-search-card__location">P</span><time datetime="2024-01-02 03:04:05"><li>none</ul>'
    c = files.cards(spark.createDataFrame([(html,)], "h string"), "h").collect()
    assert [tuple(x) for x in c] == [("77", "Co", "A & B", "P", "2024-01-02T03:04:05")]
    ld = files.json_ld(spark.createDataFrame([('<script type="application/ld+json">{"title":"T"}</script>',)], "h string"), "h", "title string").first()
    assert ld["ld"]["title"] == "T"
    p = files.pasted_rows(spark.createDataFrame([(1, "Analyst | Acme | Perth\nEngineer\nGlobex\n2 days ago")], "k int, t string"), "k", "t")
    assert collect(p, "line") == [(1, 0, "Analyst", "Acme", "Perth"), (1, 3, "Engineer", "Globex", "")]
    d = files.dictionary(spark.createDataFrame([("Python", "py thon\nab\n123")], "preferredLabel string, altLabels string"))
    assert collect(d, "alias") == [("py thon", "Python"), ("python", "Python")]
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "sent_ann_b.md").write_text("x")
    assert collect(files.directory_state(spark, str(tmp_path / "dir")).select("state", "key"), "key") == [("sent", "ann_b")]


def test_union_of_columns(spark):
    a, b = spark.createDataFrame([("1",)], "x string"), spark.createDataFrame([("2",)], "y string")
    assert files.union_all([a, b]).columns == ["x", "y"]
    assert files.with_columns(a, ["X", "z"]).columns == ["X", "z"]


def test_streams_equal_batch(spark, sf, tmp_path):
    from tessella.streaming import events as E

    s = E.source(spark, sf, "events.parquet")
    E.upsert_batches(s.select("user_id", "ts", "event_id"), str(tmp_path / "t"), "user_id", "ts", str(tmp_path / "c"))
    last = files.current(spark, str(tmp_path / "t"))
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert collect(last.select("user_id", "ts"), "user_id") == collect(want, "user_id")


def test_parts_meet_every_rule(spark):
    from tessella.plans import texts

    got = texts.duplicate_groups(spark, "/root/testdata/sf0.01").groupBy("reason").count().collect()
    assert {r["reason"] for r in got} == {"", *grouping.REASONS}


def test_resolution_by_brute_force(spark):
    rng = random.Random(9)
    names = near_names(rng, 60)
    typed, cand = [(i, n) for i, n in enumerate(names[:30])], [(i, f"k{i}", n) for i, n in enumerate(names[30:] + names[:3])]
    df, c = spark.createDataFrame(typed, "seq int, name string"), spark.createDataFrame(cand, "seq int, company_key string, company string")
    core = lambda rows: dict(spark.createDataFrame(rows, "i int, n string").select("i", company_core(F.col("n"))).collect())
    own, other = core(typed), core([(i, n) for i, _, n in cand])
    got = {r["seq"]: (r["match_type"], r["company_key"]) for r in entity.resolve(df, c).collect()}
    for i, _ in typed:
        if got[i][0] in ("fuzzy", "new"):
            best = max(((entity.similarity(own[i], other[k]), -k) for k, *_ in cand if other[k]), default=(0, 0))
            assert got[i] == ("fuzzy", f"k{-best[1]}") if own[i] and best[0] >= 0.9 else got[i][0] == "new"
    assert {x[0] for x in got.values()} >= {"exact", "fuzzy"}
