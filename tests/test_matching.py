"""The automaton, term weights and substring joins against plain Python."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from tessella.functions import classify as K
from tessella.operators import matching, substrings
from tessella.operators.automaton import SEPARATORS, Automaton
from tessella.plans import registry


def hits(aliases, strict, text):
    """(place, alias number) of every hit, by search and a look at the neighbours."""
    t, out = text.lower(), []
    for k, (alias, _) in enumerate(aliases):
        a = alias.lower()
        i = t.find(a)
        while i >= 0:
            left, right = t[i - 1 : i] if i else "", t[i + len(a) : i + len(a) + 1]
            ok = lambda c: not c or (c in SEPARATORS if alias in strict else not (c.isascii() and c.isalnum()))
            if ok(left) and ok(right):
                out.append((i, k))
            i = t.find(a, i + 1)
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_automaton_by_search(seed):
    r = random.Random(seed)
    names = {"".join(r.choice("abé B") for _ in range(r.randint(1, 4))): f"L{r.randint(0, 5)}" for _ in range(r.randint(0, 12))}
    strict = {a for a in names if r.random() < 0.3}
    texts = ["".join(r.choice("abBé ,•😀") for _ in range(r.choice([0, 3, 30, 1500]))) for _ in range(6)] + [None]
    row, alias, place = Automaton(names, strict).occurrences(texts)
    for i, t in enumerate(texts):
        assert list(zip(place[row == i].tolist(), alias[row == i].tolist())) == hits(list(names.items()), strict, t or "")


@pytest.mark.parametrize("n", [500, 50_000])
def test_automaton_of_many_aliases(n):
    r = random.Random(n)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(20_000)]
    names = {" ".join(r.sample(words, r.randint(1, 3))): f"L{i % 700}" for i in range(n)}
    keys = list(names)
    texts = [" ".join(r.choice(keys) if r.random() < 0.1 else r.choice(words) for _ in range(120)) for _ in range(40)]
    row, alias, place = Automaton(names).occurrences(texts)
    order = {a: k for k, a in enumerate(keys)}
    for i, t in enumerate(texts):  # aliases are one to three words: look each stretch of words up
        at, want = 0, []
        w = t.split(" ")
        for j, x in enumerate(w):
            want += [(at, order[" ".join(w[j : j + k])]) for k in range(1, 1 + max(len(a.split()) for a in keys)) if j + k <= len(w) and " ".join(w[j : j + k]) in order]
            at += len(x) + 1
        assert list(zip(place[row == i].tolist(), alias[row == i].tolist())) == sorted(want)


def test_automaton_apart():
    m = Automaton({"a a": "x"})
    assert m.find("a a a a") == {"x": (3, 0)}
    assert m.occurrences(["a a a a", "a a"], apart=True)[2].tolist() == [0, 4, 0]


def test_occurrences(spark):
    df = spark.createDataFrame([(1, "SQL and sql"), (2, None), (3, "no")], "id long, text string")
    got = sorted(map(tuple, matching.occurrences(df, "id", "text", [("sql", "database"), ("and", "word")]).collect()))
    assert got == [(1, "database", "sql", 0), (1, "database", "sql", 8), (1, "word", "and", 4)]


def test_term_weights(spark):
    text = "python work\nRequirements:\nthree years of python, Excel"
    df = spark.createDataFrame([(1, text), (2, "python work"), (3, None)], "id long, text string")
    terms = {"coding": ["java", "python"], "tables": ["excel"]}
    out = {r["id"]: r for r in matching.term_weights(df, "text", terms, {"b": ["years"], "a": ["three"]}, K.region_start(F.col("text"))).collect()}
    assert [tuple(t) for t in out[1]["terms"]] == [("coding", 2, 2, "python"), ("tables", 2, 1, "excel")] and out[1]["unsupported"] == ["a", "b"]
    assert [tuple(t) for t in out[2]["terms"]] == [("coding", 1, 1, "python")] and out[3]["terms"] == []
    # the fit score weighs a label by its first hit alone
    first = df.where("id = 1").select(F.explode(matching.alias_counts(F.col("text"), terms)).alias("h"), K.region_start(F.col("text")).alias("at")).select("h.label", matching.importance(F.lit(1), F.col("h.first_pos"), F.col("at")).alias("w")).collect()
    assert {r["label"]: r["w"] for r in first} == {"coding": 1, "tables": 2}


def test_term_weights_differ_from_first_hits(spark, sf):
    it = registry.QUERIES["term_weights"](spark, sf)
    assert {r["weight"] for r in it.where("label = 'working life'").select("weight").distinct().collect()} == {1, 2}


def test_holding_by_all_pairs(spark):
    r = random.Random(5)
    patterns = ["".join(r.choice("abé") for _ in range(r.randint(0, 5))) for _ in range(60)] + [None, "abab"]
    texts = ["".join(r.choice("abé ") for _ in range(r.randint(0, 12))) for _ in range(80)] + [None, "", "abab"]
    p, t = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("p", patterns), ("t", texts)))
    got = sorted(map(tuple, substrings.holding(p, t, "p", "t").collect()))
    assert got == sorted({(a, b) for a in patterns for b in texts if a and b and a in b})


def test_first_contained(spark):
    people = spark.createDataFrame([(1, "Mary Ann Lee"), (2, "Jo Bloggs"), (3, "  "), (4, None), (5, "Jo Bloggs")], "k long, name string")
    drafts = spark.createDataFrame([(3, "zed"), (4, "ann-lee"), (6, "JO-X"), (7, "jo-bloggs"), (8, None)], "seq long, slug string")
    got = {r["k"]: (r["slug"], r["seq"]) for r in substrings.first_contained(people, drafts.where("slug is not null"), "name", "slug", "seq").collect()}
    assert got == {1: ("ann-lee", 4), 2: ("JO-X", 6), 3: (None, None), 4: (None, None), 5: ("JO-X", 6)}
    blank = {r["k"]: r["seq"] for r in substrings.first_contained(people, drafts, "name", "slug", "seq").collect()}  # an empty slug is in every name
    assert blank == {1: 4, 2: 6, 3: 8, 4: 8, 5: 6}


@pytest.mark.parametrize("name", ["term_weights", "person_drafts", "alias_automaton"])
def test_queries_on_more_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    oracle.check(registry.QUERIES[name](spark, sf).toPandas(), sf, registry.ORACLE_SQL[name])


def test_rescoring_is_scoring_anew(spark, sf):
    from tessella.plans import adverts

    _, hits = adverts._fit_hits(spark, sf)
    make = lambda p: spark.createDataFrame(p, "label string, supported boolean, soft boolean, excluded boolean")
    old = make(adverts.SKILL_PROFILE)
    stored = matching.fit_score(hits, "id", old, "unknown", "soft_weight")
    # one label learned, one gone, one new without effect, one unlike before in what does not count
    new = make([x for x in adverts.NEW_PROFILE if x[0] != "widgets"] + [("unheard of", True, False, False)])
    got = {r["id"]: r for r in matching.rescored(stored, hits, "id", old, new, "unknown", "soft_weight").collect()}
    want = {r["id"]: r for r in matching.fit_score(hits, "id", new, "unknown", "soft_weight").collect()}
    touched = {r["id"] for r in hits.where("label in ('anvils', 'widgets')").select("id").collect()}
    assert sorted(got) == sorted(want) and all(got[i][c] == want[i][c] for i in want for c in want[i].asDict())
    assert {i for i, r in got.items() if r["recomputed"]} == touched and 0 < len(touched) < len(want)
    same = matching.rescored(stored, hits, "id", old, old, "unknown", "soft_weight")
    assert same.where("recomputed").count() == 0 and same.count() == len(want)
