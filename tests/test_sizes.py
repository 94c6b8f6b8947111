"""What keeps queries' work in proportion to their input: copies, few labels, small files, long texts."""

from tessella.operators import entity


def test_suggestions_compare_a_name_once(spark, monkeypatch):
    asked, ranked = [], entity.ranked
    monkeypatch.setattr(entity, "ranked", lambda t, c, n, least: asked.append((t.count(), c.count())) or ranked(t, c, n, least))
    typed = spark.createDataFrame([(i, ["Acme", "acme", "Globex", ""][i % 4]) for i in range(40)], "seq int, name string")
    known = [["Acme Inc", "Acmes", "Globe", "Zeta", "Pty Ltd"][i % 5] for i in range(50)]
    cand = spark.createDataFrame([(i, f"k{i}", x) for i, x in enumerate(known)], "seq int, company_key string, company string")
    got = {(r["seq"], r["rank"]): r["company_key"] for r in entity.suggestions(typed, cand, n=12).collect()}
    assert asked == [(3, 5)] and len(got) == 40 * 12
    core = ["acme", "acmes", "globe", "zeta", ""]
    for i in range(40):
        best = sorted((-entity.similarity(["acme", "acme", "globex", ""][i % 4], core[j % 5]), j) for j in range(50))[:12]
        assert [got[i, k + 1] for k in range(12)] == [f"k{j}" for _, j in best]


def test_postings_spread_over_tasks_and_labels_do_not_gather_them(spark, sf):
    from tessella import tables as D
    from tessella.plans import registry

    assert D.adverts(spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    plan = registry.QUERIES["fit_score"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(label" not in plan and "hashpartitioning(id" not in plan


def test_set_cover_takes_keys_in_batches(spark):
    facts = spark.createDataFrame([("one", 2, 0, ["a"]), ("one", 2, 1, ["b", "a"]), ("one", 2, 2, ["c"]), ("two", 1, 0, ["d"])], "slot string, budget int, fact int, evidences array<string>")
    rows = [(1, "a", 3), (1, "c", 1), (2, "b", 2), (2, "other", 9), (3, "other", 9), (None, "d", 4)]
    out = entity.set_cover(facts, spark.createDataFrame(rows, "k long, label string, imp int"), "k")
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, out.collect()), key=repr)
    want = {1: [(0, 3), (2, 1), 0], 2: [(1, 2), (0, 0), 0], 3: [(0, 0), (1, 0), 0], None: [(0, 0), (1, 0), 4]}
    assert got == sorted([(k, *x) for k, (p, q, two) in want.items() for x in (("one", *p), ("one", *q), ("two", 0, two))], key=repr)


def test_batches_are_worked_on_by_bytes_of_text(spark):
    import pyarrow as pa

    from tessella.batches import slices
    from tessella.operators import matching

    texts = ["ab", None, "c" * 30, "", "dé", "e" * 9, None]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["k", "t"])
    got = [s.column(1).to_pylist() for s in slices(b, 1, 10)]
    assert got == [["ab", None], ["c" * 30], ["", "dé"], ["e" * 9, None]] and sum(got, []) == texts
    assert list(slices(b.slice(0, 0), 1)) == [] and [s.column(0).to_pylist() for s in slices(b.slice(4), 1, 10)] == [[4], [5, 6]]
    long = "x " * 300_000  # each is a slice with its neighbour or alone
    df = spark.createDataFrame([(i, f"sql {long}sql" if i % 2 else "a sql") for i in range(8)], "k int, t string").coalesce(1)
    hits = {r["k"]: r["hits"][0]["freq"] for r in matching.automaton_hits(df, "t", {"sql": "SQL"}).select("k", "hits").collect()}
    assert hits == {i: 2 if i % 2 else 1 for i in range(8)}


def test_first_fit_gathers_no_table_on_the_driver(spark):
    from tessella.operators import grouping

    two = lambda *c: spark.range(1, 3).selectExpr(*c)
    steps, member = two("4 * id as node", "id as at", "id - id % 2 as held"), two("id as seq", "id as cls")
    belongs, looks = two("id as cls", "id + 4 as node"), two("id as cls", "id + 4 as node", "0 as rule")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = plan(grouping._round(steps, steps, member, belongs, looks))
    assert "SortMergeJoin" in got and "Broadcast" not in got
    rows, groups, primary = two("id as seq"), two("id as seq", "id as group_seq", "'' as reason"), two("id as group_seq", "id as primary_seq")
    assert "Broadcast" not in plan(entity.review(rows, groups, primary))


def test_resume_lines_are_spread_and_matched_once(spark, sf):
    from pyspark.sql import functions as F

    from tessella.operators import resume
    from tessella.plans import registry

    plan = registry.QUERIES["resume_experience"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
    lines = spark.createDataFrame([("Clerk | Acme 2001 - Present",), ("- built tools 2001 - 2002",), ("2001 - Present",), ("Plain words, no head.",), (None,)], "v string")
    rule = lines.select(resume.opens_entry(F.col("v")).alias("o"))
    assert [r["o"] for r in rule.collect()] == [True, False, True, False, None]
    assert rule._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_segmentation_memory_is_bounded():
    """Many short texts in one batch, of 1.5 MB in all: what is held at once follows from a stretch of them."""
    import tracemalloc

    import pyarrow as pa

    from tessella.llm import bpe, common, segmentation

    segmentation.vocabulary(bpe.public(segmentation.MODEL))
    common.powers(common.CHUNK)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([f"the number {i} opens text {i * 7919} of many words " * 9 for i in range(3000)])], names=["k", "t"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in segmentation.runner("k", 2, 5, None, True, segmentation.SHORT)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6000 and peak < 100_000_000


def test_pairs_are_measured_once_and_after_the_bound(spark):
    """A filter on the ratio stays behind the bound, and texts that owners share are compared once."""
    from pyspark.sql import functions as F

    from tessella.operators import alike

    texts = ["cold anvil promo", "cold anvil prom", "old brass ring", "old brass rings", "new"]
    df = spark.createDataFrame([(f"o{i}", t) for i in range(9) for t in texts[i % 3 :]], "o string, t string")
    out = alike.pairs(df, "o", "t", 0.86)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("RepartitionByExpression") == 1
    assert plan.index("Repartition") > plan.index("ArrowEvalPython")  # below it
    assert {r["scope"] for r in alike._scoped(alike._plain(df, "o", "t")).collect()} == {0}
    apart = df.withColumn("t", F.concat("t", F.lit(" of "), "o"))
    assert len({r["scope"] for r in alike._scoped(alike._plain(apart, "o", "t")).collect()}) == 9
    got = sorted((r["o"], r["a"], r["b"]) for r in out.collect())
    assert got == sorted((f"o{i}", b, a) for i in range(9) for a, b in (texts[:2], texts[3:1:-1]) if {a, b} <= set(texts[i % 3 :]) for a, b in [sorted((a, b), reverse=True)])


def test_a_round_goes_to_nodes_and_on_to_classes(spark):
    from tessella.operators import grouping

    rows = lambda xs, s: spark.createDataFrame(xs, s)
    # classes 1 and 5 share a URL's node; row 9 of class 5 follows row 1 of class 1 by one round
    steps = rows([(4, 1, 1), (20, 5, 5)], "node long, at long, held long")
    member, belongs = rows([(1, 1), (5, 5), (9, 5)], "seq long, cls long"), rows([(1, 5), (5, 5)], "cls long, node long")
    looks = rows([(1, 5, 0), (5, 5, 0)], "cls long, node long, rule int")
    out = grouping._round(steps, steps, member, belongs, looks)
    assert (20, 5, 1) in set(map(tuple, out.collect()))
    told = {tuple(r) for r in grouping._falling(steps, out).collect()}
    assert told == {(4, 1, 1, False), (20, 5, 1, True), (5, 1, 1, True)}


def test_suggestions_gather_no_table_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(entity, "TYPED", 2)
    monkeypatch.setattr(entity, "CANDIDATES", 2)
    monkeypatch.setattr(entity, "TASKS", 3)
    typed = spark.range(12).selectExpr("id as seq", "concat('name ', id % 9) as name")
    cand = spark.range(40).selectExpr("id as seq", "id as company_key", "concat('name ', id % 20) as company")
    out = entity.suggestions(typed, cand, n=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert f"RoundRobinPartitioning({3 * spark.sparkContext.defaultParallelism})" in plan  # of 5 x 10 blocks
    got = {(r["seq"], r["rank"]): r["company_key"] for r in out.collect()}
    core = [f"name {i % 20}" for i in range(40)]
    for i in range(12):
        best = sorted((-entity.similarity(f"name {i % 9}", x), j) for j, x in enumerate(core))[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in best]
