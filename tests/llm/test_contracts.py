"""The registered queries, column by column against plain Python, and every operator on documents with clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import components, lines_gone

from tessella.llm import bpe, common, jpeg, language_id, line_dedup, mixing, queries, segmentation, shingle_join, token_counts, topk_search, toxicity, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").orderBy("doc_id").collect()]


def rows(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]


def crc_mod(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def encoded(texts):
    lib = bpe.encoder(bpe.public("byte_bpe_50k.json")).lib
    return [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_op1(spark, sf, docs):
    want = Counter()
    for (_, t, s, lang), ids in zip(docs, encoded([d[1] for d in docs])):
        for version, n in ((token_counts.WORDS, len(WORD.findall(t or ""))), (token_counts.BPE, len(ids))):
            want[s, lang, version, "docs"] += 1
            want[s, lang, version, "tokens"] += n
    got = Counter({(r["source"], r["lang"], r["version"], k): r[k] for r in rows(spark, sf, "op1_token_counts") for k in ("docs", "tokens")})
    assert got == want


def test_op2(spark, sf, docs):
    texts = {d[0]: (d[1] or "").encode() for d in docs}
    got = rows(spark, sf, "op2_progressive_jpeg")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    same: dict = {}
    for r in got:
        raw = texts[r["doc_id"]]
        p = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        f = jpeg.encode([p])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(f), hashlib.sha256(f).hexdigest())
        t = jpeg.decode([f])[0]
        assert (r["height"], r["width"]) == t.shape[:2]
        flat = t.reshape(-1, 3).astype(float)
        assert np.allclose([float(x) for x in r["feature"].split(",")], [*flat.mean(axis=0), *flat.std(axis=0)], atol=0.006)
        assert same.setdefault(raw, r["feature"]) == r["feature"]


def test_op3(spark, sf, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op3_toxicity")}
    assert sorted(got) == [d[0] for d in docs]
    for i, r in got.items():
        assert r["held_out"] == (crc_mod(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op4(spark, sf, docs):
    want = components([d[1] for d in docs])
    ids = [d[0] for d in docs]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, sf, "op4_shingle_join")} == {ids[i]: (n, ids[c]) for i, (n, c) in want.items()}


def test_op5(spark, sf, docs):
    got = rows(spark, sf, "op5_segmentation")
    assert {r["doc_id"] for r in got} == {d[0] for d in docs} and all(r["decoded"] and 0 < r["inclusion"] <= 1 and r["log_prob"] <= 1e-9 for r in got)
    ids = {(r["doc_id"], r["sample"]): r["ids"] for r in segmentation.segment(common.read(spark, sf, "documents"), "doc_id", "text").collect()}
    assert {k: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in ids.items()} == {(r["doc_id"], r["sample"]): (r["n_pieces"], r["ids_crc32"]) for r in got}
    assert all(ids[d, 1] != v for (d, n), v in ids.items() if n == 2)


def test_op6(spark, sf, docs):
    texts = [d[1] for d in docs]
    gone = lines_gone(texts)
    got = {r["doc_id"]: r for r in rows(spark, sf, "op6_line_dedup")}
    for i, (d, t, *_) in enumerate(docs):
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if (i, k) not in gone]
        assert (got[d]["n_lines"], got[d]["n_kept"], got[d]["kept_sha256"]) == (len(lines), len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_op7(spark, sf, docs):
    size = {d[0]: len(WORD.findall(d[1] or "")) for d in docs}
    per = Counter()
    for d in docs:
        per[d[2]] += size[d[0]]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    target = mixing.quotas(per, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(per.values()))
    taken = Counter()
    got = rows(spark, sf, "op7_mixing")
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in per)
    assert sorted((r["doc_id"], r["taken"]) for r in rows(spark, sf, "op7_mixing")) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_op8(spark, sf, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op8_language_id")}
    assert sorted(got) == [d[0] for d in docs]
    learned = {d[3] for d in docs if d[3] is not None and crc_mod(d[0], 3) != 1}
    for d, t, _, _ in docs:
        r, letters = got[d], any(map(str.isalpha, t or ""))
        assert r["held_out"] == (crc_mod(d, 3) == 1) and 0 <= r["score"] <= 1 and (r["lang_pred"] in learned if letters else r["lang_pred"] == "und")
    held = [(got[d]["lang_pred"], lang) for d, t, _, lang in docs if got[d]["held_out"] and t]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op10(spark, sf, docs):
    got, start = {r["doc_id"]: r for r in rows(spark, sf, "op10_wavelet")}, 0
    for (d, *_), ids in zip(docs, encoded([x[1] for x in docs])):
        ids = np.array([*ids, 0], "<u4")
        assert got.pop(d) == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "first_id": ids[0], "n_first": int((ids == ids[0]).sum())}
        start += len(ids)
    assert not got


#: Names that operators use inside, and those of their results.
NAMES = ["a", "b", "bits", "block", "bucket", "cell", "cls", "copy", "doc", "e_doc", "fit", "full", "g", "height", "id", "ids", "k", "key", "known", "lang_pred", "ld_lang", "ld_rejected", "ld_score", "line", "link", "ln_doc", "ln_gone", "ln_key", "ln_mask", "ln_wanted", "ln_x", "media", "member", "mix_before", "mix_cell", "mix_cut", "mix_luck", "mix_mass", "mix_member", "mix_pattern", "mix_rest", "mix_size", "mix_start", "mix_taken", "mix_text", "mix_whole", "n", "n_bytes", "n_kept", "n_lines", "node", "op", "part", "payload_bytes", "predicted", "q", "rejected", "rgb", "root", "s", "sample", "score", "sj_id", "size", "slot", "sub", "t", "taken", "target", "tx", "v", "version", "width", "words"]


@pytest.fixture(scope="module")
def clashing(spark):
    text = ["the quick brown fox jumps over the lazy dog again and again", "der hund und die katze sind im haus", "the quick brown fox jumps over the lazy dog again and then", "", None, "a"]
    rows_ = [(None if i == 9 else i % 9, text[i % 6], "en" if i % 2 else "de", f"s{i % 2}", len(text[i % 6] or "")) for i in range(12)]
    d = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return d.withColumns({c: F.lit(f"own {c}") for c in NAMES})


@pytest.mark.parametrize("stage", [language_id.stage, line_dedup.stage, shingle_join.stage, mixing.stage], ids=["language", "lines", "near", "mix"])
def test_stages_with_clashing_names(spark, clashing, stage):
    out = stage(spark, clashing, "")
    assert out.columns == clashing.columns
    got = out.collect()
    assert all(r[c] == f"own {c}" for r in got for c in NAMES)
    if stage is shingle_join.stage:  # rows without an id stay
        assert any(r["doc_id"] is None for r in got)


def test_operators_with_clashing_names(spark, clashing, tmp_path):
    n = clashing.count()
    assert line_dedup.without(clashing, count=("n_lines", "n_kept")).agg(F.max("n_kept")).first()[0] == 1
    assert shingle_join.components(clashing).count() == n
    assert jpeg.read_back(jpeg.stored(clashing, "doc_id", "text")).where("payload_bytes % 64 = 0").count() == n
    media = jpeg.stored(clashing, "doc_id", "text")
    out = jpeg.decoded(media.withColumns({c: F.lit("own") for c in ("height", "width", "rgb")}), "media")
    assert out.columns == ["doc_id", "n_bytes", "media", "height", "width", "rgb"] and out.where("length(rgb) = 3 * height * width").count() == n
    model = language_id.fit(clashing)
    assert language_id.identify(clashing, model).where("score <= 1").count() == n
    assert toxicity.score(clashing, None).where("predicted = 0").count() == n
    sized = mixing.sized(clashing.drop("size"), "text", "size").withColumn("member", F.array("source"))
    assert mixing.mix(sized, "doc_id", "size", "member")[0].where("taken >= 0").count() == n
    assert segmentation.segment(clashing, "doc_id", "text").select("doc_id").distinct().count() == 10
    assert wavelet.read_back(*wavelet.write(clashing, "doc_id", "text")).count() == n - 1
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r", {"words": None})
    assert r.commit("b", clashing.withColumn("op", F.lit("insert"))) and r.totals().agg(F.sum("docs")).first()[0] == n


def test_near_duplicates_of_null_and_repeated_ids(spark):
    w = "one two three four five six seven eight nine ten eleven twelve".split()
    one, near, other = " ".join(w), " ".join([*w[:-1], "x"]), "entirely different words stand in this text here"
    d = spark.createDataFrame([(None, one), (None, near), (7, near), (7, other), (None, other + " more"), (3, "lone text of some few words"), (None, "another lone text with its own words"), (None, None)], "doc_id long, text string")
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in shingle_join.components(d).collect()), key=repr)
    # near of one twelve-word text: 7 of 9 shingles; both texts of id 7 have components of their own, named 7
    assert got == sorted([(None, 8, 7), (None, 8, 7), (7, 8, 7), (7, 4, 7), (None, 5, 7), (3, 2, 3), (None, 3, None), (None, 0, None)], key=repr)


def test_a_large_group_of_near_copies(spark):
    """2,000 texts that differ from one another by a word or two of 200: one component, by few pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(2000):
        t = list(base)
        t[int(rng.integers(200))] = f"x{i}"
        texts.append(" ".join(t))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5000, "another text of no kin at all")], "doc_id long, text string").repartition(8)
    got = shingle_join.components(d).groupBy("component_id").count().collect()
    assert {(r[0], r[1]) for r in got} == {(0, 2000), (5000, 1)}


def test_rollup_writers_do_not_overwrite_each_other(spark, tmp_path):
    s = "op string, doc_id long, source string, lang string, text string"
    batch = lambda *r: spark.createDataFrame(list(r), s)
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r", {"words": None})
    assert r.commit("a", batch(("insert", 1, "x", "en", "p q"), ("insert", None, "x", "en", "z")))
    said = {"batch": "b", "folder": "batches/other", "start": 0, "rows": False}
    (tmp_path / "r/batches/other").mkdir()
    assert not r._mark(0, said)  # the place is taken
    assert r.commit("b", batch(("delete", 1, None, None, None), ("delete", None, None, None, None)))
    assert [tuple(x) for x in r.totals().collect()] == [("x", "en", "words", 1, 1)]
    assert r.rows().count() == 3 and r.compact() and r.rows().count() == 1
    assert not r.commit("a", batch()) and r.commit("c", batch(("insert", 2, "y", None, "one two three")))
    assert sorted((x["source"], x["docs"], x["tokens"]) for x in r.totals().collect()) == [("x", 1, 1), ("y", 1, 3)]
