import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, common, language_id, line_dedup, mixing, segmentation, shingle_join, token_counts, toxicity, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_words_are_the_pattern():
    texts = ["", "a b", "  x y\tz\n", "É é", "q" * 10]
    data, off = common.text_bytes(pa.array(texts))
    h, at = common.words(data, off, common.BYTE_EXACT)
    flat = [w for t in texts for w in WORD.findall(t)]
    assert np.diff(at).tolist() == [len(WORD.findall(t)) for t in texts]
    assert len(set(h.tolist())) == len(set(flat)) == len(h)


# near-duplicate join


def components(texts):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("members", [4096, 7])
def test_shingle_join(spark, monkeypatch, members):
    monkeypatch.setattr(shingle_join, "MEMBERS", members)
    rng = random.Random(members)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))] for _ in range(8)]
    texts = [None, "", " ", "One two", "one TWO", "one two three"]
    for _ in range(110):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice(([], ["new"], [w[p], "more"]))
        texts.append(" ".join(w))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.components(docs(spark, texts)).collect()}
    assert got == components(texts)


def test_shingle_join_odd(odd, none):
    rows = shingle_join.components(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["id"] in (12, 13)} == {12}
    assert shingle_join.components(none).count() == 0


def test_tree_bound_holds():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 90), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    x, at = shingle_join.from_gaps(np.frombuffer(b"".join(map(shingle_join.gaps, sets)), np.uint16), np.cumsum([0, *[len(shingle_join.gaps(s)) // 2 for s in sets]]))
    assert all((x[at[i] : at[i + 1]] == np.unique(s >> np.uint64(64 - shingle_join.width_of(len(s))))).all() for i, s in enumerate(sets))
    tree = shingle_join.Tree(np.array([len(s) for s in sets]), np.stack([np.frombuffer(shingle_join.signature(s), np.uint64) for s in sets]))
    kept = {(min(a, b), max(a, b)) for i, j, _ in tree.pairs() for a, b in zip(i.tolist(), j.tolist())}
    for a in range(60):
        for b in range(a):
            common_ = len(np.intersect1d(sets[a], sets[b]))
            if 4 * common_ >= 3 * (len(sets[a]) + len(sets[b]) - common_):
                assert (b, a) in kept


# line dedup


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def lines_gone(texts):
    seen, gone = [], set()
    for d, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line)
            if w:
                if any(o == w or (max(len(o), len(w)) >= 4 and edit_one(o, w)) for o in seen):
                    gone.add((d, k))
                seen.append(w)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh"[: rng.choice((4, 8))]) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    texts = [None, "", "\n \n"]
    for _ in range(250):
        out = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                p = rng.randrange(len(w)) if w else 0
                w[p : p + 1] = rng.choice(([], [rng.choice("abx")], [*w[p : p + 1], rng.choice("ab")]))
            out.append(" ".join(w))
        texts.append("\n".join(out))
    d = docs(spark, texts)
    gone = {(r["doc"], r["line"]) for r in line_dedup.find(d, "doc_id", "text").collect()}
    assert gone == lines_gone(texts)
    for r in line_dedup.without(d).collect():
        t = texts[r["doc_id"]]
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r["doc_id"], k) not in gone)
        assert r["text"] == want


def test_line_dedup_odd(odd, none):
    out = line_dedup.without(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[9] == "same line here of many words to be copied" and kept[10] == "" and kept[0] is None
    assert line_dedup.without(none).count() == 0
    assert line_dedup.stage(odd.sparkSession, odd.drop("n_chars"), "").columns == odd.drop("n_chars").columns


# tokens


def texts_for_tokens():
    rng = random.Random(5)
    fixed = ["", " ", "it's we're 'sam 'S \n'll x''s", "tab\t\tx \n\n y  ", "a b c", "日本語🙂 ok", "<|endoftext|> hi", "12 34a5 ½", "\x1cx\x85"]
    return fixed + ["".join(rng.choice("ab 's\n\t'1.,é漢 trevl") for _ in range(rng.randint(0, 40))) for _ in range(2000)]


def test_encoder_is_the_library():
    e = bpe.encoder(bpe.public("byte_bpe_50k.json"))
    texts = texts_for_tokens()
    data, off = common.text_bytes(pa.array(texts))
    ids, at = e.chunk(data, off)
    want = [x.ids for x in e.lib.encode_batch(texts, add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want


def test_wavelet_lookups():
    rng = np.random.default_rng(1)
    for top, n in ((1, 10), (3, 1), (50257, 3000), (2, 0)):
        ids = rng.integers(0, top, n)
        w = wavelet.Wavelet(wavelet.dump(ids, np.array([7]), np.array([n])))
        assert w.ids().tolist() == ids.tolist() and w.doc_ids().tolist() == [7] and w.ends().tolist() == [n]
        for i in range(0, n, 37):
            t = int(ids[i])
            at = np.flatnonzero(ids == t)
            assert w.access(i) == t and w.count(t) == len(at) and w.count(t, 5, i) == int(((at >= 5) & (at < i)).sum())
            assert [w.locate(t, k) for k in range(min(3, len(at)))] == at[:3].tolist()
        assert w.count(99999) == 0
        with pytest.raises(IndexError):
            w.locate(99999, 0)


def test_wavelet_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    ids = np.random.default_rng(2).integers(0, 9, 1000)
    w = wavelet.Wavelet(wavelet.dump(ids, np.array([0]), np.array([1000])))
    assert [w.access(i) for i in range(1000)] == ids.tolist()
    assert [w.locate(4, k) for k in range(w.count(4))] == np.flatnonzero(ids == 4).tolist()


def test_wavelet_files(odd, none, monkeypatch):
    got = wavelet.read_back(*wavelet.write(odd, "doc_id", "text")).collect()
    lib = bpe.encoder(bpe.public("byte_bpe_50k.json")).lib
    start = 0
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: r[0])
    want = []
    for k, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want
    assert wavelet.read_back(*wavelet.write(none, "doc_id", "text")).count() == 0


def test_rollup(spark, tmp_path):
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r", {"words": None})
    s = "op string, doc_id long, source string, lang string, text string"
    batch = lambda *rows: spark.createDataFrame(list(rows), s)
    one = batch(("insert", 1, "a", "en", "x y z"), ("insert", 2, "a", "en", ""), ("insert", 3, None, "de", None), ("delete", 9, None, None, None))
    assert r.commit("b1", one) and not r.commit("b1", one)
    totals = lambda: {(x["source"], x["lang"]): (x["docs"], x["tokens"]) for x in r.totals().collect()}
    assert totals() == {("a", "en"): (2, 3), (None, "de"): (1, 0)}
    assert r.commit("b2", batch(("delete", 2, None, None, None), ("revise", 1, "b", "en", "x y"), ("insert", 4, "b", "en", "q")))
    assert totals() == {("b", "en"): (2, 3), (None, "de"): (1, 0)}
    # a batch that broke off before its marker counts for nothing and is written anew
    one.select("doc_id", "source", "lang", F.lit("words").alias("version"), F.lit(1).cast("long").alias("docs"), F.lit(99).cast("long").alias("tokens")).write.parquet(f"file://{tmp_path}/r/batches/b3")
    assert totals() == {("b", "en"): (2, 3), (None, "de"): (1, 0)}
    assert r.commit("b3", batch(("delete", 3, None, None, None))) and totals() == {("b", "en"): (2, 3)}
    assert token_counts.Rollup(spark, f"file://{tmp_path}/none", {"words": None}).totals().count() == 0


def test_rollup_odd(odd, none, tmp_path):
    r = token_counts.Rollup(odd.sparkSession, f"file://{tmp_path}/r", {"words": None, "bpe": "byte_bpe_50k.json"})
    r.commit("all", odd.withColumn("op", F.lit("insert")))
    assert r.totals().where("version = 'words'").agg(F.sum("docs")).first()[0] == odd.count()
    r.commit("empty", none.withColumn("op", F.lit("insert")))
    lib = bpe.encoder(bpe.public("byte_bpe_50k.json")).lib
    want = sum(len(lib.encode(x["text"] or "", add_special_tokens=False).ids) for x in odd.collect())
    assert r.totals().where("version = 'bpe'").agg(F.sum("tokens")).first()[0] == want


# segmentation


def paths(v, raw):
    byte = set(v.byte_id.tolist())
    known = {b: i for i, b in enumerate(v.bytes) if b and i not in byte}
    out = []

    def go(p, acc):
        if p == len(raw):
            out.append(tuple(acc))
        for z in range(p + 1, len(raw) + 1):
            if raw[p:z] in known:
                go(z, [*acc, known[raw[p:z]]])

    go(0, [])
    return out


def test_segmentation_follows_the_distribution():
    v = segmentation.vocabulary(bpe.public(segmentation.MODEL))
    every = paths(v, b" then")
    w = np.array([v.weight[list(p)].sum() for p in every])
    p = np.exp(w - w.max())
    p /= p.sum()
    at = {x: i for i, x in enumerate(every)}
    n = 20000
    data, off = common.text_bytes(pa.array(["then"] * n))
    draws = segmentation.sample(v, data, off, common.mix(np.arange(n).astype(np.uint64)), 2)
    picked = np.array([[at[tuple(ids[o[r] : o[r + 1]])] for r in rows] for rows, ids, o, _, _ in draws])
    assert (picked[0] != picked[1]).all()
    assert np.allclose(draws[1][3], np.log(p[picked[1]]), atol=1e-6)
    second = np.array([sum(p[a] * p[b] / (1 - p[a]) for a in range(len(p)) if a != b) for b in range(len(p))])
    for d, want in zip(picked, (p, second)):
        assert np.abs(np.bincount(d, minlength=len(p)) / n - want).max() < 0.015


def test_segmentation_runs_dry():
    """Texts of few segmentations give all of them once, with inclusion 1."""
    v = segmentation.vocabulary(bpe.public(segmentation.MODEL))
    data, off = common.text_bytes(pa.array(["at", ""]))
    every = paths(v, b" at")
    draws = segmentation.sample(v, data, off, np.arange(2).astype(np.uint64), len(every) + 2)
    got = [tuple(ids[o[0] : o[1]]) for rows, ids, o, _, _ in draws if 0 in rows]
    assert sorted(got) == sorted(every) and all((inc[list(rows).index(0)] == 1) for rows, _, _, _, inc in draws if 0 in rows)
    assert [1 in rows for rows, *_ in draws] == [True] + [False] * (len(every) + 1)


def test_segmentation_odd(odd, none):
    rows = segmentation.decoded(segmentation.segment(odd, "doc_id", "text"), name="back").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["back"] == texts[r["doc_id"]] and 0 < r["inclusion"] <= 1 for r in rows)
    again = segmentation.segment(odd.repartition(1), "doc_id", "text").collect()
    key = lambda rs: sorted((r["doc_id"], r["sample"], r["ids"], r["log_prob"]) for r in rs)
    assert key(rows) == key(again)
    assert segmentation.segment(none, "doc_id", "text").count() == 0


# mixing


def test_quotas():
    assert mixing.quotas({"a": 10, "b": 100, "c": 0}, {"a": 5, "b": 1, "c": 2}, 90) == {"a": 20, "b": 70, "c": 0}
    assert mixing.quotas({}, {}, 0) == {}


def test_route_prefers_no_repetition():
    flow = mixing.route({("x",): 10, ("x", "y"): 10}, {"x": 15, "y": 10}, 2)
    assert sum(sum(f.values()) for f in flow.values()) == 25
    assert all(sum(f.values()) <= 2 * 10 for f in flow.values()) and sum(f.get("y", 0) for f in flow.values()) == 10


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40))), f"s{min(rng.randrange(9), 3)}") for i in range(400)] + [(900, None, None), (901, "a b c", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sized = mixing.sized(d, "text", "size").withColumn("member", F.array("source"))
    out, sizes, target = mixing.mix(sized, "doc_id", "size", "member")
    got = out.toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    for s, part in got.groupby(got.source.map(lambda x: "~" if x is None else "v" + x)):
        assert part["size"].sum() == sizes[s] and abs(part.taken.sum() - target[s]) <= 1
    again = mixing.mix(sized.repartition(2), "doc_id", "size", "member")[0].toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_mix_overlap(spark):
    rows = [(i, 10, ["a"] if i < 10 else ["a", "b"] if i < 20 else []) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, size long, member array<string>")
    out, _, target = mixing.mix(d, "doc_id", "size", "member", share=1.0)
    got = out.toPandas()
    assert abs(got.taken.sum() - min(sum(target.values()), 400)) <= 2 and got[got.doc_id >= 20].taken.sum() == 0


def test_mix_odd(odd, none):
    out = mixing.stage(odd.sparkSession, odd, "")
    assert out.columns == odd.columns and out.where("text is null or text = ''").count() == 0
    assert mixing.stage(none.sparkSession, none, "").count() == 0


# classifiers


def test_language(spark):
    rng = random.Random(6)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["krak", "zwirn", "pfuh"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(12)), k) for i in range(300) for k in [("aa", "bb")[i % 2]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d, where=common.fold("doc_id", 3) != 1)
    out = language_id.identify(d, model).where(common.fold("doc_id", 3) == 1).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98 and not out.rejected.any()
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "Ж")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language_id.identify(blank, model).collect()}
    assert all(got[i] == ("und", True) for i in (1, 2, 3)) and got[4][0] in ("aa", "bb") and got[4][1]


def test_language_batches_do_not_matter():
    m = language_id.train(["le chat noir", "der hund ist"] * 20, ["fr", "de"] * 20)
    texts = ["le", "", "der hund", "x" * 50, "chat noir ist"]
    data, off = common.text_bytes(pa.array(texts))
    together = m.predict(data, off)
    for i, t in enumerate(texts):
        alone = m.predict(*common.text_bytes(pa.array([t])))
        assert alone[0][0] == together[0][i] and abs(alone[1][0] - together[1][i]) < 1e-9


def test_language_rejects_what_was_not_learned():
    rng = random.Random(8)
    vocab = {k: ["".join(rng.choice(c) for _ in range(rng.randint(3, 8))) for _ in range(60)] for k, c in (("aa", "abcdefgh"), ("bb", "ghijklmn"), ("new", "opqrstuv"))}
    text = lambda *w: " ".join(rng.choice(vocab[rng.choice(w)]) for _ in range(30))
    m = language_id.train([text(k) for _ in range(400) for k in ("aa", "bb")], ["aa", "bb"] * 400)
    rejected = lambda texts: (lambda b, p, known: (p < m.least) | (known < m.least_seen))(*m.predict(*common.text_bytes(pa.array(texts))))
    held_out = rejected([text(k) for _ in range(500) for k in ("aa", "bb")])
    assert held_out.mean() <= 0.02
    # a language that shares most of its words with a learned one
    assert rejected([text("aa", "aa", "aa", "new") for _ in range(100)]).mean() > 0.95


def test_language_odd(odd, none):
    out = language_id.stage(odd.sparkSession, odd, "")
    assert out.columns == odd.columns
    assert language_id.identify(odd, None, names=("p", "q", "r")).where("p <> 'und'").count() == 0
    assert language_id.stage(none.sparkSession, none, "").count() == 0


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = "zorg" + rng.choice(["an", "eth", "ix", "oom"])
        rows.append((" ".join(w), int(bad)))
    return rows


def test_toxicity():
    rows = toxic_rows(700, 1)
    model = toxicity.train([r[0] for r in rows[:500]], [r[1] for r in rows[:500]])
    data, off = common.text_bytes(pa.array([r[0] for r in rows[500:]]))
    s, y = model.scores(data, off), np.array([r[1] for r in rows[500:]])
    assert ((s >= toxicity.THRESHOLD) == y).mean() > 0.97 and ((0 <= s) & (s <= 1)).all()
    one = np.array([model.scores(*common.text_bytes(pa.array([r[0]])))[0] for r in rows[500:520]])
    assert np.allclose(one, s[:20], atol=1e-4)


def test_toxicity_gradient():
    net = toxicity.Net(3)
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(3, 6, toxicity.DIM)), (np.arange(6) < np.array([[6], [3], [1]])).astype(float), np.array([1.0, 0.0, 1.0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("word", "gram")}

    def loss():
        z = net.run([x @ net.p["x" + d] + net.p["g" + d] for d in "fb"], mask)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grad, _ = net.step(x, mask, y)
    for k in ("hf", "xb", "gf", "query", "out", "bias"):
        at = tuple(int(rng.integers(n)) for n in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        slope = (up - loss()) / 2e-3
        net.p[k][at] = old
        assert abs(slope - grad[k][at]) < 1e-4 + 0.02 * abs(slope)


def test_toxicity_odd(odd, none):
    model = toxicity.train(*map(list, zip(*toxic_rows(80, 2))))
    got = {r["doc_id"]: r["s"] for r in toxicity.score(odd, model, names=("s", "p")).collect()}
    assert got[0] == got[1] == got[2] == 0.0 and all(0 <= x <= 1 for x in got.values())
    assert toxicity.score(odd, None, names=("s", "p")).agg(F.max("s")).first()[0] == 0
    assert toxicity.score(none, model, names=("s", "p")).count() == 0
    empty = odd.sparkSession.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, empty) is None
