"""Operators 11 to 13 against plain Python, and odd input of the others."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, common, jpeg, license_scan, periodic_runs, segmentation, target_encoding, topk_search, wavelet
from tessella.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(w):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


@pytest.mark.parametrize("seed", range(30))
def test_runs_by_hand(seed):
    r = random.Random(seed)
    w: list = []
    while len(w) < 300:
        part = [r.choice("abcdefghij"[: r.randint(1, 10)]) for _ in range(r.randint(1, 30))]
        w += part * r.choice([1, 1, 2, 3, 7]) + part[: r.randint(0, len(part))]
    ids = periodic_runs.numbered(w)
    assert periodic_runs.runs(ids) == runs_by_hand(w)
    want = [int((ids[: len(ids) - q] == ids[q:]).sum()) for q in range(len(ids) // 2 + 1)]
    assert periodic_runs.lag_counts(ids).tolist()[1:] == want[1:]


def test_frequent_words_are_counted_by_transform():
    r = np.random.default_rng(1)
    ids = np.where(r.random(30_000) < 0.3, 0, r.integers(1, 9000, 30_000))
    got = periodic_runs.lag_counts(ids)
    assert all(got[q] == (ids[:-q] == ids[q:]).sum() for q in (1, 2, 3, 77, 4096, 15_000))
    assert periodic_runs.runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]


def test_op11(spark, sf):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert sorted(got) == sorted(docs)
    for i, text in docs.items():
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 2500:
            continue
        own = runs_by_hand(w)
        gone = {k for s, length, q in own for k in range(s + q, s + length)}
        s, length, q = min(own, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in own)
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(own), s, length, q, 1000 * length // q if own else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_runs_of_odd_documents(spark, odd, none):
    out = periodic_runs.detected(odd.withColumn("runs", F.lit("own")))
    got = {r["doc_id"]: r for r in out.collect()}
    assert [tuple(x) for x in got[4]["runs"]] == [(0, 30000, 1)] and got[4]["collapsed"] == "word"
    assert got[0]["runs"] == [] and got[0]["collapsed"] == "" and got[1]["collapsed"] == ""
    assert periodic_runs.detected(none).count() == 0 and periodic_runs.with_tails(odd).columns == odd.columns


PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licenses_by_hand(text, templates=license_scan.TEMPLATES, width=64):
    low = (text or "").translate(LOW)
    words = PLAIN.findall(low)
    base = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    labels, best = {x for _, x in base}, 0.0
    for line in low.split("\n"):
        w = PLAIN.findall(line)
        for k in range(0, max(1, len(w) - width // 2), width // 2) if len(w) > width else (0,):
            block = set(w[k : k + width])
            for label, t, least in templates:
                share = len(block & set(t.split())) / len(set(t.split()))
                if share >= least - 1e-9:
                    labels.add(label)
                    best = max(best, share)
    join = lambda xs: ",".join(sorted(set(xs)))
    return len(words), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None), join(x for _, x in base), join(labels), 1.0 if base else best


def test_op13(spark, sf):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_license_scan"](spark, sf).collect()}
    assert got == {i: licenses_by_hand(t) for i, t in docs.items()}


def test_licenses_of_made_texts(spark):
    r = random.Random(2)
    own = [t.split() for _, t, _ in license_scan.TEMPLATES]
    texts = [None, "", "MIT", "under the MIT license under the mit LICENSE", "Apache License, Version 2.0\nlicense", "apache license version\n2", "All rights\nreserved", "é all rights reserved é"]
    for _ in range(150):
        w = list(r.choice(own))
        for _ in range(r.randint(0, 4)):
            w.insert(r.randrange(len(w) + 1), r.choice(["foo", "The", "x1", "\n", "license"])) if r.random() < 0.5 else w.pop(r.randrange(len(w)))
            if not w:
                break
        pad = ["word"] * r.choice([0, 3, 60, 200])
        texts.append(" ".join(pad + w + pad))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"places": F.lit(1), "blocks": F.lit(2)})
    labels = [x[0] for x in license_scan.TEMPLATES]
    for row in license_scan.scanned(df).collect():
        n, n_base, first, last, _, want, score = licenses_by_hand(texts[row["doc_id"]])
        found = {list(license_scan.PHRASES.values())[p["phrase"]] for p in row["places"]} | {labels[b["template"]] for b in row["blocks"]}
        assert (row["n_words"], len(row["places"]), ",".join(sorted(found))) == (n, n_base, want)
    assert license_scan.scanned(df.limit(0)).count() == 0


def shop(spark, lines, sales, items=(), vendors=(), clients=()):
    make = spark.createDataFrame
    return (
        make(lines, "sale_id long, item_id long, vendor_id long, flag string"), make(sales, "sale_id long, client_id long, sold_at timestamp_ntz"),
        make(list(items), "item_id long, kind string"), make(list(vendors), "vendor_id long, nation_id int"), make(list(clients), "client_id long, segment string"),
    )


def encoded_by_hand(lines, sales, items, vendors, clients, gap=0):
    kind, nation, segment = dict(items), dict(vendors), dict(clients)
    none = lambda x: -1 if x is None else x
    rows = [(s, none(i), none(v), none(c), at, f == "returned", zlib.crc32(str(s).encode()) % 5) for s, i, v, f in lines for s2, c, at in sales if s is not None and s == s2 and at is not None]
    keys = {"item": lambda r: r[1], "vendor": lambda r: r[2], "client": lambda r: r[3], "kind": lambda r: kind.get(r[1]), "nation": lambda r: nation.get(r[2]), "segment": lambda r: segment.get(r[3]), "all": lambda r: 0}
    out = {}
    for r in rows:
        past = [x for x in rows if x[6] != r[6] and (r[4] - x[4]).total_seconds() * 1e6 > gap]
        n = {k: sum(f(x) == f(r) for x in past) for k, f in keys.items()}
        s = {k: sum(f(x) == f(r) and x[5] for x in past) for k, f in keys.items()}
        rate = lambda k, p: p if n[k] < 1 else (1000000 * s[k] + 50 * p) // (n[k] + 50)
        top = rate("all", 500000)
        own = [x for x in rows if x[:3] == r[:3]]
        out[r[:3]] = (len(own), sum(x[5] for x in own), n["item"], rate("item", rate("kind", top)), n["vendor"], rate("vendor", rate("nation", top)), n["client"], rate("client", rate("segment", top)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_target_encoding_by_hand(spark, seed, monkeypatch):
    import datetime

    monkeypatch.setattr(target_encoding, "CELL", 2)  # many bins
    monkeypatch.setattr(target_encoding, "HEAVY", 5)
    r = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    sales = [(i, r.choice([None, 1, 1, 1, 2, 3]), None if i % 17 == 5 else start + datetime.timedelta(seconds=r.choice([0, r.randint(0, 40), r.randint(0, 10**6)]))) for i in range(60)]
    lines = [(r.choice([None, 7, 7, *range(70)]), r.choice([None, 5, 5, 6, 8, 9]), r.choice([None, 1, 2, 3]), r.choice([None, "kept", "returned", "returned"])) for _ in range(260)]
    dims = [(5, "a"), (6, "a"), (8, None)], [(1, 10), (2, None)], [(1, "s"), (2, "t")]
    gap = (0, 5_000_000, 0)[seed]
    got = {tuple(x)[:3]: tuple(x)[3:] for x in target_encoding.encoded(*shop(spark, lines, sales, *dims), gap=gap).collect()}
    assert got == encoded_by_hand(lines, sales, *dims, gap=gap)


def test_target_encoding_of_nothing(spark):
    import datetime

    assert target_encoding.encoded(*shop(spark, [], [])).count() == 0
    one = target_encoding.encoded(*shop(spark, [(1, None, 2, "returned"), (1, None, 2, None)], [(1, None, datetime.datetime(2024, 1, 1))])).collect()
    assert [tuple(x) for x in one] == [(1, -1, 2, 2, 1, 0, 500000, 0, 500000, 0, 500000)]


@pytest.fixture(scope="module")
def files():
    r = random.Random(4)
    return jpeg.encode([bytes(r.randrange(32, 127) for _ in range(64 * r.randint(1, 60))) for _ in range(24)])


def test_damaged_media(files):
    """Any damage gives None or some tensor, never an error, and leaves the other files alone."""
    r, sound = random.Random(5), jpeg.decode(files)
    for _ in range(60):
        batch, hurt = list(files), {r.randrange(len(files)) for _ in range(6)}
        for k in hurt:
            f = bytearray(batch[k])
            for _ in range(r.choice([1, 3, 20])):
                at = r.randrange(len(f)) if r.random() < 0.5 else r.randrange(min(len(f), 700))  # headers as often as data
                f[at] = r.randrange(256)
            batch[k] = bytes(f[: r.randrange(len(f))] if r.random() < 0.2 else f)
        out = jpeg.decode(batch)
        assert all((out[k] == sound[k]).all() for k in range(len(files)) if k not in hurt)
    for head in (b"", b"\xff", b"\xff\xd8", b"\xff\xd8\xff\xd9", b"no"):
        assert jpeg.decode([head, files[0]])[0] is None


def test_damaged_headers(files):
    f = files[0]
    at = f.index(b"\xff\xc2") + 5
    for put in (b"\0\0\0\1", b"\0\1\0\0", b"\xff\xff\xff\xff"):  # no height, no width, more than its bytes hold
        assert jpeg.decode([f[:at] + put + f[at + 4 :]]) == [None]
    for factor in (0x00, 0x33, 0x20):
        assert jpeg.decode([f[: at + 6] + bytes([factor]) + f[at + 7 :]]) == [None]


def test_media_with_damage(spark, files):
    rows = [(i, f if i % 3 else f[: len(f) // 2].replace(b"\xff\xc4", b"\xff\xc5")) for i, f in enumerate(files)] + [(99, None), (98, b"")]
    got = {r["doc_id"]: r for r in jpeg.read_back(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert len(got) == len(rows) and got[0]["feature"] is None and got[99]["payload_bytes"] is None and got[1]["media_bytes"] == len(files[1])


def test_giant_components(spark):
    rows = [(0, [3.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [1e17, 1.0]), (100, [1e20, -1.0]), (4, [-1e20, 5.0]), (5, [2.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_search.search(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10).orderBy("query_id", "rank").collect()]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 100):
        score = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], c)))), i) for i, c in whole.items() if i != q and len(c) == len(whole[q])]
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(score, key=lambda x: (-x[0], x[1])))]
    assert got == want


def test_documents_without_an_id(spark):
    df = spark.createDataFrame([(None, "nobody's text"), (3, "three"), (None, None), (-2, "minus two")], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in wavelet.read_back(*wavelet.write(df, "doc_id", "text")).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, None, -2, 3] and [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1]]


def texts_of(k):
    words = "the of segmentation unbelievable naïve 日本語 a b internationalisation ▁x \n\n  tabs\there café".split(" ")
    texts = [" ".join(words[(7 * i * j + j) % len(words)] for j in range(3 + 11 * i)).encode() for i in range(k)] + [b"", b" ", b"\n"]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return np.frombuffer(b"".join(texts), np.uint8), off, common.mix(np.arange(len(texts)).astype(np.uint64))


@pytest.mark.parametrize("k", [1, 2, 4])
def test_segmentation_asks_the_frontier_for_what_draws_can_take(k, monkeypatch):
    """Edges get a Gumbel value of their own only where a path may branch, and draws are as with all nodes kept."""
    v, (data, off, seeds) = segmentation.vocabulary(bpe.public(segmentation.MODEL)), texts_of(12)
    seen, gumbel = [], segmentation.gumbel
    monkeypatch.setattr(segmentation, "gumbel", lambda x: seen.append(len(x)) or gumbel(x))
    few = segmentation.sample(v, data, off, seeds, k)
    assert sum(seen) <= (len(off) - 1) * (1 + k * k * 16) and sum(seen) < len(data) * k
    monkeypatch.setattr(segmentation, "least", lambda x, at, k: np.flatnonzero(np.isfinite(x)))
    for a, b in zip(few, segmentation.sample(v, data, off, seeds, k), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_segmentation_takes_the_best_edges():
    """The first draw's edges are the best of each node by share and Gumbel noise, and pieces are found by their prefixes."""
    v, (data, off, seeds) = segmentation.vocabulary(bpe.public(segmentation.MODEL)), texts_of(6)
    units = [b" the", b" internationalisation", " 日本語".encode(), b"\n", " naïve▁".encode()]
    data, end = np.frombuffer(b"".join(units), np.uint8), np.repeat(np.cumsum([len(u) for u in units]), [len(u) for u in units])
    lat = segmentation.Lattice(v, data, end)
    pieces = {b: i for i, b in enumerate(v.bytes) if b and i not in set(v.byte_id.tolist())}
    for p in range(len(data)):
        e = lat.start[p] + np.arange(lat.count[p])
        if (data[p] & 0xC0) != 0x80:
            want = {n: pieces[x] for n in range(1, end[p] - p + 1) if (x := data[p : p + n].tobytes()) in pieces}
            assert {int(lat.length[x]): int(lat.piece[x]) for x in e if lat.piece[x] not in v.byte_id} == want
            assert np.isclose(np.exp(lat.share[e]).sum(), 1)
    begin, stop = np.r_[0, np.unique(end)[:-1]], np.unique(end)
    salt = common.mix(np.arange(len(units)).astype(np.uint64))
    unit, place, edge, behind = segmentation.walk(lat, begin.copy(), begin, stop, salt)
    for u, p, x, far in zip(unit, place, edge, behind):
        e = lat.start[p] + np.arange(lat.count[p])
        seed = common.mix(salt[u : u + 1] + np.array([p - begin[u]]).astype(np.uint64) * common.STEP[11])
        h = lat.share[e] + segmentation.gumbel(common.mix(seed + lat.noise[e]))
        assert x == e[np.argmax(h)]
        assert np.isinf(far) if len(e) == 1 else np.isclose(far, np.diff(np.exp(-np.sort(h)[::-1][:2]))[0])


@pytest.mark.parametrize("many", [0, 1 << 31])
def test_target_encoding_probes_a_level_in_its_own_steps(spark, many, monkeypatch):
    """A table of steps a level, counts as one number where lines are few: narrow tables, each read once."""
    import datetime

    rng, tables, written = random.Random(5), {}, common.written
    day = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(40))
    lines = [(rng.randrange(60), rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 8]), rng.choice(["returned", "kept", None])) for _ in range(300)]
    sales = [(i, rng.choice([None, 4, 5, 6]), day()) for i in range(60)]
    dims = [(1, "x"), (2, "y")], [(7, 1), (8, 2)], [(4, "a"), (5, "b")]
    monkeypatch.setattr(target_encoding, "CELL", 2)
    monkeypatch.setattr(target_encoding, "MANY", many)
    monkeypatch.setattr(common, "written", lambda df, name, *a: tables.setdefault(name, written(df, name, *a)))
    got = {tuple(x)[:3]: tuple(x)[3:] for x in target_encoding.encoded(*shop(spark, lines, sales, *dims)).collect()}
    assert got == encoded_by_hand(lines, sales, *dims)
    made = {k: t for k, t in tables.items() if k.startswith("encode-steps")}
    assert sorted(made) == [f"encode-steps-{x}" for x in ("all", "client", "item", "kind", "nation", "segment", "vendor")]
    assert all(len(t.columns) == 4 + (5 if many else 10) for t in made.values())


def test_target_encoding_of_a_sale_with_two_clients_at_once(spark):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    got = target_encoding.encoded(*shop(spark, [(1, 2, 3, "returned")], [(1, 4, day), (1, 5, day)])).collect()
    assert [tuple(x) for x in got] == [(1, 2, 3, 1, 1, 0, 500000, 0, 500000, 0, 500000)] * 2


def test_target_encoding_compares_a_probe_with_few_steps(spark, monkeypatch):
    """Probes meet the steps of one cell: these are few, though prefix sums are made for coarser bins."""
    import datetime

    tables, written, n = {}, common.written, 3000
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i)
    monkeypatch.setattr(common, "written", lambda df, name, *a: tables.setdefault(name, written(df, name, *a)))
    target_encoding.encoded(*shop(spark, [(i, 1, 1, "returned" if i % 3 else None) for i in range(n)], [(i, 1, day(i)) for i in range(n)]))
    for x in ("item", "kind", "all"):
        t = tables[f"encode-steps-{x}"]
        sizes = [r["count"] for r in t.groupBy([c for c in t.columns if c in ("key", "bin", "cell")]).count().collect()]
        assert sum(sizes) < 1.25 * n and max(sizes) <= 34
