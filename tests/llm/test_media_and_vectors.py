import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import jpeg, queries, topk_search


def padded(b: bytes) -> bytes:
    return b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))


def round_trip(payloads):
    images, coef, base = jpeg.accumulate(jpeg.encode(payloads))
    return [jpeg.payload_of(im, coef[a:b]) for im, a, b in zip(images, base, base[1:])]


def test_payloads():
    rng = random.Random(2)
    p = [b"a" * 64, bytes(64), b"`" * 640, bytes(range(256)) * 3, b"`" * 20 + b"a", b"".join(rng.choice([b"`", b"a", b"_", b"z", b"`" * 20]) for _ in range(2000))]
    p = [padded(x) for x in p]
    assert round_trip(p) == p
    assert jpeg.encode(p) == [jpeg.encode([x])[0] for x in p]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=4))
def test_any_payload(parts):
    p = [padded(x) for x in parts]
    assert round_trip(p) == p


def reference_decode(f: bytes) -> list[np.ndarray]:
    """Coefficients of every component by a plain bit-by-bit reader of progressive scans with restart intervals."""
    _, images = jpeg.parse([f])
    im = images[0]
    data, _ = jpeg.parse([f])
    coef = np.zeros((int(im.first[-1]), 64), int)
    for comps, lo, hi, ah, al, interval, chosen, starts in im.scans:
        order, kind, unit = im.order(list(comps))
        codes = []
        for raw in chosen:
            t, code, k = {}, 0, 16
            for size, n in enumerate(raw[:16], 1):
                for _ in range(n):
                    t[size, code] = raw[k]
                    code, k = code + 1, k + 1
                code <<= 1
            codes.append(t)
        per = interval * unit if interval else len(order)
        for lane, at in enumerate(starts):
            pos, last, skip = int(at) * 8, [0] * 4, 0

            def bit():
                nonlocal pos
                b = data[pos >> 3] >> (7 - (pos & 7)) & 1
                pos += 1
                return int(b)

            def bits(n):
                return sum(bit() << (n - 1 - i) for i in range(n))

            def symbol(t):
                code = 0
                for size in range(1, 17):
                    code = code << 1 | bit()
                    if (size, code) in t:
                        return t[size, code]
                raise ValueError

            def signed(s):
                v = bits(s)
                return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1

            for b, c in zip(order[lane * per : (lane + 1) * per], kind[lane * per : (lane + 1) * per]):
                x = coef[b]
                if lo == 0:
                    if ah:
                        x[0] |= bit() << al
                    else:
                        last[c] += signed(symbol(codes[c]))
                        x[0] = last[c] << al
                    continue
                k = lo
                if not ah:
                    if skip:
                        skip -= 1
                        continue
                    while k <= hi:
                        r, s = divmod(symbol(codes[0]), 16)
                        if s:
                            k += r
                            x[k] = signed(s) * (1 << al)
                            k += 1
                        elif r == 15:
                            k += 16
                        else:
                            skip = (1 << r) + bits(r) - 1
                            break
                    continue

                def correct(k):
                    if bit():
                        x[k] += (1 << al) if x[k] > 0 else -(1 << al)

                while k <= hi and not skip:
                    r, s = divmod(symbol(codes[0]), 16)
                    v = ((1 << al) if bit() else -(1 << al)) if s else 0
                    if not s and r < 15:
                        skip = (1 << r) + bits(r)
                        break
                    while k <= hi:
                        if x[k]:
                            correct(k)
                        elif r:
                            r -= 1
                        else:
                            x[k] = v
                            k += 1
                            break
                        k += 1
                if skip:
                    for k2 in range(k, hi + 1):
                        if x[k2]:
                            correct(k2)
                    skip -= 1
    return coef


def test_against_a_plain_reader():
    rng = np.random.default_rng(4)
    p = padded(bytes(rng.choice([96, 97, 95, 98, 120, 32], 900, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]).astype(np.uint8)))
    f = jpeg.encode([p])[0]
    _, coef, _ = jpeg.accumulate([f])
    assert (coef == reference_decode(f)).all()


def test_tensors():
    flat = padded(bytes([96]) * 64 * 6)
    f = jpeg.encode([flat])[0]
    t = jpeg.decode([f, b"junk", b"", f[:40]])
    assert t[0].shape == (16, 16, 3) and (t[0] == 128).all() and t[1] is None and t[2] is None and t[3] is None
    # one DC step of a luma block lifts its samples, one of a chroma block colours the whole unit
    p = bytearray(flat)
    p[0] = 96 + 80
    p[64 * 5] = 96 + 80
    x = jpeg.decode([jpeg.encode([bytes(p)])[0]])[0].astype(int)
    assert (x[:8, :8, 1] != x[8:, 8:, 1]).all() and (x[8:, 8:, 0] == 142).all() and (x[8:, 8:, 2] == 128).all()


def test_inverse_transform():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(8, 8))
    want = np.array([[sum((1 if u else 2**-0.5) * (1 if v else 2**-0.5) / 4 * c[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    got = (c.ravel()[jpeg.ZIGZAG].astype(np.float32) @ jpeg.INVERSE).reshape(8, 8)
    assert np.allclose(got, want, atol=1e-4)
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_media_column(spark):
    f = jpeg.encode([padded(b"some payload")])[0]
    d = spark.createDataFrame([(1, bytearray(f)), (2, None), (3, bytearray(b"no"))], "id int, media binary")
    got = {r["id"]: r for r in jpeg.decoded(d, "media").collect()}
    assert (got[1]["height"], got[1]["width"], len(got[1]["rgb"])) == (16, 16, 768) and got[2]["rgb"] is None and got[3]["height"] is None
    assert jpeg.decoded(d.limit(0), "media").count() == 0


def brute(rows, k=10):
    ok = [(i, np.floor(1024 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 100 == 0:
            c = sorted(((int(x @ q), j) for j, x in ok if j != i and len(x) == len(q)), key=lambda s: (-s[0], s[1]))[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(c, 1)]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] * (1 + i % 7) + rng.normal(size=8) * 0.01 * (i % 3)).tolist()) for i in range(1500)]
    rows += [(5000 + i, base[3].tolist()) for i in range(200)]
    rows += [(None, [1.0] * 8), (9001, None), (9100, [float("nan")] + [0.0] * 7), (9200, []), (9300, [0.0] * 8), (9400, [1.0, None]), (9500, [2.0, 3.0]), (9501, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(d, "vec_id", "embedding", F.col("vec_id") % 100 == 0, bucket=64, cell=128, block=8)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert topk_search.search(d.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0


def test_registered(spark, sf):
    import oracle

    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{k}" for k in range(1, 11)}
    for n, sql in queries.ORACLE_SQL.items():
        oracle.check(queries.QUERIES[n](spark, sf).toPandas(), sf, sql)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, n = docs.columns, docs.count()
    from tessella.llm import common

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.columns == cols
        if name != "mixing":
            assert 0 < docs.count() <= n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert isinstance(out.limit(2).toPandas(), pd.DataFrame)
