import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.config import Params
from shutterlake.functions import formats, text
from shutterlake.functions.frames import reduce_indices, reduce_list, select_adaptive
from shutterlake.functions.phash import hamming, middle, phash
from shutterlake.functions.sequences import dtw_similarity, video_similarity
from shutterlake.operators.components import connected_components
from shutterlake.operators.neighbours import hash_pairs, knn_join


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_hamming_and_the_low_byte(spark):
    cases = [(0, 0, 0), (1, 1, 1), (0xFF, 8, 8), (0x100, 1, 65), (-1, 64, 65)]
    for x, d, low in cases:
        r = one(spark, hamming(F.lit(x), F.lit(0)).alias("d"), hamming(F.lit(x), F.lit(0), True).alias("low"))
        assert (r.d, r.low) == (d, low)


def test_reduce_keeps_the_float_step(spark):
    for n, t in ((102, 100), (10, 3), (5, 9), (0, 4), (7, 7)):
        got = one(spark, reduce_indices(F.lit(n), F.lit(t)).alias("r")).r
        assert got == reduce_list(n, t)
    assert len(reduce_list(102, 100)) == 101


def test_to_fixed(spark):
    for x, s in ((1.005, "1.00"), (0.125, "0.13"), (2.0, "2.00"), (-1.5, "-1.50"), (1.255, "1.25"), (0.0, "0.00"), (1234567.891, "1234567.89")):
        assert one(spark, text.to_fixed2(F.lit(x)).alias("s")).s == s


def test_dates(spark):
    d = F.lit("2021-01-01 00:05:09").cast("timestamp_ntz")
    got = {t: one(spark, text.date_token(d, t).alias("s")).s for t in ("YYYY", "WW", "hh", "h", "a", "A", "DDDD", "MMM")}
    assert got == {"YYYY": "2021", "WW": "53", "hh": "12", "h": "12", "a": "am", "A": "AM", "DDDD": "Friday", "MMM": "Jan"}
    assert one(spark, text.date_token(F.lit(None).cast("timestamp"), "WW").alias("s")).s == ""


def test_extensions(spark):
    for p, e in (("a/.jpg", ""), ("a/A.JPG", "jpg"), ("x.tar.gz", "gz"), ("b/none", "")):
        assert one(spark, formats.extension(F.lit(p)).alias("e")).e == e
    assert len(set(formats.IMAGE_EXTENSIONS)) == 37 and len(set(formats.VIDEO_EXTENSIONS)) == 23
    with pytest.raises(Exception, match="neither an image nor a video"):
        one(spark, formats.file_type(F.lit("mkv"), strict=True))


def test_adaptive_selection(spark):
    frames = F.array(*[F.struct(F.lit(float(t)).alias("ts"), F.lit(s).alias("scene")) for t, s in ((0, 0.0), (1, 0.9), (1.2, 0.9), (4, 0.0), (9, 0.0))])
    kept = one(spark, select_adaptive(frames, F.lit(0.5), F.lit(0.5), F.lit(4.0)).alias("k")).k
    assert [f.ts for f in kept] == [0.0, 1.0, 9.0]


def plain_dct(p, size):
    c = np.float32([[np.cos((2 * x + 1) * u * np.pi / (2 * size)) for x in range(size)] for u in range(8)])
    norm = np.float32([np.sqrt(2 / size) / np.sqrt(2)] + [np.sqrt(2 / size)] * 7)
    out = np.zeros(64, np.float32)
    for y in range(size):
        row = np.float32([sum(float(p[y * size + x]) * float(c[u, x]) for x in range(size)) for u in range(8)])
        for v in range(8):
            for u in range(8):
                out[v * 8 + u] = np.float32(float(out[v * 8 + u]) + float(norm[v]) * float(row[u]) * float(c[v, y]))
    return out


def test_phash_against_plain_loops():
    rng = np.random.default_rng(1)
    for _ in range(5):
        p = rng.integers(0, 256, 256, np.uint8)
        c = plain_dct(p, 16)
        m = middle(np.abs(c[1:]))
        bits = sum(1 << i for i in range(64) if c[i] > m)
        assert phash(p.tobytes(), 16) & (2**64 - 1) == bits


def test_middle_is_rank_30_or_31():
    rng = np.random.default_rng(2)
    ranks = set()
    for _ in range(200):
        x = rng.permutation(63).astype(np.float32)
        ranks.add(int(middle(x)))
    assert ranks == {30, 31}


def test_dtw():
    a = np.array([0, 1, 3], np.int64)
    assert dtw_similarity(a, a) == 1
    assert dtw_similarity(np.array([0]), np.array([1])) == 1 - 1 / 64
    assert dtw_similarity(np.zeros(0, np.int64), a) == -np.inf
    x, y = np.array([0, 255, 7]), np.array([0, 7])
    assert dtw_similarity(x, y) == dtw_similarity(y, x) == 1 - (5 / 64) / 3
    t = [0.0, 1.0, 2.0, 3.0]
    assert video_similarity([5, 6], t[:2], 1.0, [1, 5, 6, 9], t, 3.0) == 1.0


def test_banded_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    hashes = sorted({b ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for b in base for _ in range(4)} | set(base))
    df = spark.createDataFrame([(h,) for h in hashes], "hash long")
    for k in (0, 1, 2, 4):
        want = {(a, b) for a in hashes for b in hashes if bin((a ^ b) & (2**64 - 1)).count("1") <= k}
        assert {(r.ha, r.hb) for r in hash_pairs(df, df, k).collect()} == want


def test_knn(spark):
    rng = np.random.default_rng(4)
    h = [int(x) for x in rng.integers(0, 2**20, 60)]
    pts = spark.createDataFrame(list(enumerate(h)), "point long, hash long")
    got = knn_join(pts.withColumnRenamed("point", "query"), pts, 4).collect()
    want = {(q, r + 1): p for q in range(60) for r, p in enumerate(sorted((p for p in range(60) if p != q), key=lambda p: (bin(h[p] ^ h[q]).count("1"), p))[:4])}
    assert {(r.query, r["rank"]): r.point for r in got} == want


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99}
    assert connected_components(e.limit(0)).count() == 0


def test_params():
    assert (Params().max_bits("II"), Params().max_bits("VV")) == (0, 4)


def plain_warp(a, b):
    m, n = len(a), len(b)
    if not m or not n:
        return 1.0 if m == n else -np.inf
    row = [0.0] + [np.inf] * n
    for x in a:
        new = [np.inf]
        for j, y in enumerate(b):
            new.append(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") / 64 + min(row[j], row[j + 1], new[j]))
        row = new
    return 1 - row[n] / max(m, n)


def plain_video(ha, ta, da, hb, tb, db, threshold):
    short, long, ts, w, whole = (ha, hb, tb, da, db) if da <= db else (hb, ha, ta, db, da)
    best, start = 0.0, 0.0
    while start <= whole - w:
        best = max(best, plain_warp([h for h, t in zip(long, ts, strict=True) if start <= t <= start + w], short))
        if best >= threshold:
            break
        start += 1.0
    return best


def test_warping_by_plain_loops():
    rng = np.random.default_rng(0)
    for case in range(150):
        m, n = rng.integers(0, 12, 2)
        a, b = (rng.integers(-(2**62), 2**62, x) for x in (m, n))
        if case % 2 and m and n:
            b = np.resize(a, n)
        assert dtw_similarity(a, b) == pytest.approx(plain_warp(a, b), abs=1e-12)
        ta, tb = (np.sort(rng.random(x) * 20) for x in (m, n))
        da, db = ta[-1] if m else 0.0, tb[-1] if n else 0.0
        for threshold in (2.0, 0.6):
            assert video_similarity(a, ta, da, b, tb, db, 1.0, threshold) == pytest.approx(plain_video(a, ta, da, b, tb, db, threshold), abs=1e-12)


def test_hashes_meet_few_others_by_chance():
    from math import comb

    from shutterlake.operators.neighbours import BITS, MAX_KEYS, blocks_for, masks

    for n, most in ((10**4, 10**5), (10**9, 2 * 10**11)):
        m = blocks_for(n, 4)
        assert len(masks(4, m)) == comb(m, 4) <= MAX_KEYS
        assert comb(m, 4) * n * n / 2 ** (BITS * (m - 4) / m) <= most * 10
    assert all(mask.bit_count() >= 12 for mask in masks(4, 5))


def test_open_queries_write_out_no_pairs(spark, monkeypatch):
    """Queries without near points are compared in blocks: no operator makes a row of each pair."""
    from shutterlake.operators import neighbours as nb

    rng = np.random.default_rng(5)
    h = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 700)]
    pts = spark.createDataFrame([*enumerate(h), (700, h[0]), (701, None)], "point long, hash long")
    asked = pts.where("point % 10 = 0").withColumnRenamed("point", "query")
    monkeypatch.setattr(nb, "POINT_ROWS", 90)
    monkeypatch.setattr(nb, "QUERY_ROWS", 20, raising=False)
    ids = dict([*enumerate(h), (700, h[0])])
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    for n in (3, 200):
        out = nb.knn_join(asked, pts, n)
        got = {(r.query, r["rank"]): (r.point, r.distance) for r in out.collect()}
        want = {(q, i + 1): (p, bits(ids[p], ids[q])) for q in ids if q % 10 == 0 for i, p in enumerate(sorted((p for p in ids if p != q), key=lambda p: (bits(ids[p], ids[q]), p))[:n])}
        assert got == want
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_a_block():
    from shutterlake.operators.neighbours import _nearest

    point, h = np.array([1, 2, 2, 5]), np.array([0, 1, 3, -1])
    i, j, d = _nearest(np.array([2, 9]), np.array([1, -1]), point, h, 2, True)
    assert {*zip(i, j, d, strict=True)} == {(0, 0, 1), (0, 3, 63), (1, 3, 0), (1, 2, 62)}
