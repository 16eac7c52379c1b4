import numpy as np
import pytest

from shutterlake.config import Params
from shutterlake.functions.sequences import video_similarity
from shutterlake.operators import media as md

SCHEMA = "path long, duration double, frames array<struct<hash:bigint,timestamp:double>>"


def video(path, hashes, times=None):
    times = [float(t) for t in (range(len(hashes)) if times is None else times)]
    return path, times[-1], list(zip([int(h) for h in hashes], times, strict=True))


def test_a_common_frame_makes_few_pairs(spark, monkeypatch):
    """200 videos share one frame of five: 19,900 pairs, of which two can be alike."""
    rng = np.random.default_rng(1)
    rows = [video(i, [7, *rng.integers(0, 2**60, 4)]) for i in range(200)]
    rows += [(300, *rows[3][1:]), video(301, [f[0] ^ 3 for f in rows[4][2]])]
    asked, warp = [], md.warp_pairs
    monkeypatch.setattr(md, "warp_pairs", lambda pairs, *a, **b: asked.append(pairs.count()) or warp(pairs, *a, **b))
    got = md.similarity_edges(spark.createDataFrame(rows, SCHEMA)).where("pair_class = 'VV'").collect()
    assert {(r.a, r.b) for r in got} == {(3, 300), (4, 301)}
    assert sum(asked) < 20


@pytest.mark.parametrize("even", [True, False])
def test_video_edges_are_those_of_all_pairs(spark, even):
    """Copies, near copies, parts, common frames, equal times and videos of one duration, at even and at odd times."""
    rng = np.random.default_rng(2)
    flip = lambda h, bits: int(h) ^ sum(1 << int(b) for b in rng.choice(60, bits, replace=False))
    common, rows = [int(x) for x in rng.integers(0, 2**60, 2)], []
    for i in range(14):
        h = [common[int(rng.integers(0, 2))] if rng.random() < 0.4 else int(x) for x in rng.integers(0, 2**60, int(rng.integers(2, 14)))]
        t = list(range(len(h))) if even else sorted(np.round(rng.random(len(h)) * 8, 1))
        forms = [(h, t), (h, t), ([flip(x, int(rng.integers(0, 8))) for x in h], t), ([flip(h[0], 9), *h[1:]], t)]
        forms += [(h[1:], [x - t[1] for x in t[1:]])] if len(h) > 2 else []
        forms += [(h + h[:2], t + [t[-1] + 0.5, t[-1] + 1])] if not even else [(h + h[:1], [*t, t[-1] + 1])]
        rows += [video(10 * ((i * 5) % 14) + j, *f) for j, f in enumerate(forms)]
    p = Params()
    split = lambda r: ([f[0] for f in r[2]], [f[1] for f in r[2]], r[1])
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] and y[1]:
                s = video_similarity(*split(x), *split(y), p.step_size, p.video_similarity)
                if s >= p.video_similarity:
                    want[x[0], y[0]] = s
    df = spark.createDataFrame(rows, SCHEMA)
    got = md.similarity_edges(df, p).where("pair_class = 'VV'").collect()
    assert len(want) > 30 and len(got) == len(want)
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx(want)


def test_askers_of_a_common_frame_are_compared_in_lots(spark, monkeypatch):
    """300 videos of three frames, two of them common: of 44,850 pairs few are written out, and windows are walked together."""
    from shutterlake.functions import sequences as sq

    rng = np.random.default_rng(4)
    monkeypatch.setattr(md, "ASKERS", 50)
    monkeypatch.setattr(md, "HOLDERS", 70)
    rows = [video(i, [7, int(rng.integers(0, 2**60)), 9 << 40]) for i in range(300)]
    rows += [video(400 + i, [7, rows[i][2][1][0] ^ 31, 9 << 40, 5]) for i in range(20)]
    met, payable = [], md._payable
    monkeypatch.setattr(md, "_payable", lambda pairs, *a: met.append(pairs.count()) or payable(pairs, *a))
    got = md.similarity_edges(spark.createDataFrame(rows, SCHEMA), Params(), ("VV",)).collect()
    split = lambda r: ([f[0] for f in r[2]], [f[1] for f in r[2]], r[1])
    like = lambda x, y: (x[2][1][0] ^ y[2][1][0]).bit_count() <= 13
    assert {(r.a, r.b) for r in got} == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and like(x, y)}
    assert 20 <= sum(met) < 40
    calls, walk = [], sq.warped_costs
    monkeypatch.setattr(sq, "warped_costs", lambda *a: calls.append(1) or walk(*a))
    s = sq.video_similarities([(*split(rows[i]), *split(rows[300 + i])) for i in range(20)], threshold=0.93)
    assert s.tolist() == [1 - 5 / 64 / 3] * 20 and len(calls) == 1
