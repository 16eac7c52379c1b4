"""Similarity of frame sequences by dynamic time warping over sliding windows."""

from __future__ import annotations

import numpy as np


def frame_costs(a: np.ndarray, b: np.ndarray, low_byte: bool = False) -> np.ndarray:
    """Costs in [0, 1] between hashes of two sequences."""
    x = np.asarray(a, np.int64).view(np.uint64)[:, None] ^ np.asarray(b, np.int64).view(np.uint64)[None, :]
    d = np.bitwise_count(x).astype(np.float64)
    if low_byte:
        d[(x >> np.uint64(8)) != 0] = 65
    return d / 64


def warped_costs(costs: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The cheapest path's cost through the first m[i] rows and n[i] columns of each matrix costs[i], all matrices at once by antidiagonals."""
    count, rows, cols = costs.shape
    # matrices stand side by side, so that a step works on long runs
    flat = np.ascontiguousarray(costs.transpose(1, 2, 0)).reshape(rows * cols, count)
    out = np.full(count, np.inf)
    ending = np.argsort(m + n, kind="stable")
    ends = (m + n)[ending]
    before, last = np.full((rows + 1, count), np.inf), np.full((rows + 1, count), np.inf)
    before[0] = 0  # the start, at antidiagonal 0 of a table with a border
    for d in range(2, rows + cols + 1):
        now = np.full((rows + 1, count), np.inf)
        lo, hi = max(1, d - cols), min(rows, d - 1) + 1
        # from above and from the left on the antidiagonal before, from the corner on the one before that
        least = np.minimum(last[lo - 1 : hi - 1], last[lo:hi])
        np.minimum(least, before[lo - 1 : hi - 1], out=least)
        i = np.arange(lo, hi)
        now[lo:hi] = flat[(i - 1) * cols + d - i - 1] + least
        done = ending[np.searchsorted(ends, d, "left") : np.searchsorted(ends, d, "right")]
        out[done] = now[m[done], done]
        before, last = last, now
    return out


def dtw_similarity(a: np.ndarray, b: np.ndarray, low_byte: bool = False) -> float:
    """1 - the cheapest path's cost / the longer length. An empty side is infinitely far."""
    m, n = len(a), len(b)
    if not m or not n:
        return 1.0 if m == n else -np.inf
    return float(1 - warped_costs(frame_costs(a, b, low_byte)[None], np.array([m]), np.array([n]))[0] / max(m, n))


#: Cells of the matrices that are walked together.
CELLS = 1 << 18
#: Pairs of videos whose windows are walked together.
TOGETHER = 256


def video_similarity(hash_a, ts_a, duration_a: float, hash_b, ts_b, duration_b: float, step: float = 1.0, threshold: float = 2.0, low_byte: bool = False) -> float:
    """The best window of the longer against all of the shorter (of equal ones the first counts as shorter); stops at the threshold."""
    return float(video_similarities([(hash_a, ts_a, duration_a, hash_b, ts_b, duration_b)], step, threshold, low_byte)[0])


class _Windows:
    """The windows of a pair of videos, those not looked at yet and the best so far."""

    def __init__(self, hash_a, ts_a, duration_a, hash_b, ts_b, duration_b, step, low_byte):
        if duration_a <= duration_b:
            short, long, ts = np.asarray(hash_a), np.asarray(hash_b), np.asarray(ts_b, float)
            width, whole = duration_a, duration_b
        else:
            short, long, ts = np.asarray(hash_b), np.asarray(hash_a), np.asarray(ts_a, float)
            width, whole = duration_b, duration_a
        self.starts, start = [], 0.0
        while start <= whole - width:
            self.starts.append(start)
            start += step
        self.costs = frame_costs(long, short, low_byte) if len(long) and len(short) else np.zeros((len(long), len(short)))
        self.ts, self.width, self.frames = ts, width, len(short)
        self.at, self.best = 0, 0.0

    def next(self, most: int) -> list[np.ndarray]:
        lot = self.starts[self.at : self.at + most]
        self.at += len(lot)
        return [np.flatnonzero((self.ts >= s) & (self.ts <= s + self.width)) for s in lot]


def video_similarities(pairs: list[tuple], step: float = 1.0, threshold: float = 2.0, low_byte: bool = False) -> np.ndarray:
    """video_similarity of every pair (hashes, times and duration of each side), windows of many pairs at once."""
    out = np.zeros(len(pairs))
    for at in range(0, len(pairs), TOGETHER):
        some = [_Windows(*x, step, low_byte) for x in pairs[at : at + TOGETHER]]
        left, most = some, 4 if threshold <= 1 else 64  # they may stop soon
        while left := [x for x in left if x.best < threshold and x.at < len(x.starts)]:
            asked = [(x, w) for x in left for w in x.next(most)]
            got = _similarities([(x.costs, w) for x, w in asked])
            for (x, _), s in zip(asked, got.tolist(), strict=True):  # in order: a window after the first at the threshold is not looked at
                if x.best < threshold:
                    x.best = max(x.best, s)
            most = 64
        out[at : at + len(some)] = [x.best for x in some]
    return out


def _similarities(windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """1 - the cheapest path's cost / the longer length, of windows (costs of all frames of both sides, the rows of the window)."""
    rows, cols = np.array([len(w) for _, w in windows]), np.array([c.shape[1] for c, _ in windows])
    got = np.where((rows == 0) & (cols == 0), 1.0, -np.inf)
    some = np.flatnonzero((rows > 0) & (cols > 0))
    some = some[np.lexsort((cols[some], rows[some]))]  # tables of like sizes stand together
    at = 0
    while at < len(some):
        high, wide, to = 0, 0, at
        while to < len(some):
            h, w = max(high, rows[some[to]]), max(wide, cols[some[to]])
            if to > at and h * w * (to + 1 - at) > CELLS:
                break
            high, wide, to = h, w, to + 1
        lot = some[at:to]
        table = np.zeros((len(lot), high, wide))
        for i, x in enumerate(lot):
            table[i, : rows[x], : cols[x]] = windows[x][0][windows[x][1]]
        got[lot] = 1 - warped_costs(table, rows[lot], cols[lot]) / np.maximum(rows[lot], cols[lot])
        at = to
    return got
