"""Frame sequences: time ranges, selection, reduction."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


_PLACES = T.ArrayType(T.IntegerType())


def in_range(frames: str | Column, start: Column, end: Column) -> Column:
    """Frames of the closed range."""
    return F.filter(frames, lambda f: (f["timestamp"] >= start) & (f["timestamp"] <= end))


@F.pandas_udf(_PLACES)
def _selected(ts: pd.Series, scene: pd.Series, scene_threshold: pd.Series, min_gap: pd.Series, interval: pd.Series) -> pd.Series:
    out = []
    for times, scenes, least, gap, every in zip(ts, scene, scene_threshold, min_gap, interval, strict=True):
        kept, last = [], None
        for i, (t, x) in enumerate(zip(times, scenes, strict=True) if times is not None else ()):
            if last is None or (x is not None and x > least and t - last >= gap) or t - last >= every:
                kept.append(i)
                last = t
        out.append(kept)
    return pd.Series(out)


def select_adaptive(frames: str | Column, scene_threshold: Column, min_gap: Column, interval: Column) -> Column:
    """Of ordered (ts, scene), best a plain column, as each selected frame looks into it: the first, scene changes min_gap after the last selected, and any frame interval after it."""
    ts, scene = F.transform(frames, lambda f: f["ts"].cast("double")), F.transform(frames, lambda f: f["scene"].cast("double"))
    at = _selected(ts, scene, scene_threshold.cast("double"), min_gap.cast("double"), interval.cast("double"))
    return F.transform(at, lambda i: F.get(_column(frames), i))


def intervals(duration: Column, fps: float, min_frames: int) -> tuple[Column, Column, Column]:
    """Target count, interval and least gap of a video."""
    target = F.ceil(duration * fps)
    return target, duration / F.least(target, F.lit(min_frames)), F.lit(1.0 / fps)


@F.pandas_udf(_PLACES)
def _reduced(n: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([reduce_list(int(a), int(b)) for a, b in zip(n, target, strict=True)])


def reduce_indices(n: Column, target: Column) -> Column:
    """floor(0), floor(step), ... below n, the step added up in floating point as a loop would; may give target + 1 places."""
    return _reduced(n.cast("long"), target.cast("long"))


def reduce(frames: str | Column, target: Column) -> Column:
    return F.transform(reduce_indices(F.size(frames), target), lambda i: F.get(_column(frames), i))


def cap(frames: str | Column, target: Column, max_scene: int) -> Column:
    """Frames as they are unless they are more than both the target and max_scene."""
    n = F.size(frames)
    return F.when((n > target) & (n > max_scene), reduce(frames, F.greatest(target, F.lit(max_scene)))).otherwise(_column(frames))


def reduce_list(n: int, target: int) -> list[int]:
    """The same places, for tests and Python callers."""
    if n <= target:
        return list(range(n))
    step, i, out = n / target, 0.0, []
    while i < n:
        out.append(math.floor(i))
        i += step
    return out
