"""Frames of media files: decoded images as grey squares, and frame tables of videos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.config import Params
from shutterlake.functions import formats
from shutterlake.functions.frames import cap, intervals, select_adaptive
from shutterlake.functions.phash import phash, phash_udf, tables
from shutterlake.session import spool


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of BGR(A) or grey bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else a[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def squeeze(a: np.ndarray, size: int) -> np.ndarray:
    """Resized to size x size whatever the aspect; each cell is the mean of the area it covers."""
    def along(x: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0)])
        at = np.linspace(0, x.shape[0], n + 1)
        lo = np.floor(at).astype(int)
        lo = np.minimum(lo, x.shape[0] - 1)
        edge = total[lo] + (at - lo)[:, None] * x[lo]
        return np.diff(edge, axis=0) / (x.shape[0] / n)

    return np.clip(np.round(along(along(a, size).T, size).T), 0, 255).astype(np.uint8)


def image_frames(spark: SparkSession, paths: str | list[str], size: int) -> DataFrame:
    """path, hash, error of image files: one frame at time 0. Files that do not decode give an error."""
    some = "{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in formats.IMAGE_EXTENSIONS) + "}"
    pics = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{some}").load(paths).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        consts = tables(size)
        for pdf in batches:
            out = []
            for path, h, w, c, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                if w is None or w <= 0:
                    out.append((path, None, "not an image"))
                else:
                    out.append((path, phash(squeeze(grey(bytes(data), h, w, c), size).tobytes(), size, consts), None))
            yield pd.DataFrame(out, columns=["path", "hash", "error"]).astype({"hash": "Int64"})

    return pics.mapInPandas(run, "path string, hash long, error string")


def pair_frames(times: DataFrame, buffers: DataFrame) -> DataFrame:
    """Matches the n-th time of a path to its n-th grey buffer: (path, pos, ts) with (path, pos, pixels)."""
    return times.join(buffers, ["path", "pos"])


def video_frames(times: DataFrame, buffers: DataFrame, durations: DataFrame, p: Params = Params()) -> DataFrame:
    """path, ts, hash of the frames to compare: of decoded frames (times: path, pos, ts, scene; buffers: path, pos, grey pixels) those that selection and cap leave."""
    framed = spool(pair_frames(times, buffers))
    ordered = framed.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), F.col("scene").cast("double").alias("scene"), "pos"))).alias("f"))
    ordered = ordered.join(durations.select("path", "duration"), "path")
    target, interval, gap = intervals(F.col("duration"), p.target_fps, p.min_frames)
    picked = ordered.select("path", "duration", select_adaptive("f", F.lit(p.scene_threshold), gap, interval).alias("f"))
    picked = picked.select("path", F.explode(cap("f", target, p.max_scene_frames)).alias("k")).select("path", "k.pos")
    return framed.join(picked, ["path", "pos"]).select("path", "ts", phash_udf(p.resolution)("pixels").alias("hash"))


def media_table(frames: DataFrame, durations: DataFrame) -> DataFrame:
    """path, duration, frames (ordered) from frame rows (path, ts, hash); missing durations are 0, which means an image."""
    packed = frames.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").alias("timestamp"), "hash"))).alias("f"))
    packed = packed.select("path", F.transform("f", lambda x: F.struct(x["hash"].alias("hash"), x["timestamp"].alias("timestamp"))).alias("frames"))
    return packed.join(durations, "path", "left").select("path", F.coalesce("duration", F.lit(0.0)).alias("duration"), "frames")


def file_info(stats: DataFrame, metadata: DataFrame, media: DataFrame) -> DataFrame:
    """Everything about a file: three 1:1 joins; a file that lacks a part is not valid."""
    return stats.join(metadata, "path").join(media, "path")
