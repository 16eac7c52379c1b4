"""Similarity edges between files: images by hash, images and videos by best frame, videos by warped windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.config import Params
from shutterlake.functions.phash import image_similarity
from shutterlake.functions.sequences import video_similarities
from shutterlake.operators.neighbours import BITS, hash_pairs
from shutterlake.session import discard, spool

#: A frame that more files hold or nearly hold is common: those who ask by it are compared in lots.
COMMON = 64
#: Askers of a lot and holders of a block.
ASKERS, HOLDERS = 4096, 8192


def pair_class(a: str | Column, b: str | Column) -> Column:
    """II, IV or VV of two durations; 0 means an image."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    images = F.when(a == 0, 1).otherwise(0) + F.when(b == 0, 1).otherwise(0)
    return F.when(images == 2, "II").when(images == 1, "IV").otherwise("VV")


def threshold(kind: Column, p: Params) -> Column:
    return F.when(kind == "II", p.image_similarity).when(kind == "IV", p.image_video_similarity).otherwise(p.video_similarity)


def exploded(media: DataFrame) -> DataFrame:
    """path, duration, pos, ts, hash of every frame."""
    return media.select("path", "duration", F.posexplode("frames").alias("pos", "frame")).select("path", "duration", "pos", F.col("frame.timestamp").alias("ts"), F.col("frame.hash").alias("hash"))


def _side(f: DataFrame, key: str, hash_col: str, duration: str) -> DataFrame:
    return f.select(F.col("path").alias(key), F.col("duration").alias(duration), F.col("hash").alias(hash_col))


def image_video_similarity(media: DataFrame, least: float) -> DataFrame:
    """a (image), b (video), similarity: the best of all frames, of the pairs that reach `least`."""
    f = spool(exploded(media))
    images, videos = f.where("duration = 0 and pos = 0"), f.where("duration <> 0").select("path", "duration", "hash").distinct()
    near = hash_pairs(images, videos, int(64 * (1 - least) + 1e-9))
    s = _side(images, "a", "ha", "da").join(near, "ha").join(_side(videos, "b", "hb", "db"), "hb").groupBy("a", "b").agg(F.min("distance").alias("d"))
    return s.select("a", "b", (1 - F.col("d") / F.lit(64.0)).alias("similarity")).where(F.col("similarity") >= least)


def candidates(media: DataFrame, p: Params, kinds: tuple[str, ...] = ("II", "IV", "VV")) -> DataFrame:
    """a < b, class and the nearest frames' distance of files with a pair of frames near enough for their class.

    Lossless for videos too: a warped path of at least max(m, n) cells and a
    cost of at most (1 - t) * max(m, n) has a cell of cost 1 - t or less. Images
    are joined with images at their own, smaller distance.
    """
    f = exploded(media)
    firsts = spool(f.where("duration = 0 and pos = 0 or duration <> 0").select("path", "duration", "hash").distinct())
    images, videos = firsts.where("duration = 0"), firsts.where("duration <> 0")
    ways = [(images, images, "II"), (images, videos, "IV"), (videos, videos, "VV")]
    every = None
    for x, y, kind in (w for w in ways if w[2] in kinds):
        near = hash_pairs(x, y, p.max_bits(kind))
        met = _side(x, "x", "ha", "dx").join(near, "ha").join(_side(y, "y", "hb", "dy"), "hb")
        met = met.where("x < y" if kind != "IV" else "x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("distance").alias("distance"))
        met = met.select("a", "b", F.lit(kind).alias("pair_class"), "distance")
        every = met if every is None else every.unionByName(met)
    return every


def similarity_edges(media: DataFrame, p: Params = Params(), kinds: tuple[str, ...] = ("II", "IV", "VV")) -> DataFrame:
    """a < b, similarity, pair_class of every pair of the given classes at or above its class's threshold."""
    if p.no_exact_neighbours and p.least_threshold >= 1:
        return media.sparkSession.createDataFrame([], "a string, b string, similarity double, pair_class string")
    media = spool(media.select("path", "duration", "frames"))
    found = []
    direct = tuple(k for k in kinds if k != "VV")
    if direct:
        found.append(_direct_edges(media, p, direct))
    if "VV" in kinds:
        first = spool(_classes(media))
        copies = spool(_copies(media, first).select(F.col("a").alias("first"), F.col("b").alias("path")))
        found.append(_video_edges(first, first.select(F.col("path").alias("first"), "path").unionByName(copies), p))
    return reduce(DataFrame.unionByName, found)


def _classes(media: DataFrame) -> DataFrame:
    """path (the least), duration, frames, copies of files of equal duration and frames."""
    return media.groupBy("duration", "frames").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def _copies(media: DataFrame, first: DataFrame) -> DataFrame:
    """a, b: the first file of each class of more than one, and each other one."""
    many = first.where("copies > 1")
    return media.join(many, (media["duration"] == many["duration"]) & (media["frames"] == many["frames"])).select(many["path"].alias("a"), media["path"].alias("b")).where("a <> b")


def _direct_edges(media: DataFrame, p: Params, kinds: tuple[str, ...] = ("II", "IV")) -> DataFrame:
    """The edges of similarity_edges that have an image."""
    e = candidates(media, p, kinds).select("a", "b", (1 - F.col("distance") / F.lit(64.0)).alias("similarity"), "pair_class")
    return e.where(F.col("similarity") >= threshold(F.col("pair_class"), p))


def _video_edges(first: DataFrame, members: DataFrame | None, p: Params) -> DataFrame:
    """The edges of similarity_edges between videos, from one of each class (see _classes); without members (first, path), those of the first alone."""
    if members is None:
        first = first.withColumn("copies", F.lit(1))
    side = lambda n, k: first.select(F.col("path").alias(n), F.col("duration").alias(f"d{k}"), F.transform("frames", lambda f: f["hash"]).alias(f"h{k}"), F.transform("frames", lambda f: f["timestamp"]).alias(f"t{k}"), _least_gap(F.transform("frames", lambda f: f["timestamp"])).alias(f"gap{k}"))
    pairs = _video_candidates(first, p)
    asked = _payable(pairs.join(side("a", "a").drop("gapa"), "a").join(side("b", "b"), "b"), p)
    got = spool(warp_pairs(asked, p).where(F.col("similarity") >= p.video_similarity))
    discard(pairs)
    of = lambda n, k: first.select(F.col("path").alias(n), F.col("duration").alias(f"d{k}"))
    got = got.join(of("a", "a"), "a").join(of("b", "b"), "b").select(F.col("a").alias("s"), F.col("b").alias("l"), (F.col("da") < F.col("db")).alias("shorter"), "similarity")
    if members is not None:
        of = lambda n, x: members.select(F.col("first").alias(n), F.col("path").alias(x))
        got = got.join(of("s", "x"), "s").join(of("l", "y"), "l")
    else:
        got = got.withColumn("x", F.col("s")).withColumn("y", F.col("l"))
    # of videos of equal duration the lesser path counts as the shorter, so both orders were compared
    return got.where("shorter or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity", F.lit("VV").alias("pair_class"))


def _least_gap(t: str) -> Column:
    """The least difference of times; null for fewer than two."""
    ts = F.array_sort(t)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.array_min(F.zip_with(F.slice(ts, 2, n), F.slice(ts, 1, n), lambda later, one: later - one))


def _most_frames(width: Column, gap: Column, frames: Column) -> Column:
    """How many frames a window can hold at most, of a video of so many."""
    return F.when(gap > 0, F.least(frames.cast("double"), F.floor(width / gap + 1e-6) + 1.0)).otherwise(frames.cast("double"))


def _video_candidates(first: DataFrame, p: Params) -> DataFrame:
    """a, b: every pair of videos that can reach the threshold with a as the shorter side, and some that cannot; a = b where a class has more than one file.

    A warped path meets every frame of a, so it costs the sum of the frames'
    distances to their nearest of b at least, and (1 - t) * 64 * N bits at most,
    where N is the larger of a and of the most frames that a window can hold.
    So of any floor((1 - t) * 64 * N / (k + 1)) + 1 frames of a one has a frame
    of b within k bits: pairs are made from the rarest so many alone, and lines
    that stand in many files make few. Frames that are near no other file's are
    the rarest; they are counted and make none. What is left is held against
    the sum by _payable. A path also has a cell of its mean cost or less, so all
    frames are enough where N is large.
    """
    cost = (1 - p.video_similarity) * BITS
    k = min(p.max_bits("VV") + 1, BITS - 1) if p.max_bits("VV") < BITS else BITS
    v = first.where("duration <> 0").select("path", "duration", "copies", F.transform("frames", lambda f: f["hash"]).alias("h"), F.size("frames").alias("n"), _least_gap(F.transform("frames", lambda f: f["timestamp"])).alias("gap")).where("n > 0")
    bound = v.agg(F.min("gap").alias("gap"), F.max("n").alias("n")).first()
    most = F.greatest(F.col("n").cast("double"), _most_frames(F.col("duration"), F.lit(bound["gap"]).cast("double"), F.lit(bound["n"])))
    v = v.withColumn("rare", F.floor(cost * most / (k + 1) + 1e-6) + 1).withColumn("known", F.size(F.filter("h", lambda h: h.isNotNull())))
    frames = v.select("path", "duration", "rare", "known", F.posexplode("h").alias("pos", "hash")).where("hash is not null")
    held = v.select("path", F.explode(F.array_distinct("h")).alias("hash")).where("hash is not null").groupBy("hash").agg(F.count("*").alias("files"))
    held = spool(held)
    near = spool(hash_pairs(held, held, k, equal=False).select("ha", "hb"))
    others = near.join(held.select(F.col("hash").alias("hb"), "files"), "hb").groupBy(F.col("ha").alias("hash")).agg(F.sum("files").alias("others"))
    shared = held.join(others, "hash", "left").select("hash", (F.col("files") + F.coalesce("others", F.lit(0))).alias("weight")).where("weight > 1")
    of = W.partitionBy("path")
    ranked = frames.join(shared, "hash").withColumn("place", F.col("known") - F.count("*").over(of) + F.row_number().over(of.orderBy("weight", "pos")))
    ranked = spool(ranked.select("path", "duration", "hash", "weight", (F.col("place") <= F.col("rare")).alias("asks")))
    rare = spool(ranked.where("asks").select(F.col("path").alias("a"), F.col("duration").alias("da"), F.col("hash").alias("ha"), (F.col("weight") > COMMON).alias("common")).distinct())
    holds = ranked.select(F.col("path").alias("b"), F.col("duration").alias("db"), F.col("hash").alias("hb")).distinct()
    few = rare.where("not common").select("a", "da", "ha")
    few = few.withColumn("hb", F.col("ha")).unionByName(few.join(near, "ha")).drop("ha")
    met = few.join(holds, "hb").where("da <= db and a <> b").select("a", "b")
    met = met.unionByName(_met_by_common(rare.where("common").select("a", "ha"), near, holds.select("b", "hb"), v, cost))
    pairs = spool(met.distinct().unionByName(v.where("copies > 1").select(F.col("path").alias("a"), F.col("path").alias("b"))))
    discard(held, near, ranked, rare)
    return pairs


def _met_by_common(asks: DataFrame, near: DataFrame, holds: DataFrame, v: DataFrame, cost: float) -> DataFrame:
    """a, b as _payable leaves them, of the videos a that ask by a frame (a, ha) of many files.

    For each frame lots of askers meet blocks of holders in a task, which keeps
    the few pairs that pass; the others are never written out.
    """
    common = asks.select("ha").distinct()
    held = common.withColumn("hb", F.col("ha")).unionByName(common.join(near, "ha")).join(holds, "hb").select("ha", "b").distinct()
    sizes = asks.groupBy("ha").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("lots")).join(held.groupBy("ha").agg(F.ceil(F.count("*") / HOLDERS).cast("int").alias("blocks")), "ha")
    place = lambda c, count: F.pmod(F.xxhash64(c), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    known = F.filter("h", lambda h: h.isNotNull())
    x = asks.join(sizes, "ha").join(v.select(F.col("path").alias("a"), F.col("duration").alias("d"), "n", known.alias("h")), "a")
    x = x.select("ha", "a", "d", "n", "h", place("a", "lots").alias("lot"), every("blocks").alias("block"))
    y = held.join(sizes, "ha").join(v.select(F.col("path").alias("b"), F.col("duration").alias("d"), "n", "gap", F.array_distinct(known).alias("h")), "b")
    y = y.select(F.col("ha").alias("hb"), "b", F.col("d").alias("db"), F.col("n").alias("nb"), "gap", F.col("h").alias("held"), place("b", "blocks").alias("of_block"), every("lots").alias("of_lot"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if len(left) and len(right):
            order = np.argsort(right.column("db").to_numpy(), kind="stable")
            right = right.take(pa.array(order)).combine_chunks()
            h = right.column("held").combine_chunks()
            flat, ends = h.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy())]).astype(np.int64)
            d, n, gap = (right.column(c).to_numpy().astype(float) for c in ("db", "nb", "gap"))
            common = np.array([left.column("ha")[0].as_py()], np.int64).view(np.uint64)[0]
            for at, (ds, ns, hs) in enumerate(zip(left.column("d").to_pylist(), left.column("n").to_pylist(), left.column("h").to_pylist(), strict=True)):
                lo = int(np.searchsorted(d, ds, "left"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    most = np.where(gap[lo:] > 0, np.minimum(n[lo:], np.floor(ds / gap[lo:] + 1e-6) + 1), n[lo:])
                got = _within(np.array(hs, np.int64).view(np.uint64), common, flat, ends, lo, cost * np.maximum(ns, most) + 1e-6)
                out_a.append(np.full(len(got), at))
                out_b.append(got)
        i, j = (pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in (out_a, out_b))
        return pa.table({"a": left.column("a").take(i), "b": right.column("b").take(j)})

    kind = v.schema["path"].dataType.simpleString()
    return x.groupBy("ha", "lot", "block").cogroup(y.groupBy("hb", "of_lot", "of_block")).applyInArrow(run, f"a {kind}, b {kind}").where("a <> b")


def _within(asked: np.ndarray, common: np.uint64, flat: np.ndarray, ends: np.ndarray, lo: int, limits: np.ndarray) -> np.ndarray:
    """Places, from lo on, of the files (frames ends[i] to ends[i + 1] of flat) whose nearest frames to the asked ones differ in no more bits than their limit. The common frame comes last, as it settles least."""
    at, total = np.arange(lo, len(ends) - 1), np.zeros(len(limits), np.int64)
    for h in np.concatenate([asked[asked != common], asked[asked == common]]):
        if not len(at):
            break
        if 2 * len(at) > len(limits):
            d = np.minimum.reduceat(np.bitwise_count(flat[ends[lo] :] ^ h), ends[lo:-1] - ends[lo])[at - lo]
        else:
            count = ends[at + 1] - ends[at]
            starts = np.cumsum(count) - count
            d = np.minimum.reduceat(np.bitwise_count(flat[np.arange(count.sum()) + np.repeat(ends[at] - starts, count)] ^ h), starts)
        total = total + d
        kept = total <= limits[at - lo]
        at, total = at[kept], total[kept]
    return at


def _payable(pairs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, da, ha, ta, b, db, hb, tb, gapb) of which a path under the threshold could meet every frame of the shorter a."""
    cost = (1 - p.video_similarity) * BITS
    limit = cost * F.greatest(F.size("ha").cast("double"), _most_frames(F.col("da"), F.col("gapb"), F.size("hb"))) + 1e-6
    columns = pairs.drop("gapb").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other, limits = batch.column("ha"), batch.column("hb"), batch.column("_limit").to_numpy()
            x, y = (c.values.fill_null(0).to_numpy().view(np.uint64) for c in (one, other))
            at, to = one.offsets.to_numpy(), other.offsets.to_numpy()
            kept = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                hs, hl = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                kept[i] = np.bitwise_count(hs[:, None] ^ hl[None, :]).min(axis=1).sum(dtype=np.int64) <= limits[i]
            yield batch.filter(pa.array(kept)).select(columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(columns).schema.fields)
    return pairs.withColumn("_limit", limit).select(*columns, "_limit").mapInArrow(run, kinds)


def connecting_edges(media: DataFrame, p: Params = Params()) -> DataFrame:
    """a, b: edges that connect what similarity_edges connects. Files of equal duration and frames are linked to the first of them alone, so that no group of copies is written out as pairs."""
    if p.no_exact_neighbours and p.least_threshold >= 1:
        return similarity_edges(media, p).select("a", "b")
    first = spool(_classes(media))
    return _direct_edges(first, p).unionByName(_video_edges(first, None, p)).select("a", "b").unionByName(_copies(media, first))


def warp_pairs(pairs: DataFrame, p: Params, early_exit: bool = True) -> DataFrame:
    """a, b, similarity of pairs with hashes (ha, hb), times (ta, tb) and durations (da, db)."""
    stop = p.video_similarity if early_exit else 2.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = video_similarities([(r.ha, r.ta, r.da, r.hb, r.tb, r.db) for r in pdf.itertuples()], p.step_size, stop, p.low_byte_distance)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": np.array(s, float)})

    key = pairs.schema["a"].dataType.simpleString()
    return pairs.repartition("a", "b").mapInPandas(run, f"a {key}, b {key}, similarity double")
