"""Range and nearest-neighbour joins over 64-bit hashes.

Cut in m blocks of bits, hashes within k bits agree on m - k blocks or more. So
a join on every choice of m - k blocks, with the distance as a residual, loses
nothing. More blocks make longer keys, which fewer hashes share by chance,
but more of them; their number follows the number of hashes. Equal hashes are
joined once, and rows join back by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.session import discard, spool

BITS = 64
#: Keys of a hash at most.
MAX_KEYS = 128
#: Points of a block that open queries of knn_join are compared with.
POINT_ROWS = 100_000
#: Open queries that are compared with a block of points at once.
QUERY_ROWS = 20_000
#: Distances that a task computes at once.
CELLS = 1 << 22
#: Distances that cost as much as one row of a join by keys.
WORTH = 200
#: Hashes that a task packs at once.
PACKED_ROWS = 1 << 19
#: Hashes of a lot, of all tables: a task of a join holds one.
LOT_ROWS = 1 << 18
#: Pairs that a task compares at once.
PAIRS = 1 << 20
#: Pairs met by chance that cost as much as one key of a hash.
CHEAP = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def blocks_for(n: int, k: int) -> int:
    """How many blocks make the join of n hashes within k bits cheapest: keys made, and candidates met by chance."""
    able = [m for m in range(k + 1, min(BITS, k + 12) + 1) if comb(m, k) <= MAX_KEYS] or [k + 1]
    return min(able, key=lambda m: comb(m, k) * (1 + n / CHEAP / 2.0 ** (BITS * (m - k) / m)))


def masks(k: int, blocks: int, bits: int = (1 << BITS) - 1) -> list[int]:
    """Each choice of blocks - k blocks of the given bits; bits that are alike in all hashes make no key rarer."""
    places = [i for i in range(BITS) if bits >> i & 1]
    cuts = [len(places) * i // blocks for i in range(blocks + 1)]
    cell = [sum(1 << at for at in places[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(c) for c in combinations(cell, blocks - k)]


def _hashes(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.select(F.col(col).alias(name)).where(F.col(name).isNotNull()).distinct()


def _packed(hashes: DataFrame, col: str, side: int, choices: np.ndarray, lots: int) -> DataFrame:
    """cell, side, hashes: of every choice of blocks and every lot of its values the hashes of a task, as bytes, so that a hash takes 8 bytes a choice when it moves."""

    def rows(h: np.ndarray) -> pa.RecordBatch:
        cells, held = [], []
        for i, mask in enumerate(choices):
            lot = ((h & mask) * _MIX >> np.uint64(33)) % np.uint64(lots)
            order = np.argsort(lot, kind="stable")
            found, at = np.unique(lot[order], return_index=True)
            cells += [i * lots + int(x) for x in found]
            held += [x.tobytes() for x in np.split(h[order], at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([side] * len(cells), pa.int32()), pa.array(held, pa.binary())], ["cell", "side", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            count += len(held[-1])
            if count >= PACKED_ROWS:
                yield rows(np.concatenate(held))
                held, count = [], 0
        if count:
            yield rows(np.concatenate(held))

    return hashes.select(col).mapInArrow(run, "cell int, side int, hashes binary")


def _met(x: np.ndarray, y: np.ndarray, mask: np.uint64, k: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of x and y that agree on the mask and differ in k bits at most; of one table (same), each pair once and none with itself."""
    x = x[np.argsort(x & mask, kind="stable")]
    y = x if same else y[np.argsort(y & mask, kind="stable")]
    vx, vy = x & mask, y & mask
    lo = np.arange(1, len(x) + 1) if same else np.searchsorted(vy, vx, "left")
    count = np.searchsorted(vy, vx, "right") - lo
    ends, at = np.cumsum(count), 0
    while at < len(x):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        some = count[at:to]
        i = np.repeat(np.arange(at, to), some)
        j = np.arange(len(i)) + np.repeat(lo[at:to] - (ends[at:to] - some - done), some)
        near = np.flatnonzero(np.bitwise_count(x[i] ^ y[j]) <= k)
        if len(near):
            yield x[i[near]], y[j[near]]
        at = to


def hash_pairs(left: DataFrame, right: DataFrame, k: int, a: str = "hash", b: str = "hash", equal: bool = True) -> DataFrame:
    """Distinct (ha, hb, distance) of two tables' distinct hashes within k bits; of one table, without those of a hash with itself if not `equal`.

    Hashes move packed, by choice of blocks and a lot of its values, and meet in
    a task by sorting. A pair is kept by the first choice on which it agrees.
    """
    if k >= BITS:
        raise ValueError("k must be below 64")
    same = left is right and a == b
    x = spool(_hashes(left, a, "ha"))
    y = x.select(F.col("ha").alias("hb")) if same else spool(_hashes(right, b, "hb"))
    if k <= 0:
        found = x.join(y, F.col("ha") == F.col("hb")).select("ha", "hb", F.lit(0).alias("distance"))
        return found if equal or not same else found.where("ha <> hb")
    seen = [t.agg(F.count("*"), F.bit_or(c), F.bit_and(c)).first() for t, c in ([(x, "ha")] if same else [(x, "ha"), (y, "hb")])]
    if not all(s[0] for s in seen):
        return x.join(y, F.col("ha") == F.col("hb")).select("ha", "hb", F.lit(0).alias("distance"))
    n = max(s[0] for s in seen)
    some, every = 0, -1
    for s in seen:
        some, every = some | s[1], every & s[2]
    choices = np.array(masks(k, blocks_for(n, k), (some ^ every) & ((1 << BITS) - 1)), np.uint64)
    lots = -(-sum(s[0] for s in seen) // LOT_ROWS)
    packed = _packed(x, "ha", 0, choices, lots)
    if not same:
        packed = packed.unionByName(_packed(y, "hb", 1, choices, lots))

    def run(table: pa.Table) -> pa.Table:
        at = table.column("cell")[0].as_py() // lots
        sides = [[], []]
        for side, held in zip(table.column("side").to_pylist(), table.column("hashes").to_pylist(), strict=True):
            sides[side].append(np.frombuffer(held, np.uint64))
        one, other = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in sides)
        ha, hb = ([one], [one]) if same and equal and at == 0 else ([], [])
        for p, q in _met(one, other, choices[at], k, same):
            first = np.ones(len(p), bool)
            for mask in choices[:at]:
                first &= (p ^ q) & mask != 0
            p, q = p[first], q[first]
            ha += [p, q] if same else [p]
            hb += [q, p] if same else [q]
        ha, hb = (np.concatenate(h) if h else np.zeros(0, np.uint64) for h in (ha, hb))
        d = np.bitwise_count(ha ^ hb).astype(np.int32)
        return pa.table({"ha": ha.view(np.int64), "hb": hb.view(np.int64), "distance": d})

    return packed.groupBy("cell").applyInArrow(run, "ha long, hb long, distance int")


def self_pairs(df: DataFrame, k: int, col: str = "hash") -> DataFrame:
    """Distinct pairs ha < hb within k bits."""
    return hash_pairs(df, df, k, col, col).where("ha < hb")


def range_join(queries: DataFrame, points: DataFrame, k: int, q: str = "query", p: str = "point") -> DataFrame:
    """query, point, distance of every point within k bits, the bound included. Both have an id and a `hash`."""
    pairs = hash_pairs(queries, points, k)
    hits = queries.select(q, F.col("hash").alias("ha")).join(pairs, "ha").join(points.select(p, F.col("hash").alias("hb")), "hb")
    return hits.select(q, p, "distance")


def _nearest(query: np.ndarray, hq: np.ndarray, point: np.ndarray, hp: np.ndarray, n: int, excluding_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of points and distances: the n nearest of the points, which stand in ascending order, for each query; equal distances by place."""
    x, y, places = np.asarray(hq, np.int64).view(np.uint64), np.asarray(hp, np.int64).view(np.uint64), np.arange(len(hp))
    out = []
    rows = max(1, CELLS // max(1, len(y)))
    for at in range(0, len(x), rows):
        key = np.bitwise_count(x[at : at + rows, None] ^ y[None, :]).astype(np.int64) << 40
        key |= places
        if excluding_self:
            own = zip(np.searchsorted(point, query[at : at + rows], "left"), np.searchsorted(point, query[at : at + rows], "right"), strict=True)
            for i, (lo, hi) in enumerate(own):
                key[i, lo:hi] = -1
        key = key.view(np.uint64)  # own rows are last
        least = np.partition(key, n - 1, axis=1)[:, :n] if n < len(y) else key
        i, j = np.nonzero(least >> np.uint64(40) <= BITS)
        kept = least[i, j]
        out.append((i + at, (kept & np.uint64((1 << 40) - 1)).astype(np.int64), (kept >> np.uint64(40)).astype(np.int32)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _against_all(queries: DataFrame, points: DataFrame, asked: int, total: int, n: int, q: str, p: str, excluding_self: bool) -> DataFrame:
    """The n nearest of all points: blocks of queries meet blocks of points, each pair of blocks keeps n a query; no pair of rows is written out."""
    lots, blocks = max(1, -(-asked // QUERY_ROWS)), max(1, -(-total // POINT_ROWS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    if excluding_self:
        queries, points = queries.where(F.col(q).isNotNull()), points.where(F.col(p).isNotNull())
    x = queries.select(q, "hash", place(q, lots).alias("lot")).withColumn("block", every(blocks)).repartition(lots * blocks, "lot", "block")
    y = points.select(p, "hash", place(p, blocks).alias("block")).withColumn("lot", every(lots)).repartition(lots * blocks, "lot", "block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({q: left[q][:0], p: right[p][:0], "distance": np.zeros(0, np.int32)})
        right = right.sort_values(p)
        i, j, d = _nearest(left[q].to_numpy(), left["hash"].to_numpy(), right[p].to_numpy(), right["hash"].to_numpy(), n, excluding_self)
        return pd.DataFrame({q: left[q].to_numpy()[i], p: right[p].to_numpy()[j], "distance": d})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    some = x.groupBy("lot", "block").cogroup(y.groupBy("lot", "block")).applyInPandas(run, f"`{q}` {kind(queries, q)}, `{p}` {kind(points, p)}, distance int")
    return some.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy("distance", p))).where(F.col("rank") <= n).select(q, p, "distance", "rank")


def knn_join(queries: DataFrame, points: DataFrame, n: int, q: str = "query", p: str = "point", first_bits: int = 3, last_bits: int = 7, excluding_self: bool = True) -> DataFrame:
    """query, point, distance, rank of the n nearest points; equal distances by point.

    The radius grows until every query has n points within it: a round asks only
    the queries that lack some, so most are settled by long keys. Beyond
    last_bits, or where the keys of a round cost more than all distances, the
    queries still open are compared with all points, in blocks.
    """
    points = spool(points.select(p, "hash").where("hash is not null"))
    done, open_queries, k = None, spool(queries.select(q, "hash").where("hash is not null")), first_bits
    total = points.count()
    need = min(n, max(0, total - (1 if excluding_self else 0)))
    while k <= last_bits:
        near = range_join(open_queries, points, k, q, p)
        if excluding_self:
            near = near.where(F.col(q) != F.col(p))
        ranked = spool(near.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy("distance", p))).where(F.col("rank") <= n).select(q, p, "distance", "rank"))
        full = ranked.where(F.col("rank") == need).select(q)
        settled = ranked.join(full, q, "left_semi")
        done = settled if done is None else done.unionByName(settled)
        before, open_queries = open_queries, spool(open_queries.join(full, q, "left_anti"))
        discard(before)
        if open_queries.isEmpty():
            return done
        k, asked = 2 * k + 1, open_queries.count()
        if asked * total <= WORTH * comb(blocks_for(total, k), k) * (asked + total):
            break
    rest = _against_all(open_queries, points, open_queries.count(), total, n, q, p, excluding_self)
    return rest if done is None else done.unionByName(rest)
