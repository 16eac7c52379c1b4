"""Approximate nearest neighbours by adaptive dimension scan within inverted lists.

Vectors are turned by a random rotation and stored in column blocks. A query
probes the lists whose centres are nearest. In a list, squared distances are
summed block by block; after each block a hypothesis test abandons the
candidates whose partial distance already says, at the test's confidence, that
they are farther than the query's bound (after t of d rotated dimensions:
partial * d / t > ((1 + EPSILON / sqrt(t)) * bound)**2). Survivors are measured
exactly, on the original vectors in double precision. The bound of a query is
its k-th distance in its nearest list, which is searched first.

The rotation and the centres are fitted on a sample of at most `sample` vectors
(the least hashes of ids), every vector is indexed. The number of lists probed is the least
that reached `recall` on queries of the sample. Lists are scanned in tiles of
bounded numbers of candidates and queries, so a hot list is many tasks. Vectors
are sent as they are (of floats, in single precision, which is exact) and turned
where they arrive. Equal vectors are indexed once, with
their k + 1 least ids, which is all that k neighbours can need of them.

Cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do null ids. Vectors of another length than most
have neighbours of their own length only. Ties go to the smaller id. Fully
repeated rows count once; rows of one id are no candidates of its own queries.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.session import spool

K, SAMPLE, RECALL, SEED = 10, 20_000, 0.96, 7
EPSILON, COLUMN_BLOCK = 2.1, 16
#: Candidates and queries of a tile, about.
SCAN_ROWS, QUERY_ROWS = 16_384, 65_536


def valid(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


class Model:
    """Rotation, centres and number of probes for vectors of one length."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, recall: float):
        rng = np.random.default_rng(SEED)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        lists = max(1, min(math.isqrt(rows), len(sample) // 16))
        centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
        for _ in range(8):
            near = self._nearest(sample, centres)
            order = np.argsort(near, kind="stable")
            bounds = np.searchsorted(near[order], np.arange(lists + 1))
            for i in range(lists):
                if bounds[i + 1] > bounds[i]:
                    centres[i] = sample[order[bounds[i] : bounds[i + 1]]].mean(0)
        self.centres = centres
        self.probes = self._calibrate(sample, k, recall, rng)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        c2 = (centres**2).sum(1)
        return np.concatenate([(c2 - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, len(x) // 4096 + 1)])

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centres)

    def order(self, x: np.ndarray) -> np.ndarray:
        """All lists of each row, nearest first."""
        return np.argsort((self.centres**2).sum(1) - 2 * x @ self.centres.T, axis=1, kind="stable")

    def _calibrate(self, sample: np.ndarray, k: int, recall: float, rng) -> int:
        q = rng.choice(len(sample), min(300, len(sample)), replace=False)
        near, order = self.lists_of(sample), self.order(sample[q])
        d = (sample**2).sum(1) - 2 * sample[q] @ sample.T
        d[np.arange(len(q)), q] = np.inf
        top = np.argsort(d, axis=1)[:, : min(k, max(1, len(sample) - 1))]
        rank = np.argsort(order, axis=1)  # of each list
        needed = np.sort(np.take_along_axis(rank, near[top], 1).ravel()) + 1
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) if len(needed) else 1


def scan(q_rot, q_raw, c_rot, c_raw, tie, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the k nearest of a block's candidates to one query, within the bound."""
    d = len(q_rot)
    alive = np.arange(len(tie))
    partial = np.zeros(len(alive))
    if math.isinf(bound) and len(alive) > 4 * k:  # a first bound from a few candidates
        first = np.sqrt(((c_raw[: 2 * k] - q_raw) ** 2).sum(1))
        bound = float(np.partition(first, k - 1)[k - 1])
    for lo in range(0, d, COLUMN_BLOCK):
        hi = min(d, lo + COLUMN_BLOCK)
        partial = partial + ((c_rot[alive, lo:hi] - q_rot[lo:hi]) ** 2).sum(1)
        if hi < d and not math.isinf(bound):
            keep = partial * (d / hi) <= ((1 + EPSILON / math.sqrt(hi)) * bound) ** 2
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
    if not len(alive):
        return alive, np.zeros(0)
    dist = np.sqrt(((c_raw[alive] - q_raw) ** 2).sum(1))
    best = np.lexsort((tie[alive], dist))[:k]
    return alive[best], dist[best]


def _pack(x: np.ndarray, kind: str) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(x, kind)]


def _stack(col: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind).reshape(len(col), -1).astype(np.float64)


def _scan_groups(index: DataFrame, probes: DataFrame, k: int, model, kind: str) -> DataFrame:
    """rep, cand, tie, score: the k nearest of each probed tile. Both sides carry dim, list, part, lot."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "cand": [], "tie": [], "score": []}, dtype="float64").astype({"rep": "int64", "cand": "int64", "tie": "int64"})
        rotation = model.value[int(left["dim"].iloc[0])].rotation
        c_raw, q_raw = _stack(left["raw"], kind), _stack(right["raw"], kind)
        c_rot, q_rot = c_raw @ rotation, q_raw @ rotation
        c_id, tie = left["rep"].to_numpy(np.int64), left["tie"].to_numpy(np.int64)
        reps, cands, ties, scores = [], [], [], []
        for i, (rep, bound) in enumerate(zip(right["rep"], right["bound"], strict=True)):
            at, dist = scan(q_rot[i], q_raw[i], c_rot, c_raw, tie, float("inf") if bound is None or bound != bound else float(bound), k)
            reps.append(np.full(len(at), rep, np.int64))
            cands.append(c_id[at])
            ties.append(tie[at])
            scores.append(dist)
        return pd.DataFrame({"rep": np.concatenate(reps), "cand": np.concatenate(cands), "tie": np.concatenate(ties), "score": np.concatenate(scores)})

    by = ["dim", "list", "part", "lot"]
    return index.groupBy(*by).cogroup(probes.groupBy(*by)).applyInPandas(run, "rep long, cand long, tie long, score double")


def _least(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts to n before the shuffle too."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n)


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found. queries: a condition on id_col of `vectors`."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & valid(F.col("vec")))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + 0.0))  # one zero
    first = rows.withColumn("_r", F.dense_rank().over(W.partitionBy("vec").orderBy("id"))).where(F.col("_r") <= k + 1)
    distinct = spool(first.groupBy("vec").agg(F.min("id").alias("tie"), F.sort_array(F.collect_set("id")).alias("ids")).withColumn("rep", F.monotonically_increasing_id()))
    asking = spool(rows.where("asks").select("id", "vec").join(distinct.select("vec", "rep"), "vec").select("id", "rep").distinct())
    dims = {r["d"]: r["n"] for r in distinct.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()}
    models = {}
    for d, n in dims.items():
        h, some = F.xxhash64("tie"), distinct.where(F.size("vec") == d)
        if n > 4 * sample:  # so that tasks do not send so many each
            some = some.where(h < int(-(2**63) + 2**64 * 2 * sample / n))
        fit = some.orderBy(h, "tie", "vec").limit(sample).select("vec").toPandas()
        models[d] = Model(np.stack(fit["vec"].to_numpy()).astype(np.float64), n, k, recall)
    model = spark.sparkContext.broadcast(models)

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby("dim"):
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                m = model.value[d]
                yield pd.DataFrame({"dim": part["dim"], "list": m.lists_of(x), "rep": part["rep"], "tie": part["tie"], "raw": _pack(x, kind)})

    index = spool(distinct.select("rep", "tie", "vec", F.size("vec").alias("dim")).mapInPandas(index_rows, "dim int, list long, rep long, tie long, raw binary"))
    # one number per list, at most sample / 16 of each length
    sizes = {(r["dim"], r["list"]): r["n"] for r in index.groupBy("dim", "list").agg(F.count("*").alias("n")).collect()}
    parts = {key: -(-n // SCAN_ROWS) for key, n in sizes.items()}
    shape = spark.sparkContext.broadcast((sizes, parts))

    def probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, parts = shape.value
        for pdf in batches:
            for d, part in pdf.groupby("dim"):
                m = model.value[d]
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                out = []
                for rep, order, raw in zip(part["rep"], m.order(x), _pack(x, kind), strict=True):
                    seen = used = 0
                    for one in order:
                        one = int(one)
                        n = sizes.get((d, one), 0)
                        if used >= m.probes and seen > k:
                            break
                        used += 1
                        if n:
                            out += [(d, one, p, rep, raw, seen == 0) for p in range(parts[d, one])]
                            seen += n
                yield pd.DataFrame(out, columns=["dim", "list", "part", "rep", "raw", "home"])

    blocks = spark.createDataFrame([(d, i, p) for (d, i), p in parts.items()], "dim int, list long, parts long")
    asked = spool(asking.select("rep").distinct())
    lots = max(1, -(-asked.count() // QUERY_ROWS))
    index = index.join(F.broadcast(blocks), ["dim", "list"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("parts")
    index = index.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = distinct.join(asked, "rep", "left_semi").select("rep", "vec", F.size("vec").alias("dim"))
    probes = asked.mapInPandas(probe_rows, "dim int, list long, part long, rep long, raw binary, home boolean")
    probes = spool(probes.withColumn("lot", F.pmod(F.xxhash64("rep"), F.lit(lots)).cast("int")))
    none = F.lit(None).cast("double").alias("bound")
    home = spool(_least(_scan_groups(index, probes.where("home").drop("home").withColumn("bound", none), k + 1, model, kind), "rep", ["score", "tie"], k + 1).drop("_r"))
    bounds = home.groupBy("rep").agg(F.when(F.count("*") > k, F.max("score")).alias("bound"))
    rest = _scan_groups(index, probes.where("not home").drop("home").join(bounds, "rep", "left"), k + 1, model, kind)
    found = _least(home.unionByName(rest), "rep", ["score", "tie"], 2 * (k + 1)).drop("_r")
    expanded = found.join(distinct.select(F.col("rep").alias("cand"), "ids"), "cand").select("rep", "score", F.explode("ids").alias("vec_id"))
    per_rep = _least(expanded, "rep", ["score", "vec_id"], 2 * (k + 1)).drop("_r")
    hits = asking.select(F.col("id").alias("query_id"), "rep").join(per_rep, "rep").where("vec_id <> query_id")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "rep").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
