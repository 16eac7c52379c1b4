"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong
to. Token capacity flows from patterns to the quotas of their sources; the
n-th repetition of a pattern costs n - 1 a token, which is convex, so a
document is repeated only where quotas need it. The flow is solved on the
driver over patterns and sources, never over documents. Of each pattern the
routed tokens are then taken: whole passes over all its documents, and of one
more pass the documents that come first by a seeded digest, the last of them
in part.

The order inside a pattern is found without sorting it: 65,536 digest buckets
are summed, and only the bucket in which the quota ends is sorted.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; they share
`share` of all sizes; a target stops at `repeats` times its source's size and
the excess is shared again by weight.

Cases: null text: size 0, takes nothing. Null source: a source of its own.
Equal digests: ordered by doc_id, then size. Fully repeated rows count each. An
empty table or one of sizes 0 gives targets of 0. Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import word_count
from shutterlake.session import spool

WEIGHTS = (5, 2, 1)
SHARE, REPEATS, SEED = 1.5, 2, "mix-1"


def weighted_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> dict[str | None, float]:
    """Targets of sources, by filling to a common level per weight."""
    named = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    w = {name: weights[i % len(weights)] for i, (name, _) in enumerate(named)}
    size = dict(named)
    rest, total_w = share * sum(size.values()), sum(w.values())
    out = {}
    # the sources whose limit is lowest for their weight reach it first
    for name in sorted(size, key=lambda s: (repeats * size[s] / w[s], s is None, s or "")):
        if w[name] * (rest / total_w) > repeats * size[name]:
            out[name] = float(repeats * size[name])
            rest -= repeats * size[name]
            total_w -= w[name]
        else:
            break
    level = rest / total_w if total_w else 0.0
    return {name: out.get(name, w[name] * level) for name in size}


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, dict]:
    """Tokens routed from each pattern (a tuple of sources) to each source.

    Successive shortest paths with potentials: a pattern gives up to its
    capacity at cost 0, as much again at cost 1, and so on. Independent groups
    of sources settle by themselves. Quotas that no capacity can meet stay short.
    """
    pat, src = sorted(patterns, key=str), sorted(quotas, key=lambda s: (s is None, str(s)))
    node = {("p", p): i + 2 for i, p in enumerate(pat)} | {("s", s): i + 2 + len(pat) for i, s in enumerate(src)}
    graph: list[list[list]] = [[] for _ in range(len(node) + 2)]

    def arc(a: int, b: int, cap: int, cost: int) -> list:
        there, back = [b, cap, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        graph[a].append(there)
        graph[b].append(back)
        return there

    flow = {}
    for p in pat:
        for r in range(repeats):
            arc(0, node["p", p], patterns[p], r)
        for s in p:
            if s in quotas:
                flow[p, s] = arc(node["p", p], node["s", s], patterns[p] * repeats, 0)
    for s in src:
        arc(node["s", s], 1, quotas[s], 0)
    potential = [0] * len(graph)
    while True:
        dist, via, queue = [float("inf")] * len(graph), [None] * len(graph), [(0, 0)]
        dist[0] = 0
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if e[1] > 0 and (nd := d + e[2] + potential[u] - potential[e[0]]) < dist[e[0]]:
                    dist[e[0]], via[e[0]] = nd, e
                    heapq.heappush(queue, (nd, e[0]))
        if via[1] is None:
            break
        far = max(d for d in dist if d < float("inf"))
        potential = [x + min(d, far) for x, d in zip(potential, dist, strict=True)]
        path, u = [], 1
        while u != 0:
            path.append(via[u])
            u = via[u][3][0]
        push = min(e[1] for e in path)
        for e in path:
            e[1] -= push
            e[3][1] += push
    out: dict[tuple, dict] = {p: {} for p in pat}
    for (p, s), e in flow.items():
        if e[3][1]:
            out[p][s] = e[3][1]
    return out


def sized(docs: DataFrame, members: Column, seed: str) -> DataFrame:
    """doc_id, members, size, digest: what the mix needs of a document, without its text."""
    text = F.col("text").cast("string")
    return docs.select(
        "doc_id",
        members.alias("members"),
        word_count(text).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("digest"),
    )


def take(rows: DataFrame, amounts: list[tuple[tuple, int, int]]) -> DataFrame:
    """rows with `taken`; amounts: (members, words of one pass, words to take) of each pattern."""
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("members", rows.schema["members"].dataType), T.StructField("passes", T.LongType()), T.StructField("rest", T.LongType())])
    plan = spark.createDataFrame([(list(m), (n // cap) if cap else 0, (n % cap) if cap else 0) for m, cap, n in amounts], schema)
    plan = F.broadcast(plan)  # one row per pattern, collected before
    bucketed = rows.withColumn("bucket", F.substring("digest", 1, 4))
    per_bucket = bucketed.groupBy("members", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("members").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = per_bucket.withColumn("before", before).join(plan, "members").where("before <= rest and rest < before + n").select("members", "passes", "rest", F.col("bucket").alias("edge"), "before")
    edges = F.broadcast(edges)  # at most one row per pattern
    with_edge = bucketed.join(edges, "members", "left")
    inside = F.col("bucket") == F.col("edge")
    # the digests' order counts in the edge bucket alone; other rows are not gathered
    dealt = F.when(inside, F.col("edge")).otherwise(F.col("digest"))
    upto = F.coalesce(F.sum("size").over(W.partitionBy("members", dealt).orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = F.when(F.col("bucket") < F.col("edge"), F.col("size")).when(inside, F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - upto))).otherwise(F.lit(0))
    return with_edge.withColumn("taken", (F.coalesce("passes", F.lit(0)) * F.col("size") + F.coalesce(part, F.lit(0))).cast("long")).drop("bucket", "edge", "before", "rest", "passes")


def mix(docs: DataFrame, members: Column | None = None, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, targets: dict | None = None) -> DataFrame:
    """doc_id, members, size, taken, and of the first source source_size and target.

    members: an array column of sources; by default the one in `source`.
    """
    members = F.array(F.col("source").cast("string")) if members is None else F.array_sort(F.array_distinct(members))
    rows = spool(sized(docs, members, seed))
    pats = {tuple(r["members"]): int(r["n"] or 0) for r in rows.groupBy("members").agg(F.sum("size").alias("n")).collect()}
    by_source: dict = {}
    for p, n in pats.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    if targets is None:
        targets = weighted_targets(list(by_source.items()), weights, share, repeats)
    flow = min_cost_flow(pats, {s: int(targets.get(s, 0)) for s in by_source}, repeats)
    taken = take(rows, [(p, pats[p], sum(flow[p].values())) for p in pats])
    spark = docs.sparkSession
    of = spark.createDataFrame([(s, by_source[s], float(targets.get(s, 0.0))) for s in by_source], "first string, source_size long, target double")
    joined = taken.withColumn("first", F.element_at("members", 1)) if pats else taken.withColumn("first", F.lit(None).cast("string"))
    return joined.join(F.broadcast(of), joined["first"].eqNullSafe(of["first"]), "left").select("doc_id", "members", "size", "source_size", "target", "taken", "digest")


def mixture(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
