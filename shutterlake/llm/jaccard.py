"""Similarity join of documents on word n-grams: every link of Jaccard similarity at or above a threshold.

A T-occurrence search: two sets at the threshold share T shingles or more.
DivideSkip sets the longest of a document's inverted lists aside, at most
T - 1 of them, merges the others, and probes the long ones only for ids that can
still reach T. Here this is done twice.

Over the corpus, the lists set aside are the T - 1 longest, so the short ones are
those of a set's |set| - T + 1 rarest shingles, by a count sketch over all
documents; whoever occurs in one of them stays. Lists that hold one set alone go
first. Pairs that meet then pass two lossless bounds, on their sizes and on a
parity sketch (each differing shingle flips one bit, so the bits that differ are
never more than the shingles that do).

Candidates are then searched on an inverted index of their whole sets, a chunk at
a time: short lists are merged by a heap, long ones probed by binary search, and
the exact counts decide the links. No overlap is computed beside it.

`similarity_join` returns all links between unlike sets, with membership and each
row's number of links. `similarity_components` returns connectivity only, so that
no group's pairs are written out. Equal sets are one node. For it, each list
first links its documents to two of them alone; after the components of these
links are known, a second search looks only at pairs that lie in different
components, which loses no link that joins anything. A list is compared in tiles
of bounded size, inside arrays.

Cases: null text or no words: an empty set, linked with nothing. Fewer words
than the width: the whole sequence is one shingle. Rows are separate documents
even if their doc_id repeats; component_id is the least doc_id reached (null if
all are null). Texts are taken whole. Extra columns are ignored, and an empty
table gives an empty one. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import WORD, slices, tidied
from shutterlake.operators.components import connected_components
from shutterlake.operators.prefilter import may_match
from shutterlake.session import discard, spool

WIDTH, PERCENT = 5, 80
#: log2 of the number of counters of the sketch that orders shingles; counters that documents share only blur the order.
SKETCH_BITS = 22
#: Candidates that are searched together, and bytes of their texts; whichever is reached first.
CHUNK, CHUNK_BYTES = 256, 1 << 24
#: Share of list length and probe cost in DivideSkip's choice of the long lists.
MU = 0.0085
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Bytes that are hashed together; a bound on memory only.
HASH_BYTES = 1 << 19
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 64 * 256, np.uint64)
_BLANK, _LOWER = np.zeros(256, bool), np.arange(256)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER[65:91] += 32


def _word_hashes(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a run of bytes, and where they start: sums of random numbers by byte and place."""
    a = np.frombuffer(b, np.uint8)
    blank = _BLANK[a]
    edges = np.diff(np.concatenate(([True], blank, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _TABLE[((place & 63) << 8) + _LOWER[a[~blank]]]
    if int(lengths.max()) > 64:
        values *= ((place >> 6) * 2 + 1).astype(np.uint64)
    h = np.add.reduceat(values, first) + lengths.astype(np.uint64) * _P2
    h ^= h >> np.uint64(31)
    return h * _P1, starts


def _long_word_hashes(b: bytes) -> np.ndarray:
    """The same for any length, cut at white space."""
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + HASH_BYTES)
        while end < len(b) and b[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(_word_hashes(b[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; of all words, if they are fewer."""
    n = len(h)
    parts = [h[i : n - width + 1 + i] for i in range(width)] if n >= width else [h[i : i + 1] for i in range(n)]
    mixed = np.full(len(parts[0]), n if n < width else 0, np.uint64)
    for p in parts:
        mixed = (mixed ^ p) * _P1
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * _P2 + p
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words are runs of what is no ASCII white space, A-Z lower-cased."""
    out: list[np.ndarray] = []
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(encoded):
        end, size = at, 0
        while end < len(encoded) and (size + len(encoded[end]) <= HASH_BYTES or end == at):
            size += len(encoded[end]) + 1
            end += 1
        if size > HASH_BYTES + 1:
            h = _long_word_hashes(encoded[at])
            out.append(_distinct(_mixed(h, width)) if len(h) else h)
        else:
            lot = encoded[at:end]
            h, starts = _word_hashes(b"\n".join(lot))
            cuts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in lot)]))
            every = _mixed(h, width) if len(h) >= width else None
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a >= width:
                    out.append(_distinct(every[a : b - width + 1]))
                else:
                    out.append(_mixed(h[a:b], width) if b > a else np.zeros(0, np.uint64))
        at = end
    return out


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    return shingle_sets([text], width)[0]


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def least_overlap(n: int, percent: int) -> int:
    """Shared shingles that any partner of a set of n needs."""
    return -(-percent * n // 100)


def pair_overlap(n: int, m: int, percent: int) -> int:
    """Least i with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def parity_bits(n: int) -> int:
    """Bits of the parity sketch of a set of n: a power of two, n or more."""
    return max(256, 1 << max(0, n - 1).bit_length())


def parity(s: np.ndarray) -> bytes:
    """Bit i: whether the number of hashes that are i modulo the bits is odd. Halves fold by XOR to the sketch of half the bits."""
    bits = parity_bits(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_differing(n, m, percent: int):
    """Shingles in which sets of n and m may differ at most."""
    return n + m - 2 * (-(-percent * (n + m) // (100 + percent)))


def near_by_parity(a: list, b: list, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches a[i], b[i] of sets of n[i], m[i] can reach the threshold."""
    bound = most_differing(n, m, percent)
    ok = np.zeros(len(n), bool)
    size_a, size_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    least = np.minimum(size_a, size_b)
    for size in np.unique(least):
        at = np.flatnonzero(least == size)
        half = [np.zeros((len(at), size // 8), np.uint64), np.zeros((len(at), size // 8), np.uint64)]
        for out, side, sizes in ((half[0], a, size_a), (half[1], b, size_b)):
            for k in np.unique(sizes[at]):
                mine = np.flatnonzero(sizes[at] == k)
                x = np.frombuffer(b"".join([side[i] for i in at[mine]]), np.uint64).reshape(len(mine), -1)
                while x.shape[1] > size // 8:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                out[mine] = x
        ok[at] = np.bitwise_count(half[0] ^ half[1]).sum(1) <= bound[at]
    return ok


def divide_skip(lists: list[list[int]], need: int, work: dict | None = None) -> dict[int, int]:
    """Ids that occur in `need` of the sorted lists or more, with their exact counts. work: gets the entries merged and the probes made."""
    if need < 1 or len(lists) < need:
        return {}
    lists = sorted(lists, key=len)
    skipped = min(need - 1, int(need / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - skipped], lists[len(lists) - skipped :]
    out, merged, probes = {}, 0, 0
    for one, run in groupby(heapq.merge(*short)):
        n = sum(1 for _ in run)
        merged += n
        if n < need - skipped:
            continue
        left = len(long)
        for x in long:
            if n + left < need:
                break
            i = bisect_left(x, one)
            n += i < len(x) and x[i] == one
            left -= 1
            probes += 1
        if n >= need:
            out[one] = n
    if work is not None:
        work["merged"], work["probes"] = work.get("merged", 0) + merged, work.get("probes", 0) + probes
    return out


class Index:
    """Inverted lists of some sets: of each shingle the sorted places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")  # places stay sorted within a list
        every = every[order]
        self.who = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        self.shingles = every[self.starts]
        self.ends = np.append(self.starts[1:], len(every))

    def lists(self, query: np.ndarray) -> list[list[int]]:
        """The lists of the query's shingles that have one."""
        at = np.searchsorted(self.shingles, query)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == query] if len(self.shingles) else at[:0]
        return [self.who[i:j].tolist() for i, j in zip(self.starts[at], self.ends[at], strict=True)]

    def search(self, query: np.ndarray, percent: int, work: dict | None = None) -> list[int]:
        """Places of the sets that reach the threshold with the query."""
        some = [m for m in self.sizes if m]
        if not len(query) or not some:
            return []
        found = divide_skip(self.lists(query), pair_overlap(len(query), min(some), percent), work)
        return [i for i, n in found.items() if n >= pair_overlap(len(query), self.sizes[i], percent)]


def _text(docs: DataFrame):
    return docs["text"].cast("string")


def _ranks(docs: DataFrame, width: int) -> bytes:
    """One byte per counter of a count sketch of all documents' shingles: the logarithm of its sum over all tasks. The size is fixed by SKETCH_BITS."""
    segment = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low, seen = np.zeros(1 << SKETCH_BITS, np.int64), np.uint64((1 << SKETCH_BITS) - 1), []

        def tally() -> None:
            nonlocal counts, seen
            if seen:
                counts += np.bincount(np.concatenate(seen), minlength=len(counts))
            seen = []

        for batch in slices(batches, 0):
            seen.extend((s & low).astype(np.int32) for s in shingle_sets(batch.column(0).to_pylist(), width))
            if sum(map(len, seen)) > len(counts) // 4:
                tally()
        tally()
        for i in range(0, len(counts), segment):
            part = counts[i : i + segment]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // segment], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())], names=["seg", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(b.as_py()), "<i8") for b in t.column("counts"))
        logs = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"seg": pa.array([t.column("seg")[0].as_py()], pa.int32()), "logs": pa.array([zlib.compress(logs.tobytes(), 1)], pa.binary())})

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    counted = docs.select(_text(docs).alias("text")).mapInArrow(tidied(count), "seg int, counts binary")
    for r in counted.groupBy("seg").applyInArrow(add, "seg int, logs binary").collect():
        part = np.frombuffer(zlib.decompress(r["logs"]), np.uint8)
        out[r["seg"] << 16 : (r["seg"] << 16) + len(part)] = part
    return out.tobytes()


def prefix(s: np.ndarray, logs: np.ndarray, percent: int) -> np.ndarray:
    """The rarest |s| - T + 1 shingles, in the order of (sketched count, hash)."""
    n = len(s)
    size = min(n, n - least_overlap(n, percent) + 1)
    rank = logs[(s & np.uint64(len(logs) - 1)).astype(np.int64)]
    order = np.argsort(rank, kind="stable")  # s is sorted, so hashes decide among equals
    return s[order[:size]]


def _summarise(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of every row doc_id, hash of the text, n, key, parity sketch and prefix."""
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text(docs)).alias("hash"), _text(docs).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(_ranks(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.frombuffer(sent.value, np.uint8)
        for batch in slices(batches, 2):
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            rarest = [prefix(s, logs, percent).view(np.int64) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.binary()), pa.array(rarest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "hash", "n", "key", "parity", "prefix"])

    return only.mapInArrow(tidied(run), "doc_id long, hash long, n long, key binary, parity binary, prefix array<long>")


def _near_size(n, m, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


#: Rows of a list that are compared with each other in one tile.
TILE = 2048
#: Pairs of a tile that are looked at together.
SLAB = 1 << 19


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs whose sizes and sketches may be of linked sets."""
    side = nodes.select("node", "n", "parity")
    pairs = pairs.join(side.toDF("u", "n", "pu"), "u").join(side.toDF("v", "m", "pv"), "v").where(_near_size(F.col("n"), F.col("m"), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
            ok = near_by_parity(batch.column("pu").to_pylist(), batch.column("pv").to_pylist(), n, m, percent)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    return pairs.select("u", "v", "n", "m", "pu", "pv").mapInArrow(tidied(run), "u long, v long")


def tile_pairs(comp: np.ndarray, n: np.ndarray, block: np.ndarray, mixed: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of rows of one tile that lie in different components and are near in size; of a mixed tile, in different blocks."""
    size = len(n)
    step = max(1, SLAB // size)
    for lo in range(0, size - 1, step):
        i, j = np.divmod(np.arange(lo * size, min(size, lo + step) * size), size)
        ok = (i < j) & (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
        if mixed:
            ok &= block[i] != block[j]
        if ok.any():
            yield i[ok], j[ok]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted rows in tables of whole groups of equal keys, and where groups begin and the last ends."""
    left: pa.Table | None = None

    def bounds(t: pa.Table) -> list[int]:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist(), t.num_rows]

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
        if t.num_rows:
            cuts = bounds(t)
            left = t.slice(cuts[-2])
            if len(cuts) > 2:
                yield t, cuts[:-1]
    if left is not None and left.num_rows:
        yield left, [0, left.num_rows]


def _cross_pairs(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """u < v of plausible pairs that meet in a list of (h, node, comp) and lie in different components."""
    tiles = F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles")
    heads = spool(lists.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), tiles).where("c0 <> c1").select("h", "tiles"))
    rows = may_match(lists, heads, "h").join(heads, "h").join(nodes.select("node", "n", "parity"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).select("h", F.least("block", "other").alias("t0"), F.greatest("block", "other").alias("t1"), "block", "node", "n", "comp", "parity")
    rows = rows.repartition("h", "t0", "t1").sortWithinPartitions("h", "t0", "t1")

    def pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _groups(batches, ["h", "t0", "t1"]):
            sketch = t.column("parity").to_pylist()
            node, n, comp, block, t0, t1 = (t.column(c).to_numpy() for c in ("node", "n", "comp", "block", "t0", "t1"))
            two = [a for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a == 2]
            if two:  # most lists are of two, and are compared all together
                i = np.array(two)
                j = i + 1
                ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & ((t0[i] == t1[i]) | (block[i] != block[j]))
                i, j = i[ok], j[ok]
                ok = near_by_parity([sketch[x] for x in i], [sketch[x] for x in j], n[i], n[j], percent)
                yield pairs(node[i[ok]], node[j[ok]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 2:
                    for i, j in tile_pairs(comp[a:b], n[a:b], block[a:b], t0[a] != t1[a], percent):
                        i, j = i + a, j + a
                        ok = near_by_parity([sketch[x] for x in i], [sketch[x] for x in j], n[i], n[j], percent)
                        if ok.any():
                            yield pairs(node[i[ok]], node[j[ok]])

    found = spool(rows.mapInArrow(tidied(run), "u long, v long").distinct())
    discard(heads)
    return found


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) that reach the threshold, spooled. Each text is sent once per task that needs it: v is looked for among u's candidates, which are dealt over tasks by the chunk."""
    pairs = spool(pairs)
    dealt = pairs.join(pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("long").alias("parts")), "u")
    dealt = spool(dealt.select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part")))
    needs = dealt.select("u", "part", F.col("v").alias("node"), F.lit(1).alias("role")).union(dealt.select("u", "part", F.col("u").alias("node"), F.lit(0).alias("role")).distinct())
    used = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = spool(nodes.select("node", "key", "hash").join(used, "node", "left_semi"))
    only = docs.select(F.xxhash64(_text(docs)).alias("hash"), _text(docs).alias("text"))
    # one text a node: copies go before the join with those that need it
    texts = may_match(only, wanted, "hash").join(wanted, "hash").groupBy("node", "key").agg(F.first("text").alias("text"))
    rows = needs.join(texts, "node").select("u", "part", "role", "node", "key", "text").repartition("u", "part").sortWithinPartitions("u", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, query, lot, size = None, None, [], 0

        def search() -> Iterator[pa.RecordBatch]:
            nonlocal lot, size
            if lot and query is not None:
                got = Index([s for _, s in lot]).search(query, percent)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(got), pa.int64()), pa.array([lot[i][0] for i in got], pa.int64())], names=["u", "v"])
            lot, size = [], 0

        for batch in slices(batches, 5):
            u, part, role, node, key, text = (batch.column(i).to_pylist() for i in range(6))
            sets = shingle_sets(text, width)
            for i, s in enumerate(sets):
                if at != (u[i], part[i]):
                    yield from search()
                    at, query = (u[i], part[i]), None
                if set_key(s) != key[i]:  # another text of the same hash
                    continue
                if role[i] == 0:
                    query = s
                    continue
                lot.append((node[i], s))
                size += s.nbytes
                if len(lot) == CHUNK or size >= CHUNK_BYTES:
                    yield from search()
        yield from search()

    links = spool(rows.mapInArrow(tidied(run), "u long, v long"))
    discard(pairs, dealt, wanted)
    return links


def _indexed(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, key, hash), nodes (one row per set), and the lists (h, node, lo) of two nodes or more with their least."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1 .. 100")
    summary = spool(_summarise(docs, width, percent))
    one = summary.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("hash").alias("hash"), F.min("n").alias("n"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix"))
    nodes = spool(one.withColumn("node", F.monotonically_increasing_id()))
    rows = spool(summary.select("doc_id", "n", "key", "hash"))
    discard(summary)
    postings = nodes.select("node", F.explode("prefix").alias("h"))
    shared = postings.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("h", "lo")
    shared = spool(shared)
    lists = spool(may_match(postings, shared, "h").join(shared, "h").select("h", "node", "lo"))
    discard(shared)
    return rows, nodes, lists


def _connecting(docs: DataFrame, nodes: DataFrame, lists: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) that connect what all links connect."""
    size = F.size("prefix")
    # what near copies were made from shares most of its prefix, and links to them where they don't link to each other
    shared = lists.groupBy("node").agg(F.count("*").alias("c")).join(nodes.select("node", size.alias("size")), "node").select("node", "size", (F.col("c") / F.col("size")).alias("share"))
    shared = spool(shared)
    hubs = spool(lists.select("h", "node").join(shared, "node").groupBy("h").agg(F.max(F.struct("share", "node")).alias("hub")).select("h", F.col("hub.node").alias("hub")))
    ends = lists.join(hubs, "h").select("node", F.explode(F.array("lo", "hub")).alias("end")).where("node <> end")
    # a quarter of the prefix; what this passes over is left to the second search
    ends = ends.groupBy("node", "end").agg(F.count("*").alias("c")).join(shared, "node").where("c * 4 >= size").select(F.col("end").alias("u"), F.col("node").alias("v"))
    links = _verify(_plausible(ends, nodes, percent), docs, nodes, width, percent)
    discard(shared, hubs)
    found = spool(connected_components(links))
    placed = lists.select("h", "node").join(found, "node", "left").select("h", "node", F.coalesce("component", "node").alias("comp"))
    placed = spool(placed)
    more = _verify(_cross_pairs(placed, nodes, percent), docs, nodes, width, percent)
    discard(found, placed)
    return links.union(more)


def _links(docs: DataFrame, nodes: DataFrame, lists: DataFrame, width: int, percent: int) -> DataFrame:
    """All links (u, v), u < v: every node is a component of its own, so that no pair is passed over."""
    return _verify(_cross_pairs(lists.select("h", "node", F.col("node").alias("comp")), nodes, percent), docs, nodes, width, percent)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key and comp of every node."""
    return nodes.select("node", "key").join(connected_components(links), "node", "left").select("key", F.coalesce("component", "node").alias("comp"))


def _placed(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rows with component_id."""
    label = nodes.select("node", "key", "doc_id").join(connected_components(links), "node", "left").select("key", "doc_id", F.coalesce("component", "node").alias("comp"))
    label = spool(label)
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "comp").select("key", "component_id")
    out = rows.join(label, "key", "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def similarity_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. Links: 100 * intersection >= percent * union."""
    rows, nodes, lists = _indexed(docs, width, percent)
    out = _placed(rows, nodes, _connecting(docs, nodes, lists, width, percent))
    discard(nodes, lists)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def similarity_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The whole join. Members: doc_id, n_shingles, set_key (null without words), component_id and n_links (other rows linked, copies too) of every row. Links: u, v (set_keys, u < v) of every two unlike sets at the threshold."""
    rows, nodes, lists = _indexed(docs, width, percent)
    links = _links(docs, nodes, lists, width, percent)
    name = nodes.select("node", "key")
    keyed = links.join(name.toDF("u", "ku"), "u").join(name.toDF("v", "kv"), "v")
    keyed = spool(keyed.select(F.least("ku", "kv").alias("u"), F.greatest("ku", "kv").alias("v")))
    copies = rows.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"))
    ends = keyed.select(F.col("u").alias("key"), F.col("v").alias("other")).union(keyed.select("v", "u"))
    linked = ends.join(copies.toDF("other", "others"), "other").groupBy("key").agg(F.sum("others").alias("others"))
    counted = copies.join(linked, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = _placed(rows, nodes, links).join(counted, "key", "left")
    discard(lists)
    own = F.when(F.col("n") > 0, F.col("key")).alias("set_key")
    return members.select("doc_id", F.col("n").alias("n_shingles"), own, "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), keyed


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the first by doc_id (nulls last), set and text, whatever other rows have its doc_id; of rows equal in these, the least by all columns that have an order. Rows without words stay."""
    rows, nodes, lists = _indexed(docs, width, percent)
    comp = _components(nodes, _connecting(docs, nodes, lists, width, percent))
    placed = rows.where("n > 0").join(comp, "key")
    kept = placed.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "hash")).alias("k"))
    kept = spool(kept.select(F.col("k.doc_id").alias("_kept"), F.col("k.hash").alias("_hash")))
    discard(rows, nodes, lists)
    found = may_match(docs.withColumn("_hash", F.xxhash64(_text(docs))), kept, "_hash").join(kept, "_hash").where(F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")))
    ordered = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    first = found.groupBy("_kept", "_hash").agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("_row"))
    return first.select("_row.*").unionByName(docs.where(~F.coalesce(_text(docs), F.lit("")).rlike(WORD)))
