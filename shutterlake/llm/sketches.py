"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions alone.

A shingle is five words in a row; a text of fewer words is one shingle, one
without words has none. A sketch holds the k least distinct 64-bit hashes in
order. Two sketches merge into the sketch of the union; from sketches follow
estimates of resemblance, containment and the number of distinct shingles. A
set of up to k shingles is held whole and its estimates are exact.

Cases: null text: empty. Equal texts have equal fingerprints. Two empty
sketches resemble each other by 1, an empty and another one by 0. Very long
texts are hashed whole. Rows are independent; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.llm.common import words
from shutterlake.session import spool

K, WIDTH = 128, 5
#: Width of the hash range, and its least value.
RANGE, LEAST = 2.0**64, -(2.0**63)


def word_hashes(text: str | Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: str, width: int = WIDTH) -> Column:
    """Hashes of the shingles, of a column of word hashes, which must be a plain column, as each shingle looks into it."""
    h = F.col(hashes)
    many = F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, (i + d).cast("int")) for d in range(width)]))
    return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < width, F.array(F.xxhash64(h))).otherwise(many)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """df with the sketch of a text column."""
    return df.withColumn("_hashes", word_hashes(text)).withColumn(out, bottom_k(shingle_hashes("_hashes", width), k)).drop("_hashes")


def merge(a: str | Column, b: str | Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of the union of each group. Groups of any size: hashes are made distinct and cut to k within salted parts first."""
    def cut(parts: DataFrame, by: list[str]) -> DataFrame:
        ranked = parts.select(*by, "_h").distinct().withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h")))
        return ranked.where(F.col("_r") <= k)

    hashes = df.select(*keys, F.pmod(F.xxhash64(sketch), F.lit(64)).alias("_salt"), F.explode(sketch).alias("_h"))
    some = cut(cut(hashes, [*keys, "_salt"]), keys)
    got = some.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))  # k hashes at most
    every = df.select(*keys).distinct()
    null_safe = [every[c].eqNullSafe(got[c]) for c in keys]
    return every.join(got, null_safe, "left").select(*[every[c] for c in keys], F.coalesce(got[sketch], F.array().cast("array<bigint>")).alias(sketch))


def distinct_estimate(sketch: str | Column, k: int = K) -> Column:
    """Distinct shingles: the size of a sketch that is not full, else (k - 1) / the share of the range that the k-th hash ends."""
    s = F.col(sketch) if isinstance(sketch, str) else sketch
    share = (F.element_at(s, k).cast("double") - F.lit(LEAST)) / F.lit(RANGE)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that lies in both."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(u, F.col(a)), F.col(b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double") / F.size(u))


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that lie in b, 0 to 1; of an empty a: 1."""
    union = distinct_estimate(merge(a, b, k), k)
    got = resemblance(a, b, k) * union / distinct_estimate(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), got))


def fingerprint(sketch: str | Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: Rows that a block of neighbouring ids holds, about; a block is hashed by one task.
BLOCK_ROWS = 2_000
#: Blocks at most, and sampled keys per block, from which the driver takes the bounds of blocks; their product bounds what it collects.
MAX_BLOCKS, PER_BLOCK = 1 << 14, 16
_CHUNK = 128


def order_key(doc_id: str, text: str) -> Column:
    """Text that sorts as (doc_id, first bytes of the text) do, null ids least: any 64-bit id, and no arithmetic that could overflow."""
    signless = F.col(doc_id).bitwiseXOR(F.lit(-(1 << 63)))
    start = F.hex(F.substring(F.col(text).cast("binary"), 1, 8))
    return F.when(F.col(doc_id).isNull(), F.concat(F.lit("0"), start)).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(signless), 16, "0"), start))


def block_bounds(base: DataFrame, rows: int) -> list[str]:
    """Keys that cut the rows in blocks of about so many, from a bounded sample."""
    n = base.count()
    blocks = min(MAX_BLOCKS, -(-n // max(1, rows)))
    if blocks < 2:
        return []
    wanted = blocks * PER_BLOCK
    sample = base if n <= 2 * wanted else base.sample(1.5 * wanted / n, seed=5)
    keys = sorted(r[0] for r in sample.select(order_key("doc_id", "text")).limit(2 * wanted).collect())
    return sorted({keys[len(keys) * i // blocks] for i in range(1, blocks)}) if keys else []


def block_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are no greater than the key; they are looked through in two steps."""
    if not bounds:
        return F.lit(0)
    ends, every = (F.split(F.lit(",".join(x)), ",") for x in (bounds[_CHUNK - 1 :: _CHUNK], bounds))
    passed = F.size(F.filter(ends, lambda x: x <= key)) if len(bounds) >= _CHUNK else F.lit(0)
    return passed * _CHUNK + F.size(F.filter(F.slice(every, passed * _CHUNK + 1, F.lit(_CHUNK)), lambda x: x <= key))


def with_next(docs: DataFrame, rows: int = BLOCK_ROWS, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, text, sketch, block, next_text, next_sketch: the next document's in descending doc_id, after the last the first's.

    Rows are cut at sampled quantiles into blocks of about equal size, whatever
    the ids, each sorted by itself; texts move once, and are hashed where they
    arrive, so that sketches do not move. What the last row of a block needs is
    the first of the next block that has rows; those few are looked up by block.
    Equal ids are ordered by text, descending; null ids come last. Rows equal in
    both share a block.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = block_bounds(base, rows)
    base = base.withColumn("_key", order_key("doc_id", "text"))
    base = base.select("doc_id", "text", block_of(F.col("_key"), bounds).alias("block"))
    heads = spool(base.groupBy("block").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "text")).alias("head")))
    there = sorted((r[0] for r in heads.select("block").collect()), reverse=True)  # MAX_BLOCKS at most
    follows = spark.createDataFrame(list(zip(there, [*there[1:], *there[:1]], strict=True)), "block int, next_block int")
    over = F.broadcast(follows).join(heads.select(F.col("block").alias("next_block"), F.col("head.text").alias("head_text")), "next_block").select("block", "head_text")
    over = with_sketch(over, "head_text", "head_sketch", k, width)
    inside = W.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    placed = with_sketch(base.repartition("block"), "text", "sketch", k, width)
    placed = placed.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_sketch", F.lead("sketch").over(inside))
    joined = placed.join(over, "block").withColumn("next_text", F.coalesce("next_text", "head_text")).withColumn("next_sketch", F.coalesce("next_sketch", "head_sketch"))
    return joined.drop("head_text", "head_sketch")


def fingerprint_documents(docs: DataFrame, k: int = K, width: int = WIDTH, rows: int = BLOCK_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    d = with_next(docs, rows, k, width)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("n_chars", n.cast("long"))
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = with_sketch(d, "edited", "edited_sketch", k, width)
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"),
        fingerprint("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch", k).alias("near_edited"),
        resemblance("sketch", "next_sketch", k).alias("near_next"),
    )
