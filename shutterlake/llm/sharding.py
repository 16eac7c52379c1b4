"""Sharding by jump consistent hashing (Lamping and Veach 2014).

A stable key and the number of shards decide a row's shard; no ring is kept.
With one shard more, a row stays where it is or goes to the new shard, which
takes the share of rows that is due to it.

The key's generator is the published one, k * 2862933555777941757 + 1 modulo
2**64. Products of 64-bit numbers do not fit Spark's long, so it runs in
DECIMAL(38, 0), where they do. The steps are a fold; a key takes about
ln(shards) of them, and a key that is not settled after `STEPS` raises.

Cases: null keys hash as 0. Equal keys share a shard. Null text counts as
empty. Slots number each shard's rows from 0 without gaps: rows lie in
`BUCKETS` buckets by the key's digest, buckets are counted, and only rows of a
bucket are sorted together, by key, then text; fully equal rows may swap.
An empty table gives an empty one; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MULTIPLIER = "2862933555777941757"
MODULUS = "18446744073709551616"
STEPS = 128
#: Hexadecimal digits of the digest that make a bucket.
BUCKET_DIGITS = 3


def jump_hash(key: str | Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of an integer key."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = F.col(key) if isinstance(key, str) else key
    whole = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(38,0)")
    k0 = F.when(whole < 0, whole + F.lit(MODULUS).cast("decimal(38,0)")).otherwise(whole).cast("decimal(38,0)")
    start = F.struct(k0.alias("k"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, _: Column) -> Column:
        product = (s["k"].cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast("decimal(38,0)")
        k = ((product + F.lit(1).cast("decimal(1,0)")).cast("decimal(38,0)") % F.lit(MODULUS).cast("decimal(20,0)")).cast("decimal(38,0)")
        high = F.floor(k / F.lit("8589934592").cast("decimal(10,0)")).cast("bigint")
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1).cast("double"))).cast("bigint")
        moved = F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(min(shards, STEPS)))
    settled = F.aggregate(steps, start, step, lambda s: F.when(s["j"] >= F.lit(shards), s["b"]).otherwise(F.raise_error(F.lit("jump hash: not settled")).cast("bigint")))
    return settled.cast("int")


def slots(df: DataFrame, shard: str, key: str, order: list[str], out: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0, without ever sorting a shard as a whole."""
    bucketed = df.withColumn("_bucket", F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, BUCKET_DIGITS))
    counts = bucketed.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    # at most shards * 16 ** BUCKET_DIGITS rows, whatever the input
    starts = counts.select(shard, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(*order)) - 1
    return bucketed.withColumn("_within", within).join(F.broadcast(starts), [shard, "_bucket"]).withColumn(out, (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_before")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 16, out: str = "shard") -> DataFrame:
    """df with its shard; no row moves."""
    return df.withColumn(out, jump_hash(key, shards))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; only digests are shuffled, never texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash("doc_id", shards).alias("shard"),
        jump_hash("doc_id", shards + 1).alias("grown_shard"),
    )
    return slots(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
