"""A lossless filter before a join: rows whose key is surely in no other table go without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the bits of the filter. Its words are what is broadcast: 2 ** (BITS - 6) rows of two longs at most, whatever the number of keys.
BITS = 25


def _place(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))


def may_match(rows: DataFrame, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The rows whose key is, or seems to be, among the keys (a column of the same name); nulls go.

    A bitmap of fixed size by the hash of the key. As it fills up, more rows
    pass that a join will then remove; none is lost.
    """
    place = _place(F.col(key), bits)
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = keys.where(F.col(key).isNotNull()).select(place.alias("_place")).select(F.shiftright("_place", 6).alias("_word"), bit.alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    tried = rows.where(F.col(key).isNotNull()).withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6))
    return tried.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).select(*[rows[c] for c in rows.columns])
