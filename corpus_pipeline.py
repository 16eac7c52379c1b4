"""A corpus pipeline of five of the operators, each over all that the one before kept.

In every stage: an empty table gives an empty one. Null or repeated doc_ids are
rows like others, extra columns go (the stages return those of documents), texts
are taken whole, and ties are settled as the stage's operator says. Null sources
are a source of their own; null lang and n_chars pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import jaccard, linededup, mixing, packing, quality
from shutterlake.llm.common import table
from shutterlake.llm.queries import vocabulary_file
from shutterlake.session import ship, spool

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like any, repeated rows alike; without labels all stay."""
    return quality.with_score(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents of which no word is left by it go with them. A null or empty text loses nothing and stays; repeated rows of one doc_id do not make a line recur. n_chars is counted anew (null of a null text)."""
    kept = linededup.drop_recurring_lines(docs, counts=True)
    some = kept.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return some.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the first by doc_id: five words, a similarity of 0.8 or more. Repeated rows are copies; texts without words are in no group and stay."""
    return jaccard.keep_one_of_each(docs).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it, its last time whole if it is taken in part. Texts without words have size 0 and are not taken; rows of one doc_id are repeated like the most taken of them."""
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.max(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int").alias("_times")).where("_times > 0")
    chosen = docs.join(taken.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")))
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all rows, repeated ones each for itself; a null or empty text is its end token alone."""
    return packing.crc32_of_ids(packing.pack(docs, vocabulary_file("byte_bpe_50k.json")))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("mixing sources to target weights", mix_stage), ("packing", pack_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = spool(docs)
    return docs
