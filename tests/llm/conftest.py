import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])

LONG = " ".join(f"word{i} of{i % 97}" for i in range(30_000))


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and ids, and columns of clashing names."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 1), (1, "the cat sat on the mat and looked at the dog", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0),
        (None, "a text without a number is a text too", "en", "b", 9), (4, LONG, "en", "a", 9), (5, LONG + " end", "en", "a", 9), (6, "one\ntwo three", "en", None, 9), (7, "日本語 テキスト é́ 🙂", "ja", "c", 9), (8, " \t \n ", "en", "b", 9), (1, "another text of the same number stands here", "en", "c", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("key", F.lit("k")).withColumn("score", F.lit(5)).withColumn("size", F.lit(-1)).withColumn("n_tokens", F.lit(0)).withColumn("h", F.lit(0)).withColumn("shard", F.lit("s"))
