from collections import Counter

import pytest
from oracle import compare
from pyspark.sql import functions as F

from shutterlake.llm import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    compare(q.queries()[name](spark, sf), SQL[name], sf)


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0
    last = p.STAGES[-1][1](spark, docs, sf)
    assert last.count() > 0
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_stages_of_odd_rows(spark, sf, odd):
    import corpus_pipeline as p

    rows = [tuple(r) for r in odd.select(*p.COLUMNS).collect()]
    every = [r for _, r in sorted(enumerate(rows))]
    docs = odd
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == p.COLUMNS, name
        got = [tuple(r) for r in out.collect()]
        same = {r[:1] + r[2:4] for r in every}
        assert {r[:1] + r[2:4] for r in got} <= same and got, name  # ids with their lang and source
        if name == "line dedup":
            assert Counter((r[0], r[1]) for r in got if not r[1]) == Counter((r[0], r[1]) for r in before if not r[1])
        if name == "n-gram Jaccard join":
            assert max(Counter(r[1] for r in got if r[1] and r[1].split()).values()) == 1
            assert sum(not (r[1] or "").split() for r in got) == sum(not (r[1] or "").split() for r in before)
        if name == "mixing sources to target weights":
            assert all((r[1] or "").split() for r in got)
        before = got
        docs = spark.createDataFrame(got, out.schema).withColumn("score", F.lit("clash")).withColumn("_h", F.lit(1))
    pieces = p.STAGES[-1][1](spark, docs, sf)
    assert pieces.groupBy("doc_id").count().count() == len({r[0] for r in before})
