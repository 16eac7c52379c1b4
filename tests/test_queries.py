import duckdb
import pytest
from oracle import canonical, compare

from shutterlake import queries as q
from shutterlake.functions.paths import settle_conflicts

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    compare(q.queries()[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = q.queries()[name](spark, sf)
    assert len(df.collect()) > 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_suffixes_that_meet(spark, tmp_path):
    """Digits of 47016 and 57144 are equal; the query keeps to its SQL, a run still keeps targets apart."""
    ids = spark.createDataFrame([(i,) for i in (0, 1, 2, 12, 47016, 57144)], "doc_id long")
    ids.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(SQL["transfer_conflicts"])
    names = [d[0] for d in got.description]
    df = q.queries()["transfer_conflicts"](spark, str(tmp_path))
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), names)
    assert df.where("dst = '/err/IMG0_3de7d8b9.jpg'").count() == 2
    files = ids.selectExpr("concat('in/', doc_id, '/IMG0.jpg') as path", "'x/IMG0.jpg' as dst")
    assert settle_conflicts(files).select("dst").distinct().count() == 6
