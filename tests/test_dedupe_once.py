from pyspark.sql import functions as F

from shutterlake.plans.dedupe import deduplicate

SCHEMA = "path string, duration double, frames array<struct<hash:bigint,timestamp:double>>, width int, height int, lat double, lon double, camera string, image_date timestamp, size long"


def test_files_are_read_once(spark):
    """What makes the frames can be dear: every row of it is made once a run."""
    made = spark.sparkContext.accumulator(0)

    def count(d):
        made.add(1)
        return d

    rows = [(f"v{i}", 2.0, [(i // 2 << 20, 0.0), (i // 2 << 30, 2.0)], 10, 10, None, None, None, None, 100) for i in range(2, 12)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("duration", F.udf(count, "double").asNondeterministic()("duration"))
    assert {r.path: r.role for r in deduplicate(df).collect()}["v2"] in ("representative", "duplicate")
    assert made.value == len(rows)
