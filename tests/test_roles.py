import datetime as dt

from shutterlake.config import Params
from shutterlake.operators.ranking import duplicate_sets
from shutterlake.plans.dedupe import deduplicate

SCHEMA = "path string, duration double, frames array<struct<hash:bigint,timestamp:double>>, width int, height int, lat double, lon double, camera string, image_date timestamp, size long"


def file(path, duration, hashes, w=10, date=None):
    return (path, float(duration), [(h, float(i)) for i, h in enumerate(hashes)], w, 10, None, None, None, date, 100)


def test_video_keeps_its_unique_captures(spark):
    d = dt.datetime(2020, 1, 1)
    big = [1 << 8, 1 << 20, 1 << 40, 7 << 50]
    rows = [file("v", 3, big), file("c1", 0, [big[0]], 20), file("c2", 0, [big[1]], 20), file("c3", 0, [big[1]], 20), file("small", 0, [big[2]], 5), file("alone", 0, [-1], 5, d)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.path: r.role for r in deduplicate(df).collect()}
    assert got == {"v": "representative", "c1": "representative", "c2": "duplicate", "c3": "duplicate", "small": "duplicate", "alone": "unique"}
    kept = {r.path: r.role for r in deduplicate(df, Params(drop_like_captures=False)).collect()}
    assert kept["c2"] == "representative" and kept["c3"] == "duplicate"
    s = duplicate_sets(deduplicate(df)).collect()
    assert len(s) == 1 and s[0].best_path == "v" and s[0].representatives == ["c1", "v"]


def test_exact_thresholds_can_mean_no_neighbours(spark):
    df = spark.createDataFrame([file("a", 0, [5]), file("b", 0, [5])], SCHEMA)
    exact = dict(image_similarity=1.0, image_video_similarity=1.0, video_similarity=1.0)
    assert {r.role for r in deduplicate(df, Params(**exact, no_exact_neighbours=True)).collect()} == {"unique"}
    assert {r.role for r in deduplicate(df, Params(**exact)).collect()} == {"representative", "duplicate"}
