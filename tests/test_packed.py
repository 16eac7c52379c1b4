import numpy as np
import pytest

from shutterlake import fixtures as fx
from shutterlake.operators import neighbours as nb


@pytest.mark.parametrize("lot", [40, 1 << 18])
def test_packed_hashes_meet_as_all_pairs_do(spark, monkeypatch, lot):
    """Of one table and of two, of few varying bits and many lots; no row a hash and key is made."""
    monkeypatch.setattr(nb, "LOT_ROWS", lot)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**60, 60)]
    some = sorted({b ^ sum(1 << int(i) for i in rng.choice(60, int(rng.integers(0, 7)), replace=False)) for b in base for _ in range(3)})
    x, y = (spark.createDataFrame([(h,) for h in s], "hash long") for s in (some, base))
    near = lambda one, other: {(a, b, (a ^ b).bit_count()) for a in one for b in other if (a ^ b).bit_count() <= 5}
    got = nb.hash_pairs(x, y, 5)
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(near(some, base))
    assert sorted(map(tuple, nb.hash_pairs(x, x, 5).collect())) == sorted(near(some, some))
    assert sorted(map(tuple, nb.hash_pairs(x, x, 5, equal=False).collect())) == sorted(p for p in near(some, some) if p[2])


def test_lines_are_hashed_where_they_are_read(spark, tmp_path):
    """Odd lines, an id that stands twice, and no text in what moves."""
    texts = ["a b\nB a\n \n\n c", None, "", "  ", "x\r\ny  z ", "ÄÖ Σας ΟΔΟΣ\nİ i", "w " * 70000 + " ".join(map(str, range(70000))), "one two three\nfour"]
    for name, ids in (("single", range(len(texts))), ("twice", [0, 1, 2, 3, 4, 5, 6, 0])):
        spark.createDataFrame(list(zip(ids, texts, ["s"] * 8, ["l"] * 8, strict=True)), "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, "brand") for i in range(4)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/{name}/part.parquet")
        got, want = fx.media(spark, f"{tmp_path}/{name}"), fx._grouped_lines(fx.frames(spark, f"{tmp_path}/{name}"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5 - (name == "twice")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = fx.inventory(spark, f"{tmp_path}/{name}")._jdf.queryExecution().optimizedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert all("Join" not in above for above in plan.split("octet_length")[1:])  # taken below the join
        if name == "single":
            assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
