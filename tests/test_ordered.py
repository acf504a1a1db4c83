import pytest
from pyspark.sql import functions as F

from affinia.operators import ordered
from affinia.operators.ordered import numbered, placed, running
from affinia.session import clear_scratch, scratch, stored


def test_places_and_sums(spark):
    t = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(37)).alias("v"))
    got = running(t, [F.desc("v"), F.col("id")], "v", parts=5).orderBy("place").collect()
    want = sorted(t.collect(), key=lambda r: (-r.v, r.id))
    total = 0
    for k, (a, b) in enumerate(zip(got, want), 1):
        assert (a.id, a.place, a.before) == (b.id, k, total)
        total += b.v
    assert numbered(t.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("by", [None, "g"])
def test_small_and_large_tables_alike(spark, monkeypatch, by):
    t = spark.range(300).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("v"))
    order, got = [F.col("v"), F.desc("id")], []
    for small in (ordered.SMALL, 0):
        monkeypatch.setattr(ordered, "SMALL", small)
        got.append([sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (placed(t, order, by), running(t, order, "v"), numbered(t, order), placed(t.limit(0), order, by))])
    assert got[0] == got[1] and len(got[0][0]) == 300


def test_scratch_is_deleted(spark, tmp_path):
    df = stored(spark.range(3), "x")
    assert df.count() == 3
    clear_scratch(spark)
    import os

    assert not os.path.exists(scratch(spark, "y").removeprefix("file://").rsplit("/", 1)[0])
