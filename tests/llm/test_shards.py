import time

import pytest
from pyspark.sql import functions as F

from affinia.llm.kd_shards import kd_shards, op1_kd_shards
from tests.llm.data import documents, empty


def rows(spark, more=""):
    d = documents(spark, more)
    return d.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))) + 1)


@pytest.mark.parametrize("n", [1, 3, 16])
def test_every_row_once_and_slots_gapless(spark, n):
    got = kd_shards(rows(spark, "shard slot _uid _h _part _id"), ["n_chars", "doc_id"], shards=n).toPandas()
    assert len(got) == rows(spark).count()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert set(got.shard) <= set(range(n))


def test_equal_rows_are_spread(spark):
    t = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(10).cast("long").alias("size"))
    got = kd_shards(t, ["doc_id"], shards=16).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()
    assert len(got) == 16 and got.b.max() - got.b.min() <= 200


def test_a_value_that_a_third_share_is_cut(spark):
    t = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(1) * 10).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 10).alias("size"))
    got = kd_shards(t, ["x"], shards=8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()
    assert got.b.max() <= 1.03 * got.b.mean() + 100


def test_target_bytes_and_empty(spark):
    t = rows(spark)
    total = t.agg(F.sum("size")).first()[0]
    got = kd_shards(t, ["n_chars"], target_bytes=total // 4 + 1)
    assert got.agg(F.max("shard")).first()[0] == 3
    assert kd_shards(empty(t), ["n_chars"], shards=4).count() == 0


def test_query(spark, sf):
    got = op1_kd_shards(spark, sf).toPandas()
    b = got.groupby("shard")["size"].sum()
    assert len(b) == 16 and b.max() - b.min() <= 2 * got["size"].max()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def plain_tree(rows, dims, n):
    """Shard of each (id, size, values) row by a K-d tree, sorted and walked."""
    spans = [max(r[2][d] for r in rows) - min(r[2][d] for r in rows) for d in range(dims)]
    out, todo = {}, [(rows, 0, n)]
    while todo:
        part, first, k = todo.pop()
        if k == 1:
            out |= {r[0]: first for r in part}
            continue
        wide = max(range(dims), key=lambda d: (max(r[2][d] for r in part) - min(r[2][d] for r in part)) / spans[d])
        part = sorted(part, key=lambda r: r[2][wide])
        want, below, cut = sum(r[1] for r in part) * (k // 2) / k, 0, 0
        while below + part[cut][1] < want:
            below += part[cut][1]
            cut += 1
        if want - below > below + part[cut][1] - want:
            cut += 1
        todo += [(part[:cut], first, k // 2), (part[cut:], first + k // 2, k - k // 2)]
    return out


@pytest.mark.parametrize("n", [2, 7, 24])
def test_against_a_plain_tree(spark, n):
    import random

    r = random.Random(n)
    rows = [(i, r.randint(1, 500), [r.gauss(0, 1), r.random() * 100, r.gauss(5, 1e6)]) for i in range(600)]
    t = spark.createDataFrame([(i, s, *v) for i, s, v in rows], "id long, size long, x double, y double, z double")
    got = {x.id: x.shard for x in kd_shards(t, ["x", "y", "z"], shards=n, tolerance=0.0).collect()}
    assert got == plain_tree(rows, 3, n)


def test_thousands_of_shards(spark):
    """The plan and what the driver sees grow with levels and nodes, not with nodes times bins."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"), F.crc32("source").alias("source"))
    total = rows.agg(F.sum("size")).first()[0]
    began = time.perf_counter()
    got = kd_shards(rows, ["doc_id", "size", "source"], target_bytes=total // 4096 + 1).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("top"), F.count("*").alias("n"), F.max("slot").alias("last")).toPandas()
    assert time.perf_counter() - began < 120
    assert got.n.sum() == docs.count() and got.shard.between(0, 4095).all() and (got["last"] == got.n - 1).all()
    assert (got.b <= 2 * total / 4096 + got.top).all()


def test_odd_rows(spark):
    d = rows(spark, "_all _size _d0 _id _h _uid _node _part _from _own _k _b w lo hi n")
    nan = d.withColumn("x", F.when(F.col("doc_id") == 3, float("nan")).when(F.col("doc_id") == 2, float("inf")).when(F.col("doc_id") == 1, float("-inf")))
    got = kd_shards(nan, ["x", "doc_id"], shards=5).toPandas()
    assert len(got) == d.count() and set(nan.columns) | {"shard", "slot"} == set(got.columns) and set(got["_node"]) == {"x"}
    none = nan.withColumn("size", F.lit(None).cast("long"))
    assert kd_shards(none, ["x"], shards=4).count() == d.count()
