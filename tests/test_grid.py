"""The best of each group by a grid of large blocks: pairs of blocks are few, and one word is counted as wide ones are."""

import random

import pytest
from pyspark.sql import functions as F

from affinia.functions import bits
from affinia.operators import bitmatrix as B
from affinia.plans import catalogue


@pytest.mark.parametrize("size, words", [(1 << 15, 1), (64, 1), (64, 4)])
def test_best_of_groups_by_a_grid(spark, monkeypatch, size, words):
    monkeypatch.setattr(B, "GRID", size)
    monkeypatch.setattr(B, "TILE", 1000)
    r = random.Random(words)
    v = {i: [r.getrandbits(63) & r.getrandbits(63) for _ in range(words)] for i in range(200)} | {3: [0] * words, 4: [-1] * words}
    v |= {11: v[10], 12: v[10]}
    label = {i: r.choice([1, 2, 3, None]) if i != 7 else 9 for i in v}  # one group of a single row
    t = spark.createDataFrame([(i, x, label[i]) for i, x in v.items()], "vec_id long, fp array<long>, label int").withColumn("pop", bits.popcount(F.col("fp"), words))
    whole = {i: sum((x & (2**64 - 1)) << (64 * k) for k, x in enumerate(xs)) for i, xs in v.items()}
    want = {}
    for q, a in whole.items():
        for i, b in whole.items():
            if i != q:
                s = (a & b).bit_count() / (a | b).bit_count() if a | b else 0.0
                want[q, label[i]] = max(want.get((q, label[i]), 0.0), s)
    q = B.grid(t.withColumnRenamed("vec_id", "qid"), "qid")
    got = {(x.qid, x.label): x.best for x in B.best_by(q, B.grid(t, "vec_id", keep=("label",)), "qid", "vec_id", "label").collect()}
    assert got == want


@pytest.mark.parametrize("name", ["j1_every_row_as_query", "j1_wide_every_row_as_query"])
def test_pairs_of_blocks_meet_by_one_join(spark, sf, name):
    plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" not in plan and plan.count("Join Inner") == 3 and "q_block" in plan
