"""Nearest rows that a block of rows finds itself, rows dealt evenly, and joins that wait until rows are few."""

import random

import pytest
from pyspark.sql import functions as F

from affinia.functions import bits
from affinia.operators import bitmatrix as B
from affinia.operators import similarity as S
from affinia.plans import catalogue


def prints(spark, n, seed):
    r = random.Random(seed)
    v = {i: r.getrandbits(63) & r.getrandbits(63) for i in range(n)} | {3: 0}
    t = spark.createDataFrame([(i, [x]) for i, x in v.items()], "vec_id long, fp array<long>")
    return v, t.withColumn("pop", bits.popcount(F.col("fp")))


@pytest.mark.parametrize("size", [None, 8])
def test_nearest_below_and_without_itself(spark, size):
    v, t = prints(spark, 60, 4)
    sim = lambda a, b: (a & b).bit_count() / (a | b).bit_count() if a | b else 0.0
    got = sorted((r.qid, r["rank"], r.vec_id) for r in B.top(t.where("vec_id < 20").toDF("qid", "qfp", "qpop"), t, 4, 0.1, size=size, below=0.4, own=False).collect())
    want = []
    for q in range(20):
        best = sorted((-sim(v[q], x), i) for i, x in v.items() if i != q and 0.1 <= sim(v[q], x) < 0.4)[:4]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    assert got == sorted(want)


def test_rows_and_blocks_of_queries_are_dealt_to_many_tasks(spark, monkeypatch):
    _, t = prints(spark, 200, 5)
    q = t.toDF("qid", "qfp", "qpop")
    monkeypatch.setattr(S, "TASK_PAIRS", 2000)
    one = S.similarities(q, t.coalesce(1))
    assert one.rdd.getNumPartitions() == 20
    monkeypatch.setattr(S, "QUERY_BLOCK", 100)
    two = S.similarities(q, t.coalesce(1))
    assert two.count() == one.count() == 40_000
    keys = [p for p in two._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_deal" in p]
    assert keys and sorted(two.select("qid", "vec_id", "t").collect()) == sorted(one.select("qid", "vec_id", "t").collect())


def plan(spark, sf, name):
    return catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["g4_t3_pooled_votes", "g5_weighted_votes", "j2_rows_of_neighbours", "g6_knn_rank", "t2_neighbour_cap", "m28_capture_neighbours", "t1_top_similar_flagged", "w10_m25_spread_gap", "w4_best_rank", "j3_u10_g6_votes_without_leaks"])
def test_only_the_nearest_leave_a_task(spark, sf, name):
    assert "bit_count" not in plan(spark, sf, name)


def test_no_lists_of_leaks_and_no_pairs_where_compounds_do(spark, sf):
    assert "collect_set" not in plan(spark, sf, "j3_u10_without_leaks")
    for name in ("g2_compound_similarity", "g3_density"):
        assert "pchembl" not in plan(spark, sf, name)


def test_genes_are_grouped_before_their_targets_are_listed(spark, sf):
    p = plan(spark, sf, "j10_g11_h8_orthologue_triples")
    assert p.index("explode") < p.index("Aggregate")  # the plan is read from its end
