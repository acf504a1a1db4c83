"""Null models, nested choice and candidates against plain Python."""

import hashlib
import math
import random
from statistics import mean, pstdev

import pytest
from pyspark.sql import functions as F

from affinia.operators import nullmodel as N
from affinia.operators import selection as C


def drawn(scored, sizes, draws, seed=42):
    out = {}
    for q in {r[0] for r in scored}:
        for d in range(draws):
            rows = sorted((int(hashlib.md5(f"{seed}:{q}:{d}:{k}".encode()).hexdigest()[:15], 16), k, t) for i, k, t in scored if i == q)
            for n in sizes:
                out[q, d, n] = sum(t for _, _, t in rows[:n])
    return out


@pytest.mark.parametrize("buckets", [2, 1024])
def test_sums_of_random_sets(spark, monkeypatch, buckets):
    monkeypatch.setattr(N, "BUCKETS", buckets)
    r = random.Random(1)
    scored = [(q, k, r.random()) for q in range(3) for k in range(5 if q == 2 else 40)]
    got = N.drawn_sums(spark.createDataFrame(scored, "qid long, key long, t double"), "key", [1, 4, 39, 1000], 3)
    assert {(x.qid, x.draw, x.size): x.raw for x in got.collect()} == pytest.approx(drawn(scored, [1, 4, 39, 1000], 3))
    assert N.drawn_sums(spark.createDataFrame([], "qid long, key long, t double"), "key", [3], 2).count() == 0


def test_moments_laws_and_chances(spark):
    sums = spark.createDataFrame([(n, 2.0 * n**1.1 * (1 + s)) for n in (5, 10, 40, 200) for s in (-0.1, 0.0, 0.2, -0.1)], "size long, raw double")
    m = {x.size: x for x in N.null_moments(sums).collect()}
    values = [2.0 * 10**1.1 * (1 + s) for s in (-0.1, 0.0, 0.2, -0.1)]
    assert (m[10].mean, m[10].std) == pytest.approx((mean(values), pstdev(values)))
    assert m[10].loc + 0.5772156649015329 * m[10].scale == pytest.approx(m[10].mean)
    laws = {x.law: x for x in N.null_laws(N.null_moments(sums)).collect()}
    assert (laws["mean"].scale, laws["mean"].exponent, laws["mean"].r2) == pytest.approx((2.0, 1.1, 1.0)) and laws["std"].exponent == pytest.approx(1.1)
    raw = spark.createDataFrame([(1, 2.0 * 30**1.1, 30), (2, 9.0 * 30**1.1, 30)], "target int, raw double, n int")
    p = {x.target: x.p_value for x in N.p_values(raw, N.null_laws(N.null_moments(sums))).collect()}
    assert p[1] == pytest.approx(1 - math.exp(-math.exp(-0.5772156649015329)), abs=1e-6) and p[2] < p[1]


def test_choice_never_sees_its_own_fold(spark):
    r = random.Random(2)
    rows = [(i, i % 4, k, a, r.random()) for i in range(30) for k in (3, 5) for a in (1.0, 2.0)]
    o = spark.createDataFrame(rows, "qid long, fold int, k int, alpha double, value double")
    got = {x.fold: x for x in C.chosen_by_fold(o, ["k", "alpha"]).collect()}
    for f in range(4):
        score = {(k, a): mean(mean(v for _, g, kk, aa, v in rows if (g, kk, aa) == (h, k, a)) for h in range(4) if h != f) for k in (3, 5) for a in (1.0, 2.0)}
        best = min(score, key=lambda x: (-round(score[x], 12), x))
        assert (got[f].k, got[f].alpha) == best and got[f].inner == pytest.approx(score[best])
        assert got[f].n_train + got[f].n_test == 30
    out = C.out_of_fold(o, C.chosen_by_fold(o, ["k", "alpha"]), ["k", "alpha"])
    assert out.count() == 30 and all((x.k, x.alpha) == (got[x.fold].k, got[x.fold].alpha) for x in out.collect())
    assert C.chosen_by_fold(o.where("fold = 1"), ["k", "alpha"]).count() == 0
    tie = o.withColumn("value", F.lit(1.0))
    assert {(x.k, x.alpha) for x in C.chosen_by_fold(tie, ["k", "alpha"]).collect()} == {(3, 1.0)}


def test_candidates_are_false_and_few(spark):
    ranking = spark.createDataFrame([(q, 10 * q + i, 1.0 / (i + 1) + q, i + 1) for q in range(5) for i in range(7)], "qid int, target int, score double, rank int")
    truth = spark.createDataFrame([(4, 40), (4, 40), (3, 32), (0, 99)], "qid int, target int")
    got = sorted((x.qid, x.target) for x in C.candidates(ranking, truth, 2, 3).collect())
    assert got == [(2, 20), (2, 21), (3, 30), (3, 31), (4, 41), (4, 42)]
