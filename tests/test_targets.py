"""What queries find at targets, where the pairs lie, against every pair in Python."""

import random

import pytest
from pyspark.sql import functions as F

from affinia.functions import bits
from affinia.operators import bitmatrix as B
from affinia.operators import evaluate as M
from affinia.operators import targets as G


def tanimoto(a, b):
    return (a & b).bit_count() / (a | b).bit_count() if a | b else 0.0


@pytest.fixture(scope="module")
def made(spark):
    """Fingerprints of 40 compounds, some alike and one empty, and pairs with targets, potencies and scaffolds, some null."""
    r = random.Random(3)
    fps = {i: r.getrandbits(64) & r.getrandbits(64) for i in range(40)} | {7: 0}
    fps |= {11: fps[10], 12: fps[10]}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    scaffold = {i: r.choice(["a", "b", "c", None]) for i in fps}
    pairs = [(i, t, r.choice([None, 4.5, -1.0, 6.25, 7.0]), scaffold[i]) for t in [*range(12), None] for i in r.sample(sorted(fps), 3 if t else 40)]
    f = spark.createDataFrame([(i, [signed(v)]) for i, v in fps.items()], "compound long, fp array<long>").withColumn("pop", bits.popcount(F.col("fp")))
    p = spark.createDataFrame(pairs, "compound long, target long, pchembl double, scaffold string")
    q = f.where("compound < 30").toDF("qid", "qfp", "qpop")
    return fps, pairs, q, f, p


@pytest.mark.parametrize("split, size, sent", [(1 << 17, 4096, B.SENT), (10, 4, B.SENT), (10, 4, 0)])
def test_targets_against_every_pair(made, monkeypatch, split, size, sent):
    fps, pairs, q, f, p = made
    for m, name, value in ((G, "SPLIT", split), (G, "SIZE", size), (G, "TILE", 64), (B, "SENT", sent)):
        monkeypatch.setattr(m, name, value)
    dealt = G.of_compounds(G.dealt(p), f)
    hits = {}
    for i in range(30):
        for c, target, potency, scaffold in pairs:
            if tanimoto(fps[i], fps[c]) >= 0.2:
                hits.setdefault((i, target), []).append((-tanimoto(fps[i], fps[c]), c, potency, scaffold))
    got = {(r.qid, r.target): r for r in G.summary(q, dealt, 0.2, "pchembl", "scaffold").collect()}
    assert set(got) == set(hits)
    for k, h in hits.items():
        known = [x[2] for x in h if x[2] is not None]
        r = got[k]
        assert (r.n_hits, r.n_scaffolds, r.best_similarity) == (len(h), len({x[3] for x in h} - {None}), -min(h, key=lambda x: x[0])[0])
        assert r.total_similarity == pytest.approx(-sum(x[0] for x in h)) and r.best_potency == max(known, default=None)
        assert r.mean_potency == (pytest.approx(sum(known) / len(known)) if known else None)
    plain = {(r.qid, r.target): r.n_hits for r in G.summary(q, dealt, 0.2).collect()}
    assert plain == {k: len(h) for k, h in hits.items()}
    best = sorted((str(r.target), r.qid, r["rank"], r.compound, r.t, r.pchembl) for r in G.top(q, dealt, 2, 0.2, "pchembl").collect())
    want = [(str(k[1]), k[0], n + 1, c, -t, x) for k, h in hits.items() for n, (t, c, x, _) in enumerate(sorted(h, key=lambda x: x[:2])[:2])]
    assert [x[:5] for x in best] == [x[:5] for x in sorted(want, key=lambda x: x[:5])]
    assert {x[:5]: x[5] for x in best} == {x[:5]: x[5] for x in want}
    assert G.top(q, dealt, 1, own=False).where("qid = compound").count() == 0
    assert G.top(q, dealt, 1, own=False).count() == len({(i, x[1]) for i in range(30) for x in pairs if x[0] != i})


def test_compounds_too_many_to_send_are_dealt_again(made, monkeypatch):
    _, _, q, f, p = made
    want = sorted(map(str, G.summary(q, G.of_compounds(G.dealt(p), f), 0.3).select("qid", "target", "n_hits").collect()))
    monkeypatch.setattr(G, "SENT", 0)
    assert sorted(map(str, G.summary(q, G.of_compounds(G.dealt(p), f), 0.3).select("qid", "target", "n_hits").collect())) == want


@pytest.mark.parametrize("sent", [M.SENT, 0])
def test_best_ranks_without_an_order(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "SENT", sent)
    r = random.Random(5)
    scored = spark.createDataFrame([(q, t, r.choice([0.1, 0.5, 0.9])) for q in range(9) for t in range(8) if r.random() < 0.8], "qid long, target long, score double")
    truth = spark.createDataFrame([(q, r.randrange(10)) for q in range(1, 11) for _ in range(2)], "qid long, target long")
    assert sorted(M.best_ranks_of(scored, truth).collect()) == sorted(M.best_ranks(M.ranked(scored), truth).collect())


def test_no_plan_holds_hits_and_pairs(spark, sf):
    """The queries that summed over hits join no table of them with the pairs."""
    from affinia.plans import catalogue

    for name in ("g22_sea_raw", "g1_target_summary", "x3_t1_ranked_targets", "w1_evidence_compounds", "g8_t21_best_similarity"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") >= 2 and "bit_count((" not in plan.replace(" ", ""), name
