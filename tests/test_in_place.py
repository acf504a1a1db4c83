"""Votes summed up where pairs lie, distances to chosen poses only, and random sets from the rows of small digests."""

import random

import pytest
from pyspark.sql import functions as F

from affinia.operators import nullmodel as N
from affinia.operators import spatial
from affinia.operators import targets as G
from affinia.operators import voting as V
from tests.test_models import drawn


@pytest.mark.parametrize("sent, split", [(V.SENT, 1 << 17), (0, 5)])
def test_votes_where_pairs_lie(spark, monkeypatch, sent, split):
    monkeypatch.setattr(V, "SENT", sent)
    monkeypatch.setattr(G, "SPLIT", split)
    r = random.Random(2)
    rows = list({(r.randrange(30), r.randrange(6), r.choice([*"ab", None])) for _ in range(150)})
    hits = [(q, c, r.random(), t, s) for q in range(4) for c, t, s in rows]
    sims = {(q, c): x for q, c, x, _, _ in hits}
    acts = spark.createDataFrame(rows, "compound long, target long, species string")
    h = spark.createDataFrame([(q, c, sims[q, c], t, s) for q, c, _, t, s in hits], "qid long, compound long, t double, target long, species string")
    near = h.where("t >= 0.4").select("qid", "compound").distinct()
    pairs = G.dealt(acts).groupBy("target", "_part", "compound").agg(F.count_distinct(F.struct("species")).alias("species"))
    for weight, distinct in ((F.col("species").cast("double"), False), (F.lit(1.0), True)):
        assert sorted(V.votes_in_place(near, pairs, weight).collect()) == sorted(V.orthologue_votes(h, 0.4, distinct).collect())


@pytest.mark.parametrize("sent", [spatial.SENT, 0])
def test_distances_to_chosen_poses(spark, monkeypatch, sent):
    monkeypatch.setattr(spatial, "SENT", sent)
    r = random.Random(1)
    xyz = {(c, p): [r.random() for _ in range(6)] for c in range(3) for p in range(5)}
    poses = spark.createDataFrame([(*k, v) for k, v in xyz.items()], "compound int, pose int, xyz array<double>")
    got = {(x.compound, x.a, x.b): x.rmsd for x in spatial.rmsd_to(poses, poses.where("pose = 2")).collect()}
    assert got == pytest.approx({(c, 2, p): (sum((x - y) ** 2 for x, y in zip(v, xyz[c, 2])) / 2) ** 0.5 for (c, p), v in xyz.items() if p != 2})


@pytest.mark.parametrize("margin", [None, -0.99])
def test_sets_of_small_digests_and_draws_that_lack_rows(spark, monkeypatch, margin):
    if margin:
        monkeypatch.setattr(N, "sqrt", lambda x: margin)  # a bound that leaves some draws short
    r = random.Random(1)
    scored = [(q, k, r.random()) for q in range(2) for k in range(150)]
    got = N.drawn_sums(spark.createDataFrame(scored, "qid long, key long, t double"), "key", [2, 5], 4)
    assert {(x.qid, x.draw, x.size): x.raw for x in got.collect()} == pytest.approx(drawn(scored, [2, 5], 4))
