"""Hand-checked rows, one for each rule that is easily got wrong."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from affinia.functions import bits, scores, text
from affinia.operators import evaluate as M
from affinia.operators import evidence as E
from affinia.operators import matrix, spatial, splits, stats
from affinia.operators import similarity as S
from affinia.operators import voting as V
from affinia.operators.graph import connected_components


def one(spark, expr, **values):
    return spark.createDataFrame([Row(**values)] if values else [Row(_=1)]).select(expr.alias("x")).first().x


def test_tanimoto(spark):
    t = spark.createDataFrame([(0b1011, 0b0011), (5, 5), (0, 0), (-1, 1)], "a long, b long")
    t = t.select(F.array("a").alias("a"), F.array("b").alias("b"))
    got = [r.t for r in t.select(bits.tanimoto(F.col("a"), F.col("b"), bits.popcount(F.col("a")), bits.popcount(F.col("b"))).alias("t")).collect()]
    assert got == pytest.approx([2 / 3, 1.0, 0.0, 1 / 64])


def test_many_words(spark):
    r = spark.createDataFrame([([1.0] * 70 + [-1.0] * 58,)], "e array<double>").select(bits.pack_signs("e", 128).alias("w")).withColumn("p", bits.popcount(F.col("w"), 2)).first()
    assert r.w == [-1, 63] and r.p == 70


@pytest.mark.parametrize("p, want", [(None, 1.0), (6.0, 0.5), (100.0, 1.0), (0.0, 0.0)])
def test_potency_weight(spark, p, want):
    t = spark.createDataFrame([(p,)], "p double").select(scores.potency_weight(F.col("p")).alias("x"))
    assert t.first().x == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("p, want", [(None, 0.0), (5.0, 0.0), (7.5, 0.1), (10.0, 0.2), (12.0, 0.2)])
def test_evidence_potency_part(spark, p, want):
    t = spark.createDataFrame([(0.8, 0, p)], "s double, n int, p double").select(scores.evidence_score(F.col("s"), F.col("n"), F.col("p")).alias("x"))
    assert t.first().x == pytest.approx(0.52 + want)


def test_units_and_picks(spark):
    t = spark.createDataFrame([("1",), ("10000",), ("0",), ("abc",), (None,)], "v string")
    assert [r.x for r in t.select(scores.potency_of_nanomolar(F.col("v")).alias("x")).collect()] == [9.0, 5.0, None, None, None]
    t = spark.createDataFrame([("x", 6.1), (None, 6.1), ("7.5", 1.0)], "m string, c double")
    assert [r.x for r in t.select(scores.measured_else_computed(F.col("m"), F.col("c")).alias("x")).collect()] == [None, 6.1, 7.5]


def test_strongest_active_row_wins(spark):
    rows = [("a", "t", "=", 6.0, 1, False), ("a", "t", "<", 7.0, 2, False), ("a", "t", "=", 7.0, 3, False), ("a", "t", "=", 9.0, 4, True), ("b", "t", "=", 9.0, 5, True)]
    t = spark.createDataFrame(rows, "compound string, target string, relation string, pchembl double, document int, inactive boolean").withColumns({"year": F.lit(2000), "assay_type": F.lit("B")})
    got = {r.compound: r for r in E.best_pairs(t, ["compound", "target"], [F.col("document")]).collect()}
    assert (got["a"].pchembl, got["a"].best_relation, got["a"].is_censored, got["a"].is_measured_inactive, got["a"].n_documents) == (7.0, "<", True, True, 4)
    assert got["b"].pchembl is None and got["b"].is_censored is False


def test_density_is_unrounded(spark):
    t = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.49996), (1, 3, 0.7)], "qid int, compound int, t double")
    assert V.density(t).first().density == 2


def test_best_compound_keeps_its_own_potency(spark):
    t = spark.createDataFrame([(1, 1, 0.9, "t", None), (1, 2, 0.8, "t", 7.0)], "qid int, compound int, t double, target string, pchembl double")
    r = V.best_similarity(t).first()
    assert (r.best_compound, r.best_potency) == (1, None)


def test_orthologue_votes(spark):
    t = spark.createDataFrame([(1, 1, 0.9, "t", "rat"), (1, 1, 0.9, "t", "mouse")], "qid int, compound int, t double, target string, species string")
    assert V.orthologue_votes(t, 0.5).first().score == 2 and V.orthologue_votes(t, 0.5, distinct=True).first().score == 1


def test_both_regimes(spark):
    hits = [(q, c, 0.6 if q == 1 else 0.3, c % 3, 7.0) for q in (1, 2) for c in range(10)]
    t = spark.createDataFrame(hits, "qid int, compound int, t double, target int, pchembl double")
    pairs = t.where("qid = 1").select("compound", "target", "pchembl")
    got = {r.qid: r.regime for r in V.adaptive(t, pairs).collect()}
    assert got == {1: "pooled", 2: "best_similarity"}


def test_ranks_and_truth(spark):
    t = spark.createDataFrame([(1, "t2", 1.0), (1, "t1", 1.0), (2, "t1", 1.0)], "qid int, target string, score double")
    k = M.ranked(t)
    assert {r.target: r["rank"] for r in k.where("qid = 1").collect()} == {"t1": 1, "t2": 2}
    b = M.best_ranks(k, spark.createDataFrame([(1, "t2"), (2, "zz")], "qid int, target string"))
    assert {r.qid: r.best_rank for r in b.collect()} == {1: 2, 2: None}
    m = M.rank_metrics(b).first()
    assert (m.n, m.mrr, m.top_1, m.never_found) == (2, 0.25, 0.0, 0.5)


def test_macro_and_pooled(spark):
    t = spark.createDataFrame([(1, 0, 0, 10, 1.0, 1.0, None), (1, 8, 0, 10, 1 / 9, 1.0, None)], "tp long, fp long, fn long, tn long, precision double, recall double, mcc double")
    r = M.macro_and_pooled(t).first()
    assert (round(r.macro_precision, 4), round(r.pooled_precision, 4)) == (0.5556, 0.2)


def test_bins_and_fill(spark):
    got = M.equal_bins(spark.range(23), [F.col("id")], 10).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in got] == [2] * 9 + [5]
    g = spark.createDataFrame([(k, 3) for k in "abc"], "k string, size int")
    assert [r.k for r in splits.fill(g, [F.col("k")], 5).where("chosen").collect()] == ["a", "b"]
    many = spark.range(500).select("id", (F.col("id") % 7 + 1).alias("size"))
    a = splits.fill_shuffled(many, "id", 300)
    b = splits.fill(many, [splits.shuffled("id"), F.col("id")], 300)
    assert {r.id for r in a.where("chosen").collect()} == {r.id for r in b.where("chosen").collect()}


def test_percentile_and_rank_score(spark):
    s = spark.createDataFrame([("g", -8.0)], "g string, score double")
    ref = spark.createDataFrame([("g", x) for x in (-7.0, -8.0, -9.0, -6.0)], "g string, score double")
    assert M.percentile_ranks(s, ref, "g").first().percentile == 62.5
    t = spark.createDataFrame([(1, 3.0), (2, None), (3, 1.0)], "k int, v double")
    assert [r.rank_score for r in M.rank_score(t, "v", "k").orderBy("k").collect()] == [1.0, None, 0.0]
    assert M.rank_score(t.where("k = 1"), "v", "k").first().rank_score == 1.0


def test_auc_and_calibration(spark):
    t = spark.createDataFrame([("active", -10.0), ("active", -8.0), ("decoy", -9.0), ("decoy", -7.0), ("decoy", None)], "label string, score double")
    assert M.enrichment(t).first().auc == pytest.approx(0.75)
    t = spark.createDataFrame([(1.0, 1), (1.0, 0)], "p double, y int")
    assert stats.calibration_error(t, "p", "y").first().ece == pytest.approx(0.5)


def test_constant_column(spark):
    t = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    assert matrix.column_stats(t, ["a"]).first().a_sd == 1e-8


def test_components_of_chains_and_stars(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 100 for k in range(100, 160)) and len(got) == 121
    d = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "b"), ("d2", "c"), ("d3", "e")], "document string, compound string")
    assert {r.compound: r.cluster for r in splits.document_clusters(d).collect()} == {"a": "a", "b": "a", "c": "a", "e": "e"}


def test_gaps(spark):
    t = spark.createDataFrame([("A", n) for n in (1, 2, 3, 9)], "chain string, n int")
    assert [r.n for r in E.islands(t, "chain", "n").collect()] == [9]


def test_contact_prefers_hydrogen_bonds(spark):
    t = spark.createDataFrame([("r", 3.5, True, False), ("r", 2.0, False, True), ("s", 4.0, False, True)], "r string, distance double, p boolean, c boolean")
    got = {x.r: x.kind for x in spatial.contacts(t, F.col("p"), F.col("c"), ["r"]).collect()}
    assert got == {"r": "hbond", "s": "hydrophobic"}


def test_text_records(spark):
    s = "1ABC (res=2.0, RSCC=1) ligands: GOL=x (92 Da) [s]; abc=y (300.5 Da) [t] | bad | 2DEF (res=1) ligands: ATP=z (507 Da)"
    t = spark.createDataFrame([(s,)], "s string")
    got = t.select(F.explode(text.record_entries(F.col("s"))).alias("e")).select("e.id", text.heaviest_ligand(F.col("e.ligands"), ["GOL", "ATP"]).alias("b")).collect()
    assert [(r.id, r.b and (r.b.name, r.b.mass)) for r in got] == [("1ABC", ("ABC", 300.5)), ("2DEF", None)]
    assert one(spark, text.gene_of_target(F.lit("T1_EGFR_x"))) == "EGFR_x"
    assert one(spark, text.entry_id_of_file(F.lit("1abc_raw.pdb"))) == "1ABC"
    assert one(spark, text.labelled_number(F.lit("CNNscore: 0.75\n"), "CNNscore")) == 0.75
    assert one(spark, text.contains_any("a", F.lit("abc"))) is False


def test_band_pruning_changes_nothing(spark):
    t = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.xxhash64("id").bitwiseAND(F.xxhash64(F.col("id") % 5))).alias("fp")).withColumn("pop", bits.popcount(F.col("fp")))
    q = t.where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("fp").alias("qfp"), F.col("pop").alias("qpop"))
    for least in (0.2, 0.5, 0.8, 1.0):
        full = S.similarities(q, t).where(F.col("t") >= least).select("qid", "vec_id", "t").collect()
        assert sorted(full) == sorted(S.similarities(q, t, least).select("qid", "vec_id", "t").collect())


def test_splits_never_straddle(spark):
    m = spark.range(3000).select("id", (F.col("id") % 97).alias("g"), (2000 + F.col("id") % 20).alias("y"))
    f = splits.group_folds(m, "g", 5)
    assert f.count() == 97 and {r.n for r in f.groupBy("g").agg(F.countDistinct("fold").alias("n")).collect()} == {1}
    sizes = [r.s for r in f.groupBy("fold").agg(F.sum("size").alias("s")).collect()]
    assert max(sizes) - min(sizes) <= 40
    snake = splits.group_folds(m, "g", 5)
    assert snake.groupBy("g").count().where("count > 1").count() == 0
    h = splits.scaffold_holdout(m, "g", 300)
    assert 300 <= h.where("held_out").agg(F.sum("size")).first()[0] <= 350


def test_bootstrap_interval(spark):
    t = spark.range(4000).select((F.col("id") % 200).alias("g"), F.randn(5).alias("v"))
    r = stats.cluster_bootstrap(t, "v", "g", 400).first()
    assert r.low < r.point < r.high and r.n_groups == 200 and 0.03 < r.high - r.low < 0.12
    assert stats.cluster_bootstrap(t, "v", "g", 400).first() == r


def test_quantile_and_distribution_are_inverse():
    for p in (1e-6, 0.01, 0.024, 0.3, 0.5, 0.9, 0.999):
        assert stats.normal_cdf(stats.normal_quantile(p)) == pytest.approx(p, rel=1e-6)


def test_ols_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(200, 2))
    y = 1 + x @ [2, -3] + np.random.default_rng(1).normal(size=200)
    t = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [r.estimate for r in stats.ols(t, "y", ["a", "b"]).collect()] == pytest.approx(list(want))


def test_grid_join_equals_all_pairs(spark):
    p = spark.range(150).select("id", *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 100.0 - 5).alias(c) for c in "xyz"])
    got = {(r.id, r.b_id) for r in spatial.near_pairs(p, p, 1.7).select("id", "b_id").collect()}
    pts = {r.id: (r.x, r.y, r.z) for r in p.collect()}
    want = {(i, j) for i, a in pts.items() for j, b in pts.items() if sum((u - v) ** 2 for u, v in zip(a, b)) ** 0.5 <= 1.7}
    assert got == want
