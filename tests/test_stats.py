"""Statistics against plain numpy, and joins and places that no task sees whole."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinia.functions import bits, text
from affinia.operators import evaluate as M
from affinia.operators import matching, ordered, skew
from affinia.operators import similarity as S
from affinia.operators import stats as T
from affinia.operators.graph import connected_components


def rising(x, y):
    """The rising fit at each distinct x, as the greatest over j of the least over k of the means from j to k."""
    levels = sorted(set(x))
    s = [sum(b for a, b in zip(x, y) if a == v) for v in levels]
    n = [sum(a == v for a in x) for v in levels]
    mean = lambda j, k: sum(s[j : k + 1]) / sum(n[j : k + 1])
    return levels, [max(min(mean(j, k) for k in range(i, len(levels))) for j in range(i + 1)) for i in range(len(levels))]


def sample(seed, n=200):
    r = random.Random(seed)
    x = [r.randint(0, 40) / 10 for _ in range(n)]
    return x, [float(r.random() < v / 5) for v in x], [f"g{r.randint(0, 11)}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_isotonic_against_the_definition(spark, seed):
    x, y, _ = sample(seed)
    df = spark.createDataFrame([*zip(x, y), (None, 1.0), (1.0, None)], "x double, y double")
    fit = T.isotonic(df, "x", "y")
    levels, want = rising(x, y)
    assert np.interp(levels, *fit) == pytest.approx(want)
    asked = spark.createDataFrame([(-9.0,), (99.0,), (0.05,), (None,)], "x double")
    got = [r.calibrated for r in T.apply_isotonic(asked, "x", fit).collect()]
    assert got[:2] == pytest.approx([want[0], want[-1]]) and got[3] is None and want[0] <= got[2] <= want[1]


def test_calibration_out_of_fold(spark):
    x, y, g = sample(4, 300)
    rows = [(i, a, b, i % 3, "low" if a < 1 else "high" if a < 3.8 else "rare") for i, (a, b) in enumerate(zip(x, y))]
    got = T.out_of_fold_calibration(spark.createDataFrame(rows, "id int, x double, y double, f int, band string"), "x", "y", "f", "band").collect()
    assert len(got) == 300
    for r in got[::7]:
        near = [(a, b) for _, a, b, f, k in rows if f != r.f and k == r.band]
        near = near if len(near) >= 30 else [(a, b) for _, a, b, f, _ in rows if f != r.f]
        assert r.calibrated == pytest.approx(np.interp(r.x, *rising(*zip(*near))))


def draws(b, groups, seed=42):
    """One resample of so many groups, draw by draw, in Python's integers; ranges of T.LEAF groups share the draws by the tree."""
    out, wrap = [], (1 << 64) - 1
    for leaf in range(-(-groups // T.LEAF)):
        size = min(T.LEAF, groups - leaf * T.LEAF)
        for i in range(int(T._dealt(leaf, groups, b + 1, seed, T.LEAF)[b])):
            x = (seed * T._SEED + b * T._RESAMPLE + leaf * T._RANGE + i * T._DRAW) & wrap
            x = ((x ^ (x >> 30)) * T._MIX_1) & wrap
            x = ((x ^ (x >> 27)) * T._MIX_2) & wrap
            out.append(leaf * T.LEAF + ((x ^ (x >> 31)) >> 11) % size)
    return out


@pytest.mark.parametrize("groups", [1, 5, 30, 31])
def test_ranges_share_all_draws(groups):
    each = [T._dealt(k, groups, 400, 42, 4) for k in range(-(-groups // 4))]
    assert (sum(each) == groups).all()
    size = [min(4, groups - 4 * k) for k in range(len(each))]
    assert np.mean(each, axis=1) == pytest.approx(size, rel=0.15)
    counts = T._draws_of(np.arange(400), each[0], 0, size[0], 42)
    assert (counts.sum(1) == each[0]).all() and counts.mean(0) == pytest.approx([1.0] * size[0], rel=0.25)


@pytest.mark.parametrize("leaf", [4096, 3])
def test_bootstrap_of_groups(spark, monkeypatch, leaf):
    monkeypatch.setattr(T, "LEAF", leaf)
    x, y, g = sample(5)
    names = sorted(set(g))
    s, n = (np.array([sum(v for v, k in zip(vals, g) if k == name) for name in names]) for vals in (y, [1] * len(y)))
    boot = np.sort([s[d].sum() / n[d].sum() for d in (draws(b, len(names)) for b in range(500))])
    point = s.sum() / n.sum()
    left = (s.sum() - s) / (n.sum() - n)
    dev = left.mean() - left
    accel, z0 = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5), T.normal_quantile((boot < point).mean())
    at = lambda z: boot[round(T.normal_cdf(z0 + (z0 + z) / (1 - accel * (z0 + z))) * 499)]
    df = spark.createDataFrame(list(zip(y, g)), "y double, g string")
    for once in (T.AT_ONCE, 7):
        monkeypatch.setattr(T, "AT_ONCE", once)
        r = T.cluster_bootstrap(df, "y", "g", resamples=500).first()
        assert (r.point, r.low, r.high, r.n_groups, r.n) == pytest.approx((point, at(T.normal_quantile(0.025)), at(T.normal_quantile(0.975)), len(names), len(y)))
    assert T.cluster_bootstrap(df.limit(0), "y", "g").count() == 0


@pytest.mark.parametrize("leaf", [4096, 2])
def test_band_of_the_isotonic_fit(spark, monkeypatch, leaf):
    monkeypatch.setattr(T, "LEAF", leaf)
    x, y, g = sample(6)
    names, grid, curves = sorted(set(g)), [0.0, 1.0, 2.5, 4.0], []
    for b in range(60):
        rows = [(a, v) for d in draws(b, len(names)) for a, v, k in zip(x, y, g) if k == names[d]]
        curves.append(np.interp(grid, *rising(*zip(*rows))))
    low, high = np.percentile(curves, [2.5, 97.5], axis=0)
    got = T.isotonic_band(spark.createDataFrame(list(zip(x, y, g)), "x double, y double, g string"), "x", "y", "g", grid, resamples=60).orderBy("x").collect()
    assert [r.low for r in got] == pytest.approx(low) and [r.high for r in got] == pytest.approx(high)
    assert [r.fitted for r in got] == pytest.approx(np.interp(grid, *rising(x, y)))


def test_percentiles_places_and_bins(spark):
    r = random.Random(7)
    scores = [(f"g{r.randint(0, 2)}", r.randint(0, 9)) for _ in range(40)] + [("alone", 1), ("g0", None)]
    ref = [(f"g{r.randint(0, 3)}", r.randint(0, 9)) for _ in range(60)] + [("g1", None)]
    df = lambda rows: spark.createDataFrame(rows, "g string, score int")
    got = {(x.g, x.score): x.percentile for x in M.percentile_ranks(df(scores), df(ref), "g").collect()}
    want = {}
    for g, v in scores:
        own = [w for h, w in ref if h == g and w is not None]
        if own and v is not None:
            want[g, v] = 100 * sum(1.0 if w > v else 0.5 if w == v else 0 for w in own) / len(own)
    assert got == pytest.approx(want)
    rows = [(None if i % 11 == 0 else f"g{i % 3}", i) for i in range(50)]
    placed = ordered.placed(df(rows), [F.desc("score")], "g").collect()
    assert len(placed) == 50
    for p in placed:
        own = sorted((v for g, v in rows if g == p.g), reverse=True)
        assert (p.place, p["size"]) == (own.index(p.score) + 1, len(own))
    bins = M.equal_bins(df(rows), [F.col("score")], 4).collect()
    assert sorted(b.bin for b in bins) == [0] * 12 + [1] * 12 + [2] * 12 + [3] * 14


def wide(spark, n, seed, words=32):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        share = r.random()
        rows.append((i, [sum((r.random() < share) << b for b in range(64)) - (1 << 63) for _ in range(words)]))
    t = spark.createDataFrame(rows, "vec_id long, fp array<long>")
    return t.withColumn("pop", bits.popcount(F.col("fp"), words)), rows


def test_search_of_wide_fingerprints_by_bands_of_popcounts(spark):
    t, rows = wide(spark, 60, 1)
    q = t.where("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), F.col("fp").alias("qfp"), F.col("pop").alias("qpop"))
    both = lambda a, b, f: sum(bin(f(x, y) & ((1 << 64) - 1)).count("1") for x, y in zip(a, b))
    for least in (0.3, 0.7):
        want = {(i, j) for i, a in rows if i % 3 == 0 for j, b in rows if both(a, b, int.__and__) / both(a, b, int.__or__) >= least}
        assert {(r.qid, r.vec_id) for r in S.similarities(q, t, least, 32).collect()} == want
        far = matching.unlike_all(t.where("vec_id % 3 <> 0"), t.where("vec_id % 3 = 0"), least, "vec_id", 32)
        assert {r.vec_id for r in far.collect()} == {j for j, _ in rows if j % 3} - {j for _, j in want}
        plan = S.similarities(q, t, least, 32)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_hubs_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "HARMLESS", 500)
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5041)}
    left, right = spark.range(6000).selectExpr("id % 2 AS k", "id"), spark.createDataFrame([(0, 3000, "a"), (2, 9, "c")], "k long, n long, v string")
    assert skew.by_count(left, right, "k", "n", 6000).groupBy("v").count().collect() in ([("a", 3000), (None, 3000)], [(None, 3000), ("a", 3000)])


def test_empty_scaffolds_stay_empty_over_csv(spark, tmp_path):
    """An empty text comes back as null from a CSV file; either way the row has a group of its own and counts as no scaffold."""
    from affinia.sources import readers, writers

    writers.csv(spark.createDataFrame([(1, "c1"), (2, ""), (3, None)], "id long, scaffold string"), str(tmp_path / "s"))
    t = readers.delimited(spark, str(tmp_path / "s"), "id long, scaffold string")
    assert t.agg(F.count_distinct(F.nullif("scaffold", F.lit("")))).first()[0] == 1
    assert sorted(r.k for r in t.select(text.scaffold_key(F.col("id"), F.col("scaffold")).alias("k")).collect()) == ["__no_ring__:2", "__no_ring__:3", "c1"]


def test_logistic_curve_has_the_least_squares(spark):
    r = np.random.default_rng(8)
    x = np.linspace(0, 4, 80)
    y = 0.2 + 0.6 / (1 + np.exp(-(x - 1.7) / 0.4)) + r.normal(0, 0.03, 80)
    shape = lambda m, w: np.column_stack([np.ones(80), 1 / (1 + np.exp(-(x - m) / w))])
    off = lambda m, w: np.linalg.lstsq(shape(m, w), y, rcond=None)[1][0]
    rows = [*zip(x.tolist(), y.tolist()), (None, 1.0), (1.0, None)]
    got = T.logistic_curve(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    best = min(off(m, w) for m in np.linspace(1.4, 2.0, 61) for w in np.linspace(0.2, 0.7, 51))
    assert off(got["midpoint"], got["width"]) <= best + 1e-9
    assert [got["floor"], got["ceiling"]] == pytest.approx([0.2, 0.8], abs=0.05)
    assert np.isnan(T.logistic_curve(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), "x", "y")["width"])


def test_stacker_against_newton(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(240, 2))
    y = (r.random(240) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] - 1)))).astype(int)
    rows = [(i, float(a), float(b), int(v), i % 3) for i, ((a, b), v) in enumerate(zip(x, y))]
    got = {q.id: q.p for q in T.stacker(spark.createDataFrame(rows, "id int, a double, b double, y int, f int"), ["a", "b"], "y", "f", ["id"]).collect()}
    z, fold = np.column_stack([np.ones(240), x]), np.arange(240) % 3
    pull = np.array([0.0, 1.0, 1.0])  # on all weights but the constant's
    for f in range(3):
        t = fold != f
        w = np.where(y == 1, t.sum() / (2 * y[t].sum()), t.sum() / (2 * (t.sum() - y[t].sum())))[t]
        beta = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-z[t] @ beta))
            beta += np.linalg.solve((z[t] * (w * p * (1 - p))[:, None]).T @ z[t] + np.diag(pull), z[t].T @ (w * (y[t] - p)) - pull * beta)
        for i in np.flatnonzero(~t)[::10]:
            assert got[int(i)] == pytest.approx(1 / (1 + np.exp(-z[i] @ beta)), abs=1e-9)
