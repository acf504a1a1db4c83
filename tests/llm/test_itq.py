import numpy as np
import pytest

from affinia.llm import itq_neighbors as Q
from tests.llm.data import empty


def brute(x):
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (n[:, None] * n[None]) >= 0.9
    np.fill_diagonal(near, False)
    return near


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<float>")


def test_recall_and_no_false_link(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 32))
    x = np.concatenate([base, base[:200] + r.normal(size=(200, 32)) * 0.25, np.repeat(base[:1], 60, 0), base[1] + r.normal(size=(150, 32)) * 0.1]).astype(np.float32)
    near = brute(x.astype(np.float64))
    got = Q.near_vectors(table(spark, x)).toPandas().sort_values("vec_id")
    want = near.sum(1)
    assert (got.n_links.to_numpy() <= want).all()
    assert got.n_links.sum() >= 0.9 * want.sum()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def components(near):
    """Smallest member of each component, by union-find."""
    root = list(range(len(near)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(*np.nonzero(near)):
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    return [find(i) for i in range(len(near))]


@pytest.mark.parametrize("block", [2048, 16])
def test_links_and_components_against_union_find(spark, block):
    """Clusters well inside the threshold, chains of links, a large cluster of unequal vectors, and another length."""
    r = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base = unit(r.normal(size=(250, 48)))
    x = [base, base[:100] + 0.02 * unit(r.normal(size=(100, 48))), base[0] + 0.04 * unit(r.normal(size=(200, 48)))]
    p, q = unit(r.normal(size=(2, 48)))
    q = unit((q - (q @ p) * p)[None])[0]
    turn = 0.4 * np.arange(12)[:, None]  # neighbours at cosine 0.92, others below
    x = np.concatenate([*x, np.cos(turn) * p + np.sin(turn) * q]).astype(np.float32)
    near = brute(x.astype(np.float64))
    other = r.normal(size=(6, 5)).astype(np.float32)
    other[3:] = other[:3] * np.float32(2)
    ids = np.arange(len(x) + len(other))
    t = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, [*x, *other])], "vec_id long, embedding array<float>")
    got = Q.near_vectors(t, recall=0.9999, block=block).toPandas().sort_values("vec_id")
    n = len(x)
    assert got.n_links.tolist() == [*near.sum(1).tolist(), 1, 1, 1, 1, 1, 1]
    assert got.component_id.tolist() == [*components(near), n, n + 1, n + 2, n, n + 1, n + 2]


def test_doubles_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.01e-200]), (3, [5e-324, 0.0]), (4, [1.0, -1.0])]
    got = Q.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    assert got.n_links.to_dict() == {1: 1, 2: 1, 3: 0, 4: 0} and got.component_id.to_dict() == {1: 1, 2: 1, 3: 3, 4: 4}


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0])]
    got = Q.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert sorted(zip(got.vec_id, got.n_links, got.component_id)) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_rotation_is_orthogonal_and_codes_balanced():
    r = np.random.default_rng(2)
    mean, turns = Q.learn(r.normal(size=(2000, 16)), 2)
    for t in turns:
        assert np.allclose(t.T @ t, np.eye(16), atol=1e-8)
    assert Q.layout(10**9, 64)[0] > Q.layout(10**5, 64)[0]


def test_odd_rows(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [-1.0, 5.0]), (None, [1.0, 2.0]), (10, [1.0, 2.0, 3.0])]
    t = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, rep string, keys string")
    got = Q.near_vectors(t).toPandas()
    assert len(got) == len(rows)
    n = {v: list(g.n_links) for v, g in got.groupby("vec_id")}
    assert n[6] == [3] and n[7] == [3, 3] and n[8] == [3]
    assert all(n[k] == [0] for k in (0, 1, 2, 3, 4, 5, 9, 10))
    assert set(got[got.vec_id.isin([6, 7, 8])].component_id) == {6.0}
    assert Q.near_vectors(empty(t)).count() == 0


def test_recall_at_the_threshold_with_a_common_direction(spark):
    r = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    common = unit(r.normal(size=(1, 64)))
    a = unit(np.sqrt(0.7) * common + np.sqrt(0.3) * unit(r.normal(size=(1500, 64))))
    w = r.normal(size=a.shape)
    w = unit(w - (w * a).sum(1, keepdims=True) * a)
    c = r.uniform(0.9005, 0.92, size=(len(a), 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * w]).astype(np.float32)
    want = brute(x.astype(np.float64)).sum(1)
    got = Q.near_vectors(table(spark, x)).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() <= want).all() and want.sum() >= 3000
    assert got.n_links.sum() >= 0.96 * want.sum()
