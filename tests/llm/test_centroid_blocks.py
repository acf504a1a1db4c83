import numpy as np
import pytest

from affinia.llm import centroid_blocks as C


def plain(q, centroids, rounds):
    """Lloyd's rounds in Python integers."""
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids)) for x in q]
    for _ in range(rounds):
        a = assign()
        for k in range(len(centroids)):
            own = [x for x, (_, j) in zip(q, a) if j == k]
            if own:
                centroids[k] = [sum(v) // len(own) for v in zip(*own)]
    return [(k, d) for d, k in assign()], centroids


@pytest.mark.parametrize("kind", ["spread", "grouped", "ties"])
def test_nearest_is_exact_and_prunes(kind):
    rng = np.random.default_rng(1)
    c = rng.integers(-300, 300, (8, 64))
    q = {"spread": rng.integers(-300, 300, (400, 64)), "grouped": c[rng.integers(0, 8, 400)] + rng.integers(-9, 9, (400, 64)), "ties": rng.integers(-1, 2, (400, 64))}[kind]
    if kind == "ties":
        c = q[:4].repeat(2, 0)
    who, d, exact = C.nearest(q, C.segment_norms(q), (q * q).sum(1), c)
    far = ((q[:, None] - c) ** 2).sum(2)
    assert (who == far.argmin(1)).all() and (d == far.min(1)).all() and exact <= far.size
    assert kind != "grouped" or exact < far.size / 2  # most centroids are never compared exactly


def test_norms_are_never_too_small():
    q = np.array([[2**27 - 1] * 4 + [1, 0, 0, 0], [0] * 8, [-3, 4, 0, 0, 5, 0, 0, 1]])
    s = C.segment_norms(q)
    assert all(int(s[i, j]) ** 2 >= sum(int(v) ** 2 for v in q[i, 4 * j : 4 * j + 4]) for i in range(3) for j in range(2))


def test_rounds_against_plain_integers(spark):
    rng = np.random.default_rng(2)
    q = np.concatenate([rng.integers(-50, 50, (60, 6)), np.zeros((5, 6), int)]).tolist()
    rows = [(i // 2, x) for i, x in enumerate(q)] + [(None, [1, 2, 3, 4, 5, 6])]  # ids repeat, one is missing
    first = np.array([q[0], q[1], q[1], [9999] * 6])  # two equal ones, and one that stays empty
    report = []
    done, final, far = C.clustered(spark.createDataFrame(rows, "vec_id int, q array<int>").repartition(3), first, rounds=4, report=report)
    want, centroids = plain([x for _, x in rows], first.tolist(), 4)
    assert final.tolist() == centroids
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in done.collect()) == sorted((v if v is not None else -1, k, d) for (v, _), (k, d) in zip(rows, want))
    assert far == {k: sum(d for j, d in want if j == k) for k in {k for k, _ in want}}
    assert all(e <= p for e, p in report) and done.schema["vec_id"].dataType.simpleString() == "int"


def _query(spark, tmp_path, rows, more=""):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    if more:
        df = df.selectExpr("*", *[f"1 AS {c}" for c in more.split()])
    df.write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return C.op12_centroid_blocks(spark, str(tmp_path))


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=64).tolist(), None) for i in range(30)]
    bad = [(90, None, 1), (91, [0.1] * 63, 1), (92, [0.1] * 63 + [float("nan")], 1), (93, [0.1] * 63 + [None], 1), (94, [float("-inf")] * 64, 1), (95, [], 1)]
    got = _query(spark, tmp_path, good + good[:3] + [(None, [0.5] * 64, 1)] + bad, "cluster distance q norms").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted([(False, i) for i in [*range(30), 0, 1, 2]] + [(True, 0)])
    assert sum(r.distance for r in got) == got[0].inertia and len({r.cluster for r in got}) <= 8
    few = _query(spark, tmp_path, good[:3]).collect()
    assert {r.cluster for r in few} == {0, 1, 2} and all(r.distance == 0 for r in few)
    none = _query(spark, tmp_path, bad)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        _query(spark, tmp_path, [(1, [1e9] * 64, 1)]).collect()
