import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinia.llm import hard_negatives as H


def plain(rows, is_anchor, positives=5, negatives=3):
    """Every anchor against every row."""
    out = []
    for vid, label, q in rows:
        if vid is None or not is_anchor(vid):
            continue
        seen = sorted((-int(np.dot(q, x)), v, lab) for v, lab, x in rows if v is not None and v != vid and len(x) == len(q))
        for s, p, _ in [t for t in seen if t[2] == label][:positives]:
            fit = [t for t in seen if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(vid, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def grouped(n, seed=1, dim=12, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-60, 60, (7, dim))
    return [(i, int(rng.integers(labels)), (centre[rng.integers(7)] + rng.integers(-8, 9, dim)).tolist()) for i in range(n)]


def mined(spark, rows, kind="long", **how):
    df = spark.createDataFrame(rows, f"vec_id {kind}, label int, q array<long>").repartition(3)
    anchors = F.pmod(F.col("vec_id").cast("long"), F.lit(5)) == 0
    return sorted(tuple(r) for r in H.hard_negatives(df, anchors, **how).collect())


@pytest.mark.parametrize("how", [{}, {"cell": 16, "block": 3, "lists": 90}])
def test_against_every_pair(spark, how):
    rows = grouped(150)
    rows += [(1000 + i, 0, [1, 2]) for i in range(4)] + [(1010, 1, [1, 2]), (1015, 1, [3, 1])]  # another length, ties
    rows += rows[5:8] + [(None, 0, rows[0][2])] + [(2000 + i, i % 2, rows[10][2]) for i in range(30)]  # repeated rows, copies of one vector
    got = mined(spark, rows, **how)
    assert got == plain(rows, lambda v: v % 5 == 0) and len(got) > 100


def test_ids_of_any_type_and_empty_tables(spark):
    rows = [(f"{i:04d}", a, q) for i, a, q in grouped(60, 2)]
    assert mined(spark, rows, "string") == plain(rows, lambda v: int(v) % 5 == 0)
    assert mined(spark, []) == [] and mined(spark, [(5, 1, [1, 2])]) == []
    with pytest.raises(Exception, match="too long"):
        mined(spark, [(5, 1, [1 << 40, 2])])


def test_lists_that_cannot_matter_are_not_visited():
    rng = np.random.default_rng(4)
    centre = np.eye(8) * 1000
    x = np.repeat(centre, 50, 0) + rng.integers(-5, 6, (400, 8))
    made = H.Lists({8: centre})
    made.radius[:] = 20
    a = x[:50:10]
    no, yes = np.full((5, 1), H.NONE), np.full((5, 1), -H.NONE)
    assert made.open(a, no, yes, 0, 8).all() and made.open(a, no, yes, 1, 8).sum() == 35  # nothing known: all lists, by places
    assert made.open(a, np.full((5, 1), 900_000), yes, 0, 8).sum() == 5  # a k-th score: stop after the first
    assert not made.open(a, no * 0 + 10_000_000_000, yes, 0, 8).any()
    assert made.open(a, no, np.full((5, 1), 500_000), 0, 8).sum() == 35  # the nearest list lies above the window
    asked = pa.table({"row": range(5), "vec_id": range(0, 50, 10), "label": [0] * 5, "q": a.tolist(), "lo": no.tolist(), "hi": yes.tolist(), "wanted": [list(range(8))] * 5})
    members = pa.table({"vec_id": range(400), "label": [0] * 400, "list": np.repeat(np.arange(8, dtype=np.int32), 50), "q": x.astype(np.int64).tolist()})
    row, window, ids, score, worked = H.best_of(asked, members, made, 3, True)
    assert worked == 5 * 50  # of 5 * 400: the first list's third score is beyond the bounds of the others
    want = [sorted((-int(v @ y), i) for i, y in enumerate(x) if i != 10 * k)[:3] for k, v in enumerate(a)]
    assert sorted(zip(row.to_pylist(), score.to_pylist(), ids.to_pylist())) == sorted((k, -s, i) for k, w in enumerate(want) for s, i in w)


def test_packed():
    assert H._packed({0: 3, 1: 3, 2: 25, 3: 9, 4: 2}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (5, 1)}
    assert H._packed({}, 10) == {}


def test_query_leaves_out_what_has_no_score(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), int(rng.integers(10))) for i in range(300)]
    odd = [(350, None, 1), (400, [0.1, None, 1.0, 1.0], 1), (450, [float("inf")] * 4, 1), (500, [1.0] * 4, None)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS q", "2 AS row").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in H.op11_hard_negatives(spark, str(tmp_path)).collect())
    whole = [(v, (a + 1) % 10 if v % 7 == 0 else a, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for v, e, a in rows]
    assert got == plain(whole, lambda v: v % 50 == 0) and got
