"""Similarities in a block of pairs: counts of one word stay bytes, and equal names are found without a table of all pairs."""

from types import SimpleNamespace

import numpy as np

from affinia.operators import bitmatrix as B
from affinia.operators import targets as G


def test_counts_of_one_word_stay_bytes(monkeypatch):
    monkeypatch.setattr(G, "TILE", 64)
    r = np.random.default_rng(1)
    q, rows = (r.integers(0, 1 << 63, (n, 1), dtype=np.uint64) for n in (9, 20))
    q[0] = rows[3] = 0
    p = SimpleNamespace(q=q, r=rows, qpop=np.bitwise_count(q[:, 0]).astype(np.int32), pop=np.bitwise_count(rows[:, 0]).astype(np.int32))
    seen = 0
    for s, shared, either in G._tiles(p):
        assert shared.dtype == either.dtype == np.uint8
        assert (shared == np.bitwise_count(q[s] & rows[:, 0])).all() and (either == np.maximum(np.bitwise_count(q[s] | rows[:, 0]), 1)).all()
        seen += shared.size
    assert seen == 180


def test_steps_tell_all_similarities_of_one_word_apart():
    t = np.unique([i / j for j in range(1, 65) for i in range(j + 1)])
    level = np.unique((t.astype(np.float32) * np.float32(1 << 13)).astype(np.int32))
    assert len(level) == len(t) and int(level.max()) << G.PLACE < 1 << 31


def test_equal_names():
    a, b = np.array([5, 1, 7, 1]), np.array([1, 2, 5, 1])
    assert sorted(zip(*(x.tolist() for x in B.same(a, b)))) == [(i, j) for i in range(4) for j in range(4) if a[i] == b[j]]
