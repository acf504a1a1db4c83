import random

import pytest

from affinia.llm import jaccard_join as J
from affinia.llm import _blocks
from affinia.llm._text import text_words
from tests.llm.data import documents, empty, text


def shingles(t):
    w = text_words(t or "")
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            (i, s), (j, u) = sets[a], sets[b]
            if s and u and len(s & u) / len(s | u) >= 0.8:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (find(i), links[i]) for i, _ in rows}


def edited(t, n, seed):
    r = random.Random(seed)
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "zz" + str(r.randrange(99))
    return " ".join(w)


def rows():
    out = []
    for g in range(6):
        base = text(g, 150)
        out += [edited(base, k % 6, 100 * g + k) for k in range(12)]
    out += [text(500 + i, 40) for i in range(30)] + ["", None, "one two", "One, TWO!", "one two three four five"]
    return list(enumerate(out))


@pytest.mark.parametrize("block, sent", [(512, _blocks.BROADCAST_IDS), (3, 0)])
def test_against_brute_force(spark, monkeypatch, block, sent):
    """Large groups in blocks of three, and ids that are joined rather than sent, give the same."""
    monkeypatch.setattr(_blocks, "BROADCAST_IDS", sent)
    data = rows()
    got = J.jaccard_classes(spark.createDataFrame(data, "doc_id long, text string"), block=block).toPandas()
    want = brute(data)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.itertuples()} == want


def test_one_id_with_several_texts(spark):
    """Each text is compared; one row of each class stays, and no text without a near copy goes."""
    a, b, c = text(1, 80), text(2, 80), text(3, 80)
    data = [(1, a), (1, b), (2, edited(b, 1, 5)), (3, c), (3, c), (3, edited(c, 1, 6)), (4, a), (5, "..."), (5, "...")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "doc_id long, text string, _key int")
    got = J.jaccard_classes(docs).toPandas()
    assert sorted(zip(got.doc_id, got.class_id, got.n_links)) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 2), (3, 3, 2), (3, 3, 2), (4, 1, 1), (5, 5, 0), (5, 5, 0)]
    kept = J.one_of_each(docs).collect()
    assert [(r.doc_id, r.text) for r in sorted(kept, key=lambda r: r["_key"]) if r.doc_id != 3] == [(1, a), (1, b), (5, "..."), (5, "...")]
    assert len([r for r in kept if r.doc_id == 3]) == 1 and kept[0].asDict().keys() == {"doc_id", "text", "_key"}


def test_pruning_keeps_what_can_reach_the_threshold():
    need = J.least_matches()
    assert list(need) == [25, 50, 75, 100, 125] and all(need[n] < 0.8 * n for n in need)
    assert all(need[a] / a <= need[b] / b for a, b in zip(list(need), list(need)[1:]))


def test_odd_rows(spark):
    d = documents(spark, "rep class_id sig keys")
    got = J.jaccard_classes(d).toPandas()
    assert len(got) == d.count()
    one = got[got.doc_id.notna()].set_index("doc_id").sort_index()
    assert set(one.loc[10:15].class_id) == {10.0} and set(one.loc[10:15].n_links) == {5}
    assert set(one.loc[20:23].class_id) == {20.0}
    assert one.loc[30].class_id == 30 and one.loc[31].n_links == 0
    assert list(got[got.doc_id == 40].n_links) == [1, 1]
    assert got[got.doc_id.isna()].class_id.isna().all() and got[got.doc_id.isna()].kept.all()
    assert J.jaccard_classes(empty(d)).count() == 0


def test_ids_of_other_types(spark):
    rows = [("b", text(5, 60)), ("a", text(5, 60)), ("c", text(9, 60)), (None, text(5, 60))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in J.jaccard_classes(docs).collect()}
    assert got == {"a": ("a", 1, True), "b": ("a", 1, False), "c": ("c", 0, True), None: (None, 0, True)}
    assert sorted(r.doc_id or "" for r in J.one_of_each(docs).collect()) == ["", "a", "c"]
