import hashlib
import random

import pyarrow as pa
import pytest

from affinia.llm import _text as W
from affinia.llm import decontaminate as D
from affinia.llm._text import text_words
from tests.llm.data import documents, empty, text


def brute(docs, items, window=10):
    out = {}
    for i, t in docs:
        w = text_words(t or "")
        hit, found = set(), set()
        for item, it in items:
            v = text_words(it or "")
            n = min(window, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def tables(spark):
    r = random.Random(4)
    items = [(k, text(200 + k, 25)) for k in range(12)] + [(100, "Alpha, BETA gamma"), (101, None), (102, "..."), (None, text(1, 12)), (9, text(209, 25)), (300, "x " * 30)]
    docs = []
    for i in range(60):
        parts = [text(1000 + i, r.randint(0, 40))]
        if i % 3 == 0:
            v = text(200 + r.randint(0, 11), 25).upper().split()
            a = r.randint(0, 12)
            parts += [", ".join(v[a : a + r.randint(8, 13)]), text(2000 + i, 20)]
        if i % 7 == 0:
            parts.append("alpha-beta_gamma")
        docs.append((i, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "x " * 200)]
    return docs, items


def check(spark, window=10, **k):
    docs, items = tables(spark)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=window, **k).toPandas()
    want = brute(docs, [x for x in items if x[0] is not None], window)
    for r in got.itertuples():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want[r.doc_id], r.doc_id
        assert r.contaminated == (r.n_hit > 0)
    assert len(got) == len(docs) and got.contaminated.sum() >= (5 if window == 10 else 1)


@pytest.mark.parametrize("window, index_bytes", [(10, D.INDEX_BYTES), (10, 0), (64, 0), (100, D.INDEX_BYTES), (100, 0)])
def test_against_brute_force(spark, window, index_bytes):
    """The index in the tasks and the join give the same; windows of 64 words and more too."""
    check(spark, window, index_bytes=index_bytes)


def test_joined_with_a_frequent_prefix(spark, monkeypatch):
    """One passage in every document: its places and windows are dealt to several shares."""
    passage = text(5, 30)
    rows = [(i, f"w{i} {passage} v{i}") for i in range(400)]
    monkeypatch.setattr(D, "PLACES", 50)
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage), (2, passage)], "item_id long, text string")
    got = D.contamination(d, b, index_bytes=0).toPandas()
    assert len(got) == 400 and set(got.n_hit) == {30} and set(got.n_items) == {2}


def test_long_words_that_agree_in_a_polynomial_differ():
    """Thue-Morse words and their complements collide under every polynomial hash modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    h = W.words(*W.buffers(pa.array([word + " " + word.translate(str.maketrans("ab", "ba"))])))[2]
    assert h[0] != h[1]


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, text(77, 40))], "item_id long, text string")
    d = documents(spark, "n_words n_hit items _row _hits")
    for size in (D.INDEX_BYTES, 0):
        got = D.contamination(d, bench, index_bytes=size).toPandas()
        assert len(got) == d.count() and set(got[got.contaminated].doc_id) == {30.0, 31.0}
        assert set(got._row) == {"x"} and list(got.columns[-5:]) == ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert D.contamination(empty(d), bench, index_bytes=size).count() == 0
        assert D.contamination(d, empty(bench), index_bytes=size).where("contaminated").count() == 0
