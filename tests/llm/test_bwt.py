import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinia.llm import _blocks
from affinia.llm import bwt_dedup as B
from tests.llm.data import documents, empty, text


def brute(rows, k=50):
    """(doc_id, bytes, removed, runs, digest of the rest) by a table of all strings."""
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for a in range(len(raw) - k + 1):
                w = raw[a : a + k]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        if i is not None:
            for a in range(len(raw) - k + 1):
                if first[raw[a : a + k]] < i:
                    gone[a + 1 : a + k + 1] = True
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **how):
    got = B.without_repeats(df, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "a", "aÿ\x00é"])
def test_transform_and_prefixes_against_sorting(alphabet):
    r = random.Random(5)
    pieces = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 20))).encode() for _ in range(40)]
    pieces += [pieces[3], pieces[4][:-1] or b"a", b"\xff\x00\xfe" * 3]
    bwt, lcp = B.transform(pieces, 6)
    # Equal suffixes stand in the order of the pieces.
    want = sorted((p[len(p) - n :], i, n) for i, p in enumerate(pieces) for n in range(len(p) + 1))
    piece, long = B.suffixes(bwt, np.array([len(p) for p in pieces]))
    assert list(zip(piece.tolist(), long.tolist())) == [(i, n) for _, i, n in want]
    end = 256  # the last piece has the byte 255
    assert bwt.tolist() == [pieces[i][len(pieces[i]) - n - 1] if n < len(pieces[i]) else end for _, i, n in want]
    shared = lambda a, b: next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [min(6, shared(a[0], b[0])) for a, b in zip(want, want[1:])]


def test_first_documents_of_windows():
    pieces = [b"abcabcab", b"xabcabz", b"cabcab"]
    got = [tuple(map(int, x)) for x in zip(*B.first_documents(pieces, np.array([5, 2, 9]), 4))]
    want = []
    for i, p in enumerate(pieces):
        for w in range(len(p) - 3):
            want.append((i, w, min(k for q, k in zip(pieces, [5, 2, 9]) if p[w : w + 4] in q)))
    assert got == want


def corpus(seed=2):
    r = random.Random(seed)
    rows = [(i, text(900 + i, r.randint(5, 120))) for i in range(60)]
    shared = [text(7000 + p, 30)[:n] for p, n in enumerate([49, 50, 51, 52, 70, 120, 200])]
    for p in shared * 3:
        i = r.randrange(60)
        c = r.randrange(len(rows[i][1]))
        rows[i] = (i, rows[i][1][:c] + p + rows[i][1][c:])
    rows += [(100 + i, shared[5]) for i in range(5)] + [(110, "ab" * 90), (111, "ab" * 60), (112, "é" * 70), (113, "xé" + "é" * 60), (114, " " * 300), (115, " " * 120)]
    rows += [(120, "日本語" * 30 + shared[6]), (121, shared[6] + shared[6]), (122, shared[6][10:90]), (122, shared[6][5:80]), (122, shared[6][10:90]), (None, shared[6]), (123, None), (124, "")]
    return rows


@pytest.mark.parametrize("how", [{}, {"BUCKET_BYTES": 500, "GROUP_BYTES": 2000}])
def test_against_a_table_of_all_strings(spark, monkeypatch, how):
    for k, v in how.items():
        monkeypatch.setattr(B, k, v)
    rows = corpus()
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows) and sum(x[2] > 0 for x in got) > 15


def test_whole_tables(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(docs) == want
    monkeypatch.setattr(_blocks, "BROADCAST_IDS", 0)
    assert found(docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0"))) == sorted([(f"{i:09d}", *x) for i, *x in want], key=str)


def test_odd_rows(spark):
    d = documents(spark, "kept n_spans _version _spans seeds d c piece")
    got = B.without_repeats(d)
    assert set(d.columns) | {"n_bytes", "n_removed"} == set(got.columns) and got.count() == d.count()
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert found(d) == brute(rows)
    assert B.without_repeats(empty(d)).count() == 0


def test_nothing_is_removed_without_the_transform(spark, monkeypatch):
    def none(*a):
        raise RuntimeError("no transform")

    monkeypatch.setattr(B, "transform", none)
    with pytest.raises(RuntimeError, match="no transform"):
        B.first_documents([b"ab"], np.array([1]), 1)
