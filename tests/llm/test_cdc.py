import random

import pyarrow as pa
import pytest

from affinia.llm import cdc_dedup as C
from affinia.llm._text import text_words
from tests.llm.data import documents, empty, text


def brute(rows, k=51):
    """Documents that share a run of k words with another."""
    seen, hit = {}, set()
    for i, t in rows:
        w = text_words(t)
        for j in range(len(w) - k + 1):
            o = seen.setdefault(tuple(w[j : j + k]), i)
            if o != i:
                hit |= {i, o}
    return hit


def test_chunks_cover_the_text_and_resist_shifts():
    t = text(7, 900)
    doc, start, size, d = C.chunks_of(pa.array([t, "é" * 700, "x" + t, "", None, "a", "put in before it " + t]))
    for i, s in enumerate([t, "é" * 700, "x" + t, "", "", "a"]):
        raw = s.encode()
        mine = doc == i
        assert b"".join(raw[a : a + n] for a, n in zip(start[mine], size[mine])) == raw
        for a, n in zip(start[mine], size[mine]):
            assert len(raw[a : a + n].decode().split()) <= 2 * C.SPAN
    first = set(d[doc == 0].tolist())
    assert all(len(first & set(d[doc == i].tolist())) >= 0.97 * len(first) for i in (2, 6))
    assert 40 < len(first) < 900 / 4


def test_a_seed_follows_from_its_window_alone():
    """Each window of a text of short words has the seed that it has between other words."""
    r = random.Random(8)
    for most in (1, 3, 9):
        words = ["".join(r.choice("abcde") for _ in range(r.randint(1, most))) for _ in range(130)]
        whole = C._Windows(pa.array([" ".join(words)]), 51)
        for i in range(0, 80, 3):
            other = C._Windows(pa.array(["filler", " ".join(["x%d" % r.randint(0, 99) for _ in range(r.randint(0, 30))] + words[i : i + 51] + ["y%d" % r.randint(0, 99) for _ in range(r.randint(0, 30))])]), 51)
            at = [j for j in range(other.n) if other.fine[j] and other.digest[j] == whole.digest[i]]
            assert at and all((other.anchor[j] - j, other.stop[j] - j) == (whole.anchor[i] - i, whole.stop[i] - i) for j in at)
            assert whole.stop[i] - whole.anchor[i] >= C.LEAST and whole.stop[i] <= i + 51


def test_repeats_are_found_through_chunks(spark, monkeypatch):
    def none(*a):
        raise RuntimeError("no chunks")

    monkeypatch.setattr(C, "cuts", none)
    with pytest.raises(RuntimeError, match="no chunks"):
        C._Windows(pa.array([text(1, 60)]), 51)
    with pytest.raises(ValueError, match="fewer"):
        C._Windows(pa.array([text(1, 60)]), C.FEWEST - 1)


def test_ids_of_other_types(spark):
    rows = [("b", text(1, 80)), ("a", text(1, 80) + " end"), (None, text(1, 80))]
    got = C.repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(x.doc_id, x.n_words, x.first_doc_id, x.kept) for x in got} == {("a", 80, "a", True), ("b", 80, "a", False)}


def test_passages_are_caught_and_clean_texts_are_not(spark):
    r = random.Random(3)
    rows = [(i, text(10_000 + i, r.randint(20, 200))) for i in range(80)]
    for p in range(10):
        passage = text(50_000 + p, 56)
        for i in r.sample(range(80), 3):
            w = rows[i][1].split()
            c = r.randint(0, len(w))
            rows[i] = (i, " ".join([*w[:c], passage, *w[c:]]))
    got = C.repeats(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert brute(rows) <= set(got.doc_id)
    assert set(got.doc_id) <= brute(rows, 25)
    text_of = {i: t.encode() for i, t in rows}
    kept = {(text_of[x.doc_id][x.start : x.end]) for x in got.itertuples()}
    assert all(len(k.decode()) > 100 for k in kept)


def test_repeats_are_cut_from_all_but_one(spark):
    passage = text(1, 120)
    rows = [(1, "aaa " + passage + " bbb"), (2, passage + " ccc é"), (3, "nothing else")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = C.repeats(d)
    out = {r.doc_id: r.text for r in C.without_repeats(d, found).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1]
    assert len(out[2]) < 200 and out[2].endswith("ccc é")


def test_odd_rows(spark):
    d = documents(spark, "d k start words")
    got = C.repeats(d).toPandas()
    assert {30, 31} <= set(got.doc_id) and set(range(10, 16)) <= set(got.doc_id)
    assert not {40, 50, 51, 4, 1, 2, 3, 0} & set(got.doc_id)
    assert C.repeats(empty(d)).count() == 0


def test_no_passage_of_51_words_is_missed_and_none_of_50_reported(spark):
    r = random.Random(11)
    word = lambda most: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, most)))
    rows, want = [], {}
    for p in range(300):
        most, n = (1, 4)[p % 2], 50 if p % 3 == 2 else 51
        shared = [word(most) for _ in range(n)]
        for side in (0, 1):
            before, after = ([f"{'xy'[side]}{word(6)}" for _ in range(r.randint(1, 60))] for _ in range(2))
            rows.append((2 * p + side, " ".join([*before, *shared, *after])))
            if n > 50:
                at = len(" ".join(before)) + 1
                want[2 * p + side] = (at, at + len(" ".join(shared)), 51, 2 * p, side == 0)
    got = C.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == want and len(got) == len(want)
