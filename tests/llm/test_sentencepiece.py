import random

import pytest
import sentencepiece

from affinia.llm import sentencepiece_sa as S
from tests.llm.data import documents, empty

ODD = ["", "a", " a", "a ", "  hello   world  ", "\n\n a\n", "é日本語テキスト梦想", "a▁b", "x\x00y", "🙂🙂 ok", "ab" * 3000, "    " * 20, "\t\ttab", "ſK", "don't stop, 12.5%!"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def test_equal_to_the_library_and_round_trip(library):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab the\nin er é梦  ") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    c = S.Coder(S.MODEL)
    for part in (texts, texts[::-1], texts[:40]):  # from another cache each time
        ids, cut = c.encode(part)
        back = c.decode(ids, cut)
        for i, t in enumerate(part):
            assert ids[cut[i] : cut[i + 1]].tolist() == library.encode(t), t
            assert back[i].decode() == t.replace(S.SPACE, " ")


def test_pieces_are_found_where_they_are():
    import numpy as np

    m = S.Model(open(S.MODEL, "rb").read())
    raw = np.frombuffer("▁the▁there\xff".encode("latin-1", "ignore") or b"", np.uint8) if False else np.frombuffer("▁therethere".encode() + b"\xff", np.uint8)
    at, piece = S.edges(m, raw, len(raw))
    got = {(a, m.pieces[p]) for a, p in zip(at.tolist(), piece.tolist())}
    text = raw.tobytes()
    want = {(i, p) for p in m.normal for i in range(len(text)) if text.startswith(m.pieces[p].encode(), i)}
    assert got == {(i, m.pieces[p]) for i, p in want}


def test_odd_rows(spark, library):
    d = documents(spark, "ids lossless n_tokens")
    coded = S.encode(d)
    got = coded.toPandas()
    assert len(got) == d.count() and got.lossless.all()
    for r in got.itertuples():
        assert list(r.ids) == library.encode(r.text or "")
        assert r.n_tokens == len(r.ids)
    back = S.decode(coded.select("doc_id", "ids")).toPandas()
    assert sorted(map(str, back.text)) == sorted(str(t or "") for t in got.text)
    assert S.encode(empty(d)).count() == 0
