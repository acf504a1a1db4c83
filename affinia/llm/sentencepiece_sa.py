"""SentencePiece encoding and decoding by suffix-array matching.

For a batch the units not met before (a unit is a run of spaces and what follows it up to the next space or line end;
no piece crosses that border) are laid end to end, their suffixes are sorted as deep as the longest piece, and each
piece's occurrences are found by binary search. The occurrences are the edges of a lattice; sorted by position they are
relaxed, one position of all units at a time.

The model at hand is of the BPE kind, for which the best path is not the one of largest total score. Its encoding of
every prefix ends in exactly one piece, and the encoding is the only path on which each two neighbours are what BPE
makes of their joined text. So an edge is relaxed if BPE leaves it apart from the piece before it; such pairs are
worked out once and kept. Characters that no piece has become byte pieces. The results equal the library's.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm._text import release
from affinia.session import bound_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SEP = 0xFF
START, UNKNOWN = -2, -1
#: Units and pairs of pieces that a worker remembers, units it looks up at once, and a unit's bytes above which it isn't kept.
KEEP_UNITS, SEEN, AT_ONCE, KEEP_BYTES = 300_000, 1 << 21, 12_000, 1 << 16
#: Rows that a worker encodes at a time.
ROWS = 256


def _fields(buf: bytes):
    """Fields of a protocol-buffer message: number, and an int, or bytes."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(buf):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, buf[i : i + n]
            i += n


def _spot(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (SEEN.bit_length() - 1))).astype(np.int64)


class Model:
    """Pieces of a model file, and what BPE makes of short texts."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        kinds, scores = [], []
        self.prefix = True
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                scores.append(np.frombuffer(got[2], "<f4")[0] if 2 in got else 0.0)
                kinds.append(got.get(3, 1))
            elif number == 3:
                got = dict(_fields(value))
                if got.get(2) or got.get(4, 1):
                    raise ValueError("only models without a normalisation table, and that keep white space, are supported")
                self.prefix = bool(got.get(3, 1))
        kinds, self.scores = np.array(kinds), np.array(scores)
        self.byte_id = np.zeros(256, np.int32)
        self.text = []
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == 6:
                self.byte_id[int(p[3:5], 16)] = i
            self.text.append(bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() if k in (1, 4) else b"")
        self.ids = {self.pieces[i]: i for i in np.flatnonzero(kinds == 1).tolist()}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = any("\n" in p for p in self.ids)
        self.unit = re.compile(r"(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if lines else f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        # The others never come out. In the order of their bytes, so that a search for all goes through the text once.
        self.normal = sorted((i for p, i in self.ids.items() if self.bpe(p) == [i]), key=lambda i: self.pieces[i].encode())
        self.normal_bytes = [self.pieces[i].encode() for i in self.normal]
        self.length = np.array([len(p.encode()) for p in self.pieces], np.int64)
        self.normal_ids = np.array(self.normal, np.int64)
        self.normal_length = self.length[self.normal_ids]
        number = lambda pad: np.array([int.from_bytes(p[:8].ljust(8, pad), "big") for p in self.normal_bytes], np.uint64)
        self.low, self.high = number(b"\0"), number(b"\xff")
        self.deep = max(map(len, self.normal_bytes))
        self.out_len = np.array([len(t) for t in self.text], np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])
        self.out = np.frombuffer(b"".join(self.text), np.uint8)
        self.seen = np.full(SEEN, -1, np.int64)  # pairs of pieces worked out, each in its one place
        self.apart = np.zeros(SEEN, bool)

    def bpe(self, text: str) -> list[int]:
        """Merge the pair of best score, the leftmost of equals, until none is a piece; UNKNOWN for other characters."""
        s = list(text)
        ids = self.ids
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                k = ids.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return [ids.get(x, UNKNOWN) for x in s]

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each two pieces apart; it does next to the begin and to unknown characters."""
        code = left.astype(np.int64) * len(self.pieces) + right
        place = _spot(code)
        free = (left < 0) | (right < 0)
        out = free | self.apart[place]
        missing = np.flatnonzero(~free & (self.seen[place] != code))
        if len(missing):
            pairs, back = np.unique(code[missing], return_inverse=True)
            ok = np.array([self.bpe(self.pieces[a] + self.pieces[b]) == [a, b] for a, b in (divmod(c, len(self.pieces)) for c in pairs.tolist())])
            out[missing] = ok[back]
            at = _spot(pairs)
            self.seen[at], self.apart[at] = pairs, ok
            self.apart[at] = ok[np.searchsorted(pairs, self.seen[at])]  # where two met in one place, the one that stayed
        return out


def _keys(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number each; past the end there are separators."""
    wide = np.concatenate([raw, np.full(8, SEP, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)).view(">u8").ravel().astype(np.uint64)


def suffix_array(raw: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first deep bytes, or up to the separator, and the first eight bytes of each.

    They are sorted by eight bytes, then ties by eight more, until none is left.
    """
    n = len(raw)
    key = _keys(raw)
    stops = np.append(np.flatnonzero(raw == SEP), n)
    left = (np.repeat(stops, np.diff(stops, prepend=-1)))[:n] - np.arange(n)  # bytes before the separator
    order = np.argsort(key[:n])
    got = key[order]
    where, depth = np.arange(n), 8  # places in order that may still be tied
    group = np.concatenate([[0], np.cumsum(got[1:] != got[:-1])]) if n else where
    while depth < deep:
        tied = np.zeros(len(where), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        tied &= left[order[where]] >= depth
        where, group = where[tied], group[tied]
        if not len(where):
            break
        at = order[where]
        more = key[np.minimum(at + depth, n)]
        by = np.lexsort((more, group))
        order[where] = at[by]
        group, more = group[by], more[by]
        group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (more[1:] != more[:-1]))])
        depth += 8
    return order, got


def edges(model: Model, raw: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and piece of every occurrence of every piece in the text, whose units have at most longest bytes."""
    order, got = suffix_array(raw, min(model.deep, longest))
    # Binary search of all pieces by eight bytes; of the longer ones that may be there, by all of theirs.
    lo, hi = np.searchsorted(got, model.low), np.searchsorted(got, model.high, "right")
    long = np.flatnonzero((hi > lo) & (model.normal_length > 8))
    if len(long):
        deep = int(model.normal_length[long].max())
        some = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(lo[long].tolist(), hi[long].tolist())]))
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.full(deep, SEP, np.uint8)]), deep)
        text = np.ascontiguousarray(view[order[some]]).view(f"S{deep}").ravel()
        pieces = [model.normal_bytes[i] for i in long.tolist()]
        a = np.searchsorted(text, np.array(pieces, f"S{deep}"))
        b = np.searchsorted(text, np.array([p.ljust(deep, b"\xff") for p in pieces], f"S{deep}"), "right")
        # A piece's occurrences are neighbours in the order, so among the ones looked at too.
        lo[long] = np.where(b > a, some[np.minimum(a, len(some) - 1)], 0)
        hi[long] = lo[long] + (b - a)
    n = hi - lo
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return order[at], np.repeat(model.normal_ids, n)


def encode_units(model: Model, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and how many each has; spaces are given as the model writes them."""
    coded = [u.encode() for u in units]
    raw = np.frombuffer(b"\xff".join(coded) + b"\xff", np.uint8)
    size = np.array([len(c) for c in coded], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    pos, piece = edges(model, raw, int(size.max(initial=1)))
    end = pos + model.length[piece]
    # Characters that are no piece of their own.
    lead = np.flatnonzero(((raw & 0xC0) != 0x80) & (raw != SEP))
    stop = np.concatenate([lead[1:], [len(raw)]])
    last_of_unit = raw[np.minimum(stop - 1, len(raw) - 1)] == SEP
    stop = stop - last_of_unit
    single = np.zeros(len(raw) + 1, bool)
    single_end = np.zeros(len(raw) + 1, np.int64)
    single_end[lead] = stop
    single[pos[single_end[pos] == end]] = True
    lost = ~single[lead]
    pos, end, piece = np.concatenate([pos, lead[lost]]), np.concatenate([end, stop[lost]]), np.concatenate([piece, np.full(lost.sum(), UNKNOWN)])
    rel = pos - np.repeat(first, size + 1)[pos]
    order = np.argsort(rel.astype(np.int32), kind="stable")
    pos, end, piece, rel = pos[order], end[order], piece[order], rel[order]
    tail = np.full(len(raw) + 1, -3, np.int64)  # last piece of the encoding up to here
    came = np.zeros(len(raw) + 1, np.int64)
    tail[first] = START
    cuts = np.searchsorted(rel, np.arange(int(size.max(initial=0)) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a == b:
            continue
        p, e, t = pos[a:b], end[a:b], piece[a:b]
        before = tail[p]
        ok = before > -3
        p, e, t, before = p[ok], e[ok], t[ok], before[ok]
        ok = model.stay_apart(before, t)
        tail[e[ok]], came[e[ok]] = t[ok], p[ok]
    # Back from each unit's end; a byte of a lost character counts as one id.
    at, live, who, ids = first + size, np.arange(len(units)), [], []
    while True:
        live = live[at[live] > first[live]]
        if not len(live):
            break
        t, e = tail[at[live]], at[live]
        f = came[e]
        lost = np.flatnonzero(t == UNKNOWN)
        if len(lost):
            n = (e - f)[lost]
            back = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who.append(np.repeat(live[lost], n))
            ids.append(model.byte_id[raw[np.repeat(e[lost] - 1, n) - back]])
            keep = t != UNKNOWN
            who.append(live[keep]), ids.append(t[keep])
        else:
            who.append(live), ids.append(t)
        at[live] = f
    who, ids = np.concatenate([np.zeros(0, np.int64), *who])[::-1], np.concatenate([np.zeros(0, np.int64), *ids])[::-1].astype(np.int32)
    order = np.argsort(who, kind="stable")
    return ids[order], np.bincount(who, minlength=len(units))


class Coder:
    """A model with the units met so far; one to a Python worker."""

    def __init__(self, model: str | bytes):
        """model is a path or a model file's bytes."""
        self.model = Model(model if isinstance(model, bytes) else _read(model))
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin and end. A null text has none, as an empty one."""
        if len(self.index) > KEEP_UNITS:
            self.clear()
        find, index = self.model.unit.findall, self.index
        units = [find(((SPACE if self.model.prefix else "") + t).replace(" ", SPACE)) if t else [] for t in texts]
        flat = list(chain.from_iterable(units))
        which = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
        unmet = np.flatnonzero(which < 0).tolist()
        new = list(dict.fromkeys(flat[i] for i in unmet))
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            ids, n = encode_units(self.model, part)
            index.update(zip(part, range(len(self.at) - 1, len(self.at) - 1 + len(part))))
            end = int(self.at[-1]) + len(ids)
            if end > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
            self.ids[self.at[-1] : end] = ids
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
        where = self.at
        which[unmet] = [index[flat[i]] for i in unmet]
        per_unit = where[which + 1] - where[which]
        ends = np.concatenate([[0], np.cumsum(per_unit)])
        got = self.ids[np.arange(ends[-1]) - np.repeat(ends[:-1], per_unit) + np.repeat(where[which], per_unit)]
        for u in [u for u in new if len(u) > KEEP_BYTES]:  # an odd, very long unit is not kept
            index.pop(u)
        return got, ends[np.concatenate([[0], np.cumsum([len(us) for us in units])]).astype(np.int64)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids."""
        m = self.model
        n = m.out_len[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = m.out[np.arange(ends[-1], dtype=np.int64) + np.repeat(m.out_at[ids] - ends[:-1], n)].tobytes()
        cut = ends[at].tolist()
        skip = int(m.prefix)
        return [raw[a + skip if raw[a : a + 1] == b" " else a : b] if skip else raw[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_coders: dict[bytes, Coder] = {}


def coder(model: bytes) -> Coder:
    """This worker's coder of a model file."""
    name = hashlib.sha256(model).digest()
    if name not in _coders:
        _coders[name] = Coder(model)
    return _coders[name]


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """docs plus ids, n_tokens, ids_sha256 and lossless; columns of these names are replaced.

    model is a path that the driver can read; the file goes to the tasks. A null or empty text has no ids. lossless tells that decoding gives the
    text back, as it does unless the text has the character that the model writes spaces with. Repeated rows get equal
    ids, an empty table none.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens", "ids_sha256", "lossless")
    at = docs.columns.index(text)
    held = _read(model)
    schema = docs.withColumns({"ids": F.array().cast("array<int>"), "n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "lossless": F.lit(True)}).schema

    def run(batches):
        c = coder(held)
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            texts = b.column(at).to_pylist()
            ids, cut = c.encode(texts)
            back = c.decode(ids, cut)
            same = [x == (t or "").encode() for x, t in zip(back, texts)]
            packed = ids.astype("<i4").tobytes()
            sha = [hashlib.sha256(packed[4 * i : 4 * j]).hexdigest() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.diff(cut)), pa.array(sha), pa.array(same)], names=[f.name for f in schema])
        release()

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """coded, which has ids, plus text; bytes that are no UTF-8 become the replacement character, null ids a null."""
    bound_batches(coded.sparkSession)
    coded = coded.drop("text")
    at = coded.columns.index("ids")
    held = _read(model)
    schema = coded.withColumn("text", F.lit("")).schema

    def run(batches):
        c = coder(held)
        for b in batches:
            x = b.column(at)
            off = x.offsets.to_numpy().astype(np.int64)
            texts = c.decode(x.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64), off - off[0])
            out = [None if null else t.decode("utf-8", "replace") for t, null in zip(texts, x.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[f.name for f in schema])

    return coded.mapInArrow(run, schema)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
