"""Removal of repeated byte strings through the Burrows-Wheeler transform of a collection, built column by column.

What is compared are windows: strings of ``length`` bytes. Those with one anchor (the GRAM bytes in a window whose hash is
least, of equals the first) that follow each other in a text are a piece: the bytes of its windows. Equal windows have
equal anchors, so pieces with one anchor go to one group and a window meets all its equals there.

1. Anchors that one document alone has are left out: each text's anchors are dealt by hash with the digests of their pieces,
   and those that two documents share are sent back to them. Where an anchor has one piece everywhere, there is nothing to
   compare: all its windows are first in the smallest document.
2. Of the other anchors each different piece is cut out once, in the smallest document that has it.
3. A task builds the transform of a group's pieces, and the common prefixes of neighbours in suffix order, column by column
   (Bauer, Cox and Rosone 2013; with prefixes, Cox et al. 2016): each round inserts one symbol of every piece, from its end
   to its beginning, where the ranks in the transform so far put the suffix that it begins. The transform and the prefixes
   are files of the task, read from front to back and written anew each round. Suffixes between which no common prefix is
   shorter than ``length`` begin with one window; the smallest document that has one of their pieces is its first.
4. A piece's first documents go to its places, joined by its digest; a piece that is very common is sent to them. Each text
   loses the bytes of windows whose first document is smaller than its own.

Pieces are cut in two first: windows with SIDE bytes or more before the anchor, and the others, which have as many behind it.
Windows of one half can only be equal if these bytes are, so halves go to groups by them: no group grows with a common string
in ever new surroundings, and a half that is alone with its bytes needs no comparison. Only a piece's digest (64 bits) stands
for it in a join.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from affinia.llm import _blocks, _text
from affinia.llm._blocks import by_count, fresh
from affinia.session import bound_batches, forget, free_shuffles, stored, table

LENGTH, GRAM, SIDE = 50, 16, 17
#: Bytes of text whose anchors one task compares, and bytes of pieces of a group.
BUCKET_BYTES, GROUP_BYTES = 16 << 20, 4 << 20
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
#: The bits of an anchor's hash by which anchors meet; the others hold a place in a batch.
_MASK = np.int64(~0xFFFF)


class _Pieces:
    """The pieces of texts that lie end to end: text, place of its first window in it, windows, and the anchor's hash and place."""

    def __init__(self, texts: pa.Array, length: int):
        self.raw, self.off = raw, off = _text.buffers(texts)
        n = len(raw) - length + 1
        if n <= 0:
            self.doc = self.lo = self.n = self.at = np.zeros(0, np.int64)
            self.d = np.zeros(0, np.int64)
            return
        h, k = _GEAR[raw], 1
        while k < GRAM:
            h[k:] = h[k:] + (h[:-k] << np.uint64(4 * k))
            k *= 2
        h = _text.mix(h[GRAM - 1 :])
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, k = length - GRAM + 1, 1
        while 2 * k <= width:
            key = np.minimum(key[:-k], key[k:])
            k *= 2
        least = (np.minimum(key[:n], key[width - k : width - k + n]) & _LOW).astype(np.int64)
        each = np.maximum(np.diff(off) - length + 1, 0)  # windows of each text
        fine = np.repeat(off[:-1] - np.cumsum(each) + each, each) + np.arange(each.sum())
        least, doc = least[fine], np.repeat(np.arange(len(each)), each)
        new = np.flatnonzero(np.r_[True, (np.diff(least) != 0) | (np.diff(doc) != 0)]) if len(fine) else np.zeros(0, np.int64)
        self.doc, self.start, self.n = doc[new], fine[new], np.diff(np.append(new, len(fine)))
        self.lo, self.at, self.d = self.start - off[self.doc], least[new], h[least[new]].view(np.int64)
        self.length = length

    def digests(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """64-bit digest of each piece; which rises."""
        if not len(self.d):
            return np.zeros(0, np.uint64)
        start = self.start[which]
        return _digests(self.raw, start, start + self.n[which] + self.length - 1)


def _shared_anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc_id, d, first, c, n) of anchors that two documents or more of docs have. Only the upper bits of d count.

    Where the anchor has one piece everywhere, first is the smallest document, whose own row is left out. Else first is
    null, and c and n, a piece and how often it is there, stand in the row of the smallest document that has it; elsewhere n is 0.
    """
    id_field = docs.schema["doc_id"]
    longs, ids_type = T.ArrayType(T.LongType()), T.ArrayType(id_field.dataType)
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("seeds", longs), T.StructField("pieces", longs), T.StructField("ids", ids_type)])
    back = T.StructType([id_field, T.StructField("d", T.LongType()), T.StructField("first", id_field.dataType), T.StructField("c", T.LongType()), T.StructField("n", T.IntegerType())])

    def sent(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1 << 16):
                part = b.slice(a, 1 << 16)
                p = _Pieces(part.column(1), length)
                seeds, c = (p.d & _MASK) | p.doc, p.digests().view(np.int64)
                bucket = _bucket(seeds, buckets)
                by = np.argsort(bucket, kind="stable")
                seeds, c, bucket = seeds[by], c[by], bucket[by].astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(seeds) else np.zeros(0, np.int64)
                for i, j in zip(cut, np.append(cut[1:], len(seeds))):
                    here, code = np.unique(seeds[i:j] & 0xFFFF, return_inverse=True)
                    ids = part.column(0).take(pa.array(here))
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array([bucket[i]], pa.int32()), one((seeds[i:j] & _MASK) | code), one(c[i:j]), one(ids)], names=out.names)
        _text.release()

    pa_back = to_arrow_schema(back)

    def met(t: pa.Table) -> pa.Table:
        seeds, pieces, ids = (t.column(x).combine_chunks() for x in ("seeds", "pieces", "ids"))
        flat, c = seeds.flatten().to_numpy(), pieces.flatten().to_numpy()
        if not len(flat):
            return pa_back.empty_table()
        d = flat & _MASK
        row = np.repeat(np.arange(len(seeds)), np.diff(seeds.offsets.to_numpy()))
        named = ids.flatten()
        order = pc.unique(named)
        order = order.take(pc.sort_indices(order))
        doc = pc.index_in(named, value_set=order).to_numpy()[ids.offsets.to_numpy()[row] - ids.offsets.to_numpy()[0] + (flat & 0xFFFF)]
        by = np.lexsort((doc, c, d))
        d, c, doc = d[by], c[by], doc[by]
        new_d = np.r_[True, np.diff(d) != 0]
        new_c = new_d | np.r_[True, np.diff(c) != 0]
        cut, group = np.flatnonzero(new_d), np.cumsum(new_d) - 1
        least, most = np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut)
        one = np.add.reduceat(new_c.astype(np.int64), cut) == 1
        pieces_at = np.flatnonzero(new_c)
        n = np.zeros(len(d), np.int32)
        n[pieces_at] = np.diff(np.append(pieces_at, len(d)))
        n[one[group]] = 0
        keep = np.flatnonzero((least < most)[group] & ~(one[group] & (doc == least[group])))
        first = order.take(pa.array(least[group][keep], mask=~one[group][keep]))
        return pa.Table.from_arrays([order.take(pa.array(doc[keep])), pa.array(d[keep]), first, pa.array(c[keep], mask=n[keep] == 0), pa.array(n[keep])], schema=pa_back)

    return docs.select("doc_id", "text").mapInArrow(sent, out).groupBy("bucket").applyInArrow(met, back)


def _bucket(d: np.ndarray, buckets: int) -> np.ndarray:
    return ((d >> 16) % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short ones sort fast


def _places(docs: DataFrame, length: int) -> DataFrame:
    """What the anchors in seeds (d, first, c, n) of docs (doc_id, text, version, seeds) stand for.

    Of anchors with one piece everywhere: bytes start .. end that a smaller document has. Of others: start of each piece, its
    digest c, and where n names this document for it also n, d, the piece and the anchor's place ``at`` in it.
    """
    id_field = docs.schema["doc_id"]
    out = T.StructType([id_field, *T.StructType.fromDDL("version long, start int, end int, c long, n int, d long, at int, piece binary").fields])

    def run(batches):
        for b in batches:
            p = _Pieces(b.column(1), length)
            lists = b.column(3)
            flat = lists.flatten()
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            known = (flat.field("d").to_numpy() & _MASK) | owner  # a batch has far fewer rows than 65,536
            by = np.argsort(known, kind="stable")
            known = known[by]
            known, at = np.unique(known, return_index=True)
            seeds = (p.d & _MASK) | p.doc
            hit = np.searchsorted(known, seeds)
            pick = np.flatnonzero(known[np.minimum(hit, len(known) - 1)] == seeds) if len(known) else np.zeros(0, np.int64)
            which = hit[pick]
            first = flat.field("first").take(pa.array(by[at][which]))
            alone = first.is_valid().to_numpy(zero_copy_only=False)
            smaller = pick[alone][pc.less(first.drop_null(), b.column(0).take(pa.array(p.doc[pick[alone]]))).to_numpy(zero_copy_only=False)] if alone.any() else pick[:0]
            if len(smaller):  # pieces that follow each other are one span
                new = np.flatnonzero(np.r_[True, np.diff(smaller) != 1])
                last = np.append(new[1:], len(smaller)) - 1
                lo, hi, doc = p.lo[smaller[new]], (p.lo + p.n)[smaller[last]] + length - 1, p.doc[smaller[new]]
                same = np.flatnonzero(p.doc[smaller[last]] == doc)
                if len(same) < len(doc):  # a run that goes on into the next text: by single pieces
                    lo, hi, doc = p.lo[smaller], (p.lo + p.n)[smaller] + length - 1, p.doc[smaller]
                yield from _rows(b, out, doc, lo, hi)
            many = pick[~alone]
            if len(many):
                c = p.digests(many).view(np.int64)
                mine, told = _with(c, p.doc[many]), flat.field("n").to_numpy() > 0
                names, size = _with(flat.field("c").fill_null(0).to_numpy()[told], owner[told]), flat.field("n").to_numpy()[told]
                names, one = np.unique(names, return_index=True)
                spot = np.minimum(np.searchsorted(names, mine), max(len(names) - 1, 0))
                tell = names[spot] == mine if len(names) else np.zeros(len(mine), bool)
                n_here = size[one][spot] if len(names) else np.zeros(len(mine), np.int32)
                for i in range(0, len(many), 4096):
                    x, t = many[i : i + 4096], tell[i : i + 4096]
                    start, end = p.start[x], p.start[x] + p.n[x] + length - 1
                    blob = pa.array([p.raw[u:v].tobytes() if w else None for u, v, w in zip(start.tolist(), end.tolist(), t.tolist())], pa.binary())
                    none = lambda v, kind: pa.array(v, kind, mask=~t)  # noqa: E731, B023
                    yield from _rows(b, out, p.doc[x], p.lo[x], None, pa.array(c[i : i + 4096]), none(n_here[i : i + 4096], pa.int32()), none(p.d[x], pa.int64()), none(p.at[x] - start, pa.int32()), blob)
        _text.release()

    return docs.select("doc_id", "text", "version", "seeds").mapInArrow(run, out)


def _with(c: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for a digest and a row of the batch."""
    return c.view(np.uint64) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _rows(b: pa.RecordBatch, out: T.StructType, doc: np.ndarray, start: np.ndarray, end: np.ndarray | None, *more: pa.Array):
    who, kinds = pa.array(doc), to_arrow_schema(out)
    last = pa.array(end.astype(np.int32)) if end is not None else pa.nulls(len(doc), pa.int32())
    more = more or [pa.nulls(len(doc), f.type) for f in list(kinds)[4:]]
    yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(2).take(who), pa.array(start.astype(np.int32)), last, *more], names=out.names)


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digest of each span of bytes; starts and ends rise."""
    d, i = np.empty(len(ends), np.uint64), 0
    while i < len(ends):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + _text._SLICE)))
        stop = int(ends[j - 1])
        up, down = _text._powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((raw[base:stop].astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93)) * up[: stop - base], out=sums[1:])
        d[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return _text.mix(d + (ends - starts).astype(np.uint64))


def transform(pieces: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, prefixes) of the pieces: for each suffix in order, first the empty ones, the symbol before it, with 256 (or
    255 where no piece has that byte) at a piece's beginning, and how many bytes it shares with the suffix before it, ``most`` at most.

    Each round reads the two files of the round before from front to back and writes new ones.
    """
    m, size = len(pieces), np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(size) - size
    kind, none = (np.uint8, 255) if not (data == 255).any() else (np.uint16, 256)
    data = np.append(data, 0).astype(kind)
    symbol = lambda i, t: np.where(size[i] > t, data[begin[i] + np.maximum(size[i] - t - 1, 0)], kind(none))
    with tempfile.TemporaryFile() as a, tempfile.TemporaryFile() as b:
        files, n = [a, b], m
        who = np.arange(m)  # whose suffixes the last round inserted, by their places
        at = np.arange(m)
        _write(files[0], symbol(who, 0), np.zeros(m, np.uint8))
        for t in range(1, int(size.max(initial=0)) + 1):
            bwt, lcp = _read(files[0], n, kind)
            going = size[who] >= t
            who, at = who[going], at[going]
            order = np.argsort(bwt, kind="stable")
            ends = np.cumsum(np.bincount(bwt, minlength=257))
            mine = bwt[at]
            by = np.argsort(mine, kind="stable")
            who, place, cut = who[by], at[by], np.flatnonzero(np.diff(mine[by].astype(np.int64), prepend=-1))
            rank = np.empty(len(at), np.int64)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):  # one symbol: its places rise
                c = int(mine[by[i]])
                first = int(ends[c - 1]) if c else 0
                rank[i:j] = first + np.searchsorted(order[first : ends[c]], place[i:j])
            new = m + rank  # places of the suffixes that begin with the symbols at ``place``
            far = np.append(lcp, 0)
            before = order[rank - 1]
            alike = (rank > 0) & (bwt[before] == bwt[place])
            shares = np.where(alike, _least(far, np.where(alike, before, place - 1) + 1, place + 1) + 1, 0)
            after = order[np.minimum(rank + 1, n - 1)]
            old = (rank + 1 < n) & (bwt[after] == bwt[place]) & (np.append(rank[1:], -1) != rank + 1)
            then = _least(far, place[old] + 1, after[old] + 1) + 1
            grown = np.ones(n + len(new), bool)
            grown[new] = False
            bwt2, lcp2 = np.empty(n + len(new), kind), np.empty(n + len(new), np.uint8)
            bwt2[grown], lcp2[grown] = bwt, lcp
            bwt2[new], lcp2[new] = symbol(who, t), np.minimum(shares, most)
            lcp2[new[old] + 1] = np.minimum(then, most)
            n, at = len(bwt2), new
            _write(files[1], bwt2, lcp2)
            files.reverse()
        return _read(files[0], n, kind)


def _least(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of values[start:end] for each pair; no range is empty."""
    if not len(starts):
        return np.zeros(0, np.int64)
    down = np.argsort(-ends, kind="stable")  # so that what lies between two ranges is never read
    pairs = np.stack([starts[down], ends[down]], 1).ravel()
    out = np.empty(len(starts), np.int64)
    out[down] = np.minimum.reduceat(values, pairs)[::2]
    return out


def _write(f, *columns: np.ndarray) -> None:
    f.seek(0)
    f.truncate()
    for c in columns:
        f.write(c.data)
    f.flush()


def _read(f, n: int, kind) -> tuple[np.ndarray, np.ndarray]:
    f.seek(0)
    return np.fromfile(f, kind, n), np.fromfile(f, np.uint8, n)


def suffixes(bwt: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and length of each suffix, read off the transform from each piece's end to its beginning."""
    m = len(size)
    step = np.empty(len(bwt), np.int64)
    step[np.argsort(bwt, kind="stable")] = m + np.arange(len(bwt))
    piece, long = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
    at, who = np.arange(m), np.arange(m)
    for t in range(int(size.max(initial=0)) + 1):
        piece[at], long[at] = who, t
        going = size[who] > t
        at, who = step[at[going]], who[going]
    return piece, long


def first_documents(pieces: list[bytes], smallest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, window in it, smallest of the numbers of all pieces that hold the window), sorted by the first two."""
    bwt, lcp = transform(pieces, length)
    size = np.array([len(p) for p in pieces])
    piece, long = suffixes(bwt, size)
    run = np.cumsum(lcp < length)
    whole = np.flatnonzero(long >= length)
    piece, long, run = piece[whole], long[whole], run[whole]
    first = np.full(run.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, run, smallest[piece])
    window = size[piece] - long
    by = np.lexsort((window, piece))
    return piece[by], window[by], first[run[by]]


def _firsts(pieces: DataFrame, length: int, groups: int) -> DataFrame:
    """(c, n, spans) of pieces: the first documents k of their windows lo to hi, and in how many documents the piece is.
    Windows that the smallest document of a piece has alone are left out."""
    id_type = pieces.schema["k"].dataType
    span = T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("k", id_type)])
    out = T.StructType.fromDDL("c long, n long").add("spans", T.ArrayType(span))
    pa_out = to_arrow_schema(out)

    def run(t: pa.Table) -> pa.Table:
        t = t.group_by(["key", "piece", "c", "move"]).aggregate([("k", "min"), ("n", "max")])
        ids = pc.unique(t.column("k_min"))
        ids = ids.take(pc.sort_indices(ids))
        k, n = pc.index_in(t.column("k_min"), value_set=ids).to_numpy(), t.column("n_max").to_numpy()
        _, code, count = np.unique(t.column("key").to_numpy(), return_inverse=True, return_counts=True)
        alone = count[code] == 1  # no other half has its bytes
        some = np.flatnonzero(~alone)
        piece, window, first = first_documents(t.column("piece").take(pa.array(some)).to_pylist(), k[some].astype(np.int64), length)
        piece = some[piece]
        new = np.flatnonzero(np.r_[True, (np.diff(piece) != 0) | (np.diff(window) != 1) | (np.diff(first) != 0)]) if len(piece) else np.zeros(0, np.int64)
        owner, lo = piece[new], window[new]
        hi, who = lo + np.diff(np.append(new, len(piece))) - 1, first[new]
        more = np.flatnonzero(alone & (n > 1))
        owner, lo, hi, who = np.append(owner, more), np.append(lo, 0 * more), np.append(hi, pc.binary_length(t.column("piece")).to_numpy()[more] - length), np.append(who, k[more])
        by = np.argsort(owner, kind="stable")
        by = by[(who[by] < k[owner[by]]) | (n[owner[by]] > 1)]
        owner, lo, hi, who = owner[by], lo[by], hi[by], who[by]
        lo, hi = (x + t.column("move").to_numpy()[owner] for x in (lo, hi))
        named, cut = np.unique(owner, return_index=True)
        spans = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), ids.take(pa.array(who))], fields=list(pa_out.field("spans").type.value_type))
        _text.release()
        at = pa.array(named)
        return pa.Table.from_arrays([t.column("c").take(at).combine_chunks(), t.column("n_max").take(at).combine_chunks(), pa.ListArray.from_arrays(pa.array(np.append(cut, len(owner)).astype(np.int32)), spans)], names=["c", "n", "spans"]).cast(pa_out)

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    found = dealt.select("group", "key", "c", "piece", "move", "k", "n").groupBy("group").applyInArrow(run, out)
    return found.groupBy("c").agg(F.max("n").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"))  # two halves


def _halves(pieces: DataFrame, length: int) -> DataFrame:
    """pieces cut in two, with the key by which halves meet; move is the first window that is left."""
    # Window w holds the bytes w .. w + length - 1, and the anchor's begin at ``at``.
    windows = F.octet_length("piece") - (length - 1)
    t = pieces.withColumn("_left", F.least(windows, F.greatest(F.lit(0), F.col("at") - SIDE + 1)))  # windows before this hold SIDE bytes before the anchor
    cut = lambda a, n: F.substring("piece", a + 1, n)
    a = t.where("_left > 0").withColumns({"key": F.xxhash64("d", F.lit(0), cut(F.col("at") - SIDE, F.lit(SIDE))), "move": F.lit(0), "piece": cut(F.lit(0), F.col("_left") + length - 1)})
    b = t.where(F.col("_left") < windows).withColumns({"key": F.xxhash64("d", F.lit(1), cut(F.col("at") + GRAM, F.lit(SIDE))), "move": F.col("_left"), "piece": cut(F.col("_left"), F.octet_length("piece"))})
    return a.unionByName(b).drop("_left")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, version, spans) of rows in which windows also start in a document with a smaller doc_id: their places from
    the first byte to after the last, as start and end, in no order. version is xxhash64(text), which tells rows of one
    doc_id apart; equal rows have one."""
    return _repeated(docs, length)[0]


def _repeated(docs: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """What repeated() gives, and the written tables that it reads."""
    spark = docs.sparkSession
    bound_batches(spark)
    t = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select("doc_id", "text")
    total = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    seeds = stored(_shared_anchors(t, length, 1 + total // BUCKET_BYTES), "seeds", "zstd")
    free_shuffles(spark)
    by_doc = seeds.groupBy("doc_id").agg(F.collect_list(F.struct("d", "first", "c", "n")).alias("seeds"))
    found = stored(_places(t.withColumn("version", F.xxhash64("text")).join(by_doc, "doc_id"), length), "places", "zstd")
    forget(seeds)
    free_shuffles(spark)
    pieces = found.where("piece IS NOT NULL").select("d", "at", "c", "piece", F.col("doc_id").alias("k"), F.col("n").cast("long").alias("n"))
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    firsts = stored(_firsts(_halves(pieces, length), length, 1 + size // GROUP_BYTES), "firsts", "zstd")
    free_shuffles(spark)
    places = found.where("end IS NULL").select("c", "doc_id", "version", F.col("start").alias("place"))
    hits = by_count(places, firsts, "c", "n", firsts.agg(F.sum("n")).first()[0] or 0, "inner")
    spans = F.transform(F.filter("spans", lambda s: s["k"] < F.col("doc_id")), lambda s: F.struct((F.col("place") + s["lo"]).alias("start"), (F.col("place") + s["hi"] + length).alias("end")))
    hits = hits.select("doc_id", "version", spans.alias("spans")).where(F.size("spans") > 0)
    plain = found.where("end IS NOT NULL").select("doc_id", "version", F.array(F.struct("start", "end")).alias("spans"))
    return hits.unionByName(plain).groupBy("doc_id", "version").agg(F.flatten(F.collect_list("spans")).alias("spans")), [found, firsts]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch no other, in order, that cover the same bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs plus ``kept``, the UTF-8 bytes of the text that are left, n_bytes of the text, n_removed and n_spans, the maximal
    runs of what goes.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id; all texts are
    judged as they came. doc_id is of any type with an order. Rows without it neither lose bytes nor take any from others;
    rows with one doc_id are one document, whose texts don't take from each other; a null text has no bytes, and a text
    shorter than ``length`` loses none. Bytes, not characters, are cut, so ``kept`` may not be text. An empty table gives
    an empty one. Columns of docs called like the new ones are replaced, the others stay.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    docs = docs.drop(*new)
    version, spans = fresh(docs, "_version", "_spans")
    found, read = _repeated(docs, length)
    found = stored(found.toDF("doc_id", version, spans), "spans")
    for x in read:
        forget(x)
    free_shuffles(docs.sparkSession)
    ids = stored(found.select("doc_id").distinct(), "ids")
    named = docs.withColumn(version, F.xxhash64("text"))
    hit = _blocks.by_ids(named, ids, "doc_id", "left_semi").join(found, ["doc_id", version], "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{spans}`"))
    rest = _blocks.by_ids(docs, ids, "doc_id", "left_anti")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rest = rest.select(*[F.col(f"`{c}`") for c in docs.columns], raw.alias("kept"), F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    out = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("kept binary, n_bytes long, n_removed long, n_spans long").fields])
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            raw, off = _text.buffers(b.column(at))
            kept, gone, runs = [], [], []
            for i, x in enumerate(b.column(b.num_columns - 1).to_pylist()):
                text = raw[off[i] : off[i + 1]].tobytes()
                cuts = merged([(s["start"], s["end"]) for s in x or []])
                edges = [0, *(e for c in cuts for e in c), len(text)]
                kept.append(b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
                gone.append(len(text) - len(kept[-1]))
                runs.append(len(cuts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.binary()), pa.array(np.diff(off)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=out.names)

    return hit.mapInArrow(run, out).unionByName(rest)


def op13_bwt_dedup(spark, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
