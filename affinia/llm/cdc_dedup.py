"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text and is read where a word begins, over the last GEAR_BYTES bytes. A word is a
cut if its hash is the least among some SPAN words in a row (of equals the first); the bytes between two cuts are a
chunk. So a chunk has SPAN words at most, and where it begins and ends depends on the words around it alone: text put in
before it moves it, but changes nothing.

A repeat is a stretch of ``min_words`` words or more, equal byte by byte from its first word to its last, that another
document has too. Each window of ``min_words`` words has a seed: the chunks from the least of its first SPAN hashes on
that together have LEAST words. These cuts follow from the window's own bytes (see _Windows), so equal windows have equal
seeds. Seeds are deduplicated by their digest. One that a single document has rules all its windows out. The others are
extended to the windows that they stand for: where these are the same wherever the seed stands, they are repeats without
a further look; else each window is digested and meets its equals by that. Windows that follow each other become one
stretch with its true ends. So none of ``min_words`` words is missed, and a false one takes two texts with one 64-bit
digest. Each is kept in the document with the smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.llm import _blocks, _text
from affinia.llm._blocks import by_count
from affinia.session import bound_batches, forget, stored, table

GEAR_BYTES, SPAN, LEAST = 8, 12, 12
#: A repeat has over 50 words.
MIN_WORDS = 51
#: Windows of fewer words may hold no whole seed: 4 words can fill GEAR_BYTES, then come SPAN - 1, LEAST + SPAN - 1 and SPAN.
FEWEST = 4 + SPAN - 1 + LEAST + SPAN - 1 + SPAN
_GEAR = np.random.default_rng(99).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """Rolling hash of the GEAR_BYTES bytes before each byte (and before the end)."""
    h = np.zeros(len(raw) + 1, np.uint32)
    h[1:] = _GEAR[raw]
    k = 1
    while k < GEAR_BYTES:
        h[k:] = h[k:] + (h[:-k] << np.uint32(4 * k))
        k *= 2
    return h


def cuts(raw: np.ndarray, off: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that are cuts, the word of the least hash among each word and the SPAN - 1 after it) of texts end to end.

    Words too near a text's start for a whole hash come last in order, and no text takes part in another's.
    """
    n = len(start)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    top = np.uint64(0xFFFFFFFF)
    h = np.where(start - off[doc] < GEAR_BYTES, top, gear(raw)[start].astype(np.uint64))
    place = np.arange(n) + doc * SPAN  # as many empty places after each text
    key = np.full((place[-1] + 1 if n else 0) + SPAN, np.iinfo(np.uint64).max)
    key[place] = (h << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    least, k = key, 1
    while 2 * k <= SPAN:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if SPAN > k:
        least = np.minimum(least[: len(key) - SPAN + 1], least[SPAN - k : SPAN - k + len(key) - SPAN + 1])
    at = (least[place] & top).astype(np.int64)
    return np.unique(at), at


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digest of the bytes and length of each span; starts and ends rise."""
    d = np.empty(len(ends), np.uint64)
    i = 0
    while i < len(ends):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + _text._SLICE)))
        stop = int(ends[j - 1])
        up, down = _text._powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((raw[base:stop].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: stop - base], out=sums[1:])
        d[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return _text.mix(d + (ends - starts).astype(np.uint64))


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in it, bytes and digest of every chunk; what stands before a text's first cut is a chunk, and so is the rest."""
    raw, off = _text.buffers(texts)
    start, _, _, first = _text.words(raw, off)
    begin = np.unique(np.concatenate([start[cuts(raw, off, start, first)[0]], off[:-1][np.diff(off) > 0]]).astype(np.int64))
    end = np.append(begin[1:], len(raw))[: len(begin)]
    doc = np.searchsorted(off, begin, "right") - 1
    return doc, begin - off[doc], end - begin, _digests(raw, begin, end)


class _Windows:
    """Windows of so many words of texts that lie end to end: digests, and the words where the seed of each begins and ends."""

    def __init__(self, texts: pa.Array, words: int):
        raw, off = _text.buffers(texts)
        self.start, self.end, _, self.first = _text.words(raw, off)
        if words < FEWEST:
            raise ValueError(f"windows of fewer than {FEWEST} words may hold no whole seed")
        self.words, self.n = words, max(0, len(self.start) - words + 1)
        if not self.n:
            return
        whole = _digests(raw, self.start, np.append(self.start[1:], len(raw)))  # with what stands before the next word
        bare = _digests(raw, self.start, self.end)
        by = np.uint64(0x9FB21C651E98DF25)
        acc = np.zeros(self.n, np.uint64)
        for j in range(words - 1):
            acc += whole[j : j + self.n]
            acc *= by
        self.digest = _text.mix(acc + bare[words - 1 : words - 1 + self.n])
        # The seed starts at the least hash of the first words whose hash lies inside the window. A cut after it can't come
        # from words before the window: these SPAN words would hold the seed's start, whose hash is less. Nor from words
        # after the window, for its SPAN words end inside. So the cuts of a seed are the same wherever its window stands.
        cut, least = cuts(raw, off, self.start, self.first)
        inner = np.minimum(np.searchsorted(self.start, self.start[: self.n] + GEAR_BYTES), len(self.start) - 1)
        self.anchor = least[inner]
        stop = np.searchsorted(cut, self.anchor + LEAST)
        self.stop = np.append(cut, len(self.start) - 1)[stop]
        place = np.arange(self.n)
        self.doc = np.searchsorted(self.first, place, "right") - 1
        self.fine = place + words <= self.first[self.doc + 1]
        self.base = off[:-1]
        self.raw = raw

    def seeds(self, lo: np.ndarray) -> np.ndarray:
        """Digests of the seeds of the windows lo."""
        return _digests(self.raw, self.start[self.anchor[lo]], self.start[self.stop[lo]])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
        """Place of the window lo by words, and bytes from its start to the end of the window hi, all in their text."""
        doc = self.doc[lo]
        return [pa.array(x.astype(np.int32)) for x in (lo - self.first[doc], self.start[lo] - self.base[doc], self.end[hi + self.words - 1] - self.base[doc])]


def _schema(docs: DataFrame, more: str = "") -> T.StructType:
    ddl = T.StructType.fromDDL
    return T.StructType([*ddl("d long").fields, docs.schema["doc_id"], *ddl("lo int, start int, end int, n short").fields, *(ddl(more).fields if more else [])])


def seeds(docs: DataFrame, words: int) -> DataFrame:
    """(d, doc_id, lo, start, end, n, c) of every seed: its n windows begin at the word lo; c is their digest."""

    def run(batches):
        for b in batches:
            w = _Windows(b.column(1), words)
            v = np.flatnonzero(w.fine) if w.n else np.zeros(0, np.int64)
            if len(v):
                cut = np.flatnonzero((np.diff(v) != 1) | (np.diff(w.anchor[v]) != 0)) + 1
                lo, hi = v[np.concatenate([[0], cut])], v[np.concatenate([cut - 1, [len(v) - 1]])]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.digest)])
                c = _text.mix(sums[hi + 1] - sums[lo] + (hi - lo).astype(np.uint64))
                d = w.seeds(lo)
                yield pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), b.column(0).take(pa.array(w.doc[lo])), *w.spans(lo, hi), pa.array((hi - lo + 1).astype(np.int16)), pa.array(c.view(np.int64))], names=["d", "doc_id", "lo", "start", "end", "n", "c"])
        _text.release()

    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs, "c long"))


def windows(docs: DataFrame, words: int) -> DataFrame:
    """(d, doc_id, lo, start, end, n) of the windows named in places, an array of (lo, n); d is a window's digest."""

    def run(batches):
        for b in batches:
            w = _Windows(b.column(1), words)
            if w.n:
                lists = b.column(2)
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                lo, n = flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                i = np.repeat(w.first[row] + lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                own = np.repeat(row, n)
                here = i < w.n
                i, own = i[here], own[here]
                i = np.unique(i[w.fine[i] & (w.doc[i] == own)])
                for a in range(0, len(i), 1 << 16):
                    x = i[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(w.digest[x].view(np.int64)), b.column(0).take(pa.array(w.doc[x])), *w.spans(x, x), pa.array(np.ones(len(x), np.int16))], names=["d", "doc_id", "lo", "start", "end", "n"])
        _text.release()

    return docs.select("doc_id", "text", "places").mapInArrow(run, _schema(docs))


def _shared(rows: DataFrame, *more) -> DataFrame:
    """rows whose d two documents or more have, with the smallest of them, k, and the aggregates of d given."""
    dup = rows.groupBy("d").agg(F.min("doc_id").alias("k"), F.max("doc_id").alias("_m"), F.count("*").alias("_n"), *more).where("k <> _m").drop("_m")
    return by_count(rows, stored(dup, "dup"), "d", "_n", rows.count(), "inner").drop("d", "_n")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id, kept) of every stretch of windows that other documents have too.

    start and end are UTF-8 bytes, always between characters; first_doc_id is the smallest document that has one of the
    run's windows, and kept marks the runs all of whose windows no smaller document has. Null and empty texts have no
    windows, rows with a null doc_id no repeats, and rows with one doc_id, of any type that has an order, are one document. Text without a repeat has no
    row; an empty table gives none.
    """
    bound_batches(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    found = stored(seeds(docs, min_words), "seeds")
    met = stored(_shared(found, (F.min("c") == F.max("c")).alias("same")).drop("c").distinct(), "met")
    forget(found)
    places = stored(met.where("NOT same").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("places")), "places")
    some = _blocks.by_ids(docs, places.select("doc_id"), "doc_id", "left_semi").join(places, "doc_id")
    singles = _shared(stored(windows(some, min_words), "windows"))
    t = met.where("same").drop("same").unionByName(singles).distinct().withColumn("_to", F.col("lo") + F.col("n") - 1 + min_words)
    w = Window.partitionBy("doc_id").orderBy("lo", "_to")
    t = t.withColumn("_new", (F.coalesce(F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col("lo")).cast("int"))
    t = t.withColumn("_run", F.sum("_new").over(w))
    runs = t.groupBy("doc_id", "_run").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("_to") - F.min("lo")).cast("long").alias("n_words"), F.min("k").alias("first_doc_id"), F.min(F.col("k") == F.col("doc_id")).alias("kept")
    )
    return runs.drop("_run")


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the repeats that are not kept cut out of the text; n_chars follows if docs has it."""
    cuts = found.where("NOT kept").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    t = docs.join(cuts, "doc_id", "left")
    raw = F.encode("text", "UTF-8")
    piece = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    walked = F.aggregate("_cuts", F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out")), lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], F.greatest(acc["at"], x["start"]))).alias("out")))
    t = t.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.decode(F.concat(walked["out"], piece(walked["at"], F.octet_length("text"))), "UTF-8")))
    if "n_chars" in docs.columns:
        t = t.withColumn("n_chars", F.length("text").cast("long"))
    return t.select(*docs.columns)


def op8_cdc_repeats(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
