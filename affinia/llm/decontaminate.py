"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of WINDOW words (all its words, if it has fewer but not none). A document can hold a
window only if it holds the window's rarest word, so that one word is the prefix: words are ordered by how often the
whole corpus has them, and each document word that is some window's rarest word proposes a place for the window.
Length and position bounds drop places that would begin before or end after the document, and the rest are compared
over the whole window. Words are compared by 64-bit hashes.

Windows, counts and the index are made in Spark; the benchmark's texts never reach the driver. Words are counted in
COUNTERS counters, which words share by their hash: that can make a prefix less rare than it might be, and changes no
result. An index whose encoded bytes, summed first, are within INDEX_BYTES is sent to the tasks, which mark documents
as they read them. A larger one stays a table: documents are read once, candidate places, each with the words around
it, are joined with the windows by their prefix, and the documents that were hit are joined back by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm import _text
from affinia.llm._blocks import by_count, fresh
from affinia.session import bound_batches, stored, table

WINDOW = 10
INDEX_BYTES = 32 << 20
COUNTERS = 1 << 20
#: Places of one prefix that are joined in one share at most, about.
PLACES = 10_000
#: Words of 64 bits in the filter of prefixes that goes with a large index: 8 MB whatever the benchmark.
FILTER_WORDS = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
_K1, _K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()


def _counter(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def _rarity(docs: DataFrame, items: DataFrame) -> np.ndarray:
    """How often all documents have words of each counter that a word of the benchmark falls on."""

    def seen(batches):
        on = np.zeros(COUNTERS, bool)
        for b in batches:
            on[_counter(_text.words(*_text.buffers(b.column(0)))[2])] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(on))], names=["c"])

    used = np.zeros(COUNTERS, bool)
    used[items.select("text").mapInArrow(seen, "c long").distinct().toArrow().column("c").to_numpy()] = True
    packed = np.packbits(used)

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        some = np.unpackbits(packed).astype(bool)
        for b in batches:
            c = _counter(_text.words(*_text.buffers(b.column(0)))[2])
            total += np.bincount(c[some[c]], minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])
        _text.release()

    out = np.zeros(COUNTERS, np.int64)
    if used.any():
        got = docs.select("text").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
        out[got.column("c").to_numpy()] = got.column("n").to_numpy()
    return out


def _digests(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each run of words."""
    a, b = length.astype(np.uint64), length.astype(np.uint64) + np.uint64(1)
    for j in range(int(length.max(initial=0))):
        on = length > j
        w = h[np.minimum(start + j, len(h) - 1)]
        a, b = np.where(on, a * _K1 + w, a), np.where(on, (b ^ w) * _K2 + (w >> np.uint64(29)), b)
    return _text.mix(a), _text.mix(b)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _windows(items: DataFrame, rarity: np.ndarray, window: int) -> DataFrame:
    """One row a distinct window: its prefix word, the prefix's place, length, digests, words (big-endian) and items."""

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                _, _, h, _ = _text.words(*_text.buffers(batch.column(1).slice(k, 1)))
                n = min(window, len(h))
                if not n:
                    continue
                rare = rarity[_counter(h)].astype(np.float64)
                order = np.empty(len(h), np.int64)
                order[np.lexsort((h, rare))] = np.arange(len(h))  # the place of each word in the order by rarity
                for i in range(0, len(h) - n + 1, 1 << 16):
                    start = np.arange(i, min(len(h) - n + 1, i + (1 << 16)))
                    runs = start[:, None] + np.arange(n)
                    at = order[runs].argmin(1)
                    a, b = _digests(h, start, np.full(len(start), n))
                    text = np.ascontiguousarray(h[runs].astype(">u8"))
                    m = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(h[start + at]), pa.array(at.astype(np.int32)), pa.array(np.full(m, n, np.int32)), _signed(a), _signed(b), pa.array([t.tobytes() for t in text], pa.binary()), pa.array([batch.column(0)[k].as_py()] * m)],
                        names=["prefix", "at", "n", "a", "b", "words", "item"],
                    )

    got = items.select("item_id", "text").mapInArrow(cut, "prefix long, at int, n int, a long, b long, words binary, item string")
    got = got.groupBy("words").agg(F.first("prefix").alias("prefix"), F.first("at").alias("at"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.collect_set("item").alias("items"))
    return stored(got, "windows")


class _Index:
    """Windows as arrays, sorted by their prefix."""

    def __init__(self, t: pa.Table):
        col = lambda c: t.column(c).to_numpy()
        order = np.argsort(col("prefix").view(np.uint64), kind="stable")
        self.prefix, self.a, self.b = (col(c).view(np.uint64)[order] for c in ("prefix", "a", "b"))
        self.at, self.length = col("at")[order].astype(np.int64), col("n")[order].astype(np.int64)
        owners = t.column("items").combine_chunks()
        names = owners.flatten().dictionary_encode()
        self.ids = names.dictionary.to_pylist()
        lists = np.split(names.indices.to_numpy().astype(np.int32), np.cumsum(owners.value_lengths().to_numpy())[:-1]) if len(owners) else []
        lists = [lists[i] for i in order.tolist()]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.owner = np.concatenate([np.zeros(0, np.int32), *lists])

    def find(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and window of every occurrence."""
        if not len(h) or not len(self.prefix):
            return (np.zeros(0, np.int64),) * 3
        some = np.zeros(1 << 20, bool)
        some[(self.prefix & np.uint64(0xFFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(some[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        lo = np.searchsorted(self.prefix, h[at])
        hi = np.searchsorted(self.prefix, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        doc = np.searchsorted(first, at, "right") - 1
        step = max(1, (1 << 20) // max(1, int(n.max(initial=1))))
        out = [(np.zeros(0, np.int64),) * 3]
        for i in range(0, len(at), step):  # so that a frequent prefix cannot propose too many places at once
            m = n[i : i + step]
            place = np.repeat(at[i : i + step], m)
            win = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[i : i + step], m)
            d = np.repeat(doc[i : i + step], m)
            start = place - self.at[win]
            ok = (start >= first[d]) & (start + self.length[win] <= first[d + 1])
            start, win, d = start[ok], win[ok], d[ok]
            a, b = _digests(h, start, self.length[win])
            ok = (a == self.a[win]) & (b == self.b[win])
            out.append((d[ok], start[ok], win[ok]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def items_of(self, wins: np.ndarray) -> list[str]:
        own = np.unique(np.concatenate([self.owner[self.first[w] : self.first[w + 1]] for w in np.unique(wins).tolist()]))
        return sorted(self.ids[o] for o in own.tolist())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_bytes: int | None = None) -> DataFrame:
    """docs plus n_words, n_hit, n_items, items_sha256 and contaminated; columns of these names are replaced.

    A null or empty text has no words. Items whose id or text is null, or without words, have no windows; repeated
    items count once. Repeated document rows each get the same figures. Empty tables give no rows or no hits. An index
    of more than index_bytes (INDEX_BYTES) is joined rather than sent to the tasks, with the same result.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    items = _items(benchmark)
    windows = _windows(items, _rarity(docs, items), window)
    size = windows.agg(F.sum(40 + 8 * F.size("items") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x))).alias("b")).first().b or 0
    if size > (INDEX_BYTES if index_bytes is None else index_bytes):
        return _joined(docs, windows, window)
    return _marked(docs, _Index(windows.select("prefix", "at", "n", "a", "b", "items").toArrow()))


def _with_figures(docs: DataFrame):
    return docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items_sha256"), F.lit(True).alias("contaminated")).schema


def _marked(docs: DataFrame, index: _Index) -> DataFrame:
    at, schema = docs.columns.index("text"), _with_figures(docs)

    def mark(batches):
        for b in batches:
            _, _, h, first = _text.words(*_text.buffers(b.column(at)))
            d, start, win = index.find(h, first)
            n = b.num_rows
            hit, items, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), [EMPTY] * n
            if len(d):
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[win], -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                hit = covered[first[1:]] - covered[first[:-1]]
                order = np.argsort(d, kind="stable")
                of, cut = np.unique(d[order], return_index=True)
                for doc, wins in zip(of.tolist(), np.split(win[order], cut[1:])):
                    found = index.items_of(wins)
                    items[doc], sha[doc] = len(found), hashlib.sha256(",".join(found).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(first)), pa.array(hit), pa.array(items), pa.array(sha), pa.array(hit > 0)], names=schema.names)
        _text.release()

    return docs.mapInArrow(mark, schema)


def _prefix_filter(windows: DataFrame) -> np.ndarray:
    """Bits of the prefixes' low hash bits; FILTER_WORDS rows at most."""
    low = F.col("prefix").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    bit = F.expr("shiftleft(1L, CAST(prefix & 63 AS INT))")
    got = windows.groupBy(F.shiftright(low, 6).alias("i")).agg(F.bit_or(bit).alias("w")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[got.column("i").to_numpy()] = got.column("w").to_numpy()
    return out.view(np.uint64)


def _joined(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """The join of candidate places with the table of windows; a place has window - 1 words on either side, fewer at an end."""
    filled, cols, at = _prefix_filter(windows), docs.columns, docs.columns.index("text")
    row, total, found = fresh(docs, "_row", "_n_words", "_places")
    wide = docs.withColumns({row: F.monotonically_increasing_id(), total: F.lit(0).cast("long"), found: F.lit(None).cast("array<struct<prefix:bigint,p:bigint,back:int,around:binary>>")})
    schema, place = wide.schema, pa.list_(pa.struct([("prefix", pa.int64()), ("p", pa.int64()), ("back", pa.int32()), ("around", pa.binary())]))

    def propose(batches):
        for b in batches:
            _, _, h, first = _text.words(*_text.buffers(b.column(at)))
            low = h & np.uint64(FILTER_WORDS * 64 - 1)
            p = np.flatnonzero((filled[(low >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1))
            doc = np.searchsorted(first, p, "right") - 1
            back = np.minimum(p - first[doc], window - 1)
            ahead = np.minimum(first[doc + 1] - p, window)
            raw = h.astype(">u8").tobytes()
            flat = [{"prefix": w, "p": x, "back": k, "around": raw[8 * (g - k) : 8 * (g + m)]} for w, x, k, m, g in zip(h[p].view(np.int64).tolist(), (p - first[doc]).tolist(), back.tolist(), ahead.tolist(), p.tolist())]
            cut = np.searchsorted(p, first)
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat, place.value_type))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(np.diff(first)), lists], names=schema.names)
        _text.release()

    docs = stored(wide.mapInArrow(propose, schema), "docs")
    places = docs.select(F.col(row).alias("_row"), F.explode(found).alias("x")).select("_row", "x.*")
    # A prefix in many places, or of many windows, is dealt out: places by their number, windows in each share.
    often = places.groupBy("prefix").agg(F.count("*").alias("_c")).join(windows.select("prefix").distinct(), "prefix")
    often = stored(often, "often")
    shares = F.ceil(F.col("_c") / PLACES).cast("int")
    places = by_count(places, often, "prefix", "_c", int(often.agg(F.sum("_c")).first()[0] or 0), "inner")
    places = places.withColumn("_s", F.pmod(F.xxhash64("_row", "p"), shares).cast("int")).drop("_c")
    dealt = windows.join(often, "prefix").withColumn("_s", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_c")
    hits = places.join(dealt, ["prefix", "_s"]).where("back >= at AND substring(around, 8 * (back - at) + 1, 8 * n) = words")
    hits = hits.select("_row", (F.col("p") - F.col("at")).alias("start"), "n", "items")
    one = hits.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    # Words covered: each run adds what lies beyond the runs before it.
    walk = F.aggregate("_hits", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum")), lambda s, x: F.struct(
        F.greatest(s["end"], x["start"] + x["n"]).alias("end"), (s["sum"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["n"] - F.greatest(s["end"], x["start"]))).alias("sum")))
    one = one.select("_row", walk["sum"].alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    docs = docs.join(one.withColumnRenamed("_row", row), row, "left")
    return docs.select(*cols, F.col(total).alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(EMPTY)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.drop("text")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[s:s + least(10, len(w)) - 1], ' ') FOR s IN range(1, len(w) - least(10, len(w)) + 2)]) AS win FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest([struct_pack(s := s, win := array_to_string(w[s:s + n - 1], ' ')) FOR s IN range(1, len(w) - n + 2)]) AS x FROM d, ns WHERE len(w) >= n),
hits AS (SELECT dw.doc_id, dw.x.s AS s, dw.n AS n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.x.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
