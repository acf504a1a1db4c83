"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents with the same set of five-word shingles become one class first. MinHash bands propose pairs of classes;
BAND_ROWS and BANDS are set so that a pair at the threshold is missed once in 20,000. Inside a task a pair's MinHash
values are compared STEP at a time: with m of n equal, similarity has the posterior Beta(m + 1, n - m + 1), and the
pair is dropped once the chance that it reaches the threshold falls below TOLERANCE. That is done on signatures alone;
only where a pair is left do texts go to its bucket, to be verified on the exact sets of 64-bit shingle digests. Pairs
never leave the task: it gives each class its number of links, and edges that span what is linked.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.llm import _blocks, _text
from affinia.llm._blocks import fresh
from affinia.operators.graph import connected_components
from affinia.session import bound_batches, stored, table

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 25, 5
HASHES = BANDS * BAND_ROWS
STEP = 25
#: Bytes below 0x80 that no word has.
WORDLESS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOLERANCE = 1e-5
_rng = np.random.default_rng(20240501)
_A = (_rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_C = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; of a text with fewer than k words, all its words as one shingle."""
    _, _, h, first = _text.words(*_text.buffers(texts))
    s = _text.shingles(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(_text.shingles(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(h[:0])
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        v = x[i : i + 2048, None] * _A
        v ^= _C
        np.minimum(low, v.min(0), out=low)
    return low


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """For each number n of compared values the fewest equal ones with which a pair stays.

    The posterior chance that similarity is at least t is 1 - I_t(m + 1, n - m + 1), a binomial tail.
    """
    out = {}
    for n in range(step, hashes + 1, step):
        below = lambda m: sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))  # noqa: E731, B023
        out[n] = next(m for m in range(n + 1) if below(m) >= tolerance)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, sig_id, keys, sig) of every row; sig_id names the shingle set and is null where there are no words."""

    def run(batches):
        for b in batches:
            ids, keys, sigs = [], [], []
            for s in shingle_sets(b.column(1)):
                if not len(s):
                    ids.append(None), keys.append(None), sigs.append(None)
                    continue
                low = minhash(s)
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                band = low.reshape(BANDS, BAND_ROWS).astype(np.uint64)
                k = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(BAND_ROWS):
                    k = _text.mix(k * np.uint64(0x9FB21C651E98DF25) + band[:, r])
                keys.append(k.astype(np.int64))
                sigs.append(low.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "sig_id", "keys", "sig"])
        _text.release()

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("text_key long, sig_id binary, keys array<long>, sig binary").fields]))


def text_key():
    """A row is known by its doc_id and this."""
    return F.xxhash64("text")


def _left(cols, g: int, same: bool, need: dict[int, int]):
    """(i, js): the pairs of a group that belong to it and that pruning leaves; need is what least_matches() gives."""
    side, keys = cols["_s"].to_numpy(), _blocks.key_matrix(cols["groups"], BANDS)
    n = len(side)
    sig = np.frombuffer(b"".join(cols["sig"].to_pylist()), np.uint16).reshape(n, HASHES)
    for i in range(n - 1):
        js = np.arange(i + 1, n)
        js = js if same else js[side[js] != side[i]]
        if len(js):
            js = js[_blocks.owned(keys, i, js, g)]
        equal = np.zeros(len(js), np.int64)
        for k in range(STEP, HASHES + 1, STEP):
            if not len(js):
                break
            equal += (sig[js, k - STEP : k] == sig[i, k - STEP : k]).sum(1)
            js, equal = js[equal >= need[k]], equal[equal >= need[k]]
        if len(js):
            yield i, js


def _promising(threshold: float):
    """Kernel over signatures: the rows of a group that have a pair left."""
    need = least_matches(threshold)

    def kernel(cols, g, same):
        told = np.zeros(len(cols["class"]), bool)
        for i, js in _left(cols, g, same, need):
            told[i] = told[js] = True
        at = np.flatnonzero(told)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(cols[c].to_numpy()[at]) for c in ("class", "_s", "_g", "_i", "_j")], names=["class", "_s", "_g", "_i", "_j"])

    return _blocks.grouped(kernel, ["class", "sig", "groups", "_s", "_g", "_i", "_j"])


def _compare(threshold: float):
    """Kernel over signatures and texts: links and a root within the group of each linked class."""
    need = least_matches(threshold)

    def kernel(cols, g, same):
        rep, mult, texts = cols["class"].to_numpy(), cols["mult"].to_numpy(), cols["text"]
        sets: dict[int, np.ndarray] = {}

        def set_of(i):
            if i not in sets:
                sets[i] = shingle_sets(texts.slice(i, 1).combine_chunks())[0]
            return sets[i]

        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, js in _left(cols, g, same, need):
            mine = set_of(i)
            theirs = [set_of(int(j)) for j in js]
            size = np.array([len(t) for t in theirs])
            flat = np.concatenate(theirs)
            at = np.searchsorted(mine, flat)
            at[at == len(mine)] = 0
            hit = np.concatenate([[0], np.cumsum(mine[at] == flat)])
            end = np.cumsum(size)
            common = hit[end] - hit[end - size]
            # as a division, so that the same pairs pass as where a similarity is computed first
            js = js[common / (size + len(mine) - common) >= threshold]
            if len(js):
                links[i] += mult[js].sum()
                links[js] += mult[i]
                both = np.unique(label[np.append(js, i)])
                label[np.isin(label, both)] = both[0]
        told = np.flatnonzero(links)
        if len(told):
            yield pa.RecordBatch.from_arrays([pa.array(rep[told]), pa.array(links[told]), pa.array(rep[label[told]])], names=["class", "links", "root"])

    return _blocks.grouped(kernel, ["class", "mult", "sig", "groups", "text", "_s"])


def _links(docs: DataFrame, near: DataFrame, threshold: float, block: int) -> DataFrame:
    """(class, links, root) of the linked classes among near, which have signatures and groups."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _blocks.spread(near.select("class", "sig", "groups"), "class", block)
    left = stored(dealt.select("class", "sig", "groups", "_s", "_g", "_i", "_j").mapInArrow(_promising(threshold), "class long, _s int, _g long, _i int, _j int"), "left")
    mine = near.join(left.select("class").distinct(), "class", "left_semi")
    texts = docs.select(F.col("doc_id").alias("rep"), text_key().alias("text_key"), "text")
    # Rows that repeat one id and text are reduced where they are read.
    texts = _blocks.by_ids(texts, stored(mine.select("text_key").distinct(), "keys"), "text_key", "left_semi").groupBy("rep", "text_key").agg(F.first("text").alias("text"))
    near = left.join(mine.join(texts, ["rep", "text_key"]).select("class", "mult", "sig", "groups", "text"), "class")
    near = near.repartition(n, "_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j", "class")
    return near.select("class", "mult", "sig", "groups", "text", "_s", "_g", "_i", "_j").mapInArrow(_compare(threshold), "class long, links long, root long")


def classified(docs: DataFrame, threshold: float = THRESHOLD, block: int = _blocks.BLOCK) -> DataFrame:
    """(doc_id, text_key, class_id, n_links, first) for every row; first marks the class's smallest doc_id and, of that, smallest key."""
    bound_batches(docs.sparkSession)
    sigs = stored(signatures(docs), "sigs")
    named = sigs.where("sig_id IS NOT NULL AND doc_id IS NOT NULL")
    total = sigs.count()
    # A doc_id may have several texts: what is compared has a number of its own.
    reps = named.groupBy("sig_id").agg(F.min(F.struct("doc_id", "text_key")).alias("x"), F.count("*").alias("mult"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    reps = reps.select("sig_id", F.col("x.doc_id").alias("rep"), "x.text_key", "mult", "keys", "sig")
    reps = stored(reps.withColumn("class", F.monotonically_increasing_id()), "reps")
    near = stored(reps.drop("keys", "sig_id").join(_blocks.memberships(reps, "class"), "class"), "near")
    found = stored(_links(docs, near, threshold, block), "links")
    groups = connected_components(found.where("root <> class"), "class", "root").withColumnRenamed("node", "class")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    reps = reps.select("class", "sig_id", "rep", "text_key", "mult").join(links, "class", "left").join(groups, "class", "left")
    reps = stored(reps.select("sig_id", "rep", "text_key", "mult", F.coalesce("component", "class").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "told")
    least = stored(reps.groupBy("group").agg(F.min(F.struct("rep", "text_key")).alias("least"), F.count("*").alias("_c")), "least")
    reps = stored(_blocks.by_count(reps, least, "group", "_c", total, "inner").select("sig_id", "mult", "n_links", "least"), "classes")
    out = _blocks.by_count(named.select("doc_id", "text_key", "sig_id"), reps, "sig_id", "mult", total, "inner")
    out = out.select("doc_id", "text_key", F.col("least.rep").alias("class_id"), "n_links", ((F.col("doc_id") == F.col("least.rep")) & (F.col("text_key") == F.col("least.text_key"))).alias("first"))
    rest = sigs.where("sig_id IS NULL OR doc_id IS NULL").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return out.unionByName(rest)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = _blocks.BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for every row of docs; only its doc_id, of any type with an order, and text are read.

    Two documents link if the Jaccard similarity of their shingle sets reaches the threshold; a text without words
    (null and empty ones too) links with nothing. class_id is the smallest doc_id that links reach, the row's own
    included, n_links the number of other rows with another or the same text that link directly; kept marks the rows
    with the class's smallest doc_id. Rows whose doc_id is null keep a null class and link with nothing. Repeated rows
    count as copies; a doc_id with several texts is compared by each of them. An empty table gives no rows.
    """
    return classified(docs, threshold, block).select("doc_id", "class_id", "n_links", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, and of several texts of it that of the smallest hash.

    Of rows that repeat an id and text one stays, the first by its other columns. Texts without words and rows without
    doc_id all stay.
    """
    rows = stored(classified(docs, threshold).where("doc_id IS NOT NULL").select("doc_id", "text_key", "first"), "classes")
    several = stored(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    rest = rows.where("NOT first")
    if not several.head(1):  # an id tells a row
        return _blocks.by_ids(docs, stored(rest.select("doc_id"), "rest"), "doc_id", "left_anti").select(*docs.columns)
    rest = stored(rest.join(several, "doc_id", "left_anti").select("doc_id"), "rest")
    out = _blocks.by_ids(_blocks.by_ids(docs, several, "doc_id", "left_anti"), rest, "doc_id", "left_anti")
    # Of ids with several rows, each row by its text; of rows that repeat one, the first by the other columns.
    key = fresh(docs, "_key")[0]
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mine = rows.join(several, "doc_id", "left_semi").select(F.struct("doc_id", "text_key").alias(key), "first").distinct()
    own = _blocks.by_ids(docs, several, "doc_id", "left_semi").withColumn(key, F.struct("doc_id", text_key())).join(mine.where("first").drop("first"), key, "left_semi")
    words = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), WORDLESS, "")) > 0
    one = own.where(words).groupBy(key).agg(F.min_by(every, F.to_json(every)).alias("_one")).select("_one.*")
    return out.select(*docs.columns).unionByName(own.where(~words).select(*docs.columns)).unionByName(one.select(*docs.columns))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE k / (p.n + q.n - k) >= 0.8),
r AS (SELECT doc_id AS x, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.x WHERE r.m < e.y),
k AS (SELECT x, min(m) AS class_id FROM r GROUP BY x),
l AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT k.x AS doc_id, k.class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, k.x = k.class_id AS kept FROM k LEFT JOIN l ON l.x = k.x
"""
