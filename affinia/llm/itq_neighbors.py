"""Embedding near-duplicates by iterative quantisation.

Rotations that make balanced binary codes are learned on at most ``sample`` vectors (the first by a hash of their id):
principal axes of the unit vectors, turned so that the codes lose least (Gong and Lazebnik 2011), from several random
starts. Every vector is coded and put into tables over disjoint blocks of its codes. Blocks grow with the logarithm
of the number of vectors, so buckets keep their size, and there are as many tables as make a pair at the threshold share
one with probability ``recall``, counted on pairs made from the sample under the learned codes: vectors with a common
direction need more tables than their angles tell. Where that takes over MOST_TABLES, blocks are shorter.

Buckets are compared twice. First by codes alone: a bucket's rows are an id and a SKETCH of the code, pairs whose
sketches differ in more bits than all but a thousandth of the pairs made from the sample are dropped, and what has a pair left names its
bucket. Only for these do the original vectors go to the bucket and are compared by their cosine in double precision;
links, not pairs, leave the task. A pair belongs to the first table in which it meets, so none is counted twice. Equal
vectors are one throughout and counted in the end. Vectors of different lengths are never near; each length has codes of
its own, and one with fewer than LEARN vectors a single bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm import _blocks
from affinia.operators.graph import connected_components
from affinia.session import bound_batches, stored, table

THRESHOLD = 0.9
#: Vectors to learn from at most, by number and by bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
LEARN = 50
RECALL = 0.98
BUCKET = 200
LEAST_BITS, MOST_BITS = 6, 24
MOST_TABLES = 256
PROBES = 2000
#: Share of the probes whose sketches differ in as few bits as a pair may that is compared.
FAR = 0.999
#: Words of 64 bits that a sketch has at most, and rows of a bucket that one task compares at a time.
SKETCH, BLOCK, TILE = 4, 2048, 256


def learn(x: np.ndarray, rotations: int, rounds: int = 25, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the unit vectors, and rotations x d x d; code bits are the signs of (v / |v| - mean) @ rotation."""
    mean, turns = _turns(unit(x), rounds, seed)
    return mean, np.array(list(islice(turns, rotations)))


def unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _turns(x: np.ndarray, rounds: int = 25, seed: int = 3) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean = x.mean(0)
    x = x - mean
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    v = x @ axes

    def each():
        while True:
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            yield axes @ r

    return mean, each()


def probes(x: np.ndarray, threshold: float = THRESHOLD, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors a and, by two kinds x rows, unit vectors at the threshold from them.

    One kind goes off in any direction, the other along the difference to another vector of the sample.
    """
    rng = np.random.default_rng(seed)
    a = x[rng.permutation(len(x))[:PROBES]]
    out = []
    for w in (rng.normal(size=a.shape), x[rng.integers(0, len(x), len(a))] - a + 1e-9 * rng.normal(size=a.shape)):
        w = w - (w * a).sum(1, keepdims=True) * a
        w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
        out.append(threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * w)
    return a, np.array(out)


def layout(n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table's key and least number of tables, for n vectors."""
    bits = min(max(LEAST_BITS, round(log2(max(1, n / BUCKET)))), MOST_BITS, dim)
    share = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - share))


class Codes:
    """Codes learned for vectors of one length. No bits: one table with one bucket, and no sketch."""

    def __init__(self, dim: int, mean=None, turns=None, bits: int = 0, tables: int = 1, differ: int = 0):
        self.dim, self.mean, self.turns, self.bits, self.tables, self.differ = dim, mean, turns, bits, tables, differ

    def keys(self, u: np.ndarray) -> np.ndarray:
        """Key of each unit vector in each table."""
        if not self.bits:
            return np.zeros((len(u), 1), np.int64)
        per, place = self.dim // self.bits, (1 << np.arange(self.bits)).astype(np.int64)
        u = u - self.mean
        return np.concatenate([(((u @ t) >= 0)[:, : per * self.bits].reshape(len(u), per, self.bits) * place).sum(2) for t in self.turns], 1)[:, : self.tables]

    def sketch(self, keys: np.ndarray) -> np.ndarray:
        """The keys of the first tables side by side, whole ones, in SKETCH words at most."""
        q = 64 // self.bits if self.bits else 1
        out = np.zeros((len(keys), min(SKETCH, -(-keys.shape[1] // q)) if self.bits else 0), np.uint64)
        for t in range(min(keys.shape[1], q * out.shape[1])):
            out[:, t // q] |= keys[:, t].astype(np.uint64) << np.uint64(self.bits * (t % q))
        return out


def fitted(x: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Codes:
    """Codes for n vectors, learned on x. Of the probes of either kind, the share that meets in a table is ``recall`` or more."""
    x = unit(x)
    mean, more = _turns(x)
    a, b = probes(x, threshold)
    p, q = a - mean, b - mean
    turns, agree = [], []
    bits, least = layout(n, x.shape[1], threshold, recall)
    while bits:
        per, tables, met = x.shape[1] // bits, 0, np.zeros(q.shape[:2], bool)
        while tables < max(least, MOST_TABLES):
            i, j = divmod(tables, per)
            if i == len(turns):
                turns.append(next(more))
                agree.append(((p @ turns[i]) >= 0) == ((q @ turns[i]) >= 0))
            met |= agree[i][..., j * bits : (j + 1) * bits].all(-1)
            tables += 1
            if tables >= least and met.mean(1).min() >= recall:
                out = Codes(x.shape[1], mean, np.array(turns[: i + 1]), bits, tables)
                own = out.sketch(out.keys(a))
                out.differ = max(int(np.ceil(np.quantile(np.bitwise_count(own ^ out.sketch(out.keys(y))).sum(1), FAR))) for y in b)
                return out
        bits -= 1
    return Codes(x.shape[1])


_GROUP = ("_g", "_i", "_j")


def _values(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks])


def _bytes(col: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values end to end."""
    out = []
    for c in col.chunks:
        off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]] if c.buffers()[2] else np.zeros(0, np.uint8))
    return np.concatenate(out).view(kind)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows and no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _pairs(c: int, side: np.ndarray, same: bool, near):
    """Pairs (i, j) of a group, i before j, for which near(rows, all rows) holds, in tiles of rows."""
    for k in range(0, c, TILE):
        stop = min(c, k + TILE)
        ok = near(slice(k, stop)) & (np.arange(c)[None] > np.arange(k, stop)[:, None])
        if not same:
            ok &= side[k:stop, None] != side[None]
        a, b = np.nonzero(ok)
        if len(a):
            yield a + k, b


def _promising(codes: dict[int, tuple[int, int]]):
    """Kernel over (rep, sketch) rows of a bucket: the rows with a pair near enough by sketch that no table before has.

    codes: bits of a key and most bits that differ, by length.
    """

    def kernel(cols, g, same):
        rep, side, c = cols["rep"].to_numpy(), cols["_s"].to_numpy(), len(cols["rep"])
        dim, at = g >> 40, (g >> 24) & 0xFFFF
        bits, differ = codes.get(dim, (0, 0))
        told = np.zeros(c, bool)
        if bits:
            s = _bytes(cols["sketch"], np.uint64).reshape(c, -1)
            q = 64 // bits
            before, mask = range(min(at, q * s.shape[1])), np.uint64((1 << bits) - 1)
            near = lambda rows: np.bitwise_count(s[rows, None] ^ s[None]).sum(2, dtype=np.int32) <= differ
        else:
            before, mask, near = (), None, lambda rows: True
        for a, b in _pairs(c, side, same, near):
            own = np.ones(len(a), bool)
            for t in before:
                shift = np.uint64(bits * (t % q))
                own &= ((s[a, t // q] ^ s[b, t // q]) >> shift) & mask != 0
            told[a[own]] = told[b[own]] = True
        if told.any():
            at = np.flatnonzero(told)
            key = [pa.array(np.full(len(at), g)), *[pa.array(cols[c].to_numpy()[at]) for c in ("_i", "_j")]]
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(side[at]), *key], names=["rep", "_s", *_GROUP])

    return _blocks.grouped(kernel, ["rep", "sketch", "_s", "_i", "_j"])


def _compare(threshold: float):
    """Kernel over (rep, mult, e, keys) rows of a bucket: links and a root within the bucket of each linked row."""

    def kernel(cols, g, same):
        rep, side, mult = (cols[c].to_numpy() for c in ("rep", "_s", "mult"))
        c, at = len(rep), (g >> 24) & 0xFFFF
        keys = _bytes(cols["keys"], np.int32).reshape(c, -1)
        u = _scaled(_values(cols["e"]).reshape(c, -1).astype(np.float64))
        norm = np.sqrt((u * u).sum(1))
        links, label, edges = np.zeros(c, np.int64), np.arange(c), []
        for a, b in _pairs(c, side, same, lambda rows: (u[rows] @ u.T) / (norm[rows, None] * norm[None]) >= threshold):
            own = np.ones(len(a), bool)
            for t in range(at):
                own &= keys[a, t] != keys[b, t]
            a, b = a[own], b[own]
            links += np.bincount(a, mult[b], c).astype(np.int64) + np.bincount(b, mult[a], c).astype(np.int64)
            before = None
            while before is None or (label != before).any():
                before = label.copy()
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                label = label[label]
        told = np.flatnonzero(links)
        if len(told):
            yield pa.RecordBatch.from_arrays([pa.array(rep[told]), pa.array(links[told]), pa.array(rep[label[told]])], names=["rep", "links", "root"])

    return _blocks.grouped(kernel, ["rep", "mult", "e", "keys", "_s"])


def _coded(reps: DataFrame, codes: Codes) -> DataFrame:
    """(rep, keys, sketch, buckets) of the vectors of one length; a bucket is length, table and key in one number."""
    dim, tables = codes.dim, codes.tables

    def code(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                keys = codes.keys(unit(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)))
                buckets = keys | (np.arange(tables, dtype=np.int64) << 24) | (dim << 40)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(buckets.ravel()))
                raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (keys.astype(np.int32), codes.sketch(keys))]
                yield pa.RecordBatch.from_arrays([b.column(1), *raw, lists], names=["rep", "keys", "sketch", "buckets"])

    return reps.where(F.size("e") == dim).select("e", "rep").mapInArrow(code, "rep long, keys binary, sketch binary, buckets array<long>")


def _links(reps: DataFrame, coded: DataFrame, codes: list[Codes], threshold: float, block: int) -> DataFrame:
    """(rep, links, root) of every bucket's linked rows."""
    n = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = coded.select("rep", "sketch", F.explode("buckets").alias("_g"))
    # Buckets too large for one block, and into how many they are cut.
    large = stored(flat.groupBy("_g").agg(F.count("*").alias("_c")).where(F.col("_c") > block), "large")
    cut = F.coalesce(F.ceil(F.col("_c") / block), F.lit(1)).cast("int")
    dealt = _blocks.looked_up(flat, large, "_g", "_c").withColumn("_n", cut).withColumn("_s", F.pmod(F.xxhash64(F.lit(11), "rep"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("rep", "sketch", "_s", "_g", F.least("_s", "_y").alias("_i"), F.greatest("_s", "_y").alias("_j"))
    dealt = dealt.repartition(n, *_GROUP).sortWithinPartitions(*_GROUP, "rep")
    promising = dealt.mapInArrow(_promising({c.dim: (c.bits, c.differ) for c in codes}), "rep long, _s int, _g long, _i int, _j int")
    near = promising.join(reps.select("rep", "mult", "e"), "rep").join(coded.select("rep", "keys"), "rep")
    return near.repartition(n, *_GROUP).sortWithinPartitions(*_GROUP, "rep").mapInArrow(_compare(threshold), "rep long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; only vec_id and embedding are read.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing, and neither does a
    row without vec_id. Vectors of one length are compared with each other, whatever lengths there are. Rows of equal
    vectors link with each other; repeated rows count as such. component_id is the smallest vec_id that links reach, the
    row's own included; kept is vec_id = component_id (true where vec_id is null). An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    e = F.col("embedding") if dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(fine & F.col("vec_id").isNotNull(), e).alias("e"))
    # A vec_id may have several vectors: what is compared has a number of its own.
    reps = rows.where("e IS NOT NULL").groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    lengths = reps.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"), F.sum("mult").alias("rows")).collect()
    n, codes = sum(r["rows"] for r in lengths), []
    for r in lengths:
        if r.n >= LEARN:
            some = reps.where(F.size("e") == r.d).orderBy(F.xxhash64("id", "rep"), "rep").limit(min(sample, max(LEARN, SAMPLE_BYTES // (8 * r.d)))).select("e").toArrow()
            codes.append(fitted(_values(some.column("e")).reshape(-1, r.d).astype(np.float64), r.n, threshold, recall))
    rare = reps.where(~F.size("e").isin([c.dim for c in codes])) if codes else reps
    coded = rare.select("rep", F.lit(bytes(4)).alias("keys"), F.lit(b"").alias("sketch"), F.array(F.shiftleft(F.size("e").cast("long"), 40)).alias("buckets"))
    for c in codes:
        coded = coded.unionByName(_coded(reps, c))
    coded = stored(coded, "codes")
    found = stored(_links(reps, coded, codes, threshold, block), "links")
    classes = connected_components(found.where("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    key = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))
    told = reps.select("rep", "id", "mult", key("e").alias("_k")).join(links, "rep", "left").join(classes, "rep", "left")
    told = stored(told.select("_k", "id", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class")), "told")
    least = stored(told.groupBy("class").agg(F.min("id").alias("component_id"), F.count("*").alias("_c")), "least")
    told = _blocks.by_count(told, least, "class", "_c", n, "inner").select("_k", "mult", "n_links", "component_id")
    out = _blocks.by_count(rows.where("e IS NOT NULL").select("vec_id", key("e").alias("_k")), stored(told, "told"), "_k", "mult", n, "inner")
    out = out.select("vec_id", "n_links", "component_id").unionByName(rows.where("e IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_itq_neighbors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
