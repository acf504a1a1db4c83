"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of WIDTH bytes run over overlapping chunks that cover the whole text, each filter's
response is max-pooled in its chunk, chunks are averaged, and a logistic layer makes one probability. Scoring uses the
trained filters as two tables over pairs of bytes, which give the same responses as embedding and convolving.

Training takes at most ``sample`` labelled rows, the first by a hash of doc_id, and of those as many as fit in
SAMPLE_BYTES; both bounds are parameters. Their texts are used whole: each step draws chunks anew from anywhere in a
text, at most ``chunks`` of them. Every text is scored from its first byte to its last.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm._text import buffers, release
from affinia.session import bound_batches, stored, table

CHUNK, OVERLAP, WIDTH, EMBED, FILTERS = 512, 32, 4, 8, 16
#: Labelled rows, and bytes of their texts, that training takes at most.
SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
#: Steps of training, of BATCH rows each, and chunks of a row that a step draws at most.
STEPS, BATCH, CHUNKS = 600, 64, 6
THRESHOLD = 0.7
SLICE = 1 << 18


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    shift: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Response of each pair of bytes as a filter's first two and last two bytes."""
        per = [self.embed @ self.filters[i * EMBED : (i + 1) * EMBED] for i in range(WIDTH)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return np.ascontiguousarray(pair(per[0], per[1]) + self.bias), np.ascontiguousarray(pair(per[2], per[3]))


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of a text of n bytes begin; the last one is the rest, however short."""
    return np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP) if n else np.zeros(0, np.int64)


def pooled(raw: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Mean over a text's chunks of the max-pooled responses; zeros for an empty text."""
    n = len(raw)
    if not n:
        return np.zeros(FILTERS, np.float32)
    starts = chunk_starts(n)
    total = np.zeros(FILTERS, np.float64)
    per = max(1, SLICE // CHUNK)
    for k in range(0, len(starts), per):
        s = starts[k : k + per]
        a, b = int(s[0]), min(n, int(s[-1]) + CHUNK)
        piece = np.zeros(b - a + WIDTH - 1, np.uint16)
        piece[: b - a] = raw[a:b]
        pairs = piece[:-1] << np.uint16(8) | piece[1:]
        got = head[pairs[: b - a]]
        got += tail[pairs[2 : b - a + 2]]
        # A chunk is the stretch up to the next one's start and that one's first OVERLAP bytes, both pooled once.
        rel = s - a
        edges = np.unique(np.concatenate([rel, np.minimum(rel + OVERLAP, b - a - 1)]))
        parts = np.maximum.reduceat(got, edges, axis=0)
        for r in rel.tolist():
            lo, hi = np.searchsorted(edges, [r, min(b - a, r + CHUNK)])
            total += np.maximum(parts[lo:hi].max(0), 0)
    return (total / len(starts)).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: list[int], chunks: int = CHUNKS, steps: int = STEPS, seed: int = 7) -> Net:
    """Adam on the logistic loss, the two classes weighted alike; without both classes the share of ones is the score."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    p = {"embed": f(256, EMBED), "filters": f(WIDTH * EMBED, FILTERS) / 2, "bias": np.zeros(FILTERS, np.float32), "weight": f(FILTERS), "shift": np.zeros(1, np.float32)}
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return Net(p["embed"], p["filters"], p["bias"], np.zeros(FILTERS, np.float32), float(np.log(share / (1 - share))))
    size = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(texts) + bytes(CHUNK + WIDTH), np.uint8)
    have = np.array([len(chunk_starts(n)) for n in size.tolist()], np.int64)
    class_weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    while step < steps:
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH))[: steps - step]:
            step += 1
            drawn = [np.arange(k) if k <= chunks else rng.choice(k, chunks, replace=False) for k in have[part].tolist()]
            took = np.array([len(d) for d in drawn])
            doc, n = np.repeat(np.arange(len(part)), took), np.maximum(1, took).astype(np.float32)
            at = (off[part][doc] + np.concatenate([*drawn, np.zeros(0, np.int64)]).astype(np.int64) * (CHUNK - OVERLAP))[:, None] + np.arange(CHUNK + WIDTH - 1)
            inside = at < off[part + 1][doc][:, None]
            b = np.where(inside, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)
            per = [p["embed"] @ p["filters"][i * EMBED : (i + 1) * EMBED] for i in range(WIDTH)]
            act = sum(per[i][b[:, i : i + CHUNK]] for i in range(WIDTH)) + p["bias"]
            act = np.where(inside[:, :CHUNK, None], act, -np.inf)  # no filter responds beyond the text
            top = act.argmax(1)  # chunk x filter
            peak = np.take_along_axis(act, top[:, None, :], 1)[:, 0]
            on = peak > 0
            feats = np.zeros((len(part), FILTERS), np.float32)
            np.add.at(feats, doc, np.maximum(peak, 0))
            feats /= n[:, None]
            err = (sigmoid(feats @ p["weight"] + p["shift"]) - y[part]) * class_weight[part] / len(part)
            g = {"weight": feats.T @ err + 1e-4 * p["weight"], "shift": np.array([err.sum()], np.float32)}
            back = ((err / n)[doc][:, None] * p["weight"]) * on
            g["bias"] = back.sum(0)
            ge, gf = np.zeros_like(p["embed"]), np.zeros_like(p["filters"])
            for i in range(WIDTH):
                byte = np.take_along_axis(b, top + i, 1)
                w = p["filters"][i * EMBED : (i + 1) * EMBED]
                np.add.at(ge, byte.ravel(), (back[:, :, None] * w.T[None]).reshape(-1, EMBED))
                gf[i * EMBED : (i + 1) * EMBED] = np.einsum("cfe,cf->ef", p["embed"][byte], back)
            g["embed"], g["filters"] = ge, gf
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Net(p["embed"], p["filters"], p["bias"], p["weight"], float(p["shift"][0]))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, chunks: int = CHUNKS, steps: int = STEPS) -> Net:
    """Train on labelled rows that are not held out: of the first ``sample`` by a hash of doc_id, those whose whole
    texts fit into ``sample_bytes`` together, in that order. Of a doc_id with several texts or labels the least text
    and the greatest label are taken; rows without text, or whose label isn't 0 or 1, are not."""
    mine = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    mine = mine.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.where("text <> ''").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = stored(found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled")
    ids, total = [], 0
    for r in found.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r.n <= sample_bytes:
            ids, total = [*ids, r.doc_id], total + r.n
    rows = sorted(found.where(F.col("doc_id").isin(ids)).collect(), key=lambda r: r.doc_id) if ids else []
    return train([r.text.encode() for r in rows], [int(r.quality) for r in rows], chunks, steps)


def score(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus score and predicted (1 from threshold on); columns of these names are replaced.

    A null or empty text is scored from the logistic layer alone. Repeated rows get equal scores, an empty table none.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(1)}).schema
    head, tail = net.tables()
    weight, shift = net.weight.astype(np.float64), net.shift

    def run(batches):
        for b in batches:
            raw, off = buffers(b.column(at))
            feats = np.array([pooled(raw[i:j], head, tail) for i, j in zip(off[:-1].tolist(), off[1:].tolist())], np.float64).reshape(-1, FILTERS)
            s = sigmoid(feats @ weight + shift)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[f.name for f in schema])
        release()

    return docs.mapInArrow(run, schema)


def op4_quality_cnn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, net)
    return out.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
