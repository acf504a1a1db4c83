import random

import numpy as np
from pyspark.sql import functions as F

from affinia.llm import quality_cnn as Q
from tests.llm.data import documents, empty, text


def test_tables_give_what_the_network_gives():
    net = Q.train([text(i, 40).encode() if i % 2 else text(i, 40).upper().encode() for i in range(40)], [i % 2 for i in range(40)], steps=20)
    head, tail = net.tables()
    for t in (b"a", b"abc", text(1, 300).encode(), text(2, 30).encode() * 40):
        raw = np.frombuffer(t, np.uint8)
        got = Q.pooled(raw, head, tail)
        want = []
        padded = np.concatenate([raw, np.zeros(Q.WIDTH - 1, np.uint8)])
        act = sum(net.embed[padded[i : i + len(raw)]] @ net.filters[i * Q.EMBED : (i + 1) * Q.EMBED] for i in range(Q.WIDTH)) + net.bias
        for s in Q.chunk_starts(len(raw)):
            want.append(np.maximum(act[s : s + Q.CHUNK].max(0), 0))
        assert np.allclose(got, np.mean(want, 0), atol=1e-3)


def test_chunks_cover_every_byte():
    for n in (1, 31, 32, 33, 511, 512, 513, 992, 993, 5000):
        s = Q.chunk_starts(n)
        assert s[0] == 0 and s[-1] + Q.CHUNK >= n and (np.diff(s) <= Q.CHUNK - Q.OVERLAP).all()


def test_held_out_accuracy_and_no_leak(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    net = Q.fit(docs, labels)
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.fit(docs, flipped)
    assert np.array_equal(net.filters, again.filters)
    got = Q.score(docs, net).join(labels, "doc_id").toPandas()
    got = got[got.doc_id.map(Q.held_out)]
    assert (got.predicted == got.quality).mean() >= 0.9


def test_odd_rows(spark):
    d = documents(spark, "score predicted")
    labels = spark.createDataFrame([(10, 1), (20, 0), (20, 0), (None, 1), (4, 1), (1, 0), (50, None)], "doc_id long, quality int")
    got = Q.score(d, Q.fit(d, labels, steps=5)).toPandas()
    assert len(got) == d.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert got[got.doc_id.isin([0, 1])].score.nunique() == 1
    assert Q.score(empty(d), Q.fit(d, empty(labels))).count() == 0
    one = Q.score(d, Q.fit(d, labels.where("quality = 1"))).toPandas()
    assert one.score.nunique() == 1


def test_training_sees_whole_texts(spark):
    """What tells the classes apart stands far beyond the first chunks of texts that are mostly alike."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        t = "".join(r.choice("abcdefgh ") for _ in range(9000))
        rows.append((i, t + ("#$%&" * 1500 if i % 2 else "wxyz" * 1500)))
        labels.append((i, i % 2))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = Q.score(docs, Q.fit(docs, labels, chunks=4, steps=200)).toPandas()
    held = got[got.doc_id.map(Q.held_out)]
    assert ((held.score >= 0.5) == (held.doc_id % 2 == 1)).mean() >= 0.95
    few = Q.fit(docs, labels, sample_bytes=60_000, steps=1)  # four texts' worth
    assert few.filters.shape == (Q.WIDTH * Q.EMBED, Q.FILTERS)
