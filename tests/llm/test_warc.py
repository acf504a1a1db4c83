import gzip
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from affinia.llm import warc as W
from affinia.session import scratch
from tests.llm.data import empty


def pages(spark):
    big = "<p>" + "é" * 200 + "</p>"
    rows = [(3, "http://a/1", big), (1, "http://a/2", big), (2, None, big), (2, None, big), (4, "http://b/\r\nX: y%0A", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n" * 9), (9, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "y" * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("x"))


def test_round_trip_and_revisits(spark):
    path = scratch(spark, "warc")
    t = pages(spark)
    W.write(t, path)
    got = W.read(spark, path).toPandas()
    assert len(got) == t.count()
    kinds = {i: set(g.record_type) for i, g in got.groupby("page_id")}
    assert kinds[1] == {"response"} and kinds[2] == kinds[3] == {"revisit"}
    assert all(kinds[i] == {"response"} for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert set(got[got.record_type == "revisit"].refers_to) == {1.0}
    want = {r.page_id: (r.html or "").encode() for r in t.collect()}
    for r in got.itertuples():
        raw = want[None if r.page_id != r.page_id else int(r.page_id)]
        assert r.payload_digest == hashlib.sha256(raw).hexdigest() and r.payload_bytes == len(raw)
        assert bytes(r.payload) == (raw if r.record_type == "response" else b"")
    assert "http://b/\r\nX: y%0A" in set(got.target_uri)


def test_predicates_reach_the_reader(spark):
    path = scratch(spark, "warc")
    W.write(pages(spark), path)
    q = W.read(spark, path, payload=False).where("record_type = 'revisit' AND page_id IN (2, 3)")
    got = q.toPandas()
    assert len(got) == 3 and got.payload.isna().all()
    assert W.read(spark, path).where("target_uri LIKE 'http://a/%'").count() == 2
    reader = W.WarcReader(path, False)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("page_id",), (2, 3)), GreaterThan(("page_id",), 1)])) == [GreaterThan(("page_id",), 1)]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 3 and all(r["payload"] is None for r in rows)


def test_stretches_begin_at_records(spark, monkeypatch):
    path = scratch(spark, "warc")
    W.write(pages(spark).repartition(1), path)
    whole = W.WarcReader(path, True)
    n = sum(b.num_rows for p in whole.partitions() for b in whole.read(p))
    root = path.removeprefix("file://")
    writer = W.WarcWriter(path + "-small")
    monkeypatch.setattr(W, "SPLIT_BYTES", 300)
    batch = pa.RecordBatch.from_pylist([r for p in whole.partitions() for b in whole.read(p) for r in b.to_pylist()])
    writer.commit([writer.write(iter([batch])), None])
    small = W.WarcReader(path + "-small", True)
    assert len(small.partitions()) > 3 and sum(b.num_rows for p in small.partitions() for b in small.read(p)) == n
    assert root


def test_other_archives(spark, tmp_path):
    row = {"record_type": "response", "record_id": "urn:x", "target_uri": "u", "page_id": 5, "refers_to": None, "payload_digest": "d", "payload_bytes": 3, "payload": b"abc"}
    (tmp_path / "a.warc").write_bytes(W.record(row) + W.record(row | {"page_id": 6}))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(W.record(row | {"page_id": 7})) + gzip.compress(W.record(row | {"page_id": 8, "payload": b"q" * 50_000})))
    got = W.read(spark, f"file://{tmp_path}").toPandas()
    assert sorted(got.page_id) == [5, 6, 7, 8] and {len(p) for p in got.payload} == {3, 50_000}
    assert gzip.decompress(W.member(b"hello")) == b"hello"


def test_empty(spark):
    path = scratch(spark, "warc")
    W.write(empty(pages(spark)), path)
    assert W.read(spark, path).count() == 0


def test_what_a_failed_write_left_is_not_read(spark, tmp_path):
    row = {"record_type": "response", "record_id": "urn:x", "target_uri": "u", "page_id": 5, "refers_to": None, "payload_digest": "d", "payload_bytes": 3, "payload": b"abc"}
    writer = W.WarcWriter(f"file://{tmp_path}")
    done = writer.write(iter([pa.RecordBatch.from_pylist([row])]))
    assert W.WarcReader(f"file://{tmp_path}", True).partitions() == []  # not committed
    writer.abort([done, None])
    assert list(tmp_path.iterdir()) == []
    left = writer.write(iter([pa.RecordBatch.from_pylist([row])]))
    kept = writer.write(iter([pa.RecordBatch.from_pylist([row | {"page_id": 6}])]))
    writer.commit([kept])
    assert left.name != kept.name and [r.page_id for r in W.read(spark, f"file://{tmp_path}").collect()] == [6]


def test_schemes(monkeypatch):
    from pyarrow import fs

    opened = []
    monkeypatch.setattr(W, "fs", fs, raising=False)

    class Stub:
        from_uri = staticmethod(lambda uri: opened.append(uri) or (None, uri))

    monkeypatch.setattr(fs, "FileSystem", Stub)
    for path in ("s3a://b/x", "s3://b/x", "S3N://b/x", "abfss://c@a.dfs.core.windows.net/x", "file:/tmp/x", "hdfs://n:1/x"):
        W._open(path)
    assert opened == ["s3://b/x", "s3://b/x", "s3://b/x", "abfss://c@a.dfs.core.windows.net/x", "file:/tmp/x", "hdfs://n:1/x"]
    for path in ("dbfs:/x", "wasbs://c@a/x"):
        with pytest.raises(ValueError, match="cannot open"):
            W._open(path)


def test_a_record_without_a_length(tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n")
    reader = W.WarcReader(str(tmp_path), True)
    with pytest.raises(ValueError, match="no Content-Length"):
        list(reader.read(reader.partitions()[0]))
