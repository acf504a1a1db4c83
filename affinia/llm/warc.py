"""WARC archives as a PySpark Python data source.

``df.write.format("warc")`` writes one file a task, a record a row; the driver's commit publishes a manifest that names
the files of the tasks that counted and, for each, places about SPLIT_BYTES apart where a record begins. The reader
plans one partition a stretch between such places. In a stretch headers are parsed first: records that fail the
pushed-down predicates on them are stepped over by their length, and a payload is inflated only if it is asked for.

Each record is a gzip member of its own, as WARC advises, whose extra field "sl" has the member's length, so that one
can be stepped over; members without it, and plain files, are read as well. Files of other makers are read whole, file by
file; a file of this writer counts only through a manifest, so what a failed or half-done write left is never read.

Paths are opened through pyarrow's file systems: local files, hdfs, s3 (s3a and s3n are opened as s3), gs and abfs.
Their credentials come from the environment, not from Hadoop's settings. Other schemes are refused.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from affinia.llm._blocks import by_count
from affinia.session import bound_batches, scratch, stored, table

VERSION = "WARC/1.1"
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
#: Shorter payloads are never replaced by a revisit.
LEAST_BYTES = 100
SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, content_length long, payload binary"
#: Columns that come from headers alone, and the header of each.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "page_id": "X-Page-ID", "refers_to": "X-Refers-To-Page", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "content_length": "Content-Length"}
NUMBERS = ("page_id", "refers_to", "payload_bytes", "content_length")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Schemes that pyarrow knows by another name.
_ALIAS = {"s3a": "s3", "s3n": "s3"}
_KNOWN = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss", "mock")
_OWN = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")


def _open(path: str):
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    scheme = _ALIAS.get(scheme.lower(), scheme.lower())
    if scheme not in _KNOWN:
        raise ValueError(f"warc cannot open {path}: of {', '.join(_KNOWN[:-1])}, s3a and s3n none is {scheme}")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}")


def _clean(value: str) -> str:
    """Headers are lines: what would end one is escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "%\r\n") else value


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if "%" in value else value


def record(row: dict) -> bytes:
    body = row["payload"] if row["record_type"] != "revisit" else b""
    lines = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {row['refers_to']}"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """One gzip member, with its whole length in the extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = struct.pack("<2sHII", b"sl", 8, len(body) + 32, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    splits: list
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches) -> WriterCommitMessage:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in batches:
                for row in b.to_pylist():
                    got = member(record(row))
                    if at - splits[-1] >= SPLIT_BYTES:
                        splits.append(at)
                    out.write(got)
                    at += len(got)
        return _Written(name, splits, at)

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        files = [{"name": m.name, "splits": m.splits, "size": m.size} for m in messages if m is not None]
        with system.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages) -> None:
        """Delete the files of finished tasks. What others left is in no manifest, so no reader sees it."""
        system, root = _open(self.path)
        for m in messages:
            if m is not None:
                try:
                    system.delete_file(f"{root}/{m.name}")
                except FileNotFoundError:
                    pass


@dataclass
class WarcStretch(InputPartition):
    name: str
    start: int
    stop: int


class _Stream:
    """Bytes of a file from any place on, kept while they are looked at."""

    def __init__(self, file):
        self.file, self.base, self.buf = file, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from place on; fewer at the file's end."""
        a = place - self.base
        if a < 0 or a + n > len(self.buf):
            self.file.seek(place)
            self.base, self.buf, a = place, self.file.read(max(n, 1 << 18)), 0
        return self.buf[a : a + n]


class _Plain:
    """A record in a plain file."""

    def __init__(self, stream: _Stream, at: int):
        self.stream, self.at, n = stream, at, 1 << 12
        while (end := (got := stream.at(at, n)).find(b"\r\n\r\n")) < 0:
            if len(got) < n:
                raise ValueError(f"no end of headers after {at}")
            n *= 2
        self.head, self.body = got[:end], at + end + 4

    def end(self, length: int) -> int:
        return self.body + length + 4

    def payload(self, length: int) -> bytes:
        return self.stream.at(self.body, length)


class _Member:
    """A record in a gzip member; inflated only as far as is asked."""

    def __init__(self, stream: _Stream, at: int):
        self.stream, self.start = stream, at
        first = stream.at(at, 32)
        self.length = struct.unpack_from("<I", first, 16)[0] if first[3:4] == b"\x04" and first[12:16] == b"sl\x08\0" else None
        self.z, self.fed, self.out = zlib.decompressobj(31), at, b""
        while (end := self.out.find(b"\r\n\r\n")) < 0:
            if not self._more(1 << 11):
                raise ValueError(f"no end of headers after {at}")
        self.head, self.body = self.out[:end], end + 4

    def _more(self, n: int) -> bool:
        if self.z.eof:
            return False
        got = self.z.unconsumed_tail or self.stream.at(self.fed, 1 << 13)
        if not self.z.unconsumed_tail:
            self.fed += len(got)
        self.out += self.z.decompress(got, n)
        return bool(got)

    def end(self, length: int) -> int:
        if self.length is None:
            while self._more(1 << 20):
                pass
            self.length = self.fed - len(self.z.unused_data) - self.start
        return self.start + self.length

    def payload(self, length: int) -> bytes:
        while len(self.out) < self.body + length and self._more(1 << 20):
            pass
        return self.out[self.body : self.body + length]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, want_payload: bool):
        self.path, self.want_payload, self.tests = path, want_payload, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                value = f.value if isinstance(f, EqualTo | In | StringStartsWith) else None
                self.tests.append((column, type(f).__name__, set(value) if isinstance(f, In) else value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root))
        out, manifests = [], [i for i in found if i.base_name.startswith("manifest-")]
        for info in manifests:
            with system.open_input_stream(info.path) as f:
                for x in json.loads(f.read())["files"]:
                    edges = [*x["splits"], x["size"]]
                    out += [WarcStretch(x["name"], a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a]
        out += [WarcStretch(i.base_name, 0, i.size) for i in found if i.size and i.base_name.endswith((".warc", ".warc.gz")) and not _OWN.fullmatch(i.base_name)]
        return sorted(out, key=lambda p: (p.name, p.start))

    def _passes(self, head: dict) -> bool:
        for column, kind, value in self.tests:
            got = head.get(column)
            if got is None or (kind == "EqualTo" and got != value) or (kind == "In" and got not in value) or (kind == "StringStartsWith" and not got.startswith(value)):
                return False
        return True

    def read(self, partition):
        if partition is None:  # what Spark gives when nothing was planned
            return
        system, root = _open(self.path)
        schema = pa.schema([(c, pa.int64() if c in NUMBERS else pa.string()) for c in HEADERS] + [("payload", pa.binary())])
        rows, size = [], 0
        of = {h.lower(): c for c, h in HEADERS.items()}
        kind = _Member if partition.name.endswith(".gz") else _Plain
        with system.open_input_file(f"{root}/{partition.name}") as f:
            stream, at = _Stream(f), partition.start
            while at < partition.stop:
                got = kind(stream, at)
                lines = got.head.decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{partition.name}: no record at {at}")
                head: dict = dict.fromkeys(HEADERS)
                for line in lines[1:]:
                    key, _, value = line.partition(":")
                    column = of.get(key.lower())
                    if column:
                        value = value.strip()
                        head[column] = int(value) if column in NUMBERS else _unclean(value) if column == "target_uri" else value.strip("<>") if column == "record_id" else value.removeprefix("sha256:")
                n = head["content_length"]
                if n is None:
                    raise ValueError(f"{partition.name}: the record at {at} has no Content-Length, so its end is unknown")
                if self._passes(head):
                    rows.append(head | {"payload": got.payload(n) if self.want_payload else None})
                    size += 500 + (n if self.want_payload else 0)
                at = got.end(n)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    """Options: path; payload ("true" unless "false": then payloads are stepped over and the column is null)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("warc archives are only added to; choose a new path")
        return WarcWriter(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """A record a page: of equal payloads of least bytes or more the smallest page_id's is a response, others revisit it.

    A null html is an empty payload. Rows that repeat the smallest page_id are responses too. A row whose page_id is
    null revisits like any other, and is a response where no row of its payload has an id. Other columns are dropped.
    """
    t = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    t = t.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    keys = t.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    # Ids of the pages that revisit, found on digests alone; the pages themselves are dealt by page_id, which is not skewed.
    first = stored(first, "first")
    again = by_count(keys, first, "payload_digest", "n", first.agg(F.sum("n")).first()[0] or 0, "inner").where("page_id IS NULL OR page_id <> first").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    t = t.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_page", "_digest")
    revisit = F.col("refers_to").isNotNull()
    return t.select(
        F.concat(F.lit("urn:sha1:"), F.sha1(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "payload_digest"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes",
        F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("long").alias("content_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    register(pages.sparkSession)
    bound_batches(pages.sparkSession)
    records(pages, least).write.format("warc").mode("append").save(path)


def read(spark, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as archives, then read back: responses with their payloads, revisits by their headers alone."""
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    full = read(spark, path).where("record_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    brief = read(spark, path, payload=False).where("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.unionByName(brief)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT page_id, n, d, min(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to FROM f
"""
