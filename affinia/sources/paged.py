"""Paged REST scans as Python data sources.

``paged``: pages by offset; one partition a stretch of pages, read in parallel, and resumable. ``cursor``: pages that
name the next one; one partition a list of first addresses. ``ids``: records by id, many a request, the ids taken from
the query's own filters. The fetching functions are given by name
("module:function"), so tests and closed networks can serve pages from files.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.streaming import StreamingQuery

from affinia.session import exists


def _get(url: str):
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as r:  # noqa: S310
        return json.load(r)


def _page_of(answer) -> list:
    return answer if isinstance(answer, list) else next((v for v in answer.values() if isinstance(v, list)), [])


def fetch_json(url: str, offset: int, limit: int) -> list:
    """GET with offset and limit; the first list among the answer's values is the page."""
    return _page_of(_get(f"{url}{'&' if '?' in url else '?'}offset={offset}&limit={limit}"))


def count_json(url: str) -> int:
    """How many records an address has, as the answer's page_meta tells."""
    return int(_get(f"{url}{'&' if '?' in url else '?'}limit=1")["page_meta"]["total_count"])


def follow_json(url: str) -> tuple[list, str | None]:
    """A page and the address of the next; one without a host is on the same."""
    from urllib.parse import urljoin

    answer = _get(url)
    after = (answer.get("page_meta") or {}).get("next") if isinstance(answer, dict) else None
    return _page_of(answer), urljoin(url, after) if after else None


def named(function: str) -> Callable:
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


def tried(function: Callable, tries: int, *args):
    """function(*args), again after 1, 2, 4 ... seconds, a minute at most, where the network fails."""
    for n in range(tries):
        try:
            return function(*args)
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(min(2**n, 60))


@dataclass
class Stretch(InputPartition):
    pages: list


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.page, self.per = options["url"], int(options.get("page", 1000)), int(options.get("pages_per_task", 20))
        self.fetch, self.tries = options.get("fetch", "affinia.sources.paged:fetch_json"), int(options.get("tries", 4))
        self.lenient, self.done = options.get("lenient", "false").lower() == "true", set(json.loads(options.get("done", "[]")))
        self.total = options.get("total")
        self.count = options.get("count", "affinia.sources.paged:count_json")

    def partitions(self):
        total = int(self.total) if self.total is not None else tried(named(self.count), self.tries, self.url)
        left = [(i, min(self.page, total - i)) for i in range(0, total, self.page) if i not in self.done]
        return [Stretch(left[k : k + self.per]) for k in range(0, len(left), self.per)]

    def read(self, partition):
        if partition is None:
            return
        fetch = named(self.fetch)
        for at, n in partition.pages:
            try:
                rows = tried(fetch, self.tries, self.url, at, n)
            except OSError:
                if not self.lenient:
                    raise
                continue  # left for the next run
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.int64()), pa.array(range(at, at + len(rows)), pa.int64()), pa.array([json.dumps(r) for r in rows])], names=["page", "offset", "json"])


class PagedStreamReader(DataSourceStreamReader):
    """Offsets are numbers of records, so that a last page that wasn't full goes on where it ended."""

    def __init__(self, options):
        self.pages = PagedReader(options)

    def initialOffset(self):
        return {"record": 0}

    def latestOffset(self):
        p = self.pages
        return {"record": int(p.total) if p.total is not None else tried(named(p.count), p.tries, p.url)}

    def partitions(self, start, end):
        p, a, b = self.pages, start["record"], end["record"]
        calls = [(i, min(p.page, b - i)) for i in range(a, b, p.page)]
        return [Stretch(calls[k : k + p.per]) for k in range(0, len(calls), p.per)]

    def read(self, partition):
        return self.pages.read(partition)


def followed(spark: SparkSession, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Take up all records that the checkpoint doesn't know yet, each once, and stop (an extension beside ``resumed``).

    A run that was killed is taken up by the next: Spark's checkpoint has the offsets of the batch that was under way, and the
    file sink its finished files, so no page is lost or read twice.
    """
    spark.dataSource.register(PagedSource)
    pages = spark.readStream.format("paged").options(**options).load()
    return pages.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


class PagedSource(DataSource):
    """Options: url; page, pages_per_task, tries; fetch and count, functions by name; total, else count(url) is asked;
    done, a JSON list of pages to leave out; lenient, "true" if a page that fails throughout is left out, not an error."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "page long, offset long, json string"

    def reader(self, schema):
        return PagedReader(self.options)

    def streamReader(self, schema):
        return PagedStreamReader(self.options)


def resumed(spark: SparkSession, out: str, **options) -> DataFrame:
    """Fetch the pages that the table at out lacks, add them, and read it. A page that fails is left for the next call."""
    spark.dataSource.register(PagedSource)
    done = [r.page for r in spark.read.schema("page long").parquet(out).distinct().collect()] if exists(spark, out) else []
    spark.read.format("paged").options(**{"lenient": "true"} | options, done=json.dumps(done)).load().write.mode("append").parquet(out)
    return spark.read.schema("page long, offset long, json string").parquet(out)


class CursorReader(DataSourceReader):
    def __init__(self, options):
        self.starts, self.per = json.loads(options["starts"]), int(options.get("starts_per_task", 20))
        self.follow, self.tries = options.get("follow", "affinia.sources.paged:follow_json"), int(options.get("tries", 4))

    def partitions(self):
        return [Stretch(self.starts[k : k + self.per]) for k in range(0, len(self.starts), self.per)]

    def read(self, partition):
        if partition is None:
            return
        follow = named(self.follow)
        for start in partition.pages:
            url, page = start, 0
            while url:
                rows, url = tried(follow, self.tries, url)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([start] * len(rows)), pa.array([page] * len(rows), pa.int32()), pa.array([json.dumps(r) for r in rows])], names=["start", "page", "json"])
                page += 1


class CursorSource(DataSource):
    """Options: starts, a JSON list of first addresses; starts_per_task, tries; follow, a function by name that gives a
    page's rows and the next address or None."""

    @classmethod
    def name(cls):
        return "cursor"

    def schema(self):
        return "start string, page int, json string"

    def reader(self, schema):
        return CursorReader(self.options)


def fetch_ids_json(url: str, column: str, ids: list) -> list:
    """GET the records of these ids: column__in=a,b,c."""
    from urllib.parse import quote

    return _page_of(_get(f"{url}{'&' if '?' in url else '?'}{column}__in={','.join(quote(str(i)) for i in ids)}&limit={len(ids)}"))


#: Ids of one request.
IDS = 25


class IdReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.column, self.per = options["url"], options.get("column", "id"), int(options.get("ids_per_request", IDS))
        self.fetch, self.tries = options.get("fetch", "affinia.sources.paged:fetch_ids_json"), int(options.get("tries", 4))
        self.requests, self.ids = int(options.get("requests_per_task", 20)), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("id",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.ids = asked if self.ids is None else self.ids & asked  # the requests ask for no others
            else:
                yield f

    def partitions(self):
        if self.ids is None:
            raise ValueError("ids can only be looked up: filter id by = or IN, and set spark.sql.python.filterPushdown.enabled")
        ids = sorted(i for i in self.ids if i is not None)
        calls = [ids[k : k + self.per] for k in range(0, len(ids), self.per)]
        return [Stretch(calls[k : k + self.requests]) for k in range(0, len(calls), self.requests)]

    def read(self, partition):
        if partition is None:
            return
        for ids in partition.pages:
            yield from _looked_up(named(self.fetch), self.tries, self.url, self.column, ids)


def _looked_up(fetch: Callable, tries: int, url: str, column: str, ids: list):
    rows = tried(fetch, tries, url, column, ids)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([str(r[column]) for r in rows]), pa.array([json.dumps(r) for r in rows])], names=["id", "json"])


class IdSource(DataSource):
    """Records by id, ``ids_per_request`` of them a request. The ids are those of the filters: id = 'a', id IN ('a', 'b').

    Options: url; column, the records' name of the id; ids_per_request, requests_per_task, tries; fetch, a function by name.
    """

    @classmethod
    def name(cls):
        return "ids"

    def schema(self):
        return "id string, json string"

    def reader(self, schema):
        return IdReader(self.options)


def by_ids(spark: SparkSession, ids: list[str], **options) -> DataFrame:
    """The records of a list of ids; the list goes into the plan, so it should be a short one."""
    spark.dataSource.register(IdSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("ids").options(**options).load().where(F.col("id").isin(ids))


def backfilled(ids: DataFrame, column: str, out: str, url: str, fetch: str = "affinia.sources.paged:fetch_ids_json", record_column: str = "id", per: int = IDS, tries: int = 4) -> DataFrame:
    """Look up the distinct ids of a table that the records at out lack, add them, and read all. Ids never meet on the driver:
    tasks request those they have, ``per`` at a time; an id that has no record is asked for again by the next call."""
    spark = ids.sparkSession
    missing = ids.select(F.col(column).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    if exists(spark, out):
        missing = missing.join(spark.read.schema("id string").parquet(out), "id", "left_anti")

    def run(batches):
        held = []
        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= per:
                yield from _looked_up(named(fetch), tries, url, record_column, held[:per])
                held = held[per:]
        if held:
            yield from _looked_up(named(fetch), tries, url, record_column, held)

    missing.mapInArrow(run, "id string, json string").write.mode("append").parquet(out)
    return spark.read.schema("id string, json string").parquet(out)
