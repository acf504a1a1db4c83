"""Requests that the id source makes, and searches that leave leaks out or have many queries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from affinia.functions import bits
from affinia.operators import similarity as S
from affinia.session import scratch
from affinia.sources import paged


def served(url, column, ids):
    """Records of even ids; each request is a line of the file at url."""
    with open(url, "a") as f:
        f.write(json.dumps(ids) + "\n")
    return [{"id": i, "name": f"n{i}"} for i in ids if int(i) % 2 == 0]


FETCH = "tests.test_lookup:served"


def requests(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def test_filters_become_requests(spark, tmp_path):
    log = tmp_path / "log"
    got = paged.by_ids(spark, [str(i) for i in range(60)], url=str(log), fetch=FETCH, requests_per_task="2")
    assert sorted(int(r.id) for r in got.collect()) == list(range(0, 60, 2))
    asked = requests(log)
    assert sorted(map(len, asked)) == [10, 25, 25] and sorted(int(i) for a in asked for i in a) == list(range(60))
    log.unlink()
    assert [r.id for r in got.where("id = '4' AND json LIKE '%n4%'").collect()] == ["4"] and requests(log) == [["4"]]
    with pytest.raises(Exception, match="looked up"):
        spark.read.format("ids").options(url=str(log), fetch=FETCH).load().collect()


def test_only_missing_ids_are_backfilled(spark, tmp_path):
    log, out = tmp_path / "log", scratch(spark, "records")
    some = spark.createDataFrame([(i % 40,) for i in range(100)] + [(None,)], "ref int").coalesce(1)
    assert sorted(int(r.id) for r in paged.backfilled(some, "ref", out, str(log), FETCH).collect()) == list(range(0, 40, 2))
    assert sorted(int(i) for a in requests(log) for i in a) == list(range(40)) and max(map(len, requests(log))) <= 25
    log.unlink()
    more = some.unionByName(spark.createDataFrame([(50,), (52,)], "ref int"))
    assert {int(r.id) for r in paged.backfilled(more, "ref", out, str(log), FETCH).collect()} == {*range(0, 40, 2), 50, 52}
    assert {int(i) for a in requests(log) for i in a} == {*range(1, 40, 2), 50, 52}  # what is there is not asked for again


def prints(spark, n, seed, id_col, *names):
    r = random.Random(seed)
    t = spark.createDataFrame([(i, [r.getrandbits(63) & r.getrandbits(63)]) for i in range(n)], f"{id_col} long, {names[0]} array<long>")
    return t.withColumn(names[1], bits.popcount(F.col(names[0])))


def test_leaks_by_either_fingerprint_and_blocks_of_queries(spark, monkeypatch):
    rows, second = prints(spark, 80, 1, "vec_id", "fp", "pop"), prints(spark, 80, 2, "vec_id", "fp", "pop")
    q = lambda t: t.where("vec_id < 20").toDF("qid", "qfp", "qpop")
    every = lambda t: {(r.qid, r.vec_id): r.t for r in S.similarities(q(t), t).collect()}
    a, b = every(rows), every(second)
    want = {k for k in a if k[0] != k[1] and a[k] < 0.25 and b[k] < 0.25}
    assert 0 < len(want) < len(a)
    for size in (S.QUERY_BLOCK, 6):
        monkeypatch.setattr(S, "QUERY_BLOCK", size)
        assert every(rows) == a
        assert {(r.qid, r.vec_id) for r in S.similarities(q(rows), rows, 0.25).collect()} == {k for k in a if a[k] >= 0.25}
        clean = S.with_leaks(q(rows), rows, 0.25, second=second, second_queries=q(second))
        assert {(r.qid, r.vec_id) for r in S.similarities(clean, rows, keep=S.unleaked()).collect()} == want
        assert {(r.qid, r.vec_id) for r in S.without_leaks(q(rows), rows, 0.25).collect()} == {k for k in a if k[0] != k[1] and a[k] < 0.25}
