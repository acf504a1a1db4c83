"""Every query with SQL, against DuckDB on the same files."""

import math

import duckdb
import pytest

from affinia.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.5f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equal_to_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cur = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (x != "~" and y != "~" and abs(float(x) - float(y)) < 2e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_without_sql(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_results_do_not_depend_on_partitions(spark, sf):
    names = ["f2_u5_t4_adaptive", "g10_t9_pair_argmax", "t12_three_way_split", "m32_p15_document_clusters", "w7_w8_t11_equal_bins"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([sorted(map(str, catalogue.queries()[q](spark, sf).collect())) for q in names])
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
