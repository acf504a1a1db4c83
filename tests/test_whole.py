"""Queries that must see every row of their tables."""

from collections import Counter

from affinia.plans import catalogue


def clusters(edges, limit=1000):
    """Compound -> smallest compound joined with it, by union-find over documents of at most limit compounds."""
    up, of = {}, {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for c, d in set(edges):
        of.setdefault(d, set()).add(c)
        find(c)
    for cs in of.values():
        if len(cs) <= limit:
            for c in cs:
                a, b = sorted((find(c), find(min(cs))))
                up[b] = a
    return {c: find(c) for c in up}


def test_document_clusters_take_every_row(spark, tmp_path):
    edges = [(c, 1) for c in range(1, 7)]  # more than 4 compounds
    edges += [(c + k, 100 + c) for c in range(10, 40) for k in (0, 1)]  # a chain
    edges += [(50, 200), (51, 200), (60, 201)]
    edges += [(c, 300) for c in range(1000, 2001)]  # 1001 compounds: no link
    edges += [(c, 301) for c in range(3000, 4000)]  # 1000 compounds: one cluster
    rows = [(c, d, float(1 + (c + d) % 50)) for c, d in edges]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = clusters(edges)
    got = {r.compound: r.cluster for r in catalogue.queries()["m32_p15_document_clusters"](spark, str(tmp_path)).collect()}
    assert got == want
    spark.createDataFrame(edges, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    split = catalogue.queries()["t14_cluster_split"](spark, str(tmp_path)).collect()
    assert {r.cluster: r["size"] for r in split} == Counter(want.values())
    target = round(0.2 * len(want))
    assert all(r.side == "train" for r in split if r["size"] > target) and 0 < sum(r["size"] for r in split if r.side == "test")


def test_the_most_significant_targets_stay(spark, sf, monkeypatch):
    from affinia.plans import models

    monkeypatch.setattr(models, "_sea", lambda t: spark.createDataFrame([(1, "far", 50.0, 10), (1, "near", 3.3, 10)], "qid long, target string, raw double, n long"))
    got = {r.target: r.p_value for r in catalogue.queries()["m18_x11_sea_pvalue"](spark, sf).collect()}
    assert set(got) == {"far", "near"} and got["far"] <= 0.0001 < got["near"]


def test_pasted_lines_with_any_separator_stay(spark, tmp_path):
    spark.createDataFrame([("a;b\nc\td,e\nf,g\n\n;x",)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["p13_s16_pasted_lines"](spark, str(tmp_path)).collect()
    assert sorted(r.value for r in got) == ["a", "c", "f"]


def test_bootstraps_draw_as_often_as_the_reference(spark, sf, monkeypatch):
    from affinia.plans import evaluation

    seen = []
    monkeypatch.setattr(evaluation.T, "cluster_bootstrap", lambda rows, *a, resamples=2000: seen.append(resamples) or rows)
    for q in ("m9_cluster_bootstrap", "m10_paired_bootstrap"):
        catalogue.queries()[q](spark, sf)
    assert seen == [10_000, 10_000]
