import corpus_pipeline as P
from affinia.llm import _blocks, decontaminate, secrets
from affinia.session import stored
from tests.llm.data import LONG, documents, empty, text
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as classes


def run_stages(spark, sf, docs):
    for name, stage in P.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), "t")
        yield name, before, docs


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, before, after in run_stages(spark, sf, docs):
        old = {r.doc_id: r for r in before.collect()}
        new = {r.doc_id: r for r in after.collect()}
        if name != P.STAGES[-1][0]:
            assert after.dtypes == before.dtypes
        rows = [(i, r.text) for i, r in old.items()]
        if name.startswith("n-gram"):
            assert set(new) == {i for i, (c, _) in classes(rows).items() if c == i}
        elif name.startswith("benchmark"):
            assert set(new) == {i for i, x in contaminated(rows, bench).items() if not x[1]}
        elif name.startswith("secret"):
            assert set(new) == set(old)
            assert all(r.n_chars == len(r.text) for i, r in new.items() if r.text != old[i].text)
        elif name.startswith("quality"):
            assert set(new) < set(old) and len(new) > len(old) / 2
    assert all(r.lossless for r in new.values())


CLASH = "blob _blob spans _spans _salt _key text_key score predicted n_words n_hit contaminated items_sha256 _own_score class rep"


def test_odd_rows_and_columns_pass_every_stage(spark, sf):
    """Nulls, empty and long texts, copies, repeated rows, and columns called as the stages call theirs."""
    docs = stored(documents(spark, CLASH), "docs")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        got = out.toPandas()
        assert 0 < len(got) <= docs.count() and all(set(got[c]) == {"x"} for c in CLASH.split()), name
    for name, before, after in list(run_stages(spark, sf, documents(spark)))[1:]:
        assert after.count() <= before.count(), name
    kept = P.near_duplicates(spark, documents(spark), sf).toPandas()
    assert (kept.doc_id == 40).sum() == 1 and kept.doc_id.isna().sum() == 1
    told = {r.doc_id: r for r in P.secret_removal(spark, documents(spark), sf).collect()}
    assert "hunter22xx" not in told[50].text and told[50].n_chars == len(told[50].text) and told[0].text is None and told[4].text == LONG


def test_empty_tables_and_two_columns(spark, sf):
    docs = documents(spark).select("doc_id", "text")
    for name, stage in P.STAGES:
        assert stage(spark, empty(docs), sf).count() == 0, name
        assert stage(spark, docs, sf).count() > 0, name


def test_distinct_texts_of_one_id_stay(spark, sf):
    rows = [(1, text(1, 60), 5), (1, text(2, 60), 5), (1, text(2, 60), 4), (2, text(3, 60), 1)]
    out = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), sf).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out) == sorted([rows[0], rows[2], rows[3]])


def test_ids_that_are_joined_rather_than_sent(spark, sf, monkeypatch):
    """Beyond their bounds, ids and findings are joined by a shuffle, with the same result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [sorted(map(str, stage(spark, docs, sf).collect())) for _, stage in P.STAGES[1:4]]
    monkeypatch.setattr(_blocks, "BROADCAST_IDS", 0)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 0)
    monkeypatch.setattr(secrets, "SENT_BYTES", 0)
    assert [sorted(map(str, stage(spark, docs, sf).collect())) for _, stage in P.STAGES[1:4]] == want
