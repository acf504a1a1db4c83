import re

from pyspark.sql import functions as F

from affinia.llm import secrets as S
from affinia.session import scratch
from tests.llm.data import documents, empty

PATTERNS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def brute(t):
    out = []
    for i, (kind, p, g, n) in enumerate(PATTERNS):
        out += [(m.start(), i, kind, m.end()) for m in p.finditer(t or "") if len(m.group(g)) >= n]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


CASES = ["", "token=secret:abcdefghij", "API_KEY : 'abcdefgh' password=short Secret=12345678", "é🙂 passwd='zzzzzzzz' " + "a" * 31 + " " + "a" * 32, "AKIAAKIA" + "B" * 8, "AKIA" + "C" * 11, "apikey=apikey=apikey=x", "tokentoken=abcdefghi.jkl token=abcdefgh", "paſſword=abcdefgh toKen=abcdefgh", "0" * 64 + "g" + "f" * 40, "x" * 5000 + "secret=" + "y" * 9]


def test_spans_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    found, _ = S.blob_ledger_scan(df)
    for r in found.withColumn("s", S.joined(F.col("spans"))).collect():
        assert r.s == brute(CASES[r.doc_id]), CASES[r.doc_id][:60]


def test_ledger_scans_only_what_is_unseen(spark):
    old = spark.createDataFrame([("a", 1, "password=abcdefgh"), ("b", 1, "clean")], "path string, version int, text string")
    found, new = S.blob_ledger_scan(old)
    ledger = new
    assert ledger.count() == 2
    late = old.unionByName(spark.createDataFrame([("c", 2, "password=abcdefgh"), ("b", 2, "secret = zyxwvuts")], old.schema))
    found, new = S.blob_ledger_scan(late, ledger)
    assert new.count() == 1
    assert {(r.path, r.version) for r in found.where(F.size("spans") > 0).collect()} == {("a", 1), ("c", 2), ("b", 2)}
    assert S.blob_ledger_scan(late, ledger, rule_version="next")[1].count() == 3
    twice = ledger.union(ledger)  # a job that was retried after it had added
    assert S.blob_ledger_scan(late, twice)[0].count() == late.count()


def test_a_ledger_folder_over_versions(spark):
    """Each version scans only what no version before it had; findings are the same in one version and in three."""
    docs = documents(spark)
    path, scans = scratch(spark, "ledger"), []
    for rows in (docs.where("doc_id < 30"), docs, docs):
        before = S.read_ledger(spark, path).count()
        S.add_version(rows, path)
        scans.append(S.read_ledger(spark, path).count() - before)
    blobs = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert scans[0] > 0 and scans[0] + scans[1] == blobs and scans[2] == 0
    key = lambda r: (r.doc_id or -1, str(r.spans))
    found = [sorted(map(key, S.findings(docs, S.scanned(docs, scratch(spark, "ledger"), versions=n)).collect())) for n in (1, 3)]
    assert found[0] == found[1] == sorted(map(key, S.findings(docs, S.read_ledger(spark, path)).collect()))


def test_the_queries_second_version_scans_only_what_the_first_lacks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    first, second = S.history(docs)
    blobs = lambda d: {r.blob for r in S._named(d, "text").select("blob").collect()}
    old, every = blobs(first), blobs(second)
    assert second.count() == docs.count() and 0.3 * len(every) < len(old) < 0.7 * len(every) and old < every
    path, added, scan = scratch(spark, "ledger"), [], S.scan

    def counted(rows, *a):
        added.append({r.blob for r in rows.select("blob").collect()})
        return scan(rows, *a)

    monkeypatch.setattr(S, "scan", counted)
    ledger = S.scanned(docs, path)
    assert added == [old, every - old] and ledger.count() == len(every)  # the blobs of the first version are skipped


def test_many_findings(spark, monkeypatch):
    """Tens of thousands of matches in one text, and findings joined by the commonest blobs where they are too large to send."""
    t = " ".join(f"é{i} token={i:08d}x" + ("0123456789abcdef" * 2 if i % 7 == 0 else "") for i in range(30_000))
    rows = [(i, t) for i in range(3)] + [(9, "secret=12345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (S.SENT_BYTES, 0):
        monkeypatch.setattr(S, "SENT_BYTES", size)
        found, _ = S.blob_ledger_scan(df)
        got = found.withColumn("s", S.joined(F.col("spans"))).collect()
        assert {r.doc_id: r.s for r in got} == {i: brute(x) for i, x in rows}
    told = df.join(found, "doc_id").select("doc_id", S.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in told} == {i: redacted(x) for i, x in rows}


def redacted(t):
    out, at = "", 0
    for a, e in sorted((int(a), int(e)) for _, a, e in (x.split(":") for x in brute(t).split(","))):
        if a >= at:
            out += t[at:a] + "[REDACTED]"
        at = max(at, e)
    return out + t[at:]


def test_redaction_merges_overlaps(spark):
    t = "k secret=" + "0123456789abcdef" * 2 + " end é"
    df = spark.createDataFrame([(1, t), (2, "nothing")], "doc_id long, text string")
    found, _ = S.blob_ledger_scan(df)
    got = {r.doc_id: r.t for r in df.join(found, "doc_id").select("doc_id", S.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "k [REDACTED] end é", 2: "nothing"}


def test_odd_rows(spark):
    d = documents(spark, "blob spans _salt rule_version _c")
    found, _ = S.blob_ledger_scan(d)
    got = found.withColumn("s", S.joined(F.col("spans"))).toPandas()
    assert len(got) == d.count() and set(got[got.s != ""].doc_id) == {50.0}
    assert S.blob_ledger_scan(empty(d))[0].count() == 0
