"""Secret scans with an incremental blob ledger (native).

Every version of every path is addressed by the SHA-256 of its text. A ledger is a folder that holds, for each blob and
rule version, the spans that a scan found; a version of the corpus adds only the pairs that it lacks, one copy of each
blob being scanned, and findings are joined from the ledger to all paths. Rows of a blob are reduced before the shuffle,
so a third of all rows may share one. A ledger to which a retried job has added twice reads as if it had added once.

Spark's regular expressions give matches, not places. A place is the sum of the lengths of the pieces between matches
(``split`` with the same pattern) and of the matches before it, counted in code points. Sums over many matches go by
blocks, so that no step copies what the steps before it have found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.llm._blocks import by_count, fresh
from affinia.session import exists, scratch, stored, table

# Fixed by the contract: kind, pattern, group that is measured, its least length.
RULES = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
RULE_VERSION = "base-1"
#: A text without a match of these has no match that counts; they are cheaper than to measure every match.
_QUICK = {
    "assign": r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
#: Patterns that match whole runs, and the ones that match only those of the least length.
_RUNS = {(r"AKIA[A-Z0-9]+", 16): r"AKIA[A-Z0-9]{12,}", (r"[0-9a-f]+", 32): r"[0-9a-f]{32,}"}
#: Versions in which the queries here hand over a corpus, and bytes of findings that are sent to the tasks at most.
VERSIONS, SENT_BYTES = 2, 32 << 20
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPAN}"
_BLOCK, _PIECE = 64, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The merge of each value (of 0 or more) with all before it, by blocks: time grows as n * _BLOCK + (n / _BLOCK) ** 2."""
    fold = lambda a: F.aggregate(a, F.lit(0), merge)
    last = F.ceil(F.size(values) / _BLOCK).cast("int") - 1

    def walk(blocks):
        inside = lambda b, before: F.transform(b, lambda _, j: merge(before, fold(F.slice(b, 1, j + 1))))
        return _let(F.transform(blocks, fold), lambda tops: F.flatten(F.transform(blocks, lambda b, i: _let(fold(F.slice(tops, 1, i)), lambda before: inside(b, before)))))

    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_let(cut, walk))


def rule_spans(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of the matches that count, as structs in the order in which they are sorted."""
    # A text is cut around its matches, and each piece's length with the match after it gives the next place.
    quick = _QUICK.get(kind)
    pattern = _RUNS.get((pattern, least), pattern)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    got = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else whole
    gap = F.transform(F.split(text, pattern, -1), F.length)
    seen = F.arrays_zip(F.slice(gap, 1, F.size(whole)).alias("gap"), whole.alias("len"), got.alias("got"))

    def spans(m):
        ends = _upto(F.transform(m, lambda x: x["gap"] + x["len"]), lambda a, b: a + b)
        found = F.zip_with(m, ends, lambda x, e: F.struct((e - x["len"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), x["got"].alias("got")))
        return F.transform(F.filter(found, lambda x: x["got"] >= least), lambda x: x.dropFields("got")).cast(SPAN)

    found = _let(seen, spans)
    return F.when(text.rlike(quick), found).otherwise(F.array().cast(SPAN)) if quick else found


def scan(blobs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """blobs without their text, plus ``spans``, sorted by start, then by the rules' order."""
    kinds = [rule_spans(F.col(text), *r, rank=i) for i, r in enumerate(rules)]
    return blobs.withColumn("spans", F.array_sort(F.concat(*kinds))).drop(text)


def _named(versions: DataFrame, text: str) -> DataFrame:
    named = versions.drop("blob", "spans").withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return named.withColumn("blob", F.sha2(F.col(text), 256))


def _known(ledger: DataFrame, rule_version: str) -> DataFrame:
    """One row a blob, however often the ledger has it."""
    return ledger.where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("spans").alias("spans"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules=RULES, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """What versions adds to the ledger: the scan of one copy of each blob that it lacks under this rule version."""
    blobs = _named(versions, text).groupBy("blob").agg(F.first(text).alias(text))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    return scan(blobs, rules, text).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def with_spans(named: DataFrame, hits: DataFrame, blob: str = "blob", spans: str = "spans") -> DataFrame:
    """named, rows with a blob, plus the spans of hits, a written table of one row a blob; null where it has none.

    Findings of SENT_BYTES at most are sent to the tasks; of more, those of the commonest blobs.
    """
    size = hits.agg(F.sum(100 + 40 * F.size(spans))).first()[0] or 0
    hits = hits.withColumnRenamed("blob", blob)
    if size <= SENT_BYTES:
        return named.join(F.broadcast(hits), blob, "left")
    n = fresh(named, "_c")[0]
    counted = stored(named.groupBy(blob).agg(F.count("*").alias(n)).join(hits, blob), "hits")
    return by_count(named, counted, blob, n, counted.agg(F.sum(n)).first()[0] or 0).drop(n)


def findings_by_blob(ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """One row a blob that has findings."""
    return stored(_known(ledger, rule_version).where(F.size("spans") > 0), "hits")


def findings(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """Every row of versions without its text, plus ``blob`` and ``spans`` as the ledger has them."""
    return with_spans(_named(versions, text).drop(text), findings_by_blob(ledger, rule_version)).withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def blob_ledger_scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, rule_version: str = RULE_VERSION, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every row of versions, rows to append to the ledger), the latter written before it is used.

    versions has one row for each historical version of each path, with a text column; a null text counts as empty.
    The findings are versions without the text, plus ``blob`` and ``spans``. The ledger's columns are blob,
    rule_version and spans; rows that it repeats count once. Repeated rows each get the findings; an empty table gives
    none. Columns of versions named blob or spans are replaced, the rest stay.
    """
    new = stored(unseen(versions, ledger, rules, rule_version, text), "unseen")
    return findings(versions, new if ledger is None else new.unionByName(ledger.select("blob", "rule_version", "spans")), rule_version, text), new


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger in a folder; empty where there is none yet."""
    if exists(spark, path):
        return spark.read.schema(LEDGER).parquet(path)
    none = F.lit(None)
    return spark.range(0).select(none.cast("string").alias("blob"), none.cast("string").alias("rule_version"), none.cast(SPAN).alias("spans"))


def add_version(versions: DataFrame, path: str, rules=RULES, rule_version: str = RULE_VERSION, text: str = "text") -> None:
    """Scan what the ledger in the folder lacks, and add it."""
    unseen(versions, read_ledger(versions.sparkSession, path), rules, rule_version, text).write.mode("append").parquet(path)


def history(docs: DataFrame, key: str = "doc_id", versions: int = VERSIONS) -> list[DataFrame]:
    """docs as it grew: version k has the rows of the first k of so many shares by a hash of the key, the last has all rows.
    So a version holds all that the one before it had, as the versions of a corpus do."""
    share = F.pmod(F.xxhash64(key), F.lit(versions))
    return [docs.where(share <= k) for k in range(versions - 1)] + [docs]


def scanned(docs: DataFrame, path: str, key: str = "doc_id", versions: int = VERSIONS) -> DataFrame:
    """The ledger in the folder after each version of docs has been added; a version scans what those before it lack."""
    for version in history(docs, key, versions):
        add_version(version, path)
    return read_ledger(docs.sparkSession, path)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping ones merged, replaced by the mark."""

    def cut(pieces, a, b):
        i = F.floor(a / _PIECE).cast("int")
        held = F.array_join(F.slice(pieces, i + 1, F.floor((b - 1) / _PIECE).cast("int") - i + 1), "")
        return F.when(b > a, F.substr(held, a - i * _PIECE + 1, b - a)).otherwise("")

    def out(x):
        before = lambda k: F.when(k == 0, 0).otherwise(F.get(x["ends"], k - 1))
        kept = F.transform(x["spans"], lambda s, k: F.when(s["start"] >= before(k), F.concat(cut(x["pieces"], before(k), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), cut(x["pieces"], F.element_at(x["ends"], -1), x["n"]))

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))
    whole = F.struct(spans.alias("spans"), _upto(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("ends"), pieces.alias("pieces"), F.length(text).alias("n"))
    return F.when(F.size(spans) == 0, text).otherwise(_let(whole, out))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents. The ledger gets half of the rows as a first version and all of them as a second, of which it
    scans what it lacks; then every path's findings are read from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs, scanned(docs, scratch(spark, "ledger")))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(r[0]) for r in RULES], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_kind(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest([struct_pack(a := list_sum(p[1:k]) + coalesce(list_sum(m[1:k - 1]), 0), e := list_sum(p[1:k]) + list_sum(m[1:k]), g := g[k]) FOR k IN range(1, len(m) + 1)]) AS x
      FROM (SELECT doc_id, [length(y) FOR y IN regexp_split_to_array(t, '{pattern}')] AS p, [length(y) FOR y IN regexp_extract_all(t, '{pattern}', 0)] AS m, [length(y) FOR y IN regexp_extract_all(t, '{pattern}', {group})] AS g FROM d)"""


_ASSIGN_SQL = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(f"SELECT doc_id, rank, kind, x.a AS a, x.e AS e FROM ({_sql_kind(k, _ASSIGN_SQL if k == 'assign' else p, g, n, i)}) WHERE x.g >= {n}" for i, (k, p, g, n) in enumerate(RULES))}),
s AS (SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
      string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY a, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
