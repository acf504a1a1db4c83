"""A corpus from raw documents to tokens, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents. A stage reads doc_id and
text, and n_chars where docs has it; further columns go along unchanged, whatever they are called. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm import decontaminate, jaccard_join, quality_cnn, secrets, sentencepiece_sa
from affinia.llm._blocks import fresh
from affinia.session import scratch, stored, table


def _beside(docs: DataFrame, *taken: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names called otherwise, and how."""
    clash = [c for c in docs.columns if c in taken]
    other = dict(zip(clash, fresh(docs, *[f"_own_{c}" for c in clash])))
    return docs.withColumnsRenamed(other), other


def _back(out: DataFrame, docs: DataFrame, other: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns])


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, repeated rows alike. It learns from the labelled rows of docs that are not
    held out; with labels of one class or none every text gets one score. A null or empty text has the score of an
    empty one. A score of 0.7 itself stays."""
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    own, other = _beside(docs, "score", "predicted")
    return _back(quality_cnn.score(own, net).where("predicted = 1"), docs, other)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row: that of the smallest doc_id, and where this has several texts or rows, the
    one of the smallest hash, then the first by its other columns. Texts without words, null and empty ones too, and
    rows without doc_id all stay."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none. Repeated rows share their fate."""
    own, other = _beside(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return _back(decontaminate.contamination(own, table(spark, sf_dir, "benchmark")).where("NOT contaminated"), docs, other)


def secret_removal(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts overwritten, overlapping ones once; n_chars follows where a text has changed.
    Null and empty texts stay as they are."""
    blob, spans = fresh(docs, "_blob", "_spans")
    ledger = secrets.scanned(docs.select("doc_id", "text"), scratch(spark, "ledger"))
    hits = secrets.findings_by_blob(ledger).withColumnRenamed("spans", spans)
    out = secrets.with_spans(docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)), hits, blob, spans)
    out = out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text, with its doc_id, lang and source as far as docs has them; none for a null or empty text."""
    return sentencepiece_sa.encode(docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns])).drop("text")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_removal),
    ("SentencePiece encoding and decoding", tokens),
]
#: The classifier and the tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
