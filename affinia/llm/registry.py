"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from affinia.llm import bwt_dedup, cdc_dedup, centroid_blocks, decontaminate, hard_negatives, html_text, itq_neighbors, jaccard_join, kd_shards, quality_cnn, secrets, sentencepiece_sa, warc

_ALL = [
    (kd_shards.op1_kd_shards, None),
    (html_text.op2_html_text, None),
    (itq_neighbors.op3_itq_neighbors, None),
    (quality_cnn.op4_quality_cnn, None),
    (secrets.op5_secrets, secrets.ORACLE_SQL),
    (sentencepiece_sa.op6_sentencepiece, None),
    (warc.op7_warc, warc.ORACLE_SQL),
    (cdc_dedup.op8_cdc_repeats, None),
    (jaccard_join.op9_jaccard_join, jaccard_join.ORACLE_SQL),
    (decontaminate.op10_decontaminate, decontaminate.ORACLE_SQL),
    (hard_negatives.op11_hard_negatives, hard_negatives.ORACLE_SQL),
    (centroid_blocks.op12_centroid_blocks, centroid_blocks.ORACLE_SQL),
    (bwt_dedup.op13_bwt_dedup, None),
]


def queries() -> dict:
    return {q.__name__: q for q, _ in _ALL}


def oracle_sql() -> dict:
    return {q.__name__: sql for q, sql in _ALL if sql}
