"""Exact bit-vector similarity of a batch of queries with all rows, and what is made of it.

Scores are of distinct compounds; pairs of compound and target are joined to them afterwards. The queries are the side
that is sent to the tasks: they are counted first, and more than QUERY_BLOCK are dealt to blocks, which rows meet by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.functions import bits
from affinia.functions.scores import evidence_score

QUERY_BLOCK = 1 << 15
#: From so many queries on, rows are dealt anew, so that a task has so many pairs at most, however the files are cut.
MANY_QUERIES, TASK_PAIRS = 32, 20_000_000


def similarities(queries: DataFrame, rows: DataFrame, least: float = 0.0, words: int = 1, keep: Column | None = None) -> DataFrame:
    """Queries (qid, qfp, qpop, ...) x rows (fp, pop, ...) with t >= least.

    Above 0 the join is on popcounts: each query is repeated for the bands of popcounts that can reach it, so a row meets
    only queries of its band, and only popcounts that fit exactly go on to the bits. At 0 every pair is wanted.
    One word is taken out of its array before the join. Rows are dealt to all cores first, as the work is in the pairs.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = cores
    if n >= MANY_QUERIES:
        parts = max(cores, -(-n * rows.count() // TASK_PAIRS))
        rows = rows.repartition(parts)
    t = bits.tanimoto(F.col("fp"), F.col("qfp"), F.col("pop"), F.col("qpop"), words)
    if words == 1:
        first = lambda df, c: df.withColumn(c, F.get(c, F.lit(0)))
        rows, queries = first(rows, "fp"), first(queries, "qfp")
        shared = F.bit_count(F.col("fp").bitwiseAND(F.col("qfp")))
        union = F.col("pop") + F.col("qpop") - shared
        t = F.when(union > 0, shared.cast("double") / union).otherwise(F.lit(0.0))
    on = []
    if blocks > 1:  # each row meets every block of queries once; a block is a key of the join, not a plan of its own
        deals = -(-parts // blocks)  # a block's queries meet as many deals of rows, so that there are keys for all tasks
        deal = F.pmod(F.xxhash64(*rows.columns), F.lit(deals)).cast("int")
        queries = queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        rows, on = rows.withColumn("_deal", deal).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["_block", "_deal"]
    if least > 0:
        # Bands as wide as the fingerprint has words: 64 of them at most.
        low, high = F.floor(F.col("qpop") * least / words), F.floor(F.col("qpop") / (least * words))
        queries = queries.withColumn("_band", F.explode(F.sequence(F.greatest(low - 1, F.lit(0)), F.least(high + 1, F.lit(bits.WORD)))))
        rows, on = rows.withColumn("_band", F.floor(F.col("pop") / words)), [*on, "_band"]
    q = F.broadcast(queries) if blocks == 1 else queries
    both = rows.join(q, on).drop(*on) if on else rows.join(q)
    if least > 0:
        both = both.where(bits.band(F.col("qpop"), F.col("pop"), least))
    if keep is not None:
        both = both.where(keep)
    both = both.withColumn("t", t).drop("fp", "pop", "qfp", "qpop")
    return both.where(F.col("t") >= least) if least > 0 else both


def top(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows a group, with their place; the order should be total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def target_summary(hits: DataFrame, target: str = "target", scaffold: str = "scaffold", potency: str = "pchembl", compound: str = "compound") -> DataFrame:
    """One row a query and target: hits, best and mean similarity and potency, scaffolds (null ones don't count)."""
    return hits.groupBy("qid", target).agg(
        F.count("*").alias("n_hits"), F.max("t").alias("best_similarity"), F.avg("t").alias("mean_similarity"),
        F.max(potency).alias("best_potency"), F.avg(potency).alias("mean_potency"), F.countDistinct(scaffold).alias("n_scaffolds"),
        F.max_by(compound, F.struct(F.col("t"), -F.col(compound))).alias("best_compound"),
    )


def ranked_targets(hits: DataFrame, target: str = "target") -> DataFrame:
    """target_summary with the evidence score, and ranks by similarity and by score, each with the target as tie key."""
    return ranked_summary(target_summary(hits, target), target)


def ranked_summary(summary: DataFrame, target: str = "target") -> DataFrame:
    s = summary.withColumn("evidence", evidence_score(F.col("best_similarity"), F.col("n_scaffolds"), F.col("best_potency")))
    by = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), target)).cast("long")
    return s.withColumns({"rank_similarity": by("best_similarity"), "rank_evidence": by("evidence")})


def suggest(rows: DataFrame, text: str, columns: list[str], key: str, potency: str, limit: int = 8) -> DataFrame:
    """The most potent row of each key that has the text in one of the columns; at most 20 rows."""
    from affinia.functions.text import contains_any

    found = rows.where(contains_any(text, *[F.col(c) for c in columns]))
    best = top(found, [key], [F.desc_nulls_last(potency), *[F.col(c) for c in columns]], 1, "_r").drop("_r")
    return best.orderBy(F.desc_nulls_last(potency), key).limit(max(1, min(limit, 20)))


def with_leaks(queries: DataFrame, rows: DataFrame, cutoff: float, key: str = "vec_id", second: DataFrame | None = None, second_queries: DataFrame | None = None) -> DataFrame:
    """queries plus ``leaked``, the sorted keys of the rows that a query must not be compared with: those of cutoff or more by
    either fingerprint, and its own. A search leaves them out with ``unleaked(key)`` as its keep, so no table of all pairs arises."""
    near = similarities(queries, rows, cutoff).select("qid", key)
    if second is not None:
        near = near.unionByName(similarities(queries if second_queries is None else second_queries, second, cutoff).select("qid", key))
    near = near.unionByName(queries.select("qid", F.col("qid").alias(key)))
    return queries.join(near.groupBy("qid").agg(F.array_sort(F.collect_set(key)).alias("leaked")), "qid")


def unleaked(key: str = "vec_id") -> Column:
    return ~F.array_contains("leaked", F.col(key))


def without_leaks(queries: DataFrame, rows: DataFrame, cutoff: float, key: str = "vec_id", second: DataFrame | None = None) -> DataFrame:
    """(qid, key) of the rows that a query may be compared with: none of cutoff or more by either fingerprint, not itself.
    By one fingerprint the pair's own similarity tells, so no query carries a list of leaks."""
    if second is None:
        return similarities(queries, rows, keep=F.col("qid") != F.col(key)).where(F.col("t") < cutoff).select("qid", key)
    return similarities(with_leaks(queries, rows, cutoff, key, second), rows, keep=unleaked(key)).select("qid", key)
