"""Density-adaptive nearest-neighbour voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.functions.scores import potency_weight
from affinia.operators.similarity import top
from affinia.session import stored

DENSE_AT, DENSE_FROM, POOL, CAP = 0.5, 8, 10, 300


def compound_similarity(hits: DataFrame, compound: str = "compound") -> DataFrame:
    return hits.groupBy("qid", compound).agg(F.max("t").alias("t"))


def density(compounds: DataFrame, at: float = DENSE_AT) -> DataFrame:
    """Compounds of a similarity of at least ``at``, over all of them and unrounded."""
    return compounds.groupBy("qid").agg(F.count_if(F.col("t") >= at).alias("density"))


def neighbours(compounds: DataFrame, n: int = CAP, compound: str = "compound") -> DataFrame:
    return top(compounds, ["qid"], [F.desc("t"), F.col(compound)], n)


def pooled_votes(near: DataFrame, pairs: DataFrame, k: int = POOL, compound: str = "compound", alpha: float = 0.0, **cfg) -> DataFrame:
    """Sum over the k nearest compounds' targets of potency weight times t ** alpha, with the votes' number."""
    w = potency_weight(F.col("pchembl"), **cfg) * (F.pow("t", F.lit(alpha)) if alpha else F.lit(1.0))
    return near.where(F.col("rank") <= k).join(pairs, compound).groupBy("qid", "target").agg(F.sum(w).alias("score"), F.count("*").alias("votes"))


def orthologue_votes(hits: DataFrame, least: float, distinct: bool = False, compound: str = "compound") -> DataFrame:
    """One vote for each row (each target once, if distinct) of a compound with at least the given similarity."""
    rows = hits.where(F.col("t") >= least)
    near = neighbours(compound_similarity(rows, compound), CAP, compound).select("qid", compound)
    got = rows.join(near, ["qid", compound])
    if distinct:
        got = got.select("qid", compound, "target").distinct()
    return got.groupBy("qid", "target").agg(F.count("*").cast("double").alias("score"))


#: Neighbours that are sent to the tasks; more meet the pairs by a shuffle.
SENT = 4_000_000


def votes_in_place(near: DataFrame, pairs: DataFrame, weight: Column, compound: str = "compound") -> DataFrame:
    """(qid, target, score): weight summed over the pairs of each query's neighbours. pairs are dealt by target, so they are
    summed up where they lie and no table of neighbours' pairs is shuffled."""
    near = stored(near, "near")
    near = F.broadcast(near) if near.count() <= SENT else near
    return pairs.join(near, compound).groupBy("qid", "target").agg(F.sum(weight).alias("score"))


def best_similarity(hits: DataFrame, compound: str = "compound") -> DataFrame:
    """Best similarity a target, with the compound that has it and that compound's own potency."""
    best = F.max_by(F.struct(F.col(compound).alias("c"), F.col("pchembl").alias("p")), F.struct(F.col("t"), -F.col(compound)))
    return hits.groupBy("qid", "target").agg(F.max("t").alias("score"), best.alias("_b")).select("qid", "target", "score", F.col("_b.c").alias("best_compound"), F.col("_b.p").alias("best_potency"))


def adaptive(hits: DataFrame, pairs: DataFrame, orthologue: DataFrame | None = None, top_k: int = 25, dense_from: int = DENSE_FROM, compound: str = "compound", k: int = POOL) -> DataFrame:
    """Pooled votes where a query has dense_from near compounds or more, else best similarity; top_k targets a query."""
    compounds = compound_similarity(hits, compound)
    d = density(compounds)
    pooled = pooled_votes(neighbours(compounds, CAP, compound), pairs, k, compound).select("qid", "target", "score")
    if orthologue is not None:
        pooled = pooled.unionByName(orthologue).groupBy("qid", "target").agg(F.sum("score").alias("score"))
    dense = F.col("density") >= dense_from
    a = pooled.join(d, "qid").where(dense).withColumn("regime", F.lit("pooled"))
    b = best_similarity(hits, compound).select("qid", "target", "score").join(d, "qid").where(~dense).withColumn("regime", F.lit("best_similarity"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "target")
    return a.unionByName(b).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)
