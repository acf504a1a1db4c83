"""Compound by target predictions in long form, shortlists, and applicability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.ordered import numbered

ACTIVE, GAP = 6.0, 1.0


def in_domain(rows: DataFrame) -> DataFrame:
    """pred is null outside the applicability domain."""
    return rows.withColumn("pred", F.when(F.col("in_ad"), F.col("pred")))


def profile(rows: DataFrame, active: float = ACTIVE, gap: float = GAP) -> DataFrame:
    """Per compound: best target, gap to the next, call, active targets, mean and coverage, over in-domain cells."""
    p = F.col("pred")
    w = Window.partitionBy("compound").orderBy(F.desc_nulls_last("pred"), "target")
    t = in_domain(rows).withColumn("_r", F.row_number().over(w))
    at = lambda k, c: F.max(F.when((F.col("_r") == k) & p.isNotNull(), F.col(c)))
    g = t.groupBy("compound").agg(
        F.count(p).alias("n_in_domain"), F.count("*").alias("n_targets"), at(1, "target").alias("best_target"), at(1, "pred").alias("best_pred"), at(2, "pred").alias("_second"),
        F.count_if(p >= active).alias("n_active"), F.avg(p).alias("mean_pred"),
    )
    n, step = F.col("n_in_domain"), F.col("best_pred") - F.col("_second")
    call = F.when(n >= 2, F.when(step >= gap, "selective").otherwise("multi-target")).when(n == 1, "single in-domain target").otherwise("no in-domain target")
    return g.withColumns({"gap_to_next": step, "call": call, "coverage": n / F.col("n_targets"), "multi_target": F.col("n_active") >= 2}).drop("_second")


def consensus(profiles: DataFrame) -> DataFrame:
    """Place by active targets, then mean prediction (to 9 digits, so that equal sums in another order tie), then compound; those without a mean have none."""
    ok = profiles.where("mean_pred IS NOT NULL")
    return numbered(ok, [F.desc("n_active"), F.desc(F.round("mean_pred", 9)), F.col("compound")], "consensus_rank")


def best_per_target(rows: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.desc("pred"), "compound")
    return in_domain(rows).where("pred IS NOT NULL").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def fused(q: Column, d: Column, weight: float = 0.35) -> Column:
    """Weighted rank scores; the first alone where the second is missing."""
    return F.when(q.isNotNull() & d.isNotNull(), (1 - weight) * q + weight * d).otherwise(q)


def shortlist(rows: DataFrame, score: str, key: str) -> DataFrame:
    """Final places; rows without a score come last."""
    return numbered(rows, [F.desc_nulls_last(score), F.col(key)])


def column_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and sample deviation of each column; a constant column's deviation is 1e-8."""
    sd = lambda c: F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1e-8))
    return rows.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[sd(c).alias(f"{c}_sd") for c in columns])


def mean_abs_z(rows: DataFrame, columns: list[str], stats: DataFrame, name: str = "ad_z", limit: float = 3.0) -> DataFrame:
    """Mean absolute z-score over the columns, and whether it is within the limit. stats has one row."""
    z = reduce(lambda a, b: a + b, [F.abs(F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in columns]) / len(columns)
    return rows.crossJoin(F.broadcast(stats)).withColumn(name, z).withColumn("in_ad", F.col(name) <= limit).drop(*stats.columns)
