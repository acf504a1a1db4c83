"""Property-matched decoys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.similarity import similarities
from affinia.operators.splits import shuffled


def band_join(actives: DataFrame, pool: DataFrame, tolerances: dict[str, float], equal: list[str], first: str) -> DataFrame:
    """Pool rows within every tolerance of an active (columns a_*). ``first`` is dealt to bands as wide as its tolerance,
    and each active looks into three, so the join is on equal bands."""
    width = tolerances[first]
    a = actives.select(*[F.col(c).alias("a_" + c) for c in actives.columns]).withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    a = a.withColumn("_band", F.floor(F.col("a_" + first) / width) + F.col("_d")).drop("_d")
    for c in equal:
        a = a.withColumnRenamed("a_" + c, c)
    t = pool.withColumn("_band", F.floor(F.col(first) / width)).join(a, ["_band", *equal]).drop("_band")
    for c, tol in tolerances.items():
        t = t.where(F.abs(F.col(c) - F.col("a_" + c)) <= tol)
    return t


def unlike_all(candidates: DataFrame, actives: DataFrame, limit: float = 0.25, key: str = "compound", words: int = 1) -> DataFrame:
    """Candidates whose similarity to every active is under the limit: those that no active reaches, by the pruned search."""
    a = actives.select(F.col("fp").alias("qfp"), F.col("pop").alias("qpop")).distinct().withColumn("qid", F.xxhash64("qfp"))
    one = candidates.select(key, "fp", "pop").distinct()
    return one.select(key).distinct().join(similarities(a, one, limit, words).select(key).distinct(), key, "left_anti")


def pick(matches: DataFrame, n: int, key: str, active: str, seed: int = 42) -> DataFrame:
    """At most n decoys an active, none twice: each goes to its smallest active, then a repeatable shuffle picks."""
    one = matches.groupBy(key).agg(F.min(active).alias(active))
    return one.withColumn("_r", F.row_number().over(Window.partitionBy(active).orderBy(shuffled(key, seed), key))).where(F.col("_r") <= n).drop("_r")
