"""Hyperparameters chosen on other folds, and candidates for a review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chosen_by_fold(outcomes: DataFrame, grid: list[str], fold: str = "fold", value: str = "value") -> DataFrame:
    """(fold, grid columns, inner, n_train, n_test): for each fold the grid point with the best mean over the other folds.

    outcomes has a row for each record and grid point. A grid point's score for a fold is the mean of the other folds' means,
    all folds at once: the sum over all folds less the own. The smallest grid point wins a tie. Records of a single fold have
    no other, so none is chosen.
    """
    own = outcomes.groupBy(fold, *grid).agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    every = Window.partitionBy(*grid)  # as many rows as folds
    left = own.withColumns({"_k": F.count("*").over(every) - 1, "_rest": F.sum("_m").over(every) - F.col("_m"), "n_train": F.sum("_n").over(every) - F.col("_n")})
    left = left.where("_k > 0").withColumn("inner", F.round(F.col("_rest") / F.col("_k"), 12))
    best = left.withColumn("_r", F.row_number().over(Window.partitionBy(fold).orderBy(F.desc("inner"), *grid))).where("_r = 1")
    return best.select(fold, *grid, "inner", "n_train", F.col("_n").alias("n_test"))


def out_of_fold(outcomes: DataFrame, chosen: DataFrame, grid: list[str], fold: str = "fold") -> DataFrame:
    """The rows of outcomes at the grid point that was chosen for their fold without them."""
    return outcomes.join(F.broadcast(chosen.select(fold, *grid)), [fold, *grid])  # one row a fold


def candidates(ranking: DataFrame, truth: DataFrame, per_query: int = 4, queries: int = 54) -> DataFrame:
    """ranking (qid, target, score, rank, ...) less the true pairs: the first ``per_query`` of each query, of the ``queries``
    queries whose best candidate scores highest, ties by the query."""
    false = ranking.join(truth.select("qid", "target").distinct(), ["qid", "target"], "left_anti")
    few = false.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "target"))).where(F.col("_r") <= per_query).drop("_r")
    first = few.groupBy("qid").agg(F.max("score").alias("_top")).orderBy(F.desc("_top"), "qid").limit(queries).select("qid")
    return few.join(F.broadcast(first), "qid")
