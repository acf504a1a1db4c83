"""Retrieval evaluation. A ranking is (qid, target, rank); truth is (qid, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.functions.scores import hit_at, mcc, reciprocal_rank
from affinia.operators.ordered import numbered, placed, running
from affinia.session import stored


def ranked(scored: DataFrame, by: str = "qid", score: str = "score", key: str = "target") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)).cast("long"))


def best_ranks(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, best_rank): null where no true target was ranked; queries without truth are left out."""
    return truth.join(ranking, ["qid", "target"], "left").groupBy("qid").agg(F.min("rank").alias("best_rank"))


#: True pairs that are sent to the tasks; more meet the scores by a shuffle.
SENT = 4_000_000


def best_ranks_of(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """best_ranks(ranked(scored), truth) of (qid, target, score), read twice, but with no query's targets put in order: the
    best true target of each query is sought first, then those that are not behind it are counted."""
    truth = stored(truth.select("qid", "target").distinct(), "truth")
    true = scored.join(F.broadcast(truth) if truth.count() <= SENT else truth, ["qid", "target"])
    first = true.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("target").alias("t"))).alias("_first"))
    first = stored(first, "first")  # a row a query
    ahead = scored.join(F.broadcast(first), "qid").where(F.struct((-F.col("score")).alias("s"), F.col("target").alias("t")) <= F.col("_first"))
    return truth.select("qid").distinct().join(ahead.groupBy("qid").agg(F.count("*").alias("best_rank")), "qid", "left")


def rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """Top-k shares, mean reciprocal rank (a miss counts 0), median rank of what was found, and the share never found."""
    r = F.col("best_rank")
    out = [F.count("*").alias("n"), *[F.avg(hit_at(r, k).cast("double")).alias(f"top_{k}") for k in ks], F.avg(reciprocal_rank(r)).alias("mrr"), F.median(r).alias("median_rank"), F.avg(r.isNull().cast("double")).alias("never_found")]
    return ranks.groupBy(*(by or [])).agg(*out)


def confusion(predicted: DataFrame, truth: DataFrame, universe: Column | int) -> DataFrame:
    """Per query tp, fp, fn, tn, precision, recall and MCC; a ratio without a denominator is null."""
    p = predicted.select("qid", "target", F.lit(1).alias("p")).distinct()
    t = truth.select("qid", "target", F.lit(1).alias("t")).distinct()
    both = p.join(t, ["qid", "target"], "full").groupBy("qid").agg(
        F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = both.withColumn("tn", (universe if isinstance(universe, Column) else F.lit(universe)) - tp - fp - fn)
    return out.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)), "recall": F.when(tp + fn > 0, tp / (tp + fn)), "mcc": mcc(tp, fp, fn, F.col("tn"))})


def macro_and_pooled(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the queries' ratios beside the ratio of the sums; they can differ several-fold."""
    s = lambda c: F.sum(c)
    return stats.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("mcc").alias("macro_mcc"),
        F.try_divide(s("tp"), s("tp") + s("fp")).alias("pooled_precision"), F.try_divide(s("tp"), s("tp") + s("fn")).alias("pooled_recall"), mcc(s("tp"), s("fp"), s("fn"), s("tn")).alias("micro_mcc"),
    )


def threshold_sweep(scored: DataFrame, truth: DataFrame, thresholds: list[float], queries: DataFrame) -> DataFrame:
    """Macro precision and recall and covered queries at each threshold, for as many thresholds as are asked for at the cost
    of one: scores go into the bins between thresholds, and a query's counts change only where it has a bin."""
    from pyspark.ml.feature import Bucketizer

    levels = sorted({float(x) for x in thresholds})
    spark = scored.sparkSession
    hit = scored.where("score IS NOT NULL").join(truth.select("qid", "target").distinct().withColumn("true", F.lit(1)), ["qid", "target"], "left")
    cut = Bucketizer(splits=[-float("inf"), *levels, float("inf")], inputCol="_score", outputCol="_bin").transform(hit.select("qid", F.col("score").cast("double").alias("_score"), "true"))
    per = cut.groupBy("qid", F.col("_bin").cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count("true").alias("tp")).where("bin > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("bin"))  # as many rows as bins at most
    asked = queries.select("qid").distinct().join(truth.groupBy("qid").agg(F.count("*").alias("n_true")), "qid", "left")
    runs = per.withColumns({"n_pred": F.sum("n").over(w), "tp": F.sum("tp").over(w), "below": F.coalesce(F.lead("bin").over(w), F.lit(0))}).join(asked, "qid")
    # What a query adds holds for the thresholds below + 1 to bin: it comes at the one and goes after the other.
    value = [F.lit(1).alias("covered"), (F.col("tp") / F.col("n_pred")).alias("precision"), F.coalesce(F.col("tp") / F.col("n_true"), F.lit(0.0)).alias("recall")]
    turns = runs.select("below", "bin", *value).withColumn("_e", F.explode(F.array(F.struct((F.col("below") + 1).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("bin") + 1).alias("at"), F.lit(-1).alias("sign")))))
    names = ("covered", "precision", "recall")
    steps = turns.groupBy("_e.at").agg(*[F.sum(F.col(c) * F.col("_e.sign")).alias(c) for c in names])
    grid = spark.createDataFrame([(i + 1, x) for i, x in enumerate(levels)], "at int, threshold double")
    over = Window.orderBy("at")  # a row a threshold
    curve = grid.join(steps, "at", "left").select("threshold", *[F.sum(F.coalesce(c, F.lit(0))).over(over).alias(c) for c in names])
    total = asked.agg(F.count("*").alias("_all"), F.count("n_true").alias("_with"))
    return curve.crossJoin(F.broadcast(total)).select(
        "threshold", F.when(F.col("covered") > 0, F.col("precision") / F.col("covered")).alias("precision"), F.try_divide(F.col("recall"), F.col("_with")).alias("recall"), F.try_divide(F.col("covered"), F.col("_all")).alias("coverage")
    )


def reliability(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """L-score table: precision of a prediction by its number of votes."""
    t = truth.withColumn("true", F.lit(1))
    return votes.join(t, ["qid", "target"], "left").groupBy("votes").agg(F.count("*").alias("n_predictions"), F.avg(F.col("true").isNotNull().cast("double")).alias("precision"), F.countDistinct("qid").alias("n_queries"))


def popularity_ranks(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Best rank of a true target when targets are ranked by their number of compounds, alike for all queries."""
    n = pairs.groupBy("target").agg(F.countDistinct("compound").alias("score"))
    rank = numbered(n, [F.desc("score"), F.col("target")]).select("target", "rank")
    return truth.join(rank, "target", "left").groupBy("qid").agg(F.min("rank").alias("best_rank"))


def enrichment(scored: DataFrame, fraction: float = 0.2) -> DataFrame:
    """ROC AUC with ties at half (Mann-Whitney on average ranks), and the enrichment factor of the best fraction.

    A lower score is better; rows without one are only counted. label is active or decoy. Ranks are worked out on
    distinct scores, in stretches of them.
    """
    ok = scored.where("score IS NOT NULL")
    levels = ok.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "active").alias("a"))
    levels = running(running(levels, [F.col("score")], "n", "_p", "n_before").withColumn("d", F.col("n") - F.col("a")), [F.col("score")], "d", "_p", "d_before")
    total = levels.agg(F.sum("n").alias("n_all"), F.sum("a").alias("n_active"), F.sum(F.col("a") * (F.col("d_before") + 0.5 * (F.col("n") - F.col("a")))).alias("worse"))
    total = total.withColumns({"auc": F.try_divide(F.col("n_active") * (F.col("n_all") - F.col("n_active")) - F.col("worse"), (F.col("n_active") * (F.col("n_all") - F.col("n_active"))).cast("double")), "k": F.greatest(F.lit(1), F.round(F.col("n_all") * fraction)).cast("long")})
    # The best k rows; a score that k cuts through counts in proportion.
    top = levels.crossJoin(F.broadcast(total.select("k"))).agg(F.sum(F.col("a") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") - F.col("n_before")) / F.col("n")))).alias("found"))
    return total.crossJoin(top).select("n_all", "n_active", "auc", F.try_divide(F.col("found") / F.col("k"), F.col("n_active") / F.col("n_all")).alias("ef"))


def percentile_ranks(scores: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """Share of a group's reference scores that a score beats, in per cent; lower is better and ties count half.

    Scores of groups without reference scores are left out, and null ones on either side. Only distinct scores are
    put in order, in stretches of them.
    """
    n = reference.where("score IS NOT NULL").groupBy(by, "score").agg(F.count("*").alias("n")).withColumn("asked", F.lit(False))
    levels = n.unionByName(scores.where("score IS NOT NULL").select(by, "score").distinct().withColumns({"n": F.lit(0).cast("long"), "asked": F.lit(True)}))
    levels = running(levels.groupBy(by, "score").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked")), [F.col(by), F.col("score")], "n", "_p", "_before")
    groups = levels.groupBy(by).agg(F.min("_before").alias("_start"), F.sum("n").alias("_all")).where("_all > 0")
    above = F.col("_all") - (F.col("_before") - F.col("_start")) - F.col("n")
    return levels.where("asked").join(groups, by).select(by, "score", (100.0 * (above + 0.5 * F.col("n")) / F.col("_all")).alias("percentile"))


def rank_score(rows: DataFrame, value: str, key: str, by: str | None = None, higher: bool = True, name: str = "rank_score") -> DataFrame:
    """1 for the best of a batch to 0 for the worst, by place; ties are broken by key, null values have no score."""
    some = placed(rows.where(F.col(value).isNotNull()), [F.desc(value) if higher else F.asc(value), F.col(key)], by, "_place", "_size")
    some = some.withColumn(name, 1.0 - (F.col("_place") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))).drop("_place", "_size")
    return some.unionByName(rows.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def equal_bins(rows: DataFrame, order: list[Column], k: int, by: str | None = None, name: str = "bin") -> DataFrame:
    """Bins of equal size by place; what is left over goes to the last one."""
    t = placed(rows, order, by, "_place", "_size")
    width = F.greatest(F.floor(F.col("_size") / k), F.lit(1))
    return t.withColumn(name, F.least(F.floor((F.col("_place") - 1) / width), F.lit(k - 1)).cast("int")).drop("_place", "_size")
