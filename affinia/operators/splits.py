"""Leakage-safe splits. A shuffle is the order of a salted digest, so it repeats on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.operators.graph import connected_components
from affinia.operators.ordered import running
from affinia.session import stored


def shuffled(key: str | Column, seed: int = 42) -> Column:
    """Sort key of a repeatable shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def fill(groups: DataFrame, order: list[Column], target: float | Column, size: str = "size", name: str = "chosen") -> DataFrame:
    """Groups in order until their sizes reach the target; the group that crosses it is chosen too.

    The order should be total. No task sees all groups.
    """
    return running(groups, order, size, "_place", "_before").withColumn(name, F.col("_before") < target).drop("_place", "_before")


def fill_shuffled(groups: DataFrame, key: str, target: float, seed: int = 42, size: str = "size", name: str = "chosen") -> DataFrame:
    """fill() in shuffled order without a global sort: 256 buckets by the digest's first two digits are summed first."""
    t = groups.withColumn("_h", shuffled(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    sums = t.groupBy("_b").agg(F.sum(size).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("_own", own).join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + F.col("_own") < target).drop("_h", "_b", "_own", "_before")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(shuffled(key, seed), key).limit(n)


def sample_per_group(rows: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(by).orderBy(shuffled(key, seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def scaffold_holdout(members: DataFrame, group: str, n: int, least: int = 1, most: int = 50, seed: int = 42) -> DataFrame:
    """(group, size, held_out): groups of least to most members in shuffled order until n members are held out."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size"))
    fine = fill_shuffled(sizes.where(F.col("size").between(least, most)), group, n, seed, name="held_out")
    return fine.unionByName(sizes.where(~F.col("size").between(least, most)).withColumn("held_out", F.lit(False)))


def temporal_split(members: DataFrame, group: str, year: str, fraction: float) -> DataFrame:
    """(group, size, year, test): the groups with the latest first year until the fraction of members is in the test."""
    g = members.groupBy(group).agg(F.count("*").alias("size"), F.min(year).alias("year")).where("year IS NOT NULL")
    total = F.broadcast(g.agg(F.round(F.sum("size") * fraction).alias("_target")))
    return fill(g.crossJoin(total), [F.desc("year"), F.col(group)], F.col("_target"), name="test").drop("_target")


def hyper_nodes(edges: DataFrame, node: str, of: str, limit: int) -> DataFrame:
    """Nodes with more than limit neighbours."""
    return edges.groupBy(node).agg(F.countDistinct(of).alias("n")).where(F.col("n") > limit).select(node)


def document_clusters(edges: DataFrame, compound: str = "compound", document: str = "document", limit: int = 1000) -> DataFrame:
    """(compound, cluster): compounds joined through documents of at most ``limit`` compounds; cluster is the smallest."""
    small = edges.join(hyper_nodes(edges, document, compound, limit), document, "left_anti")
    hub = stored(small.groupBy(document).agg(F.min(compound).alias("hub")), "hubs")
    found = connected_components(small.join(hub, document).select(F.col(compound).alias("src"), F.col("hub").alias("dst")))
    every = edges.select(compound).distinct()
    return every.join(found.withColumnRenamed("node", compound), compound, "left").select(compound, F.coalesce("component", compound).alias("cluster"))


def cluster_split(clusters: DataFrame, fraction: float, key: str = "cluster", seed: int = 42) -> DataFrame:
    """(cluster, size, side): shuffled clusters fill the test set; one too large for it goes to train."""
    sizes = stored(clusters.groupBy(key).agg(F.count("*").alias("size")), "sizes")
    target = round(fraction * (sizes.agg(F.sum("size")).first()[0] or 0))
    fine = fill_shuffled(sizes.where(F.col("size") <= target), key, target, seed, name="test")
    return fine.withColumn("side", F.when(F.col("test"), "test").otherwise("train")).drop("test").unionByName(sizes.where(F.col("size") > target).withColumn("side", F.lit("train")))


def _turns(counts: list[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """For (size, how many groups), sizes falling: (size, [(first place, folds in turn)]) of the greedy choice; places from 0.

    Groups of one size go round the folds that lie less than a size above the smallest, until the next fold joins them.
    """
    loads, place, out = [0] * k, 0, []
    for size, left in counts:
        steps = []
        while left:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            m = next((i for i in range(1, k) if (loads[order[i]], order[i]) > (loads[order[0]] + size, order[0])), k)
            low = loads[order[0]]
            rounds = -(-left // m) if m == k or not size else max(1, (loads[order[m]] - low) // size - 1)
            n = min(left, m * rounds)
            steps.append((place, order[:m]))
            for i, f in enumerate(order[:m]):
                loads[f] += size * (n // m + (i < n % m))
            place, left = place + n, left - n
        out.append((size, steps))
    return out


def group_folds(members: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """(group, size, fold): groups from the largest down, each to the smallest fold so far; none is divided.

    Groups of one size take folds in turns that follow from how many groups each size has, which is all the driver
    sees: as many rows as there are different sizes, at most the root of twice the number of members. So the choice
    is the greedy one at every number of groups.
    """
    sizes = stored(members.groupBy(group).agg(F.count("*").alias("size")), "folds")
    counts = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]
    turns = sizes.sparkSession.createDataFrame(_turns(counts, k), "size long, _steps array<struct<first: long, folds: array<int>>>")
    placed = running(sizes, [F.desc("size"), shuffled(group, seed), F.col(group)], place="_place").join(F.broadcast(turns), "size")
    at = F.col("_place") - 1
    step = F.element_at(F.filter("_steps", lambda x: x["first"] <= at), -1)
    fold = F.get(step["folds"], ((at - step["first"]) % F.size(step["folds"])).cast("int"))
    return placed.select(group, "size", fold.alias("fold"))


def without(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return rows.join(held.select(key), key, "left_anti")
