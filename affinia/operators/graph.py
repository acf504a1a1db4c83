"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.operators.skew import by_count
from affinia.session import forget, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; component is its smallest reachable node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the number of rounds grows with the
    logarithm of a component's size, long chains included, and no step puts a component's rows on one node of
    higher degree than its neighbours; nodes with a large part of all edges are joined by broadcast. Each round ends in a written table. Null ends and loops are ignored.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = stored(e, "cc")
    last, size = None, e.count()
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = by_count(both, low, "u", "n", 2 * size, "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            by_count(down, small_low, "u", "n", 2 * size, "inner").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        nxt = stored(small, "cc")
        sign = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(e)
        e, size = nxt, sign[0]
        if tuple(sign) == last:
            break
        last = tuple(sign)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    pairs = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().join(e.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return pairs.unionByName(roots.withColumn("component", F.col("node")))
