"""Places and running sums over a whole table, without a window that sees all of it.

Rows are range-partitioned by the order and written, so that each part is one stretch of it; the parts' counts and sums
are added up, and each part goes on from what the parts before it have. The order should be total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.session import stored


#: Rows that one task orders as fast as several do; fewer go through a plain window, with the same result.
SMALL = 200_000


def _few(rows: DataFrame) -> bool:
    return rows.count() <= SMALL


def running(rows: DataFrame, order: list[Column], size: str | None = None, place: str = "place", before: str = "before", parts: int | None = None) -> DataFrame:
    """rows plus the place from 1, and the sum of ``size`` over the rows before (nulls count as 0)."""
    if parts is None and _few(rows):
        w = Window.orderBy(*order)
        out = rows.withColumn(place, F.row_number().over(w).cast("long"))
        if not size:
            return out
        return out.withColumn(before, F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = stored(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    value = F.coalesce(F.col(size), F.lit(0)) if size else F.lit(0)
    sums = t.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_s"))
    w = Window.partitionBy("_part").orderBy(*order)
    own = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumns({"_own": own, "_row": F.row_number().over(w)}).join(F.broadcast(sums), "_part")
    out = t.withColumns({place: (F.col("_n") + F.col("_row")), before: F.col("_s") + F.col("_own")}).drop("_part", "_n", "_s", "_own", "_row")
    return out if size else out.drop(before)


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    return running(rows, order, place=name)


#: Groups whose sizes are sent to the tasks at most; more are joined by a shuffle.
SENT = 1_000_000


def placed(rows: DataFrame, order: list[Column], by: str | None = None, place: str = "place", size: str = "size") -> DataFrame:
    """rows plus the place from 1 in their group, and the group's size. No task sees all of a group, however large."""
    if _few(rows):
        w = Window.partitionBy(*([by] if by else [F.lit(0)]))
        return rows.withColumns({place: F.row_number().over(w.orderBy(*order)).cast("long"), size: F.count("*").over(w)})
    t = numbered(rows, [*([F.col(by)] if by else []), *order], "_p")
    if by is None:
        return t.withColumnRenamed("_p", place).crossJoin(F.broadcast(t.agg(F.count("*").alias(size))))
    g = stored(t.groupBy(F.col(by).alias("_g")).agg((F.min("_p") - 1).alias("_before"), F.count("*").alias(size)), "groups")
    g = F.broadcast(g) if g.count() <= SENT else g
    return t.join(g, F.col(by).eqNullSafe(F.col("_g"))).withColumn(place, F.col("_p") - F.col("_before")).drop("_p", "_g", "_before")
