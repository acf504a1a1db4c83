"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of one key that a task can well take.
HARMLESS = 10_000


def by_count(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """left joined with right, of one row a key, of which count tells how many rows left has.

    Keys with over a thousandth of all rows, at most a thousand of them, are broadcast; so none makes a large task.
    Keys of HARMLESS rows or fewer are joined as any others.
    """
    least = max(HARMLESS, total // 1000)
    if total <= least:
        return left.join(right, key, how)
    hot, rest = right.where(F.col(count) > least), right.where(F.col(count) <= least)
    mark = hot.select(key)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(mark), key, "left_anti").join(rest, key, how))
