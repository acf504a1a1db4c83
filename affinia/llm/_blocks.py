"""Pairs of rows that share a key, compared inside tasks without emitting the pairs.

Each item has an array of bucket keys, one a table. Buckets of one member are dropped, and buckets with the same
members become one. A bucket of more than ``block`` members is cut into blocks, and every pair of its blocks is one
group of rows, so that a large bucket spreads over many tasks. A pair that shares several buckets belongs to the one
with the smallest key that both have, which both rows show; so it is compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.operators.skew import by_count

BLOCK = 512
NONE = np.iinfo(np.int64).max


#: Ids that are broadcast at most; each takes about 16 bytes in a task's memory.
BROADCAST_IDS = 4_000_000


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where rows has columns that are called so (letter case is no difference)."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def by_ids(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """rows whose id is (left_semi) or isn't (left_anti) in ids, a written table of distinct ids.

    Up to BROADCAST_IDS of them are counted and sent to the tasks, so that long rows needn't be dealt by id; more are
    joined by a shuffle.
    """
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, on, how)


def looked_up(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left with the columns of right where that has its key, else nulls. right is a written table of few of left's keys
    and count, of how many rows they have; up to BROADCAST_IDS of them are sent to the tasks."""
    n = right.agg(F.count("*").alias("n"), F.sum(count).alias("s")).first()
    if n.n <= BROADCAST_IDS:
        return left.join(F.broadcast(right), key, "left")
    return by_count(left, right, key, count, n.s)


def memberships(items: DataFrame, id_col: str = "rep", keys: str = "keys") -> DataFrame:
    """(id, groups) for the items that share a bucket with another; groups: array of (pos, g, c) by table."""
    flat = items.select(F.col(id_col), F.posexplode(keys).alias("pos", "key"))
    a, b = F.xxhash64(id_col), F.xxhash64(F.lit(7), F.col(id_col))
    live = flat.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b")).where("c > 1")
    live = live.select("key", F.xxhash64("c", "a", "b").alias("g"), F.col("c").cast("int").alias("c"))
    return flat.join(live, "key").groupBy(id_col).agg(F.collect_list(F.struct("pos", "g", "c")).alias("groups"))


def spread(rows: DataFrame, id_col: str = "rep", block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """rows with groups, once for each pair of blocks that they are part of, gathered and sorted by that."""
    own = F.array_distinct(F.transform("groups", lambda x: F.struct(x["g"].alias("g"), x["c"].alias("c"))))
    t = rows.withColumn("_x", F.explode(own)).withColumn("_n", F.ceil(F.col("_x.c") / block).cast("int"))
    t = t.withColumn("_s", F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.col("_n")).cast("int"))
    t = t.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = t.withColumns({"_g": F.col("_x.g"), "_i": F.least("_s", "_y"), "_j": F.greatest("_s", "_y")}).drop("_x", "_n", "_y")
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(n, "_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j", id_col)


def grouped(kernel: Callable[[dict, int, bool], Iterator[pa.RecordBatch]], columns: list[str]):
    """A mapInArrow function that calls kernel(columns of a group as lists or arrays, group's key, both blocks the same)."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(t: pa.Table, last: bool):
            g, i, j = (t.column(c).to_numpy() for c in ("_g", "_i", "_j"))
            cut = np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = np.concatenate([[0], cut, [len(g)]])
            upto = len(edges) - 1 if last else len(edges) - 2
            for k in range(upto):
                a, b = int(edges[k]), int(edges[k + 1])
                if b - a > 1:
                    part = t.slice(a, b - a)
                    yield from kernel({c: part.column(c) for c in columns}, int(g[a]), bool(i[a] == j[a]))
            rest = t.slice(int(edges[upto])) if not last else None
            held[:] = rest.to_batches() if rest is not None and rest.num_rows else []

        for b in batches:
            if b.num_rows:
                if held and all(held[-1].column(c)[-1].as_py() == b.column(c)[b.num_rows - 1].as_py() for c in ("_g", "_i", "_j")):
                    held.append(b)  # still the same group
                    continue
                yield from groups(pa.Table.from_batches([*held, b]), False)
        if held:
            yield from groups(pa.Table.from_batches(held), True)

    return run


def key_matrix(groups: pa.ChunkedArray, tables: int) -> np.ndarray:
    """Bucket of each row in each table; 0 where it has no partner."""
    c = groups.combine_chunks()
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0)
    n = np.diff(c.offsets.to_numpy())
    flat = c.flatten()
    out = np.zeros((len(c), tables), np.int64)
    out[np.repeat(np.arange(len(c)), n), flat.field("pos").to_numpy()] = flat.field("g").to_numpy()
    return out


def owned(keys: np.ndarray, i: int, js: np.ndarray, g: int) -> np.ndarray:
    """Which of the pairs (i, js) belong to bucket g."""
    k = keys[js]
    return np.where((k == keys[i]) & (k != 0), k, NONE).min(1) == g
