"""What queries find at targets, worked out where a target's pairs lie, so that no table of hits and pairs arises.

A hit is a query, a compound and one of the compound's targets: as many as queries times pairs. Pairs are dealt by target
instead and packed into blocks of whole targets. A block of queries meets a block of pairs as one row of a join, as in
``bitmatrix``; numpy counts the common bits and reduces each target's stretch of the block. One row a query and target, or
its few best, leaves the task. Targets of more than SPLIT rows are dealt in parts, whose rows are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.operators import bitmatrix as B
from affinia.operators.similarity import top as first_of
from affinia.session import bound_batches, stored

#: Rows of a block, queries of one, pairs that are counted at a time.
SIZE, QUERIES, TILE = 4096, 2048, 1 << 16
#: Bits of a row's place in a target's stretch; rows of a target from which on it is dealt in parts, and rows that are dealt
#: to a task.
PLACE = 17
SPLIT, TASK = 1 << PLACE, 200_000
#: Compounds that are sent to the tasks; more are joined by a shuffle.
SENT = 1_000_000


def dealt(rows: DataFrame, target: str = "target", compound: str = "compound") -> DataFrame:
    """rows dealt by target, plus ``_part``: null, or of a large target the part that a compound belongs to. What is grouped
    by target, _part and more afterwards needs no further shuffle."""
    sizes = stored(rows.groupBy(target).agg(F.count("*").alias("_n")), "sizes")
    large = sizes.where(F.col("_n") > SPLIT)
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK))
    if large.isEmpty():
        return rows.withColumn("_part", F.lit(None).cast("int")).repartition(parts, target)
    large = large.select(F.col(target).alias("_t"), F.ceil(F.col("_n") / SPLIT).alias("_parts"))  # a row for SPLIT rows at most
    t = rows.join(F.broadcast(large), F.col(target).eqNullSafe(F.col("_t")), "left")
    return t.withColumn("_part", F.pmod(F.xxhash64(compound), F.col("_parts")).cast("int")).drop("_t", "_parts").repartition(parts, target, "_part")


def of_compounds(pairs: DataFrame, compounds: DataFrame, compound: str = "compound") -> DataFrame:
    """A dealt table's pairs with the columns of their compounds: where they lie if the compounds can be sent there, else dealt again."""
    if compounds.count() <= SENT:
        return pairs.join(F.broadcast(compounds), compound)
    return pairs.join(compounds, compound).repartition(max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // TASK)), "target", "_part")


def _blocks(pairs: DataFrame, names: list[str], order: list[str], parts: bool) -> DataFrame:
    """pairs of a dealt table as rows of bitmatrix's blocks, each of whole targets; parts of targets are cut at SPLIT rows."""
    out = T.StructType.fromDDL("block long, lo int, hi int, words int, bits binary, pops array<int>")
    for c in names:
        out.add(c, T.ArrayType(pairs.schema[c].dataType))

    def packed(t: pa.Table, block: int) -> pa.RecordBatch:
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks())
        bits = t.column("_fp").combine_chunks().flatten().to_numpy().tobytes()
        head = [pa.array([block]), *(pa.array([x], pa.int32()) for x in (0, 0, len(bits) // 8 // t.num_rows)), pa.array([bits], pa.binary()), one("_pop")]
        return pa.RecordBatch.from_arrays([*head, *map(one, names)], names=out.names)

    def run(batches):
        held, count, at = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < SIZE:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            ends, done = np.arange(SPLIT, t.num_rows, SPLIT) if parts else _ends(t.column("target").chunk(0)), 0
            while True:  # blocks of SIZE rows or more that end where a target may
                fit = ends[(ends >= done + SIZE) & (ends < t.num_rows)]
                if not len(fit):
                    break
                yield packed(t.slice(done, int(fit[0]) - done), at)
                done, at = int(fit[0]), at + 1
            held, count = t.slice(done).to_batches(), t.num_rows - done
        if count:
            yield packed(pa.Table.from_batches(held), at)

    t = pairs.select(F.col("fp").alias("_fp"), F.col("pop").cast("int").alias("_pop"), *names, *[c for c in order if c not in names])
    t = t.sortWithinPartitions("target", *order).select("_fp", "_pop", *names)
    return t.mapInArrow(run, out)


def _ends(a: pa.Array) -> np.ndarray:
    """Where runs of equal values end; nulls are equal."""
    return np.asarray(pc.run_end_encode(a, run_end_type=pa.int64()).run_ends)


def _found(queries: DataFrame, pairs: DataFrame, names: list[str], order: list[str], parts: bool, out: T.StructType, work: Callable) -> DataFrame:
    bound_batches(pairs.sparkSession)
    q = B.blocks(queries, "qid", "qfp", "qpop", size=QUERIES)
    rows = _blocks(pairs, names, order, parts)
    if q.count() > B.SENT:
        rows = stored(rows, "pairs")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from work(B._Pair(b, i))

    return B.met(q, rows, how=F.lit(True)).mapInArrow(run, out)


def _tiles(p: B._Pair):
    """(queries, common bits, bits in either or 1) of a few queries at a time with all rows of the block."""
    step = max(1, TILE // len(p.r))
    one = p.r.shape[1] == 1  # counts of one word, and their sums, are bytes
    qpop, pop = (x.astype(np.uint8) if one else x for x in (p.qpop, p.pop))
    both = np.empty((min(step, len(p.q)), len(p.r)), np.uint64) if one else None
    for i in range(0, len(p.q), step):
        s = slice(i, i + step)
        q = p.q[s]
        shared = np.bitwise_count(np.bitwise_and(q, p.r[:, 0], out=both[: len(q)])) if one else B.common(q, p.r)
        yield s, shared, np.maximum(qpop[s][:, None] + pop - shared, 1)


def _merged(pairs: DataFrame, found: Callable, merge: Callable) -> DataFrame:
    """found of whole targets, and merged found of those in parts, if there are any. found is told whether they are parts."""
    if pairs.where("_part IS NOT NULL").isEmpty():
        return found(pairs, False)
    return found(pairs.where("_part IS NULL"), False).unionByName(merge(found(pairs.where("_part IS NOT NULL"), True)))


def summary(queries: DataFrame, pairs: DataFrame, least: float = 0.0, potency: str | None = None, scaffold: str | None = None) -> DataFrame:
    """(qid, target, n_hits, best_similarity, total_similarity) of each query (qid, qfp, qpop) and target that has pairs of a
    similarity of least or more; with potency best_potency and mean_potency, with scaffold n_scaffolds (null ones don't count).

    pairs are dealt, one row a compound and target, with fp and pop."""
    qid, target = queries.schema["qid"].dataType, pairs.schema["target"].dataType
    out = T.StructType([T.StructField("qid", qid), T.StructField("target", target)])
    for c, k in (("n_hits", "long"), ("best_similarity", "double"), ("total_similarity", "double")):
        out.add(c, k)
    if potency:
        out.add("best_potency", "double").add("_potency", "double").add("_measured", "long")
    if scaffold:
        out.add("_scaffolds", T.ArrayType(pairs.schema[scaffold].dataType)).add("n_scaffolds", "long")
    names = ["target", *[c for c in (potency, scaffold) if c]]

    def found(part: DataFrame, listed: bool) -> DataFrame:
        def work(p: B._Pair):
            names_of = p.list("target")
            ends = _ends(names_of)
            cut = np.concatenate([[0], ends[:-1]])
            add = lambda x, at, kind: np.add.reduceat(x, at, axis=1, dtype=kind)
            if potency:
                worth = p.list(potency).cast(pa.float64())
                known = np.asarray(worth.is_valid())
                worth = worth.fill_null(0.0).to_numpy()
                value, level = np.unique(worth, return_inverse=True)
                level = np.where(known, level + 1, 0).astype(np.uint16 if len(value) < 1 << 16 else np.uint32)  # of values in order; 0: none
            if scaffold:
                kinds = p.list(scaffold)
                runs = np.union1d(ends, _ends(kinds))
                kind_at = np.concatenate([[0], runs[:-1]])
                named = np.asarray(kinds.take(pa.array(kind_at)).is_valid())
                kind_cut = np.searchsorted(kind_at, cut)
            got, held = [], None
            for s, shared, either in _tiles(p):
                if held is None:
                    held = np.empty((2, *shared.shape))
                t, hits = held[:, : len(shared)]
                np.copyto(t, shared), np.copyto(hits, either), np.divide(t, hits, t)
                hit = t >= least
                one = hit.view(np.uint8)
                np.copyto(hits, one)
                n = add(one, cut, np.uint32)
                who, which = np.nonzero(n)
                at = lambda x: x[who, which]  # noqa: E731, B023
                cols = [who + s.start, which, at(n).astype(np.int64), at(np.maximum.reduceat(t, cut, axis=1)), at(add(np.multiply(t, hits, t), cut, None))]
                if potency:
                    best = at(np.maximum.reduceat(np.multiply(level, one, dtype=level.dtype), cut, axis=1)).astype(np.int64)
                    m = n if known.all() else add(one * known, cut, np.uint32)
                    cols += [value[np.maximum(best, 1) - 1], at(add(np.multiply(hits, worth, t), cut, None)), at(m).astype(np.int64)]
                if scaffold:
                    seen = np.maximum.reduceat(one, kind_at, axis=1).view(bool) & named
                    cols.append(at(add(seen, kind_cut, np.int64)))
                    if listed:
                        in_one, place = np.nonzero(seen)
                        group = np.searchsorted(kind_cut, place, side="right") - 1
                        cols.append(place[np.lexsort((place, group, in_one))])
                got.append(cols)
            last = len(got[0]) - 1
            col = [np.concatenate([g[i] for g in got]) for i in range(len(got[0]))]
            if not len(col[0]):
                return
            arrays = [p.list("q_qid").take(pa.array(col[0])), names_of.take(pa.array(cut[col[1]])), *(pa.array(c) for c in col[2:5])]
            if potency:
                none = col[7] == 0
                arrays += [pa.array(col[5], mask=none), pa.array(col[6], mask=none), pa.array(col[7])]
            if scaffold:
                counts = pa.array(col[last - 1] if listed else col[last])
                if listed:
                    offsets = np.concatenate([[0], np.cumsum(col[last - 1])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), kinds.take(pa.array(kind_at[col[last]])))
                else:
                    lists = pa.nulls(len(counts), pa.list_(kinds.type))
                arrays += [lists, counts]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

        return _found(queries, part, names, [scaffold] if scaffold else [], listed, out, work)

    def merge(parts: DataFrame) -> DataFrame:
        a = [F.sum("n_hits").alias("n_hits"), F.max("best_similarity").alias("best_similarity"), F.sum("total_similarity").alias("total_similarity")]
        if potency:
            a += [F.max("best_potency").alias("best_potency"), F.sum("_potency").alias("_potency"), F.sum("_measured").alias("_measured")]
        if scaffold:
            kinds = F.array_distinct(F.flatten(F.collect_list("_scaffolds")))
            a += [kinds.alias("_scaffolds"), F.size(kinds).cast("long").alias("n_scaffolds")]
        return parts.groupBy("qid", "target").agg(*a)

    s = _merged(pairs, found, merge)
    if potency:
        s = s.withColumn("mean_potency", F.col("_potency") / F.col("_measured"))
    return s.drop("_potency", "_measured", "_scaffolds")


def top(queries: DataFrame, pairs: DataFrame, k: int, least: float = 0.0, potency: str | None = None, own: bool = True) -> DataFrame:
    """(qid, target, compound, t, potency, rank) of the k most similar compounds of each query and target; ties by the
    compound. Without own, a query is not compared with the compound of its name. pairs as for summary."""
    names = ["target", "compound", *([potency] if potency else [])]
    out = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), *[pairs.schema[c] for c in names]]).add("t", "double").add("rank", "long")

    def work(p: B._Pair):
        name = p.list("target")
        ends = _ends(name)
        cut = np.concatenate([[0], ends[:-1]])
        # A row's key: its similarity by steps smaller than what two can differ by, then its place from the end, as rows of a
        # target stand in the order of compounds. The largest key of a stretch is its best row.
        kind, real, steps = (np.int32, np.float32, 1 << 13) if p.r.shape[1] == 1 else (np.int64, np.float64, 1 << 45)
        last = (1 << PLACE) - 1
        place = (last - np.arange(len(name)) + np.repeat(cut, ends - cut)).astype(kind)
        who_own, at_own = (np.zeros(0, int),) * 2 if own else B.same(p.values("q_qid"), p.values("compound"))
        got = []
        for s, shared, either in _tiles(p):
            key = (np.divide(shared.astype(real), either.astype(real)) * real(steps)).astype(kind)
            np.left_shift(key, kind(PLACE), key), np.bitwise_or(key, place, key)
            mine = (who_own >= s.start) & (who_own < s.stop)
            key[who_own[mine] - s.start, at_own[mine]] = -1
            for rank in range(1, k + 1):
                best = np.maximum.reduceat(key, cut, axis=1)
                who, which = np.nonzero(best >= 0)
                at = cut[which] + (last - (best[who, which] & last))
                t = shared[who, at] / either[who, at].astype(np.float64)
                who, at, t = (x[t >= least] for x in (who, at, t))
                if not len(who):
                    break
                got.append((who + s.start, at, t, np.full(len(who), rank)))
                key[who, at] = -1
        if got:
            who, at, t, rank = (np.concatenate(c) for c in zip(*got))
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([p.list("q_qid").take(pa.array(who)), *(p.list(c).take(at) for c in names), pa.array(t), pa.array(rank)], names=out.names)

    found = lambda part, parts: _found(queries, part, names, ["compound"], parts, out, work)
    merge = lambda parts: first_of(parts.drop("rank"), ["qid", "target"], [F.desc("t"), F.col("compound")], k)
    return _merged(pairs, found, merge)
