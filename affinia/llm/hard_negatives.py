"""Hard negatives by exact search of k-means inverted lists.

Centroids are learned on at most SAMPLE vectors; then every vector goes to the list of its nearest centroid c, and each
list keeps its radius r, the largest distance of a member from c. For an anchor a, Cauchy-Schwarz bounds all scores of a
list: a.c - |a| r <= a.x <= a.c + |a| r. An anchor visits lists by falling upper bound. It skips a list whose bounds lie
outside the window in which it looks, and it stops when the upper bound falls strictly below its k-th score so far; a
list whose bound equals that score is visited, so ties are settled by id. What is found is exact whatever the centroids.

The search runs in rounds of ever more lists a visit (FIRST, then GROWTH times as many, at last all that are left). In
each, an anchor asks for the lists that it can't rule out; lists are packed into cells of about CELL rows, and anchors of
near lists into blocks of about BLOCK. Cells and blocks that ask for each other meet by a shuffle in groups of bounded
size, and at most k rows a window leave a group. A large list is cut into several cells, so that no task grows with it.
Vectors of different lengths have no score; each length has lists of its own.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from affinia.llm.centroid_blocks import usable
from affinia.session import bound_batches, forget, stored, table

#: Vectors to learn from at most, by number and by bytes; lists at most; least vectors of a length that get centroids.
SAMPLE, SAMPLE_BYTES, MOST_LISTS, LEARN = 20_000, 64 << 20, 1024, 100
CELL, BLOCK = 4096, 512
FIRST, GROWTH = 8, 8
#: Squared lengths below this have exact scores in double precision.
EXACT = 1 << 53
NONE = -(1 << 62)


def learned(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's rounds from rows drawn at random."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        who = _closest(x, c)[0]
        n = np.bincount(who, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, who, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    who = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
    return who, np.linalg.norm(x - c[who], axis=1)


class Lists:
    """The lists of all lengths: centroids, radii, and the cells that hold them. Its size is that of the centroids."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids, self.first, n = centroids, {}, 0
        for dim in sorted(centroids):
            self.first[dim] = n
            n += len(centroids[dim])
        self.n, self.radius, self.cells = n, np.zeros(n), [(0, 0)] * n

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each anchor can have in each list of its length; empty lists have none."""
        c = self.centroids[a.shape[1]]
        at = self.first[a.shape[1]]
        r = self.radius[at : at + len(c)]
        long = np.linalg.norm(a, axis=1)[:, None]
        mid, reach = a @ c.T, long * r
        reach += 1e-9 * (long * (r + np.linalg.norm(c, axis=1)) + 1)  # rounding
        empty = r < 0
        return np.where(empty, np.inf, mid - reach), np.where(empty, -np.inf, mid + reach)

    def open(self, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, seen: int, upto: int) -> np.ndarray:
        """Which lists each anchor asks for, of the places seen .. upto in its order: those that some window can't rule out."""
        low, high = self.bounds(a)
        order = np.argsort(-high, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        meets = ((high[:, :, None] >= lo[:, None, :]) & (low[:, :, None] <= hi[:, None, :]) & (lo <= hi)[:, None, :]).any(2)
        return meets & (place >= seen) & (place < upto)


def _rows(column, kind=np.int64) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the lists in a column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        out.append((at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), dim)))
    return out


def _packed(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """First cell and number of cells of each list that has rows: short ones share a cell, long ones take several."""
    out, cell, held = {}, 0, 0
    for i in sorted(counts):
        if counts[i] > size or held + counts[i] > size:
            cell, held = cell + (held > 0), 0
        parts = -(-counts[i] // size)
        out[i] = (cell, parts)
        cell, held = (cell + parts, 0) if parts > 1 else (cell, held + counts[i])
    return out


def _dealt(rows: DataFrame, packed: dict[int, tuple[int, int]], name: str) -> DataFrame:
    """rows with the cell of their list, rows of several cells dealt by a hash of their id and vector."""
    spark = rows.sparkSession
    t = spark.createDataFrame([(i, c, n) for i, (c, n) in sorted(packed.items())], "list int, _first int, _parts int")  # MOST_LISTS a length
    return rows.join(F.broadcast(t), "list").withColumn(name, F.col("_first") + F.pmod(F.xxhash64("vec_id", "q"), "_parts").cast("int")).drop("_first", "_parts")


def index(vectors: DataFrame, anchors: Column, sample: int = SAMPLE, lists: int | None = None, cell: int = CELL, block: int = BLOCK) -> tuple[DataFrame, DataFrame, Lists]:
    """(vectors with list and cell, the anchors among them with row and block, the lists). vectors has vec_id, label and q."""
    counts = {r.dim: r.n for r in vectors.groupBy(F.size("q").alias("dim")).agg(F.count("*").alias("n")).collect()}
    most = max(LEARN, min(sample, SAMPLE_BYTES // (8 * max([1, *counts]))))
    drawn: dict[int, list] = {}
    for r in vectors.select("q").orderBy(F.xxhash64("vec_id", "q")).limit(most).collect():
        drawn.setdefault(len(r.q), []).append(r.q)
    centroids = {}
    for dim, n in counts.items():
        x = np.array(drawn.get(dim, []), float).reshape(-1, dim)
        centroids[dim] = learned(x, min(lists or round(sqrt(n)), MOST_LISTS, len(x))) if len(x) >= LEARN else np.zeros((1, dim))
    made = Lists(centroids)
    out = T.StructType([*vectors.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def run(batches):
        for b in batches:
            who, away = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at, x in _rows(b.column(2), float):
                i, d = _closest(x, made.centroids[x.shape[1]])
                who[at], away[at] = i + made.first[x.shape[1]], d
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(who), pa.array(away)], names=[*b.schema.names, "list", "away"])

    t = stored(vectors.select("vec_id", "label", "q").mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id()), "lists")
    made.radius[:] = -1
    sizes, asking = {}, {}
    for r in t.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.count_if(anchors).alias("a")).collect():
        made.radius[r.list], sizes[r.list] = r.r, r.n
        if r.a:
            asking[r.list] = r.a
    packed = _packed(sizes, cell)
    for i, c in packed.items():
        made.cells[i] = c
    members = stored(_dealt(t.drop("away"), packed, "cell"), "members")
    return members.drop("row"), stored(_dealt(members.where(anchors).drop("cell"), _packed(asking, block), "block").drop("list"), "anchors"), made


def _asked(state: DataFrame, made: Lists, seen: int, upto: int) -> DataFrame:
    """state once for each cell that the anchor asks for, with the lists wanted there."""
    out = T.StructType([*state.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("wanted", T.ArrayType(T.IntegerType()))])
    names = state.columns

    def run(batches):
        for b in batches:
            lo, hi = (np.array(b.column(names.index(c)).to_pylist(), np.int64).reshape(b.num_rows, -1) for c in ("lo", "hi"))
            for at, a in _rows(b.column(names.index("q")), float):
                want = made.open(a, lo[at], hi[at], seen, upto)
                i, j = np.nonzero(want)
                j = j + made.first[a.shape[1]]
                first, parts = np.array(made.cells, np.int64).reshape(-1, 2)[j].T
                rep = np.repeat(np.arange(len(i)), parts)
                cell = first[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
                by = np.lexsort((j[rep], cell, i[rep]))
                i, cell, j = i[rep][by], cell[by], j[rep][by]
                new = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(cell) != 0)]) if len(i) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(i)).astype(np.int32)), pa.array(j.astype(np.int32)))
                got = b.take(pa.array(at[i[new]]))
                for s in range(0, len(new), 1024):
                    yield pa.RecordBatch.from_arrays([*(c.slice(s, 1024) for c in got.columns), pa.array(cell[new[s : s + 1024]].astype(np.int32)), lists.slice(s, 1024)], names=[*names, "cell", "wanted"])

    return state.mapInArrow(run, out)


def best_of(asked: pa.Table, members: pa.Table, made: Lists, k: int, same: bool) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array, int]:
    """(row, window, id, score) of the k best members of one cell in each window of each anchor, and the scores worked out."""
    members = members.take(pc.sort_indices(members, [("vec_id", "ascending")]))
    codes = pc.dictionary_encode(members.column("vec_id").combine_chunks())
    ids = codes.indices.to_numpy(zero_copy_only=False)
    mine = pc.fill_null(pc.index_in(asked.column("vec_id").combine_chunks(), value_set=codes.dictionary), -1).to_numpy(zero_copy_only=False)
    labels, my_label = (t.column("label").to_numpy() for t in (members, asked))
    lo, hi = (np.array(asked.column(c).to_pylist(), np.int64).reshape(asked.num_rows, -1) for c in ("lo", "hi"))
    n, windows = lo.shape
    score, who = np.full((n, windows, k), NONE), np.full((n, windows, k), -1)
    lists, wanted = members.column("list").to_numpy(), asked.column("wanted").combine_chunks()
    worked = 0
    for at, a in _rows(asked.column("q"), float):
        first = made.first[a.shape[1]]
        here = [c for c in np.unique(lists) if first <= c < first + len(made.centroids[a.shape[1]])]
        low, high = made.bounds(a)
        ask = [set(wanted[int(i)].as_py()) for i in at]
        for c in sorted(here, key=lambda c: -high[:, c - first].max()):
            kth = np.maximum(lo[at], score[at, :, k - 1])
            useful = ((high[:, c - first, None] >= kth) & (low[:, c - first, None] <= hi[at])).any(1) & np.array([c in s for s in ask])
            rows, cols = np.flatnonzero(useful), np.flatnonzero(lists == c)
            if not len(rows):
                continue
            x = members.column("q").take(pa.array(cols)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cols), -1)
            s = (a[rows] @ x.T).astype(np.int64)
            worked += s.size
            fits = ((my_label[at[rows], None] == labels[cols]) == same) & (mine[at[rows], None] != ids[cols])
            for w in range(windows):
                ok = fits & (s >= kth[rows, w, None]) & (s <= hi[at[rows], w, None])
                some = np.flatnonzero(ok.any(1))
                if not len(some):
                    continue
                v = np.where(ok[some], s[some], NONE)
                if len(cols) > k:  # the k best, of equals those that come first: members are in the order of ids
                    cut = np.partition(v, len(cols) - k, axis=1)[:, len(cols) - k, None]
                    above = v > cut
                    level = (v == cut) & (np.cumsum(v == cut, 1) <= k - above.sum(1, keepdims=True))
                    take = np.nonzero(above | level)[1].reshape(len(some), k)
                else:
                    take = np.broadcast_to(np.arange(len(cols)), v.shape)
                new = np.take_along_axis(v, take, 1)
                own = at[rows[some]]
                both = np.concatenate([score[own, w], new], 1), np.concatenate([who[own, w], np.where(new > NONE, cols[take], -1)], 1)
                order = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                score[own, w], who[own, w] = (np.take_along_axis(x, order, 1) for x in both)
    i, w, j = np.nonzero(who >= 0)
    found = who[i, w, j]
    return asked.column("row").take(pa.array(i)), pa.array(w.astype(np.int32)), members.column("vec_id").take(pa.array(found)), pa.array(score[i, w, j]), worked


def search(members: DataFrame, state: DataFrame, made: Lists, k: int, same: bool, first: int = FIRST) -> DataFrame:
    """(row, window, vec_id, score, place) of the k best members of the anchor's label, or of others, in each window.

    state has the anchors: row, block, vec_id, label, q, and arrays lo and hi of windows, which hold their ends. The
    first place has the highest score, of equals the smallest vec_id; rows with the anchor's own vec_id take no part.
    """
    id_type = members.schema["vec_id"].dataType
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("vec_id", id_type), T.StructField("score", T.LongType())])
    by_rank = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    columns = ["row", "block", "vec_id", "label", "q", "lo", "hi"]
    state, best, seen, step = state.select(*columns), None, 0, first

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        got = best_of(asked, rows, made, k, same)[:4] if asked.num_rows and rows.num_rows else [pa.array([], f.type) for f in pa_out]
        return pa.Table.from_arrays([*got], names=["row", "window", "vec_id", "score"]).cast(pa_out)

    pa_out = to_arrow_schema(out)
    while best is None or seen < made.n:
        upto = min(seen + step, made.n)
        asked = _asked(state, made, seen, upto)
        need = asked.select(F.col("block").alias("at_block"), F.col("cell").alias("at_cell")).distinct()
        rows = members.join(need, F.col("cell") == F.col("at_cell")).select("at_block", "at_cell", "vec_id", "label", "list", "q")
        new = asked.groupBy("block", "cell").cogroup(rows.groupBy("at_block", "at_cell")).applyInArrow(meet, out)
        ranked = (new if best is None else new.unionByName(best.drop("place"))).withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= k)
        best, old = stored(ranked, "best"), best
        if old is not None:
            forget(old)
        seen, step = upto, step * GROWTH
        if seen < made.n:
            full = best.where(F.col("place") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
            raised = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
            state = stored(state.join(full, "row", "left").withColumn("lo", raised).select(*columns), "state")
    return best


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **how) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors: vec_id, label and q.

    Scores are inner products of the integers in q. An anchor's positives are the best other rows of its label, and the
    negatives of each are the best rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.
    Rows without vec_id take no part. Rows are other rows if their vec_id differs; repeated rows count as often as they
    are there. An anchor without positives, or a positive without negatives, has no row; an empty table gives none.
    """
    bound_batches(vectors.sparkSession)
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    vectors = vectors.where("vec_id IS NOT NULL").select("vec_id", "label", F.when(square < EXACT, F.col("q")).otherwise(F.raise_error(F.lit("a vector is too long for exact scores"))).alias("q"))
    members, asking, made = index(vectors, anchors, **how)
    one = lambda x: F.array(F.lit(x).cast("long"))
    found = search(members, asking.withColumns({"lo": one(NONE + 1), "hi": one(-NONE)}), made, positives, True)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", F.col("vec_id").alias("id"), "score"))).alias("positives"))
    state = stored(asking.join(found, "row").withColumns({"lo": F.expr("transform(positives, x -> x.score)"), "hi": F.expr("transform(positives, x -> x.score)")}), "positives")
    state = state.withColumns({"lo": F.expr(f"transform(lo, s -> (s * {low} + pmod(-(s * {low}), 100)) DIV 100)"), "hi": F.expr(f"transform(hi, s -> (s * {high} - pmod(s * {high}, 100)) DIV 100)")})
    state = state.withColumns({c: F.concat(c, F.array_repeat(F.lit(x).cast("long"), positives - F.size(c))) for c, x in (("lo", 1), ("hi", 0))})  # empty windows
    mined = search(members, state, made, negatives, False)
    named = state.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("window", "p"))
    return mined.join(named, ["row", "window"]).select("anchor_id", F.col("p.id").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


SCALE, ANCHORS, SHIFTED = 256, 50, 7


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are all rows whose vec_id ANCHORS divides, against all rows. Rows with a null label, null vector, or null or
    non-finite components take no part; columns beyond vec_id, embedding and label are not read."""
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding") & F.col("label").isNotNull())
    label = F.when(F.pmod("vec_id", F.lit(SHIFTED)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))
    return hard_negatives(vectors, F.pmod("vec_id", F.lit(ANCHORS)) == 0)


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % {ANCHORS} = 0 AND a.vec_id <> v.vec_id AND len(a.q) = len(v.q)),
p AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
