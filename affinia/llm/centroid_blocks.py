"""Centroid clustering of integer vectors with block-norm screening.

A vector is cut into segments of SEGMENT components and compressed to their Euclidean norms, rounded up to integers,
which are stored beside it once. For a vector x and a centroid c, Cauchy-Schwarz on each segment gives

    |x - c|^2  >=  |x|^2 + |c|^2 - 2 * sum over segments of |x_s| * |c_s|,

an integer bound that the 64 components take no part in. A vector visits the centroids by rising bound and stops at the
first that lies above the least exact distance so far; only what is visited gets an exact integer distance (Bottesch,
Buehler and Kaechele 2016). A bound equal to that distance is visited, so that ties go to the smaller number.

The centroids, k times dim integers, are all that a round brings to the driver or sends to tasks. Each task adds its own
vectors up first, so a round shuffles k rows a task however large a cluster is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.session import bound_batches, stored, table

SEGMENT = 4
#: Least absolute value of a component that is refused: below it all distances fit into 64 bits.
LIMIT = 1 << 27


def whole(column: str, scale: int, limit: int = LIMIT) -> Column:
    """floor(scale * x) of each component, x as double; components too large for exact sums are an error."""
    v = F.transform(column, lambda x: F.floor(x.cast("double") * scale))
    return F.transform(v, lambda x: F.when(F.abs(x) < limit, x.cast("int")).otherwise(F.raise_error(F.lit(f"a component is too large for exact distances: at most {limit - 1} once scaled"))))


def usable(column: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & fine, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def segment_norms(q: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Norm of each segment, never too small."""
    square = np.add.reduceat(q * q, np.arange(0, q.shape[1], segment), axis=1)
    return np.floor(np.sqrt(square.astype(np.float64))).astype(np.int64) + 1


def compressed(vectors: DataFrame, dim: int, segment: int = SEGMENT) -> DataFrame:
    """(vec_id, q, norms, square) of vectors, rows of vec_id and q: array of dim integers."""
    out = T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL("q array<int>, norms array<int>, square long").fields])

    def run(batches):
        for b in batches:
            q = matrix(b.column(1), dim)
            s = segment_norms(q, segment)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)), pa.array(s.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array((q * q).sum(1))], names=["vec_id", "q", "norms", "square"])

    return vectors.select("vec_id", "q").mapInArrow(run, out)


def nearest(q: np.ndarray, norms: np.ndarray, square: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance, and how many exact distances were worked out."""
    n, k = len(q), len(centroids)
    own = (centroids * centroids).sum(1)
    low = square[:, None] + own - 2 * (norms @ segment_norms(centroids, segment).T)
    order = np.argsort(low, axis=1, kind="stable")
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    rows, exact = np.arange(n), 0
    for r in range(k):
        rows = rows[low[rows, order[rows, r]] <= best[rows]]  # bounds rise, so a row that stops here is done
        if not len(rows):
            break
        j = order[rows, r]
        exact += len(rows)
        d = square[rows] + own[j] - 2 * np.einsum("ij,ij->i", q[rows], centroids[j])
        closer = (d < best[rows]) | ((d == best[rows]) & (j < who[rows]))
        best[rows[closer]], who[rows[closer]] = d[closer], j[closer]
    return who, best, exact


def _sums(stored_vectors: DataFrame, centroids: np.ndarray, segment: int) -> DataFrame:
    """One row a task and cluster: its vectors' number, the sum of their distances and of their components."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]):
        n, far, total, exact, seen = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0, 0
        for b in batches:
            if b.num_rows:
                q = matrix(b.column(0), dim)
                who, d, e = nearest(q, matrix(b.column(1), -(-dim // segment)), b.column(2).to_numpy(), centroids, segment)
                n += np.bincount(who, minlength=k)
                np.add.at(far, who, d)
                for c in np.unique(who):
                    total[c] += q[who == c].sum(0)
                exact, seen = exact + e, seen + len(q) * k
        got = np.flatnonzero(n)
        work = [[v] + [0] * (len(got) - 1) for v in (exact, seen)]
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(n[got]), pa.array(far[got]), pa.array(total[got].tolist(), pa.list_(pa.int64())), *[pa.array(w[: len(got)], pa.int64()) for w in work]], names=["cluster", "n", "far", "total", "exact", "pairs"])

    return stored_vectors.select("q", "norms", "square").mapInArrow(run, "cluster int, n long, far long, total array<long>, exact long, pairs long")


def totals(stored_vectors: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> list:
    """k rows at most: cluster, n, far, exact, pairs and total, the sums over the whole table."""
    dim = centroids.shape[1]
    t = _sums(stored_vectors, centroids, segment).groupBy("cluster")
    return t.agg(*[F.sum(c).alias(c) for c in ("n", "far", "exact", "pairs")], F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dim)]).alias("total")).collect()


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Non-empty centroids at the floor of their vectors' mean; empty ones stay."""
    out = centroids.copy()
    for r in sums:
        out[r.cluster] = [s // r.n for s in r.total]
    return out


def clustered(vectors: DataFrame, first: np.ndarray, rounds: int = 10, segment: int = SEGMENT, report: list | None = None) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """((vec_id, cluster, distance) of every row, the final centroids, the sum of distances of each cluster that isn't empty).

    vectors has vec_id and q, an array of as many integers as a centroid has; equal rows count as often as they are
    there, and rows without vec_id like any other. report gets the exact distances and the pairs of each round.
    """
    bound_batches(vectors.sparkSession)
    t = stored(compressed(vectors, first.shape[1], segment), "compressed")
    centroids = first
    for _ in range(rounds):
        sums = totals(t, centroids, segment)
        if report is not None:
            report.append((sum(r.exact for r in sums), sum(r.pairs for r in sums)))
        centroids = moved(centroids, sums)
    final = centroids

    def run(batches):
        for b in batches:
            who, d, _ = nearest(matrix(b.column(1), final.shape[1]), matrix(b.column(2), -(-final.shape[1] // segment)), b.column(3).to_numpy(), final, segment)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    out = T.StructType([t.schema["vec_id"], *T.StructType.fromDDL("cluster int, distance long").fields])
    done = stored(t.select("vec_id", "q", "norms", "square").mapInArrow(run, out), "clustered")
    return done, final, {r.cluster: r.far for r in done.groupBy("cluster").agg(F.sum("distance").alias("far")).collect()}


DIM, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose vec_id has the smallest digests, ties by their components; rows without vec_id last."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("q", key.alias("key")).orderBy(F.asc_nulls_last("key"), "q").limit(clusters).collect()
    return np.array([r.q for r in rows], np.int64)


def op12_centroid_blocks(spark, sf_dir: str) -> DataFrame:
    """Vectors of another length than DIM, null ones and those with null or non-finite components are left out; an empty
    table gives an empty one, and fewer than CLUSTERS vectors as many clusters. Further columns are not read."""
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.where(usable("embedding") & (F.size("embedding") == DIM)).select("vec_id", whole("embedding", SCALE).alias("q"))
    first = first_centroids(vectors)
    if not len(first):
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return vectors.select("vec_id", *none)
    done, final, far = clustered(vectors, first, ROUNDS)
    named = spark.createDataFrame([(c, far[c], sum(far.values()), ",".join(map(str, final[c].tolist()))) for c in sorted(far)], "cluster int, cluster_inertia long, inertia long, components string")
    named = named.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return done.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (SELECT rid, arg_min(k, d * {CLUSTERS} + k) AS k, min(d) AS d FROM (SELECT v.rid, c.k, sum((v.x - c.y) * (v.x - c.y)) AS d FROM v JOIN c{i} c ON v.i = c.i GROUP BY v.rid, c.k) GROUP BY rid)"""


def _move_sql(i: int) -> str:
    return f"""
c{i + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN s.n IS NULL THEN c.y ELSE CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS y
  FROM c{i} c LEFT JOIN (SELECT a.k, v.i, sum(v.x) AS s, count(*) AS n FROM a{i} a JOIN v ON v.rid = a.rid GROUP BY a.k, v.i) s ON s.k = c.k AND s.i = c.i)"""


ORACLE_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIM}),
v AS MATERIALIZED (SELECT rid, unnest(range({DIM})) AS i, unnest(q) AS x FROM e),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS k FROM e),
c0 AS MATERIALIZED (SELECT f.k, v.i, v.x AS y FROM f JOIN v ON v.rid = f.rid WHERE f.k < {CLUSTERS}),{",".join(_round_sql(i) + "," + _move_sql(i) for i in range(ROUNDS))},{_round_sql(ROUNDS)},
g AS (SELECT k, CAST(sum(d) AS BIGINT) AS far FROM a{ROUNDS} GROUP BY k),
h AS (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY k)
SELECT e.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, g.far AS cluster_inertia, CAST((SELECT sum(far) FROM g) AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM e JOIN a{ROUNDS} a ON a.rid = e.rid JOIN g ON g.k = a.k JOIN h ON h.k = a.k
"""
