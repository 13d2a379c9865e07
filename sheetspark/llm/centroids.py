"""Centroid clustering in integers; the nearest centroid by the threshold algorithm.

Each dimension keeps its centroids sorted by value. From a vector's value the lists
are walked outward, nearest centroid first, in all dimensions alike; a centroid that
comes up for the first time gets its exact distance. No centroid still unseen can be
nearer than the sum of the squared gaps at the frontier, so the walk ends when that
sum strictly exceeds the best exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

K, ROUNDS, WIDTH, SEED = 8, 10, 64, 3
#: Components of this size or more could carry a squared distance out of a long.
LARGEST = 1 << 27
FAR = np.iinfo(np.int64).max
STEP = 4096


class Lists:
    """Centroids with their values sorted in each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, width = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        ordered = np.take_along_axis(centroids.T, self.order, axis=1)
        # A guard beyond either end: its gap is never the smaller one.
        self.values = np.full((width, k + 2), FAR, np.int64)
        self.values[:, 1:-1] = ordered

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid; ties take the
        smaller number."""
        rows, (k, width) = len(vectors), self.centroids.shape
        best, number = np.full(rows, FAR), np.full(rows, k)
        seen = np.zeros((rows, k), bool)
        dims = np.arange(width)
        right = np.empty((rows, width), np.int64)
        for j in range(width):
            right[:, j] = np.searchsorted(self.values[j, 1:-1], vectors[:, j]) + 1
        left = right - 1
        active = np.arange(rows)
        x = vectors
        for _ in range(k):
            below = np.where(left > 0, x - self.values[dims, left], FAR)
            above = np.where(right <= k, self.values[dims, right] - x, FAR)
            down = below <= above
            gap = np.where(down, below, above)
            met = self.order[dims, np.where(down, left, right) - 1]
            left, right = left - down, right + ~down
            fresh = np.zeros((len(active), k), bool)
            fresh[np.arange(len(active))[:, None], met] = True
            fresh &= ~seen
            seen |= fresh
            for c in np.flatnonzero(fresh.any(axis=0)):
                at = np.flatnonzero(fresh[:, c])
                apart = ((x[at] - self.centroids[c]) ** 2).sum(axis=1)
                to = active[at]
                better = (apart < best[to]) | (apart == best[to]) & (c < number[to])
                best[to[better]], number[to[better]] = apart[better], c
            on = (gap**2).sum(axis=1) <= best[active]
            if not on.any():
                break
            active, x, seen, left, right = active[on], x[on], seen[on], left[on], right[on]
        return number, best


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    # ``flatten`` minds the offset of a sliced batch.
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    lists = Lists(centroids)
    for batch in batches:
        vectors = _vectors(batch.column(batch.schema.get_field_index("x")), centroids.shape[1])
        for at in range(0, len(vectors), STEP):
            part = vectors[at : at + STEP]
            yield batch.slice(at, STEP), part, *lists.nearest(part)


def _sums(centroids: np.ndarray):
    """Per task the count and component sums of each cluster: as many rows as there
    are centroids, so a cluster of any size is summed where its vectors are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        totals, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, part, number, _ in _assigned(batches, centroids):
            counts += np.bincount(number, minlength=k)
            for c in np.unique(number):
                totals[c] += part[number == c].sum(axis=0)
        c, j = np.divmod(np.arange(k * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (c, j, totals.ravel(), np.repeat(counts, width))], names=["c", "j", "s", "n"])

    return run


def _final(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, best in _assigned(batches, centroids):
            ids = batch.column(batch.schema.get_field_index("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return run


def quantised(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """``id x``: vectors of ``width`` finite components, as integers floor(1024 x)."""
    names = vectors.columns
    plain = vectors.toDF(*[f"in_{i}" for i in range(len(names))])
    doubles = F.col(f"in_{names.index(vector_col)}").cast("array<double>")
    usable = (F.size(doubles) == width) & F.forall(doubles, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    inside = F.forall(doubles, lambda v: F.abs(v) < float(LARGEST // 1024))
    x = F.when(inside, F.transform(doubles, lambda v: F.floor(v * 1024).cast("long"))).otherwise(
        F.raise_error(F.lit(f"a component is {LARGEST // 1024} or more: its squared distance does not fit a long"))
    )
    return plain.where(F.coalesce(usable, F.lit(False))).select(F.col(f"in_{names.index(id_col)}").alias("id"), x.alias("x"))


def cluster_centroids(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    seed: int = SEED,
) -> DataFrame:
    """``id cluster distance cluster_inertia inertia centroid centroid_sha256`` for
    every vector of ``width`` finite components.

    Components are floor(1024 x). The first centroids are the ``k`` vectors with the
    smallest sha256 of ``<seed>:<id>``; each of ``rounds`` rounds assigns every vector
    to its nearest centroid and replaces each non-empty one by the floor of the exact
    mean. A round that moves no centroid ends them: all later ones are the same.

    A round sends ``k`` rows of sums from each task; the driver holds ``k`` centroids.
    The vectors are written once as integers, and only read in each round.

    Vectors that are null, of another length, or with a null, NaN or infinite component
    have no row. Ids may repeat: each row is a vector, and those of one id have one hash,
    with ties by their components. A null id comes after all hashes. Fewer than ``k``
    vectors are as many centroids; an empty table has no rows. A component of 131,072
    or more is an error, as squared distances are longs. Texts and other columns are
    not read, whatever their names. The id column keeps its name and type.
    """
    spark = vectors.sparkSession
    held = saved(quantised(vectors, id_col, vector_col, width))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = held.select(mark.alias("mark"), "x").orderBy(F.asc_nulls_last("mark"), "x").limit(k).collect()
    id_type = held.schema["id"].dataType
    if not first:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
        fields = [T.StructField(id_col, id_type), *T.StructType.fromDDL(empty).fields]
        return spark.createDataFrame([], T.StructType(fields))
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        sums = held.select("x").mapInArrow(_sums(centroids), "c long, j long, s long, n long")
        exact = sums.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        moved = centroids.copy()
        for c, j, s, n in exact.where("n > 0").collect():
            moved[c, j] = int(s) // n
        if (moved == centroids).all():
            break
        centroids = moved
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("cluster int, distance long").fields])
    placed = saved(held.mapInArrow(_final(centroids), schema))
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    named = []
    for c, components in enumerate(centroids.tolist()):
        digest = hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
        named.append((c, inertia.get(c, 0), total, components, digest))
    # One row a centroid.
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    joined = placed.join(F.broadcast(table), "cluster")
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op13_centroid_clustering(spark, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return cluster_centroids(vectors).drop("centroid")


def _rounds_sql() -> str:
    """The rounds one after the other: distances of every vector to every centroid."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT rid, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM ("
            f"SELECT v.rid, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist "
            f"FROM v, k{r} k) GROUP BY rid)"
        )
        if r < ROUNDS:
            steps.append(
                f"k{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM k{r} k LEFT JOIN ("
                f"SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY j) AS x FROM ("
                f"SELECT a.c, e.j, sum(e.x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} a JOIN e USING (rid) GROUP BY a.c, e.j) "
                f"GROUP BY c) m ON m.c = k.c)"
            )
    return ",\n".join(steps)


OP13_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: y::DOUBLE) AS y FROM embeddings),
v AS MATERIALIZED (
  SELECT rid, vec_id, list_transform(y, lambda z: floor(1024 * z)::BIGINT) AS x FROM w
  WHERE len(y) = {WIDTH} AND len(list_filter(y, lambda z: z IS NOT NULL AND isfinite(z))) = {WIDTH}),
e AS MATERIALIZED (SELECT rid, unnest(range(1, {WIDTH + 1})) AS j, unnest(x) AS x FROM v),
k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark, x) - 1 AS c, x
  FROM (SELECT sha256('{SEED}:' || vec_id) AS mark, x FROM v ORDER BY mark, x LIMIT {K})),
{_rounds_sql()}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.dist AS distance, sum(a.dist) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.dist) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (rid) JOIN k{ROUNDS} k ON k.c = a.c
"""
