"""Clustering around centroids with Elkan's bounds.

Vectors and centroids are integers, so that distances, means and ties are exact. Between rounds each
vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to
every centroid. When centroids move, bounds move by as much; a vector whose upper bound is under half
the way from its centroid to the next one needs no look, and a centroid is passed over whose lower
bound, or half of whose distance from the vector's own, is above the upper bound. Bounds are rounded
to the safe side and pruning is strict, so a centroid that ties is always compared, by exact
distances.

A round is one pass of the vectors through Arrow batches, which writes them with their new bounds as
a table in the shared folder; sums by centroid are made in each task and added up by Spark. Only
centroids and their sums are on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: The largest component: squared distances of DIMS such ones fit in a long.
MOST = 1 << 27
_STATE = "vec_id long, v array<int>, cluster int, distance long, upper float, lower array<float>"
_ARROW = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.float32()), ("lower", pa.list_(pa.float32()))])


def _at_least(x: np.ndarray) -> np.ndarray:
    """Of a number worked out in a few steps of double precision, a float that isn't below its exact value."""
    return np.nextafter((np.asarray(x, np.float64) * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _at_most(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((np.asarray(x, np.float64) * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), 0)


def _distances(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid, or to one each."""
    apart = v - centroid
    return np.einsum("ij,ij->i", apart, apart)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, exact distance, upper, lower, distances worked out) of rows by their bounds.

    v and centroids are long; bounds are of distances to these centroids, and hold. Of centroids
    at the same distance the first is taken.
    """
    between = np.stack([_distances(centroids, c) for c in centroids])
    half = _at_most(np.sqrt(between.astype(np.float64)) / 2)
    next_ = np.where(np.eye(len(centroids), dtype=bool), np.inf, half).min(axis=1)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    exact = _distances(v, centroids[cluster])
    looked = len(v)
    own = np.arange(len(v))
    root = np.sqrt(exact.astype(np.float64))
    upper = np.minimum(upper, _at_least(root))
    lower[own, cluster] = np.maximum(lower[own, cluster], _at_most(root))
    open_ = np.nonzero(upper >= next_[cluster])[0]
    for j in range(len(centroids)):
        a = cluster[open_]
        # strict: what may tie is compared
        rows = open_[(a != j) & (lower[open_, j] <= upper[open_]) & (half[a, j] <= upper[open_])]
        if not len(rows):
            continue
        d = _distances(v[rows], centroids[j])
        looked += len(rows)
        root = np.sqrt(d.astype(np.float64))
        lower[rows, j] = _at_most(root)
        nearer = (d < exact[rows]) | ((d == exact[rows]) & (j < cluster[rows]))
        moved = rows[nearer]
        cluster[moved], exact[moved], upper[moved] = j, d[nearer], _at_least(root[nearer])
    return cluster, exact, upper, lower, looked


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold after the centroids have moved."""
    way = np.sqrt(_distances(before, after).astype(np.float64))
    far = _at_least(way).astype(np.float64)
    return _at_least(upper.astype(np.float64) + far[cluster]), _at_most(np.maximum(lower.astype(np.float64) - far, 0))


def kept_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of exactly DIMS components, none null or non-finite, as integers
    floor(SCALE * x). Vectors with a component beyond MOST are left out as well."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE)).alias("w"), F.col(vector).alias("x"))
    # NaN is above all numbers, and floor() of what is no long is wrong, so x itself is compared
    fits = F.forall("x", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= MOST / SCALE))
    return rows.filter((F.size("x") == DIMS) & fits).select("vec_id", F.col("w").cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least SHA-256 of "<seed>:<vec_id>", fewer than k if there are fewer; a
    null id is written as null, and of vectors with one id the least come first."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    return [list(r.v) for r in vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def _pass(state: DataFrame, centroids: list[list[int]], before: list[list[int]] | None) -> DataFrame:
    """The state after rows are assigned to the nearest centroids; before: the centroids that the
    rows' bounds are of, None for rows without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = np.array(centroids, np.int64)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            flat = lambda name, kind: batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind)
            v = flat("v", np.int64).reshape(rows, -1)
            if before is None:
                cluster, upper, lower = np.zeros(rows, np.int64), np.full(rows, np.inf, np.float32), np.zeros((rows, len(now)), np.float32)
            else:
                cluster, upper, lower = batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), flat("lower", np.float32).reshape(rows, -1)
                upper, lower = moved_bounds(cluster, upper, lower, np.array(before, np.int64), now)
            cluster, exact, upper, lower, _ = assign(v, cluster, upper, lower, now)
            lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists(v.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(exact), pa.array(upper.astype(np.float32)), lists(lower.astype(np.float32))], schema=_ARROW)
        common.release_memory()

    return state.mapInArrow(run, _STATE)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, n, sums) of the rows of a task."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        if batch.num_rows:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                n, sums = total.get(int(c), (0, 0))
                total[int(c)] = n + int((cluster == c).sum()), sums + v[cluster == c].sum(axis=0)
    rows = [{"cluster": c, "n": n, "sums": sums.tolist()} for c, (n, sums) in total.items()]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _means(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid moved to the floor of its rows' mean; one without rows stays."""
    parts = state.select("cluster", "v").mapInArrow(_sums, "cluster int, n long, sums array<long>")
    # a task's sums fit in a long; those of all tasks needn't
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(DIMS))).alias("sums"))
    out = [list(c) for c in centroids]
    for r in added.collect():  # one row for each centroid
        out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def cluster_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(state, centroids): vec_id, v, cluster, distance (squared) and bounds of each kept vector, and
    the k last centroids.

    Vectors that are null, have another number of components than DIMS, or a component that is null,
    not finite or beyond MOST in size are left out. The centroids start as first_centroids(), and
    are as many as there are vectors if those are fewer than k. Each round assigns every vector to
    its nearest centroid, ties to the first, and moves each centroid to the floor of its vectors'
    mean; at last vectors are assigned once more. Repeated rows and ids are rows of their own; no
    vectors give no rows and no centroids. Other columns are dropped.

    Each round's rows are written to the shared folder, and removed once the next has read them.
    """
    spark = table.sparkSession
    common.ship(spark)
    vectors = kept_vectors(table, key, vector)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return spark.createDataFrame([], _STATE), []
    state, before, held = vectors, None, None
    for i in range(rounds + 1):
        at = common.fresh_dir(spark, f"elkan-{i}")
        _pass(state, centroids, before).write.parquet(at)
        state = spark.read.schema(_STATE).parquet(at)
        if held is not None:
            common.remove_dir(spark, held)
        before, held = centroids, at
        if i < rounds:
            centroids = _means(state, centroids)
    return state, centroids


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """The cluster of every vector, with the sums of distances and its centroid's checksum."""
    state, centroids = cluster_vectors(common.table(spark, sf_dir, "embeddings"))
    sums = [] if not centroids else state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row for each centroid
    total = sum(r.s for r in sums)
    told = [(r.cluster, r.s, total, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """op13_centroid_clusters in DuckDB SQL, by all distances."""
    rows = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CENTROIDS})
)"""
    for i in range(ROUNDS + 1):
        rows += f""", d{i} AS MATERIALIZED (
  SELECT kept.vec_id, any_value(kept.v) AS v, list(struct_pack(d := list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c)) AS all_d FROM kept, c{i} GROUP BY kept.vec_id
), a{i} AS MATERIALIZED (SELECT vec_id, v, list_min(all_d).c AS cluster, list_min(all_d).d AS distance FROM d{i})"""
        if i < ROUNDS:
            rows += f""", m{i} AS (
  SELECT cluster, list(m ORDER BY p) AS v FROM (SELECT cluster, p, floor(sum(x::HUGEINT)::DOUBLE / count(*)) AS m FROM (SELECT cluster, unnest(v)::BIGINT AS x, unnest(range({DIMS})) AS p FROM a{i}) GROUP BY cluster, p) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.cluster = c)"""
    return (
        rows
        + f""" SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(f.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} f ON f.c = cluster"""
    )


OP13_SQL = _oracle()
