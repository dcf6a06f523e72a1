"""An index of vectors in inverted lists, searched exactly.

Centroids are fitted by k-means on a bounded sample of the vectors, scaled to length 1; every vector
lies in the list of its nearest centroid, with its norm and its distance to the centroid. On the unit
sphere the triangle inequality bounds how near to a query any vector of a list can be, by the query's
distance to the centroid and the list's least and largest distance. A search reads the most promising
lists until it has as many rows as asked, and then those that its worst row doesn't rule out, so its
rows are those of a scan of all vectors. Vectors without a direction, and those of another number of
components than most, score 0 against everything and are a list of their own.

Lists are folders of a copy-on-write store; new vectors go into the lists of the centroids there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.cluster import durable
from lodestone.sources.buckets import BucketStore, Change, Table

TABLES = {"vectors": Table("list", "qualified_name", ("list",)), "lists": Table("list", "list")}
#: Vectors that centroids are fitted on at most; the least by a hash of their names.
SAMPLE = 20_000
#: Lists of an index: about the root of the number of vectors, within these bounds.
FEWEST, MOST = 4, 2048
#: How much scores may err by rounding to 9 digits and in double precision.
SLACK = 2e-9
_FLAT = -1
#: Products with centroids that a task holds at once.
PRODUCTS = 1 << 20
#: Norms below which scores aren't cosines alone, of vectors and of queries.
LEAST_NORM, LEAST_QUERY = 1e-6, 1e-3


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _measured(rows: DataFrame) -> DataFrame:
    """(qualified_name, kind, file_path, vector as doubles, norm)."""
    doubles = F.transform("vector", lambda x: x.cast("double"))
    named = rows.select("qualified_name", "kind", "file_path", doubles.alias("vector"))
    return named.withColumn("norm", F.sqrt(_dot(F.col("vector"), F.col("vector"))))


def _directed(dims: int) -> Column:
    return F.coalesce((F.size("vector") == dims) & (F.col("norm") >= LEAST_NORM) & (F.col("norm") < float("inf")), F.lit(False))


class VectorIndex:
    """What a store at a place holds; see build() and load()."""

    def __init__(self, store: BucketStore):
        self.store = store
        self.dims = store.manifest["meta"]["dims"]
        #: A row for each list, MOST and one at most: (list, centroid, nearest, farthest, n).
        self.lists = {r["list"]: r for r in store.read("lists").collect()}
        #: Lists that the last search read.
        self.lists_read: list[int] = []

    @classmethod
    def load(cls, spark: SparkSession, at: str) -> VectorIndex | None:
        store = BucketStore(spark, at, TABLES)
        return cls(store) if store.exists else None

    @classmethod
    def build(cls, rows: DataFrame, at: str, of: str | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Stores an index of rows (qualified_name, kind, file_path, vector), names being unique; `of`
        says what it was made of. Vectors may be null, empty or of any number of components."""
        rows = durable(_measured(rows))
        sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        dims = max(sizes["d"] or 0, 0) if sizes else 0
        own = rows.filter(_directed(dims))
        count = own.count()
        centroids: list[list[float]] = []
        if count:
            units = own.orderBy(F.xxhash64("qualified_name"), "qualified_name").limit(sample).select(F.transform("vector", lambda x: x / F.col("norm")).alias("unit"))
            different = durable(units.distinct())
            if different.count() < 2 * FEWEST:
                centroids = [list(r.unit) for r in different.collect()]
            else:
                k = min(max(int(math.sqrt(count)), FEWEST), MOST, different.count() // 2)
                model = KMeans(k=k, seed=1, maxIter=8, featuresCol="features").fit(different.select(array_to_vector("unit").alias("features")))
                centroids = [list(map(float, c)) for c in model.clusterCenters()]
        store = BucketStore(rows.sparkSession, at, TABLES)
        # lists are summed up from the stored vectors, so each is placed once
        store.replace({"vectors": _placed(rows, centroids, dims), "lists": lambda written, _: _summaries(written["vectors"], centroids)}, {"dims": dims, "of": of, "centroids": centroids})
        return cls(store)

    @property
    def of(self) -> str | None:
        return self.store.manifest["meta"]["of"]

    def updated(self, rows: DataFrame, gone: DataFrame) -> VectorIndex:
        """With rows in place of those with their names, and without those of gone (qualified_name);
        only lists that this touches are written."""
        centroids = self.store.manifest["meta"]["centroids"]
        new = durable(_placed(_measured(rows), centroids, self.dims))
        owners = durable(new.select("qualified_name").union(gone.select("qualified_name")).distinct())
        old = self.store.read("vectors").join(owners, "qualified_name", "left_semi")
        touched = durable(old.select("list").union(new.select("list")).distinct())
        kept = self.store.rows("vectors", touched).join(owners, "qualified_name", "left_anti").unionByName(new)
        told = durable(_summaries(kept, centroids))
        self.store.apply({"vectors": Change(owners, new, touched), "lists": Change(touched, told, touched)})
        return VectorIndex(self.store)

    def _read(self, lists: list[int], query: list[float], kind: str | None) -> DataFrame:
        """(qualified_name, kind, file_path, score) of some lists."""
        keys = self.store.spark.createDataFrame([(i,) for i in lists], "list int")
        rows = self.store.read("vectors", self.store.buckets_of(keys)).filter(F.col("list").isin(lists))
        norm = math.sqrt(sum(x * x for x in query))
        score = _dot(F.col("vector"), F.array(*map(F.lit, query))) / F.greatest(F.col("norm") * norm, F.lit(1e-9))
        score = F.when((F.size("vector") == len(query)) & (F.size("vector") > 0), score).otherwise(0.0)
        found = rows.select("qualified_name", "kind", "file_path", F.round(score, 9).alias("score"))
        return found if kind is None else found.filter(F.col("kind") == kind)

    def best_scores(self, query: list[float]) -> dict[int, float]:
        """The highest score that a vector of each list may have."""
        norm = math.sqrt(sum(x * x for x in query))
        if len(query) != self.dims or norm < LEAST_QUERY:
            return dict.fromkeys(self.lists, 1.0)
        out = {}
        for i, r in self.lists.items():
            if i == _FLAT:
                out[i] = r.farthest  # 0 if all of them are zeros or of other lengths
                continue
            way = math.dist([x / norm for x in query], r.centroid)
            apart = max(way - r.farthest, r.nearest - way, 0.0)
            out[i] = 1 - max(apart - 1e-9, 0.0) ** 2 / 2
        return out

    def search(self, query: list[float], kind: str | None = None, limit: int = 20) -> DataFrame:
        """(qualified_name, kind, file_path, score): the nearest by cosine, then by name, as of all
        vectors; see lists_read for what it took."""
        bounds = self.best_scores(query)
        order = sorted(bounds, key=lambda i: (-bounds[i], i))
        top = lambda df: df.orderBy(F.desc("score"), "qualified_name").limit(limit)
        none = self.store.spark.createDataFrame([], "qualified_name string, kind string, file_path string, score double")
        best, read, wanted, step = [], 0, 0, limit
        while read < len(order):
            while wanted < len(order) and (wanted == read or sum(self.lists[i].n for i in order[read:wanted]) < step):
                wanted += 1
            if len(best) == limit:
                # whatever may reach the worst row so far
                wanted = max(read, sum(bounds[i] >= best[-1]["score"] - SLACK for i in order))
                if wanted == read:
                    break
            found = top(none.union(self._read(order[read:wanted], query, kind)).union(self.store.spark.createDataFrame(best, none.schema)))
            best, read, step = found.collect(), wanted, 2 * step
        self.lists_read = order[:read]
        return self.store.spark.createDataFrame(best, none.schema)


def _flat_away(dims: int) -> Column:
    """1 for vectors without a list that may still score."""
    return F.when((F.size("vector") == dims) & (F.col("norm") > 0), 1.0).otherwise(0.0)


def _nearest(centroids: list[list[float]], units: Column) -> Column:
    """(list, away) of vectors without nulls: the nearest centroid, the first of those as near, and its distance."""
    table = np.array(centroids)
    squares, step = (table * table).sum(axis=1), max(1, PRODUCTS // len(centroids))

    def nearest(vectors: pa.Array) -> pa.Array:
        rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        near, away = np.empty(len(rows), np.int32), np.empty(len(rows))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            near[i : i + step] = found = (squares - 2 * (part @ table.T)).argmin(axis=1)
            away[i : i + step] = np.sqrt(np.square(part - table[found]).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(near), pa.array(away)], ["list", "away"])

    return F.arrow_udf(nearest, "list int, away double")(units)


def _placed(rows: DataFrame, centroids: list[list[float]], dims: int) -> DataFrame:
    """(…, norm, away, list): the list of each row and its distance to the centroid."""
    if not centroids:
        return rows.withColumns({"away": _flat_away(dims), "list": F.lit(_FLAT)})
    unit = F.when(_directed(dims), F.transform("vector", lambda x: x / F.col("norm"))).otherwise(F.array_repeat(F.lit(0.0), dims))
    told = rows.withColumn("_near", _nearest(centroids, unit))
    away, at = F.when(_directed(dims), F.col("_near.away")).otherwise(_flat_away(dims)), F.when(_directed(dims), F.col("_near.list")).otherwise(_FLAT)
    return told.select("qualified_name", "kind", "file_path", "vector", "norm", away.alias("away"), at.alias("list"))


def _summaries(placed: DataFrame, centroids: list[list[float]]) -> DataFrame:
    told = placed.groupBy("list").agg(F.min("away").alias("nearest"), F.max("away").alias("farthest"), F.count("*").alias("n"))
    table = placed.sparkSession.createDataFrame([*enumerate(centroids), (_FLAT, [])], "list int, centroid array<double>")
    return told.join(F.broadcast(table), "list").select("list", "centroid", "nearest", "farthest", "n")
