"""Vector, lexical and hybrid search over nodes.

Vectors are plain arrays and stay in the JVM. A text's vector counts its words by hash bucket.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.cluster import durable, ship
from lodestone.functions.columns import like

from .query import clamp
from .vectors import VectorIndex

DIMS, RRF_K, DEFAULT_MODEL = 64, 60.0, "hash-v1"
#: How often a service is asked for a batch.
ATTEMPTS = 3


def bucket(word: Column, dims: int = DIMS) -> Column:
    """A word's bucket, from the first byte of its hash."""
    return (F.conv(F.substring(F.md5(word), 1, 2), 16, 10).cast("int") % dims).cast("int")


def vectorize(text: Column, dims: int = DIMS) -> Column:
    """Word counts by bucket, scaled to length 1; zeros for a text without words. Words are runs of
    letters, digits, _ and -."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_-]+"), lambda w: w != "")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # what is used in a loop is bound before it, to be worked out once
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    count = lambda buckets: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    scale = lambda v: let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))
    return let(let(F.transform(words, lambda w: bucket(w, dims)), count), scale)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if lengths differ or both are empty."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot / F.greatest(norm(a) * norm(b), F.lit(1e-9))).otherwise(0.0)


def embed_nodes(nodes: DataFrame, model: str = DEFAULT_MODEL, remote: Callable[[list[str]], list[list[float]]] | None = None, known: DataFrame | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """(qualified_name, model, vector, text_hash, fallback) of all symbols. A blank model is the default one.

    `remote` maps a list of texts to vectors, for models behind a service. It is asked once for each
    different text, in batches on the executors, and not for texts of which `known` (text_hash, model,
    vector, fallback) has a vector of this model. A batch is asked for `attempts` times; if it fails
    still, its symbols get the default vectors with fallback set, which searches leave out, as they
    are of another space.
    """
    model = model.strip() or DEFAULT_MODEL
    text = F.concat_ws(" ", "kind", "name", "qualified_name", "file_path")
    rows = nodes.filter("kind <> 'file'").select("qualified_name", F.lit(model).alias("model"), text.alias("_text")).withColumn("text_hash", F.sha2("_text", 256))
    local = vectorize(F.col("_text"))
    if remote is None:
        return rows.select("qualified_name", "model", local.alias("vector"), "text_hash", F.lit(False).alias("fallback"))

    ship(nodes.sparkSession)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, texts = [None] * len(batch), batch["_text"].tolist()
            for attempt in range(attempts):
                try:
                    found = [list(map(float, v)) for v in remote(texts)]
                    if len(found) == len(texts):
                        vectors = found
                        break
                except Exception:  # noqa: BLE001  whatever a service raises, the rows tell of it
                    time.sleep(min(0.2 * 2**attempt, 5) * (attempt + 1 < attempts))
            yield pd.DataFrame({"text_hash": batch["text_hash"], "vector": vectors})

    asked = rows.select("text_hash", "_text").dropDuplicates(["text_hash"])
    held = None if known is None else known.filter((F.col("model") == model) & ~F.coalesce("fallback", F.lit(False)) & F.col("text_hash").isNotNull()).select("text_hash", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["text_hash"])
    if held is not None:
        asked = asked.join(held, "text_hash", "left_anti")
    # kept, so that no plan over it asks again
    told = durable(asked.mapInPandas(call, "text_hash string, vector array<double>"))
    told = told if held is None else told.unionByName(held)
    both = rows.join(told.withColumnRenamed("vector", "_told"), "text_hash", "left")
    return both.select("qualified_name", "model", F.coalesce("_told", local).alias("vector"), "text_hash", F.col("_told").isNull().alias("fallback"))


def own_space(embeddings: DataFrame) -> DataFrame:
    """Without vectors that stand in for those of a service that failed."""
    return embeddings.filter("fallback IS NOT TRUE") if "fallback" in embeddings.columns else embeddings


def vector_search(nodes: DataFrame, embeddings: DataFrame, query: list[float] | DataFrame, kind: str | None = None, limit: int = 20) -> DataFrame:
    """(qualified_name, kind, file_path, score): the nearest by cosine, then by name."""
    found = nodes.select("qualified_name", "kind", "file_path").join(embeddings.select("qualified_name", "vector"), "qualified_name")
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    score = F.round(cosine(F.col("vector"), F.array(*map(F.lit, query))), 9)
    return found.select("qualified_name", "kind", "file_path", score.alias("score")).orderBy(F.desc("score"), "qualified_name").limit(limit)


def lexical_score(name: str, query: str) -> Column:
    """1 for equal names, 0.85 for names that contain the query, else 0.5; case is ignored."""
    lowered, q = F.lower(name), query.lower()
    return F.when(lowered == q, 1.0).when(lowered.contains(q), 0.85).otherwise(0.5)


def lexical_search(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The first nodes by kind and name whose name or qualified name contains the query, best score
    first. The limit comes before the scores."""
    pattern = f"%{query.strip()}%"
    found = nodes.filter(like("name", pattern) | like("qualified_name", pattern))
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    first = found.orderBy("kind", "qualified_name").limit(limit)
    return first.select("qualified_name", "kind", "file_path", lexical_score("name", query).alias("score")).orderBy(F.desc("score"), "kind", "qualified_name")


def query_vector(spark, text: str) -> list[float]:
    """vectorize() of one query text, without a job."""
    counts = [0.0] * DIMS
    for word in re.split(r"[^\w-]+", text):
        if word:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:2], 16) % DIMS] += 1
    norm = max(math.sqrt(sum(x * x for x in counts)), 1e-12)
    return [x / norm for x in counts]


def hybrid_search(nodes: DataFrame, embeddings: DataFrame, query: str, kind: str | None = None, limit: int = 20, index: VectorIndex | None = None) -> DataFrame:
    """Vector and lexical results fused by reciprocal ranks; ties by name. An index of the nodes'
    vectors saves a scan of them."""
    limit = clamp(limit, 1, 200)
    pool = max(3 * limit, 60)
    asked = query_vector(nodes.sparkSession, query)
    vector = vector_search(nodes, embeddings, asked, kind, pool) if index is None else index.search(asked, kind, pool)
    lexical = lexical_search(nodes, query, kind, pool)
    ranked = vector.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("score"), "qualified_name"))).unionByName(lexical.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("score"), "kind", "qualified_name"))))
    fused = ranked.groupBy("qualified_name", "kind", "file_path").agg(F.round(F.sum(1 / (RRF_K + F.col("_rank"))), 9).alias("score"))
    return fused.orderBy(F.desc("score"), "qualified_name").limit(limit)


def semantic_search(nodes: DataFrame, embeddings: DataFrame, query: str, kind: str | None = None, limit: int = 20, model: str = DEFAULT_MODEL, index: VectorIndex | None = None) -> DataFrame:
    """Hybrid if there are vectors of the model, else lexical."""
    own = own_space(embeddings).filter(F.col("model") == (model.strip() or DEFAULT_MODEL))
    if own.take(1):
        return hybrid_search(nodes, own, query, kind, limit, index)
    return lexical_search(nodes, query, kind, clamp(limit, 1, 200))


def cross_repo_search(nodes: DataFrame, query: str, limit: int = 20, aliases: tuple[str, ...] = (), kind: str | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """Search in each repository (nodes and embeddings have repo_alias), scored by rank within it:
    lexical, or fused with vectors if there are embeddings. All repositories in one plan."""
    limit_each = clamp(max(3 * limit, 60), 1, 200)
    pool = max(3 * limit_each, 60) if embeddings is not None else max(3 * limit, 60)
    found = nodes.filter(F.col("repo_alias").isin(*aliases)) if aliases else nodes
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    in_repo = Window.partitionBy("repo_alias")
    pattern = f"%{query.strip()}%"
    hits = found.filter(like("name", pattern) | like("qualified_name", pattern)).withColumn("score", lexical_score("name", query))
    first = hits.withColumn("_at", F.row_number().over(in_repo.orderBy("kind", "qualified_name"))).filter(F.col("_at") <= pool)
    columns = ["repo_alias", "qualified_name", "kind", "file_path"]
    ranked = first.select(*columns, F.row_number().over(in_repo.orderBy(F.desc("score"), "kind", "qualified_name")).alias("_rank"))
    if embeddings is not None:
        near = found.join(embeddings.select("repo_alias", "qualified_name", "vector"), ["repo_alias", "qualified_name"])
        near = near.withColumn("score", F.round(cosine(F.col("vector"), F.array(*map(F.lit, query_vector(nodes.sparkSession, query)))), 9))
        vector = near.select(*columns, F.row_number().over(in_repo.orderBy(F.desc("score"), "qualified_name")).alias("_rank")).filter(F.col("_rank") <= pool)
        fused = ranked.unionByName(vector).groupBy(*columns).agg(F.round(F.sum(1 / (RRF_K + F.col("_rank"))), 9).alias("score"))
        ranked = fused.select(*columns, F.row_number().over(in_repo.orderBy(F.desc("score"), "qualified_name")).alias("_rank")).filter(F.col("_rank") <= limit_each)
    return ranked.select(*columns, F.round(1 / (RRF_K + F.col("_rank")), 9).alias("score")).orderBy(F.desc("score"), "repo_alias", "qualified_name").limit(limit)
