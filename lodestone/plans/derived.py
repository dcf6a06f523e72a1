"""Graph, files and changes derived from the star-schema tables, for the catalogue's queries.

The tables hold no source code: parts stand for functions, their brand and type for files, orders
that hold two parts for calls and imports. The SQL is plain enough for Spark and for other engines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.cluster import durable, fresh_dir, ship
from lodestone.sources.listing import open_store

GRAPH = """
pairs AS (
  SELECT DISTINCT a.l_orderkey AS ok, a.l_partkey AS ap, b.l_partkey AS bp
  FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
), fn AS (
  SELECT p_partkey AS k,
         lower(replace(p_brand, '#', '')) || '/' || CASE WHEN p_partkey % 10 = 0 THEN 'tests/' ELSE '' END
           || lower(p_type) || '_' || CAST(p_size % 4 AS VARCHAR(10)) || CASE WHEN p_partkey % 10 = 0 THEN '.spec.ts' ELSE '.ts' END AS file_path,
         replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR(20)) AS name,
         1 + p_partkey % 50 AS line_start, 1 + p_partkey % 50 + p_size * 3 - 1 AS line_end
  FROM {part}
), filed AS (
  SELECT file_path, max(line_end) AS line_end FROM fn GROUP BY file_path
), cls AS (
  SELECT file_path, 'C' || replace(replace(file_path, '/', '_'), '.', '_') AS name,
         lag(file_path) OVER (PARTITION BY split_part(file_path, '/', 1) ORDER BY file_path) AS base_file
  FROM filed
), nodes AS (
  SELECT 'file' AS kind, file_path AS name, 'file::' || file_path AS qualified_name, file_path, CAST(0 AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, 'typescript' AS language FROM filed
  UNION ALL SELECT 'class', name, file_path || '::' || name, file_path, 1, 1, 'typescript' FROM cls
  UNION ALL SELECT 'function', name, file_path || '::' || name, file_path, CAST(line_start AS BIGINT), CAST(line_end AS BIGINT), 'typescript' FROM fn
), edges AS {materialized} (
  SELECT 'contains' AS kind, 'file::' || file_path AS source, file_path || '::' || name AS target, file_path FROM cls
  UNION ALL SELECT 'contains', 'file::' || file_path, file_path || '::' || name, file_path FROM fn
  UNION ALL SELECT {merged}'calls', s.file_path || '::' || s.name, t.file_path || '::' || t.name, s.file_path
            FROM pairs JOIN fn s ON s.k = ap JOIN fn t ON t.k = bp WHERE ok % 13 = 0
  UNION ALL SELECT {merged}DISTINCT 'imports_from', 'file::' || s.file_path, 'file::' || t.file_path, s.file_path
            FROM pairs JOIN fn s ON s.k = ap JOIN fn t ON t.k = bp WHERE ok % 17 = 1 AND CASE WHEN s.file_path = t.file_path THEN 0 ELSE 1 END = 1
  UNION ALL SELECT 'inherits', c.file_path || '::' || c.name, b.file_path || '::' || b.name, c.file_path
            FROM cls c JOIN cls b ON b.file_path = c.base_file
), changes AS (
  SELECT file_path, CAST(sum(k % 7) AS BIGINT) AS added, CAST(sum(k % 3) AS BIGINT) AS deleted FROM fn WHERE k % 97 = 0 GROUP BY file_path
)"""

DOCS = """
docs AS (
  SELECT source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR(20)) || CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '.txt' ELSE '.py' END AS path,
         text AS content, n_chars AS size, doc_id, source, lang
  FROM {documents}
)"""

_HELD: dict[tuple[str, str, str], DataFrame] = {}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table. Parts look small by their file but are large as a broadcast, so they are merged."""
    sql = f"WITH {GRAPH.replace('{materialized} ', '').replace('{merged}', '/*+ MERGE(s, t) */ ')} SELECT * FROM {name}"
    return spark.sql(sql, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _held(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, kept in the shared folder once for a session and folder: a plan with CTEs that is
    persisted isn't found again in unions or beside another such plan, and would be worked out anew."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _HELD:
        _HELD[at] = durable(derive(spark, sf_dir, name))
    return _HELD[at]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "nodes")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "edges")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "changes")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {DOCS} SELECT * FROM docs", documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Files of rules in the tree of documents, and what makes it the tree of a git repository.
TREE_RULES = {
    ".git/config": "",
    ".ignore": "*1.md\n!doc_*21.md\n",
    "src0/.gitignore": "# all but a few\n/en/\n!en\ndoc_*5.txt\n",
    "src1/.gitignore": "de/\n/*/doc_?7.py\n",
}

_TREES: dict[tuple[str, str], str] = {}


def tree(spark: SparkSession, sf_dir: str) -> str:
    """The root of a folder in the shared one that holds every document as a file, written by tasks
    once for a session; and a few files of rules."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _TREES:
        root = fresh_dir(spark, "tree")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = open_store(root)
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(f"{base}/{path}") as to:
                        to.write((content or "").encode())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

        ship(spark)
        files = docs(spark, sf_dir).select("path", "content")
        rules = spark.createDataFrame(list(TREE_RULES.items()), "path string, content string")
        files.unionByName(rules).mapInArrow(write, "n long").agg({"n": "sum"}).collect()
        _TREES[at] = root
    return _TREES[at]


def graph_oracle(select: str) -> str:
    """SQL over nodes, edges and changes for an engine that has the tables by name."""
    return f"WITH RECURSIVE {GRAPH.format(lineitem='lineitem', part='part', materialized='MATERIALIZED', merged='')}{select}"


def docs_oracle(select: str) -> str:
    return f"WITH {DOCS.format(documents='documents')}{select}"
