"""One object for a repository's graph. All methods give lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import build, communities, flows, query, risk, search, text, traverse
from lodestone.operators.parse import snapshot_imports
from lodestone.operators.resolve import SNAPSHOT_ENDINGS, resolve_imports
from lodestone.operators.vectors import VectorIndex
from lodestone.sources import embedding
from lodestone.sources.buckets import BucketStore
from lodestone.sources.snapshot import load_tables, save_generation


@dataclass
class CodeGraph:
    """files is a snapshot (see schemas.FILES); facts are what was parsed of it."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    facts: DataFrame

    @classmethod
    def build(cls, files: DataFrame) -> CodeGraph:
        nodes, edges, facts = build.build(files)
        return cls(nodes, edges, files, facts)

    def updated(self, files: DataFrame) -> CodeGraph:
        """With a newer snapshot, of which only what changed is parsed, and what that touches resolved."""
        new = build.update(files, build.stored_tables(self.files, self.nodes, self.edges, self.facts))
        return CodeGraph(new["nodes"], new["edges"], new["files"], new["facts"])

    def save(self, at: str) -> None:
        """Writes all tables as a new generation of the store, which readers see once all are there;
        edges by kind, so that a query for one kind reads no other. What the graph is made of may come
        from the same store."""
        BucketStore(self.files.sparkSession, at, build.TABLES).replace(build.stored_tables(self.files, self.nodes, self.edges, self.facts))

    @classmethod
    def load(cls, spark: SparkSession, at: str) -> CodeGraph | None:
        store = BucketStore(spark, at, build.TABLES)
        return cls(*map(store.read, ("nodes", "edges", "files", "facts"))) if store.exists else None

    @classmethod
    def refresh(cls, files: DataFrame, at: str) -> dict[str, int]:
        """Brings the stored graph up to a newer snapshot, rewriting only buckets that change; builds it
        if there is none. How many buckets of each table were written, none of all for a whole build."""
        store = BucketStore(files.sparkSession, at, build.TABLES)
        if store.exists:
            return store.apply(build.changes_of(files, store))
        cls.build(files).save(at)
        return {}

    @staticmethod
    def updated_at(spark: SparkSession, at: str) -> str | None:
        """When the stored graph was made, which is another time for each generation."""
        return BucketStore(spark, at, build.TABLES).updated_at

    @staticmethod
    def stored_status(spark: SparkSession, at: str) -> DataFrame:
        """One row on the stored graph, or on there being none."""
        store = BucketStore(spark, at, build.TABLES)
        if not store.exists:
            return query.graph_status(None, None, at, spark=spark)
        return query.graph_status(store.read("nodes"), store.read("edges"), at, store.updated_at)

    def status(self) -> DataFrame:
        return query.graph_status(self.nodes, self.edges)

    def query(self, pattern: str, target: str, limit: int = 50) -> DataFrame:
        return query.query_graph(self.nodes, self.edges, pattern, target, limit)

    def impact_radius(self, changed: DataFrame, max_depth: int = 2, contains: bool = False) -> DataFrame:
        return traverse.impact_radius(self.edges, changed, max_depth, contains=contains)

    def reverse_import_impact(self, changed: DataFrame, max_depth: int = 3) -> DataFrame:
        imports = resolve_imports(snapshot_imports(self.files), self.files, SNAPSHOT_ENDINGS, modules=False).filter(F.col("specifier").startswith("."))
        return traverse.reverse_import_impact(imports.select(F.col("file_path").alias("source"), "target"), changed, max_depth)

    def large_symbols(self, min_lines: int = 50, kind: str | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
        return query.large_symbols(self.nodes, min_lines, kind, path, limit)

    def review_context(self, changed: DataFrame, max_depth: int = 2, include_source: bool = True, max_lines: int = 80) -> DataFrame:
        return query.review_context(self.edges, self.files, changed, max_depth, include_source, max_lines)

    def communities(self, limit: int = 50) -> DataFrame:
        return communities.list_communities(self.nodes, self.edges, limit)

    def community(self, name: str, members: bool = True) -> DataFrame:
        return communities.community_detail(self.nodes, self.edges, name, members)

    def architecture_warnings(self) -> DataFrame:
        return communities.architecture_warnings(self.nodes, self.edges)

    def wiki_pages(self) -> DataFrame:
        return communities.wiki_pages(self.nodes, self.edges)

    def flows(self) -> tuple[DataFrame, DataFrame]:
        return flows.flows(self.nodes, self.edges)

    def affected_flows(self, changed: DataFrame, limit: int = 50) -> DataFrame:
        return flows.affected_flows(*self.flows(), changed, limit)

    def change_risk(self, changes: DataFrame, diff_lines: DataFrame | None = None) -> DataFrame:
        return risk.change_risk(self.nodes, self.edges, changes, None if diff_lines is None else risk.security_hits(diff_lines))

    def embeddings(self, model: str = search.DEFAULT_MODEL, known: DataFrame | None = None) -> DataFrame:
        """Vectors of all symbols; of a model behind a service those in `known` aren't asked for again."""
        return search.embed_nodes(self.nodes, model, embedding.client(model), known)

    def search(self, text: str, kind: str | None = None, limit: int = 20, model: str = search.DEFAULT_MODEL, embeddings: DataFrame | None = None, index: VectorIndex | None = None) -> DataFrame:
        """`embeddings` are stored ones; without any, vectors are made for this search. `index` is one
        of these nodes' vectors."""
        return search.semantic_search(self.nodes, self.embeddings(model) if embeddings is None else embeddings, text, kind, limit, model, index)

    def index_vectors(self, embeddings: DataFrame, at: str, of: str | None = None) -> VectorIndex:
        """Stores an index of the nodes' vectors (qualified_name, vector)."""
        return VectorIndex.build(self.nodes.select("qualified_name", "kind", "file_path").join(embeddings.select("qualified_name", "vector"), "qualified_name"), at, of)

    def postprocess(self, at: str) -> DataFrame:
        """Stores flows, their files and communities as a new generation; one row with the numbers."""
        listed, members = self.flows()
        found = communities.communities(self.nodes, self.edges)

        def write(to: str) -> None:
            listed.write.parquet(f"{to}/flows")
            members.write.parquet(f"{to}/flow_memberships")
            found.write.parquet(f"{to}/communities")

        spark = self.nodes.sparkSession
        save_generation(spark, at, write)
        stored = load_tables(spark, at, "flows", "communities")
        return stored[0].agg(F.count("*").alias("flows")).join(stored[1].agg(F.count("*").alias("communities")))

    def prompt(self, repo: str, updated_at: str, max_bytes: int = 64_000) -> DataFrame:
        return text.format_prompt(self.files, repo, updated_at, max_bytes)

    def symbol(self, name: str) -> tuple[DataFrame, DataFrame]:
        return text.query_symbol(self.files, name)

    def refactor_preview(self, name: str, limit: int = 100) -> DataFrame:
        return text.refactor_preview(self.files, name, limit)

    def refactored(self, name: str, new_name: str, max_files: int = 50) -> DataFrame:
        return text.apply_refactor(self.files, name, new_name, max_files)
