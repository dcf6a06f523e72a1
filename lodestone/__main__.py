"""Command line: python -m lodestone <command> [--root DIR] [--store DIR] ...

A repository's snapshot and graph live in the store, in a folder by the hash of its path.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.graph import CodeGraph
from lodestone.operators import communities, flows, risk, search, text
from lodestone.operators import query as patterns
from lodestone.operators import repos as registries
from lodestone.operators.vectors import VectorIndex
from lodestone.schemas import EMBEDDINGS, REPOS, conform
from lodestone.sources import documents, git, stores
from lodestone.sources.config import MARKERS, SnapshotConfig, detect_preset
from lodestone.sources.snapshot import list_files, load_snapshot, load_tables, refresh, save_generation, save_snapshot
from lodestone.streaming.watch import watch


class Session:
    def __init__(self, options: argparse.Namespace):
        self.options = options
        self.root = Path(options.root).resolve()
        self.store = Path(options.store).expanduser()
        self.spark = SparkSession.builder.appName("lodestone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        self.spark.sparkContext.setLogLevel("ERROR")

    def at(self, root: Path | None = None) -> str:
        return str(self.store / hashlib.sha256(str(root or self.root).encode()).hexdigest()[:16])

    def config(self) -> SnapshotConfig:
        return SnapshotConfig.load(f"{self.at()}/config.json", str(self.root / ".lodestone.json"))

    def refresh(self) -> DataFrame:
        """Reads the working tree again, keeping what didn't change."""
        new = refresh(list_files(self.spark, str(self.root), self.config()), self.snapshot(), self.config(), str(self.root)).drop("changed")
        save_snapshot(new, f"{self.at()}/snapshot")
        return self.snapshot()

    def snapshot(self) -> DataFrame | None:
        return load_snapshot(self.spark, f"{self.at()}/snapshot")

    def files(self) -> DataFrame:
        found = self.snapshot()
        return self.refresh() if found is None else found

    def stored_graph(self, root: Path | None = None) -> CodeGraph | None:
        return CodeGraph.load(self.spark, f"{self.at(root)}/graph")

    def build(self) -> CodeGraph:
        """Takes a new snapshot and parses what changed since the stored graph, if there is one."""
        CodeGraph.refresh(self.refresh(), f"{self.at()}/graph")
        graph = self.stored_graph()
        graph.postprocess(f"{self.at()}/derived")
        return graph

    def flows(self) -> tuple[DataFrame, DataFrame]:
        """Stored flows and their files."""
        graph = self.graph()
        return load_tables(self.spark, f"{self.at()}/derived", "flows", "flow_memberships") or graph.flows()

    def embeddings(self) -> DataFrame | None:
        """Stored vectors of all models."""
        found = load_tables(self.spark, f"{self.at()}/embeddings", "vectors")
        return None if found is None else conform(found[0], EMBEDDINGS)

    def index_at(self) -> str:
        """Where the index of the model's vectors is."""
        return f"{self.at()}/index-{hashlib.sha256(self.options.model.encode()).hexdigest()[:16]}"

    def graph(self) -> CodeGraph:
        return self.stored_graph() or self.build()

    def changes(self) -> tuple[DataFrame, DataFrame]:
        """Files named by --changed, or those that git tells of."""
        named = [p.strip().strip("'\"").replace("\\", "/") for p in (getattr(self.options, "changed", None) or "").split(",") if p.strip()]
        if named:
            return self.spark.createDataFrame([(p, 0, 0) for p in named], "file_path string, added long, deleted long"), self.spark.createDataFrame([], "ord long, line string")
        return git.changes(self.spark, str(self.root), self.options.base)

    def registry(self) -> DataFrame:
        return stores.load_registry(self.spark, str(self.store / "registry.json"))

    def all_graphs(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the registered repositories that have a graph."""
        wanted = set(filter(None, (self.options.aliases or "").split(",")))
        nodes = edges = None
        for r in self.registry().collect():
            graph = self.stored_graph(Path(r["path"])) if not wanted or r["alias"] in wanted else None
            if graph is not None:
                n, e = (t.withColumn("repo_alias", F.lit(r["alias"])) for t in (graph.nodes, graph.edges))
                nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
        if nodes is None:
            sys.exit("no registered repository has a graph")
        return nodes, edges


def _register(s: Session) -> DataFrame:
    graph = s.graph()
    status = graph.status().first()
    entry = s.spark.createDataFrame([(s.options.name, str(s.root), status["node_count"], status["edge_count"], datetime.now(UTC).isoformat())], REPOS)
    new = s.spark.createDataFrame(registries.upsert(s.registry(), entry).collect(), REPOS)
    s.store.mkdir(parents=True, exist_ok=True)
    stores.save_registry(new, str(s.store / "registry.json"))
    return new


def _unregister(s: Session) -> DataFrame:
    new = s.spark.createDataFrame(registries.remove(s.registry(), s.options.name).collect(), REPOS)
    stores.save_registry(new, str(s.store / "registry.json"))
    return new


def _init(s: Session) -> str:
    preset = s.options.preset or detect_preset([p.name for p in s.root.iterdir()])
    (s.root / ".lodestone.json").write_text(json.dumps(SnapshotConfig.for_preset(preset).__dict__, indent=2) + "\n")
    return preset


def _embed(s: Session) -> DataFrame:
    """Vectors of one model, stored in place of those of before; of other models' those of symbols that
    are gone go."""
    graph, old = s.graph(), s.embeddings()
    new = conform(graph.embeddings(s.options.model, old), EMBEDDINGS)
    if old is not None:
        others = old.filter(F.col("model") != s.options.model).join(graph.nodes.select("qualified_name"), "qualified_name", "left_semi")
        new = new.unionByName(others.select(new.columns))
    save_generation(s.spark, f"{s.at()}/embeddings", lambda to: new.write.parquet(f"{to}/vectors"))
    own = search.own_space(s.embeddings()).filter(F.col("model") == s.options.model)
    graph.index_vectors(own, s.index_at(), CodeGraph.updated_at(s.spark, f"{s.at()}/graph"))
    return s.embeddings().groupBy("model").count()


def _search(s: Session) -> DataFrame:
    """By stored vectors of the model and names; by names alone if there are none."""
    found = s.embeddings()
    none = s.spark.createDataFrame([], "qualified_name string, model string, vector array<double>")
    index = VectorIndex.load(s.spark, s.index_at())
    if index is not None and index.of != CodeGraph.updated_at(s.spark, f"{s.at()}/graph"):
        index = None  # of an older graph
    return s.graph().search(s.options.name or "", s.options.kind, s.options.limit, s.options.model, none if found is None else found, index)


def _readme(s: Session) -> DataFrame:
    return s.spark.createDataFrame([("README.md", (s.root / "README.md").read_text())], "path string, content string")


def _paths(s: Session) -> DataFrame:
    return s.changes()[0].select("file_path")


def _impact_of_repositories(s: Session) -> DataFrame:
    nodes, edges = s.all_graphs()
    return registries.cross_repo_impact(edges, nodes.select("repo_alias").distinct().join(_paths(s)), s.options.depth)


#: What each command does; the text is its help.
COMMANDS = {
    "init": ("write a configuration for a preset", _init),
    "detect": ("tell the preset of the root", lambda s: detect_preset([p.name for p in s.root.iterdir() if p.name in {m for v in MARKERS.values() for m in v}])),
    "refresh": ("take a snapshot", lambda s: stores.snapshot_status(s.refresh(), s.spark)),
    "status": ("tell of the snapshot", lambda s: stores.snapshot_status(s.snapshot(), s.spark)),
    "store-path": ("where snapshot and graph are", lambda s: s.at()),
    "prompt": ("the snapshot as one text", lambda s: text.format_prompt(s.files(), str(s.root), datetime.now(UTC).isoformat(), s.options.max_bytes).first()["prompt"]),
    "prompts": ("fixed prompts", lambda s: documents.prompt(s.options.name) if s.options.name else "\n".join(documents.PROMPTS)),
    "graph-build": ("build the graph", lambda s: s.build() and CodeGraph.stored_status(s.spark, f"{s.at()}/graph")),
    "graph-status": ("count nodes and edges", lambda s: CodeGraph.stored_status(s.spark, f"{s.at()}/graph")),
    "query-graph": (f"edges by pattern: {', '.join([*patterns.PATTERNS, 'tests_for'])}", lambda s: s.graph().query(s.options.pattern, s.options.name or "", s.options.limit)),
    "impact-radius": ("files near the changed ones", lambda s: s.graph().impact_radius(_paths(s), s.options.depth)),
    "reverse-imports": ("files that import the changed ones", lambda s: s.graph().reverse_import_impact(_paths(s), s.options.depth)),
    "detect-changes": ("risk of changed files", lambda s: s.graph().change_risk(*s.changes())),
    "minimal-context": ("the gist of the changes", lambda s: risk.minimal_context(s.graph().change_risk(*s.changes()))),
    "graph-postprocess": ("work out flows and communities anew", lambda s: s.graph().postprocess(f"{s.at()}/derived")),
    "list-flows": ("execution flows", lambda s: flows.list_flows(s.flows()[0], s.options.limit)),
    "get-flow": ("one flow in detail", lambda s: flows.flow_detail(s.flows()[0], s.graph().edges, s.options.name)),
    "affected-flows": ("flows through changed files", lambda s: flows.affected_flows(*s.flows(), _paths(s).withColumn("ord", F.col("file_path")), s.options.limit)),
    "list-communities": ("communities", lambda s: s.graph().communities(s.options.limit)),
    "get-community": ("one community in detail", lambda s: s.graph().community(s.options.name or "")),
    "architecture-overview": ("warnings about communities", lambda s: s.graph().architecture_warnings()),
    "review-context": ("changed and near files with their first lines", lambda s: s.graph().review_context(_paths(s), s.options.depth)),
    "find-large-functions": ("long symbols", lambda s: s.graph().large_symbols(s.options.min_lines, s.options.kind, s.options.name, s.options.limit)),
    "docs-section": ("a section of the README", lambda s: documents.docs_section(_readme(s), s.options.name or "usage").first()["section"]),
    "embed-graph": ("vectors of symbols", _embed),
    "semantic-search": ("symbols near a text", _search),
    "query-symbol": ("definitions and references of a name", lambda s: text.symbol_totals(s.files(), s.options.name or "")),
    "refactor-preview": ("lines that a renaming would change", lambda s: s.graph().refactor_preview(s.options.name or "", s.options.limit)),
    "refactor-apply": ("rename in the working tree", lambda s: str(stores.write_refactored(s.graph().refactored(s.options.name, s.options.new_name, s.options.limit), str(s.root)))),
    "generate-wiki": ("a page for each community", lambda s: str(stores.write_wiki(communities.wiki_pages(s.graph().nodes, s.graph().edges), f"{s.at()}/wiki", s.options.force))),
    "get-wiki-page": ("a page", lambda s: stores.read_wiki_page(s.spark, f"{s.at()}/wiki", s.options.name or "")),
    "registry-list": ("registered repositories", lambda s: s.registry()),
    "registry-add": ("register the root under a name", _register),
    "registry-remove": ("unregister a name", _unregister),
    "cross-repo-search": ("search registered repositories", lambda s: search.cross_repo_search(s.all_graphs()[0], s.options.name or "", s.options.limit)),
    "cross-repo-impact": ("impact in registered repositories", _impact_of_repositories),
    "watch": ("refresh whenever files change", lambda s: watch(s.spark, str(s.root), lambda df, i: s.refresh() and None, f"{s.at()}/watch", config=s.config()).awaitTermination()),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("lodestone", formatter_class=argparse.RawDescriptionHelpFormatter, epilog="commands:\n" + "\n".join(f"  {n:<22} {h}" for n, (h, _) in COMMANDS.items()))
    out.add_argument("command", choices=COMMANDS, metavar="command")
    out.add_argument("name", nargs="?", help="the target, text, symbol, page or alias that the command asks for")
    out.add_argument("new_name", nargs="?", help="the new name of refactor-apply")
    for option, default in (("--root", "."), ("--store", "~/.lodestone"), ("--base", "HEAD"), ("--changed", None), ("--pattern", "related"), ("--kind", None), ("--model", search.DEFAULT_MODEL), ("--preset", None), ("--aliases", None)):
        out.add_argument(option, default=default)
    for option, number in (("--limit", 50), ("--depth", 2), ("--min-lines", 50), ("--max-bytes", 64_000)):
        out.add_argument(option, type=int, default=number)
    out.add_argument("--force", action="store_true")
    return out


def main(arguments: list[str] | None = None) -> int:
    """Prints rows as lines of JSON, and texts as they are."""
    options = parser().parse_args(arguments)
    found = COMMANDS[options.command][1](Session(options))
    if isinstance(found, DataFrame):
        for line in found.toJSON().toLocalIterator():
            print(line)
    elif found is not None:
        print(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
