"""The graph built from a snapshot, in full or from what changed.

Each file's facts are stored unresolved, beside three indexes: the symbols that files define by name,
the files that refer to a name, and the files whose imports may mean a path. A change resolves anew
the files that it can touch and no others: those that changed themselves, those that refer to a name
whose first symbol is another one now, and those whose imports may mean a path that has come or gone.
What is looked up for that are rows of single keys, so the work grows with the change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.cluster import durable
from lodestone.functions.columns import FILE_LANGUAGES, language_of, lines_of, posix
from lodestone.schemas import EDGES, FILES, NODES, conform
from lodestone.sources.buckets import BucketStore, Change, HeldTables, Table

from .parse import parse_files
from .resolve import import_base, import_candidates, resolve_imports, resolve_names

#: What a graph is stored as.
TABLES = {
    "files": Table("path", "path"),
    "facts": Table("file_path", "file_path"),
    "nodes": Table("file_path", "file_path", ("kind",)),
    "edges": Table("file_path", "file_path", ("kind",)),
    "symbols": Table("name", "file_path"),
    "referrers": Table("target_name", "file_path"),
    "importers": Table("candidate", "file_path"),
}


def file_nodes(files: DataFrame) -> DataFrame:
    path = posix("path")
    count = F.when(F.col("content").isNull(), 0).otherwise(F.size(lines_of("content"))).cast("long")
    return files.select(F.lit("file").alias("kind"), path.alias("name"), F.concat(F.lit("file::"), path).alias("qualified_name"), path.alias("file_path"), F.lit(0).cast("long").alias("line_start"), count.alias("line_end"), language_of(path, FILE_LANGUAGES, "unknown").alias("language"))


def symbol_index(facts: DataFrame) -> DataFrame:
    """(name, file_path, qualified_name): the first symbol of each name in each file."""
    first = F.min(F.struct("ord", "qualified_name")).alias("f")
    return facts.filter("rec = 'symbol'").groupBy("name", "file_path").agg(first).select("name", "file_path", "f.qualified_name")


def referrer_index(facts: DataFrame) -> DataFrame:
    """(target_name, file_path): which files refer to a name."""
    return facts.filter("rec = 'reference'").select("target_name", "file_path").distinct()


def importer_index(facts: DataFrame) -> DataFrame:
    """(candidate, file_path): which files' imports may mean a path."""
    based = facts.filter("rec = 'import'").select("file_path", import_base(posix("file_path"), F.col("target_name")).alias("_base"))
    return based.select(F.explode(import_candidates(F.col("_base"))).alias("candidate"), "file_path").distinct()


def nodes_of(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes of files and of the symbols in their facts; of symbols with one qualified name the first
    in its file. Qualified names begin with the path."""
    first = F.row_number().over(Window.partitionBy("qualified_name").orderBy("file_path", "ord"))
    own = facts.filter("rec = 'symbol'").withColumn("_r", first).filter("_r = 1")
    return conform(file_nodes(files), NODES).unionByName(conform(own, NODES))


def edges_of(facts: DataFrame, paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edges that facts make, a multiset, given all known paths (path) and, for each name that
    they refer to, all its symbols (name, file_path, qualified_name)."""
    contains = facts.filter("rec = 'symbol'").select(F.lit("contains").alias("kind"), F.col("container").alias("source"), F.col("qualified_name").alias("target"), "file_path")
    imports = resolve_imports(facts.filter("rec = 'import'").select("file_path", F.col("target_name").alias("specifier")), paths)
    imported = imports.select(F.lit("imports_from").alias("kind"), F.concat(F.lit("file::"), "file_path").alias("source"), F.concat(F.lit("file::"), "target").alias("target"), "file_path")
    named = resolve_names(facts.filter("rec = 'reference'").select("kind", "source", "target_name", "file_path"), symbols.withColumn("ord", F.lit(0)))
    return conform(contains, EDGES).unionByName(conform(imported, EDGES)).unionByName(conform(named, EDGES))


def assemble(files: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all files."""
    return nodes_of(files, facts), edges_of(facts, files, symbol_index(facts))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, facts) of a whole snapshot, which is parsed once; facts are kept in the shared folder."""
    facts = durable(parse_files(files))
    return (*assemble(files, facts), facts)


def file_index(files: DataFrame) -> DataFrame:
    return files.select(posix("path").alias("file_path"), F.col("hash").alias("content_hash"))


def changed_files(files: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, stale): files whose hash the index doesn't have, and paths that are gone."""
    now = file_index(files)
    same = now.join(index, ["file_path", "content_hash"], "left_semi")
    changed = files.join(same.select(F.col("file_path").alias("_p")), posix("path") == F.col("_p"), "left_anti")
    return changed, index.join(now, "file_path", "left_anti").select("file_path")


def stored_tables(files: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """All of TABLES of a graph."""
    return {"files": conform(files.withColumn("path", posix("path")), FILES), "facts": facts, "nodes": nodes, "edges": edges, "symbols": symbol_index(facts), "referrers": referrer_index(facts), "importers": importer_index(facts)}


def _differing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keys of rows that are in one of two tables only, or more often in one; either is read once."""
    both = old.select(new.columns).withColumn("_n", F.lit(1)).union(new.withColumn("_n", F.lit(-1)))
    return both.groupBy(*new.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").select(key).distinct()


def changes_of(files: DataFrame, old: BucketStore | HeldTables) -> dict[str, Change]:
    """What a newer snapshot changes of TABLES.

    Equal to building anew: of a name's symbols the first by path is the one that counts before and
    after, and imports take the first candidate that is a known path.
    """
    files = conform(files.withColumn("path", posix("path")), FILES)
    known = old.read("files")
    changed, stale = changed_files(files, file_index(known))
    changed, stale = durable(changed), durable(stale)
    new = durable(parse_files(changed))
    gone = durable(changed.select(F.col("path").alias("file_path")).union(stale))
    moved = file_index(files).join(file_index(known), "file_path", "left_anti").select("file_path").union(stale)
    was = durable(old.rows("facts", gone))
    # names whose first symbol is another one now
    symbols_new, symbols_was = symbol_index(new), symbol_index(was)
    names = durable(symbols_new.select("name").union(symbols_was.select("name")).distinct())
    held = old.rows("symbols", names)
    first = lambda symbols, of: symbols.groupBy("name").agg(F.min(F.struct("file_path", "qualified_name")).alias(of))
    after = held.join(gone, "file_path", "left_anti").unionByName(symbols_new)
    shifted = first(held, "before").join(first(after, "after"), "name", "full_outer").filter(~F.col("before.qualified_name").eqNullSafe(F.col("after.qualified_name")))
    shifted = durable(shifted.select(F.col("name").alias("target_name")))
    touched = old.rows("referrers", shifted).select("file_path").union(old.rows("importers", moved.select(F.col("file_path").alias("candidate"))).select("file_path"))
    touched = durable(touched.distinct().join(gone, "file_path", "left_anti"))
    # what these files' edges are now
    resolved = durable(old.rows("facts", touched).unionByName(new))
    wanted = resolved.filter("rec = 'reference'").select(F.col("target_name").alias("name")).distinct()
    symbols = old.rows("symbols", wanted).join(gone, "file_path", "left_anti").unionByName(symbols_new)
    edges = edges_of(resolved, files.select("path"), symbols)
    owners = gone.union(touched)
    # rows of files tell their times as well
    told = [c for c in FILES.names if c not in ("content", "summary")]
    rewritten = durable(files.select(told).exceptAll(known.select(told)).select("path").union(stale.select(F.col("file_path").alias("path"))).distinct())
    by_owner = lambda owners, rows: Change(owners, rows, owners)
    out = {
        "files": Change(rewritten, files.join(rewritten, "path", "left_semi"), rewritten),
        "facts": by_owner(gone, new),
        "nodes": by_owner(gone, nodes_of(changed, new)),
        "edges": by_owner(owners, durable(edges)),
    }
    for name, index in (("symbols", symbol_index), ("referrers", referrer_index), ("importers", importer_index)):
        rows = durable(index(new))
        out[name] = Change(gone, rows, _differing(index(was), rows, TABLES[name].key))
    return out


def update(files: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """TABLES after a newer snapshot, with only changed files parsed and touched ones resolved."""
    held = HeldTables(TABLES, tables)
    return held.changed(changes_of(files, held))
