"""The named queries over the code graph and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.cluster import durable, fresh_dir
from lodestone.functions.columns import FILE_LANGUAGES, SYMBOL_LANGUAGES, extension, file_of, language_of, lines_of, page_name, top_segment, without_quotes
from lodestone.graph import CodeGraph
from lodestone.operators import build, parity, parse, repos, resolve, risk, search, text, traverse
from lodestone.operators import communities as com
from lodestone.operators import flows as flo
from lodestone.operators import query as qry
from lodestone.operators.grams import GramIndex
from lodestone.operators.vectors import VectorIndex
from lodestone.operators.words import WordIndex
from lodestone.plans import derived
from lodestone.plans.derived import docs, docs_oracle, edges, graph_oracle, nodes
from lodestone.schemas import FILES, conform
from lodestone.sources.config import SnapshotConfig
from lodestone.sources.listing import listing
from lodestone.sources.snapshot import compare_listing, list_files, load_snapshot, refresh, save_snapshot
from lodestone.streaming.watch import bursts, debounced, open_bursts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


def queries() -> dict[str, Query]:
    """Every catalogue query by name; each takes (spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(_ORACLES)


# Communities ---------------------------------------------------------------------------------

_COMMUNITIES = """, counted AS (
  SELECT split_part(file_path, '/', 1) AS name, count(DISTINCT file_path) AS file_count, count(*) AS node_count FROM nodes GROUP BY 1
), ends AS (
  SELECT split_part(substr(source, 7), '/', 1) AS name, split_part(substr(target, 7), '/', 1) AS other FROM edges WHERE kind = 'imports_from'
), communities AS (
  SELECT name, file_count, node_count, coalesce(c.coupling, 0) AS coupling FROM counted
  LEFT JOIN (SELECT name, count(*) AS coupling FROM ends WHERE name <> other GROUP BY name) c USING (name)
), listed AS (SELECT * FROM communities ORDER BY node_count DESC, file_count DESC, name LIMIT 50)
"""
_register("communities", lambda s, d: com.communities(nodes(s, d), edges(s, d)), graph_oracle(_COMMUNITIES + "SELECT * FROM communities"))
_register("list_communities", lambda s, d: com.list_communities(nodes(s, d), edges(s, d), 10), graph_oracle(_COMMUNITIES + "SELECT * FROM communities ORDER BY node_count DESC, file_count DESC, name LIMIT 10"))
_WARNINGS = """, warned AS (
  SELECT name, 'High coupling in ' || name || ' (' || coupling || ' cross-community edges)' AS warning FROM listed WHERE coupling > 200
  UNION ALL SELECT name, 'Large singleton community ' || name || ' (' || node_count || ' nodes)' FROM listed WHERE file_count = 1 AND node_count > 80
) SELECT * FROM warned UNION ALL SELECT NULL, 'No major architecture warnings detected' WHERE NOT EXISTS (SELECT 1 FROM warned)"""
_register("architecture_warnings", lambda s, d: com.architecture_warnings(nodes(s, d), edges(s, d)), graph_oracle(_COMMUNITIES + _WARNINGS))
_register(
    "community_detail",
    lambda s, d: com.community_detail(nodes(s, d), edges(s, d), "Brand1").withColumn("members", F.array_join("members", "|")),
    graph_oracle(
        _COMMUNITIES
        + """, chosen AS (SELECT * FROM communities WHERE name LIKE '%brand1%' ORDER BY node_count DESC, name LIMIT 1),
  first AS (SELECT qualified_name FROM nodes, chosen WHERE file_path = chosen.name OR starts_with(file_path, chosen.name || '/') ORDER BY qualified_name LIMIT 500)
SELECT chosen.*, (SELECT string_agg(qualified_name, '|' ORDER BY qualified_name) FROM first) AS members FROM chosen"""
    ),
)
_TOP_FILES = """, per_file AS (SELECT file_path, count(*) AS symbols FROM nodes GROUP BY 1), top AS (
  SELECT name, file_path, symbols, row_number() OVER (PARTITION BY name ORDER BY symbols DESC, file_path) AS rank
  FROM communities, per_file WHERE starts_with(lower(file_path), lower(name)) QUALIFY rank <= 20
)"""
_register("wiki_top_files", lambda s, d: com.wiki_top_files(nodes(s, d), edges(s, d)), graph_oracle(_COMMUNITIES + _TOP_FILES + "SELECT * FROM top"))
_register(
    "wiki_pages",
    lambda s, d: com.wiki_pages(nodes(s, d), edges(s, d)),
    graph_oracle(
        _COMMUNITIES
        + _TOP_FILES
        + """SELECT trim(regexp_replace(name, '[^A-Za-z0-9_-]', '-', 'g'), '-') AS page,
  '# ' || name || chr(10) || chr(10) || '- Files: ' || file_count || chr(10) || '- Nodes: ' || node_count || chr(10) || '- Coupling: ' || coupling || chr(10) || chr(10) || '## Top Files' || chr(10)
  || string_agg('- ' || file_path || ' (' || symbols || ' symbols)', chr(10) ORDER BY rank) || chr(10) AS body
FROM communities JOIN top USING (name) GROUP BY name, file_count, node_count, coupling"""
    ),
)

# Structural queries --------------------------------------------------------------------------


def _pattern_oracle(where: str) -> str:
    return graph_oracle(f"SELECT source, target, kind, file_path FROM edges WHERE {where} ORDER BY source, target, kind, file_path LIMIT 50")


_SMALL = "(lower({0}) LIKE '%small_r%')"
for _name, _kinds, _ends in (
    ("imports_of", "imports_from", ["source"]),
    ("importers_of", "imports_from", ["target"]),
    ("callees_of", "calls", ["source"]),
    ("callers_of", "calls", ["target"]),
    ("container_of", "contains", ["source"]),
    ("depends_on", "imports_from,calls", ["source"]),
    ("inheritance_of", "inherits", ["source", "target"]),
    ("implemented_by", "implements", ["target"]),
    ("related", "", ["source", "target"]),
):
    _target = "Small_R" if _kinds == "calls" or not _kinds else "brand2/Small"
    _like = _target.lower()
    _where = " OR ".join(f"lower({e}) LIKE '%{_like}%'" for e in _ends)
    if _kinds:
        _where = f"kind IN ({', '.join(repr(k) for k in _kinds.split(','))}) AND ({_where})"
    _register(_name, lambda s, d, n=_name, t=_target: qry.query_graph(nodes(s, d), edges(s, d), n, t), _pattern_oracle(_where))
_register(
    "tests_for",
    lambda s, d: qry.query_graph(nodes(s, d), edges(s, d), " tests_for ", "Small"),
    graph_oracle(
        "SELECT qualified_name AS source, '%::Small' AS target, 'tests_for' AS kind, file_path FROM nodes WHERE kind = 'function' AND (file_path LIKE '%test%' OR file_path LIKE '%.spec.%') AND lower(name) LIKE '%small%' ORDER BY 1, 2, 3, 4 LIMIT 50"
    ),
)
_GRAMS: dict[tuple[str, str], GramIndex] = {}


def _grams(s: SparkSession, d: str) -> GramIndex:
    """The stored postings of the derived graph, made once for a session."""
    at = (s.sparkContext.applicationId, d)
    if at not in _GRAMS:
        _GRAMS[at] = GramIndex.build(nodes(s, d), edges(s, d), fresh_dir(s, "grams"))
    return _GRAMS[at]


_register("callers_of_by_postings", lambda s, d: _grams(s, d).query_graph("callers_of", "Small_R"), _pattern_oracle(f"kind = 'calls' AND {_SMALL.format('target')}"))
_register("related_by_postings", lambda s, d: _grams(s, d).query_graph("related", "Small_R"), _pattern_oracle(f"{_SMALL.format('source')} OR {_SMALL.format('target')}"))
_register(
    "large_symbols",
    lambda s, d: qry.large_symbols(nodes(s, d), 60, "function", "Small", 100),
    graph_oracle(
        "SELECT kind, qualified_name, file_path, line_start, line_end, CASE WHEN line_end >= line_start THEN line_end - line_start + 1 ELSE 0 END AS line_count FROM nodes WHERE kind = 'function' AND lower(file_path) LIKE '%small%' AND line_count >= 60 ORDER BY line_count DESC, qualified_name LIMIT 100"
    ),
)
_register("graph_status", lambda s, d: qry.graph_status(nodes(s, d), edges(s, d)), graph_oracle("SELECT true AS exists, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count"))

# Traversals ----------------------------------------------------------------------------------


def _changed(s: SparkSession, d: str) -> DataFrame:
    return derived.changes(s, d).select("file_path")


_IMPACT = """, adj AS (
  SELECT source, target FROM edges WHERE kind IN ('imports_from', 'calls') UNION SELECT target, source FROM edges WHERE kind IN ('imports_from', 'calls')
), reached(node, depth) AS (
  SELECT 'file::' || file_path, 0 FROM {changed} UNION SELECT target, depth + 1 FROM reached JOIN adj ON node = source WHERE depth < {depth}
), impacted AS (SELECT DISTINCT CASE WHEN starts_with(node, 'file::') THEN substr(node, 7) ELSE split_part(node, '::', 1) END AS file_path FROM reached)"""
_register("impact_radius", lambda s, d: traverse.impact_radius(edges(s, d), _changed(s, d), 2), graph_oracle(_IMPACT.format(changed="changes", depth=2) + "SELECT file_path FROM impacted"))


def _imports(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).filter("kind = 'imports_from'").select(file_of("source").alias("source"), file_of("target").alias("target"))


_register(
    "reverse_import_impact",
    lambda s, d: traverse.reverse_import_impact(_imports(s, d), _changed(s, d), 3),
    graph_oracle(
        """, back AS (SELECT DISTINCT substr(target, 7) AS source, substr(source, 7) AS target FROM edges WHERE kind = 'imports_from'), reached(file_path, depth) AS (
  SELECT file_path, 0 FROM changes UNION SELECT target, depth + 1 FROM reached JOIN back ON file_path = source WHERE depth < 3
) SELECT file_path, min(depth) AS depth FROM reached GROUP BY file_path"""
    ),
)


def _review_files(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).filter("kind = 'file'").select(F.col("file_path").alias("path"), F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of "), "file_path"))).alias("content"))


_register(
    "review_snippets",
    lambda s, d: qry.review_context(edges(s, d), _review_files(s, d), _changed(s, d), 2, True, 5),
    graph_oracle(
        _IMPACT.format(changed="changes", depth=2) + """SELECT file_path, '### ' || file_path || chr(10) || array_to_string([('line ' || i || ' of ' || file_path) for i in range(1, 11)], chr(10)) AS snippet
FROM impacted WHERE file_path IN (SELECT file_path FROM nodes) ORDER BY file_path LIMIT 30"""
    ),
)
_register(
    "cross_repo_impact",
    lambda s, d: repos.cross_repo_impact(_by_repo(edges(s, d), "file_path"), _by_repo(derived.changes(s, d).select("file_path"), "file_path"), 2),
    graph_oracle(
        """, e AS (SELECT DISTINCT split_part(file_path, '/', 1) AS repo, source, target FROM edges WHERE kind IN ('imports_from', 'calls')),
  adj AS (SELECT repo, source, target FROM e UNION SELECT repo, target, source FROM e), reached(repo, node, depth) AS (
  SELECT split_part(file_path, '/', 1), 'file::' || file_path, 0 FROM changes UNION SELECT r.repo, target, depth + 1 FROM reached r JOIN adj a ON r.repo = a.repo AND node = source WHERE depth < 2
) SELECT DISTINCT repo AS repo_alias, CASE WHEN starts_with(node, 'file::') THEN substr(node, 7) ELSE split_part(node, '::', 1) END AS file_path FROM reached"""
    ),
)


def _by_repo(df: DataFrame, path: str) -> DataFrame:
    """Each top folder stands for a repository."""
    return df.withColumn("repo_alias", top_segment(path))


# Flows ---------------------------------------------------------------------------------------

_ENTRIES = """, marked AS (
  SELECT qualified_name AS entry, name, qualified_name IN (SELECT target FROM edges WHERE kind = 'calls') AS hinted FROM nodes WHERE kind = 'function'
), entries AS (
  SELECT * FROM marked WHERE NOT hinted OR lower(name) LIKE '%main%' OR lower(name) LIKE '%handler%' OR lower(name) LIKE '%route%' OR lower(name) LIKE '%page%'
)"""
_FLOWS = (
    _ENTRIES
    + """, chosen AS (SELECT *, row_number() OVER (ORDER BY hinted, entry) AS id FROM entries QUALIFY id <= 300),
calls AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls'), traced(entry, node, depth) AS (
  SELECT entry, entry, 0 FROM chosen UNION SELECT entry, target, depth + 1 FROM traced JOIN calls ON node = source WHERE depth < {depth}
), visited AS (SELECT DISTINCT entry, node, split_part(node, '::', 1) AS file_path FROM traced), flows AS (
  SELECT id, 'flow:' || name AS name, entry, count(DISTINCT file_path) AS file_count, count(*) AS node_count, count(*) + 1.5::DOUBLE * count(DISTINCT file_path) AS criticality
  FROM chosen JOIN visited USING (entry) GROUP BY id, name, entry
), members AS (SELECT DISTINCT id AS flow_id, file_path FROM chosen JOIN visited USING (entry))"""
)
_register("flow_entries", lambda s, d: flo.flow_entries(nodes(s, d), edges(s, d)), graph_oracle(_ENTRIES + "SELECT * FROM entries"))
_register("flows", lambda s, d: flo.flows(nodes(s, d), edges(s, d))[0], graph_oracle(_FLOWS.format(depth=4) + "SELECT * FROM flows"))
_register("flow_memberships", lambda s, d: flo.flows(nodes(s, d), edges(s, d))[1], graph_oracle(_FLOWS.format(depth=4) + "SELECT * FROM members"))
_register("list_flows", lambda s, d: flo.list_flows(flo.flows(nodes(s, d), edges(s, d))[0], 20), graph_oracle(_FLOWS.format(depth=4) + "SELECT * FROM flows ORDER BY criticality DESC, node_count DESC, id LIMIT 20"))
_register(
    "flow_detail",
    lambda s, d: flo.flow_detail(flo.flows(nodes(s, d), edges(s, d))[0], edges(s, d), "ring").withColumns({c: F.array_join(c, "|") for c in ("nodes", "files")}),
    graph_oracle(
        _FLOWS.format(depth=4)
        + """, one AS (SELECT * FROM flows WHERE name LIKE '%ring%' ORDER BY criticality DESC, id LIMIT 1), deep(node, depth) AS (
  SELECT entry, 0 FROM one UNION SELECT target, depth + 1 FROM deep JOIN calls ON node = source WHERE depth < 5
) SELECT one.*, (SELECT string_agg(DISTINCT node, '|' ORDER BY node) FROM deep) AS nodes, (SELECT string_agg(DISTINCT split_part(node, '::', 1), '|' ORDER BY split_part(node, '::', 1)) FROM deep) AS files FROM one"""
    ),
)


def _ordered_changes(s: SparkSession, d: str) -> DataFrame:
    return derived.changes(s, d).select("file_path", F.crc32("file_path").alias("ord")).drop("ord").withColumn("ord", F.hex(F.encode(F.reverse("file_path"), "UTF-8")))


_register(
    "affected_flows",
    lambda s, d: flo.affected_flows(*flo.flows(nodes(s, d), edges(s, d)), _ordered_changes(s, d), 10),
    graph_oracle(
        _FLOWS.format(depth=4)
        + """, first AS (
  SELECT f.*, row_number() OVER (PARTITION BY id ORDER BY reverse(m.file_path)) AS r, reverse(m.file_path) AS o FROM flows f JOIN members m ON f.id = m.flow_id WHERE m.file_path IN (SELECT file_path FROM changes)
) SELECT id, name, entry, file_count, node_count, criticality FROM first WHERE r = 1 ORDER BY o, criticality DESC, node_count DESC, id LIMIT 10"""
    ),
)

# Risk ----------------------------------------------------------------------------------------

_RISK = (
    _IMPACT.format(changed="changes", depth=2)
    + """, tests AS (SELECT * FROM nodes WHERE file_path LIKE '%test%' OR file_path LIKE '%.spec.%'),
names AS (SELECT file_path, lower(name) AS part FROM nodes WHERE kind = 'function' AND file_path IN (SELECT file_path FROM changes) QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY qualified_name) <= 100),
stems AS (SELECT file_path, lower(replace(replace(split_part(regexp_extract(file_path, '[^/]*$'), '.', 1), '-', ''), '_', '')) AS stem FROM changes),
linked AS (SELECT n.file_path, count(*) AS c FROM names n JOIN tests t ON contains(lower(t.name), part) OR contains(lower(t.qualified_name), part) GROUP BY 1),
hit AS (SELECT s.file_path, count(*) AS c FROM stems s JOIN tests t ON t.kind = 'function' AND (contains(lower(t.name), stem) OR contains(lower(t.qualified_name), stem)) GROUP BY 1),
counted AS (
  SELECT c.file_path, (SELECT count(*) FROM impacted) - CASE WHEN c.file_path IN (SELECT file_path FROM impacted) THEN 1 ELSE 0 END AS impacted_files,
    coalesce(k.c, 0) AS callers, coalesce(hit.c, 0) AS test_hits, c.added + c.deleted AS changed_lines, 0::BIGINT AS security_hits, coalesce(f.c, 0) AS functions, coalesce(linked.c, 0) AS linked
  FROM changes c LEFT JOIN (SELECT split_part(target, '::', 1) AS file_path, count(*) AS c FROM edges WHERE kind = 'calls' GROUP BY 1) k USING (file_path)
  LEFT JOIN (SELECT file_path, count(*) AS c FROM nodes WHERE kind = 'function' GROUP BY 1) f USING (file_path) LEFT JOIN hit USING (file_path) LEFT JOIN linked USING (file_path)
), scored AS (
  SELECT *, 1.5::DOUBLE * callers + 0.8::DOUBLE * impacted_files + 0.3::DOUBLE * changed_lines + 0.7::DOUBLE * functions + CASE WHEN test_hits = 0 AND linked = 0 THEN 4 ELSE 0 END AS score FROM counted
), risks AS (
  SELECT file_path, impacted_files, callers, test_hits, changed_lines, security_hits, round(score, 6) AS risk_score, CASE WHEN score >= 16 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS risk FROM scored
)"""
)


def _risks(s: SparkSession, d: str) -> DataFrame:
    return risk.change_risk(nodes(s, d), edges(s, d), derived.changes(s, d))


_register("change_risk", _risks, graph_oracle(_RISK + "SELECT * FROM risks"))
_RISK_WORDS = ("hot", "gear", "small")


def _risks_of_diff(s: SparkSession, d: str) -> DataFrame:
    """With a diff in which each function of a changed file is an added line."""
    changed = derived.changes(s, d)
    heads = changed.select(F.struct("file_path", F.lit("").alias("name")).alias("ord"), F.concat(F.lit("+++ b/"), "file_path").alias("line"))
    lines = nodes(s, d).filter("kind = 'function'").join(changed.select("file_path"), "file_path", "left_semi").select(F.struct("file_path", "name").alias("ord"), F.concat(F.lit("+def "), "name").alias("line"))
    return risk.change_risk(nodes(s, d), edges(s, d), changed, risk.security_hits(heads.union(lines), _RISK_WORDS))


_register(
    "change_risk_of_diff",
    _risks_of_diff,
    graph_oracle(
        _RISK.replace("0::BIGINT AS security_hits", "coalesce(words.c, 0) AS security_hits")
        .replace("LEFT JOIN hit USING", "LEFT JOIN words USING (file_path) LEFT JOIN hit USING")
        .replace(" + CASE WHEN test_hits", " + 1.3::DOUBLE * security_hits + CASE WHEN test_hits")
        .replace("counted AS (", f"words AS (SELECT file_path, sum({' + '.join(f'contains(lower(name), {w!r})::INT' for w in _RISK_WORDS)})::BIGINT AS c FROM nodes WHERE kind = 'function' GROUP BY 1),\ncounted AS (", 1)
        + "SELECT * FROM risks"
    ),
)
_register(
    "minimal_context",
    lambda s, d: risk.minimal_context(_risks(s, d)).withColumns({c: F.array_join(c, "|") for c in ("top_files", "suggested_tools")}),
    graph_oracle(
        _RISK
        + f"""SELECT CASE WHEN bool_or(risk = 'high') THEN 'high' WHEN bool_or(risk = 'medium') THEN 'medium' ELSE 'low' END AS risk, count(*) AS changed_files, sum(impacted_files)::BIGINT AS impacted_files,
  (SELECT string_agg(file_path || ' (' || risk || ')', '|' ORDER BY impacted_files DESC, file_path) FROM (SELECT * FROM risks ORDER BY impacted_files DESC, file_path LIMIT 5)) AS top_files,
  '{"|".join(risk.SUGGESTED_TOOLS)}' AS suggested_tools FROM risks"""
    ),
)
_WORDS = ("token", "idiot", "license", "the")
_register(
    "security_hits",
    lambda s, d: risk.line_hits(docs(s, d).select(F.col("path").alias("file_path"), F.explode(lines_of("content")).alias("line")), _WORDS),
    docs_oracle(
        f"""SELECT path AS file_path, sum({" + ".join(f"contains(lower(line), '{w}')::INT" for w in _WORDS)})::BIGINT AS security_hits
FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM docs) GROUP BY 1 HAVING sum({" + ".join(f"contains(lower(line), '{w}')::INT" for w in _WORDS)}) > 0"""
    ),
)


def _diff(s: SparkSession, d: str) -> DataFrame:
    """A unified diff of all documents, in turn added, removed and unchanged lines; some files are deleted."""
    each = docs(s, d)
    sign = F.get(F.array(*map(F.lit, "+- ")), (F.col("_at") % 3).cast("int"))
    heads = each.select(F.struct("path", F.lit(-1).alias("at")).alias("ord"), F.when(F.col("path").endswith("7.py"), "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), "path")).alias("line"))
    lines = each.select("path", F.posexplode(lines_of("content")).alias("_at", "_line"))
    return heads.union(lines.select(F.struct("path", F.col("_at").alias("at")).alias("ord"), F.concat(sign, "_line").alias("line")))


_register(
    "diff_security_hits",
    lambda s, d: risk.security_hits(_diff(s, d), _WORDS),
    docs_oracle(
        f""", body AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS a FROM docs
), diff AS (
  SELECT path, -1 AS a, CASE WHEN path LIKE '%7.py' THEN '+++ /dev/null' ELSE '+++ b/' || path END AS line FROM docs
  UNION ALL SELECT path, a, CASE a % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END || line FROM body
), told AS (
  SELECT line, last_value(CASE WHEN starts_with(line, '+++ b/') THEN trim(substr(line, 7)) END IGNORE NULLS) OVER (ORDER BY path, a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file_path FROM diff
)
SELECT file_path, sum({" + ".join(f"contains(lower(line), '{w}')::INT" for w in _WORDS)})::BIGINT AS security_hits
FROM told WHERE file_path IS NOT NULL AND regexp_matches(line, '^[+-]') AND NOT starts_with(line, '+++') AND NOT starts_with(line, '---') GROUP BY 1 HAVING sum({" + ".join(f"contains(lower(line), '{w}')::INT" for w in _WORDS)}) > 0"""
    ),
)

# Search --------------------------------------------------------------------------------------

_VECTOR = """, counts AS (
  SELECT qualified_name, ('0x' || substr(md5(w), 1, 2))::INT % 64 AS b, count(*)::DOUBLE AS n FROM (
    SELECT qualified_name, unnest(regexp_split_to_array(kind || ' ' || name || ' ' || qualified_name || ' ' || file_path, '[^\\p{L}\\p{N}_-]+')) AS w FROM nodes WHERE kind <> 'file') WHERE w <> '' GROUP BY 1, 2
)"""
_register(
    "embed_nodes",
    lambda s, d: search.embed_nodes(nodes(s, d)).select("qualified_name", "model", F.posexplode("vector").alias("dim", "value")).filter("value <> 0").withColumn("value", F.round("value", 9)),
    graph_oracle(_VECTOR + "SELECT qualified_name, 'hash-v1' AS model, b AS dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY qualified_name)), 9) AS value FROM counts"),
)


def _table_vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The embeddings table as nodes and vectors."""
    table = s.read.parquet(f"{d}/embeddings.parquet")
    name = F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("qualified_name")
    return table.select(name, F.concat(F.lit("k"), F.col("label").cast("string")).alias("kind"), F.lit("vectors").alias("file_path")), table.select(name, F.col("embedding").alias("vector"))


_register(
    "vector_search",
    lambda s, d: search.vector_search(*_table_vectors(s, d), [1.0 if i % 3 else -1.0 for i in range(64)], None, 25),
    """WITH q AS (SELECT [CASE WHEN i % 3 <> 0 THEN 1.0 ELSE -1.0 END::DOUBLE for i in range(64)] AS v)
SELECT lpad(vec_id::VARCHAR, 9, '0') AS qualified_name, 'k' || label AS kind, 'vectors' AS file_path,
  CASE WHEN len(embedding) = 64 THEN round(list_dot_product(embedding::DOUBLE[], v) / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v)), 1e-9), 9) ELSE 0 END AS score
FROM embeddings, q ORDER BY score DESC, qualified_name LIMIT 25""",
)


def _indexed_neighbours(s: SparkSession, d: str) -> DataFrame:
    """The rows nearest to one of them, by an index that is stored with two thirds of them and then
    brought up to date."""
    described, vectors = _table_vectors(s, d)
    rows = described.join(vectors, "qualified_name")
    late = F.crc32("qualified_name") % 3 == 0
    # of what comes late some had other vectors before, and some rows are no more
    first = rows.filter(~late).unionByName(rows.filter(late & (F.crc32("qualified_name") % 2 == 0)).withColumn("vector", F.reverse("vector")))
    gone = rows.filter(~late).limit(50).withColumn("qualified_name", F.concat(F.lit("old"), "qualified_name"))
    index = VectorIndex.build(first.unionByName(gone), fresh_dir(s, "vectors")).updated(rows.filter(late), gone.select("qualified_name"))
    query = rows.filter("qualified_name = '000000007'").first()["vector"]
    return index.search(list(map(float, query)), None, 25)


_register(
    "vector_index_search",
    _indexed_neighbours,
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7)
SELECT lpad(vec_id::VARCHAR, 9, '0') AS qualified_name, 'k' || label AS kind, 'vectors' AS file_path,
  CASE WHEN len(embedding) = 64 THEN round(list_dot_product(embedding::DOUBLE[], v) / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v)), 1e-9), 9) ELSE 0 END AS score
FROM embeddings, q ORDER BY score DESC, qualified_name LIMIT 25""",
)
_LEXICAL = """, lexical AS (
  SELECT qualified_name, kind, file_path, CASE WHEN lower(name) = 'hot_gear_4' THEN 1 WHEN contains(lower(name), 'hot_gear_4') THEN 0.85 ELSE 0.5 END::DOUBLE AS score
  FROM (SELECT * FROM nodes WHERE lower(name) LIKE '%hot_gear_4%' OR lower(qualified_name) LIKE '%hot_gear_4%' ORDER BY kind, qualified_name LIMIT {limit})
)"""
_register("lexical_search", lambda s, d: search.lexical_search(nodes(s, d), "Hot_Gear_4", None, 30), graph_oracle(_LEXICAL.format(limit=30) + "SELECT * FROM lexical"))
_register("lexical_search_by_postings", lambda s, d: _grams(s, d).lexical_search("Hot_Gear_4", None, 30), graph_oracle(_LEXICAL.format(limit=30) + "SELECT * FROM lexical"))
_register(
    "search_without_vectors",
    lambda s, d: search.semantic_search(nodes(s, d), search.embed_nodes(nodes(s, d)).withColumn("model", F.lit("other")), "Hot_Gear_4", None, 30),
    graph_oracle(_LEXICAL.format(limit=30) + "SELECT * FROM lexical"),
)
_register(
    "hybrid_search",
    lambda s, d: search.semantic_search(nodes(s, d), search.embed_nodes(nodes(s, d)), "Hot_Gear_4", None, 20),
    graph_oracle(
        _VECTOR
        + _LEXICAL.format(limit=60)
        + """, scored AS (
  SELECT qualified_name, round(coalesce(max(n) FILTER (b = ('0x' || substr(md5('Hot_Gear_4'), 1, 2))::INT % 64), 0) / greatest(sqrt(sum(n * n)), 1e-9), 9) AS score FROM counts GROUP BY 1
), vector AS (SELECT qualified_name, kind, file_path, s.score FROM scored s JOIN nodes USING (qualified_name) ORDER BY s.score DESC, qualified_name LIMIT 60),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, qualified_name) AS r FROM vector UNION ALL SELECT *, row_number() OVER (ORDER BY score DESC, kind, qualified_name) FROM lexical
) SELECT qualified_name, kind, file_path, round(sum(1 / (60.0::DOUBLE + r)), 9) AS score FROM ranked GROUP BY 1, 2, 3 ORDER BY score DESC, qualified_name LIMIT 20"""
    ),
)
_register(
    "cross_repo_search",
    lambda s, d: search.cross_repo_search(_by_repo(nodes(s, d), "file_path"), "gear", 40),
    graph_oracle(
        """, hit AS (
  SELECT split_part(file_path, '/', 1) AS repo_alias, qualified_name, kind, file_path, CASE WHEN lower(name) = 'gear' THEN 1 WHEN contains(lower(name), 'gear') THEN 0.85 ELSE 0.5 END AS s
  FROM nodes WHERE lower(name) LIKE '%gear%' OR lower(qualified_name) LIKE '%gear%' QUALIFY row_number() OVER (PARTITION BY repo_alias ORDER BY kind, qualified_name) <= 120
) SELECT repo_alias, qualified_name, kind, file_path, round(1 / (60.0::DOUBLE + row_number() OVER (PARTITION BY repo_alias ORDER BY s DESC, kind, qualified_name)), 9) AS score FROM hit ORDER BY score DESC, repo_alias, qualified_name LIMIT 40"""
    ),
)

# Texts ---------------------------------------------------------------------------------------


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).withColumn("mode", F.when(F.col("path").endswith(".py"), "full").otherwise("summary")).withColumn("summary", text.summarize("content", "path", 300))


_LINES = "SELECT path, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS nr FROM docs"
_register(
    "summarize_generic",
    lambda s, d: docs(s, d).filter("path LIKE '%.txt'").select("path", F.md5(text.summarize("content", "path", 10_000_000)).alias("summary_md5")),
    docs_oracle(
        f""", lines AS ({_LINES}) SELECT path, md5(coalesce(string_agg(norm || chr(10), '' ORDER BY nr) FILTER (norm <> '' AND nr <= 200), '')) AS summary_md5
FROM (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm FROM lines) WHERE path LIKE '%.txt' GROUP BY path"""
    ),
)
_register(
    "summarize_markdown",
    lambda s, d: docs(s, d).filter("path LIKE '%.md'").select("path", F.md5(text.summarize("content", "path", 10_000_000)).alias("summary_md5")),
    docs_oracle(
        f""", lines AS ({_LINES}), fenced AS (
  SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm, starts_with(line, '```') AS fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY path ORDER BY nr) % 2 AS inside FROM lines WHERE path LIKE '%.md'
) SELECT path, md5(coalesce(string_agg(norm || chr(10), '' ORDER BY nr) FILTER (NOT fence AND inside = 0 AND regexp_matches(norm, '^(#|- |\\* |1\\.)|Rule|Violation|MUST|must')), '')) AS summary_md5 FROM fenced GROUP BY path"""
    ),
)
_register(
    "prompt_budget",
    lambda s, d: text.prompt_blocks(docs(s, d).withColumn("mode", F.lit("full")).withColumn("summary", F.lit("")), "h" * 100, 200_000).select("path", F.md5("block").alias("block_md5"), "start"),
    docs_oracle(
        """, blocks AS (SELECT path, '### ' || path || chr(10) || content || chr(10) || chr(10) AS block FROM docs),
placed AS (SELECT *, strlen(block) AS n, 100 + coalesce(sum(strlen(block)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM blocks),
shown AS (SELECT *, start + n <= 200000 AS whole, lag(start + n <= 200000, 1, true) OVER (ORDER BY path) AS shown FROM placed)
SELECT path, md5(CASE WHEN whole THEN block ELSE (
  SELECT max_by(p, len(p)) FROM (SELECT substr(block, 1, k) AS p FROM range(0, len(block) + 1) AS r(k)) WHERE strlen(p) <= 200000 - start) || '...truncated...' || chr(10) END) AS block_md5, start FROM shown WHERE shown"""
    ),
)
_WORDS_AT: dict[tuple[str, str], WordIndex] = {}


def _word_index(s: SparkSession, d: str) -> WordIndex:
    """The stored postings of all documents' words, made once for a session."""
    at = (s.sparkContext.applicationId, d)
    if at not in _WORDS_AT:
        _WORDS_AT[at] = WordIndex.build(docs(s, d), fresh_dir(s, "words"))
    return _WORDS_AT[at]


_PREVIEW = docs_oracle(f""", lines AS ({_LINES}) SELECT path AS file_path, nr::BIGINT AS line, substr(trim(line), 1, 180) AS text FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])thon($|[^\\p{{L}}\\p{{N}}_])') ORDER BY 1, 2 LIMIT 100""")
_register("refactor_preview_by_postings", lambda s, d: _word_index(s, d).refactor_preview("thon", 100), _PREVIEW)
_register(
    "refactor_preview",
    lambda s, d: text.refactor_preview(docs(s, d), "thon", 100),
    docs_oracle(f""", lines AS ({_LINES}) SELECT path AS file_path, nr::BIGINT AS line, substr(trim(line), 1, 180) AS text FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])thon($|[^\\p{{L}}\\p{{N}}_])') ORDER BY 1, 2 LIMIT 100"""),
)
_register(
    "refactor_totals",
    lambda s, d: text.refactor_totals(docs(s, d), "thon", 100),
    docs_oracle(f""", lines AS ({_LINES}) SELECT least(count(*), 100) AS total_occurrences, count(DISTINCT path) AS files_touched FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])thon($|[^\\p{{L}}\\p{{N}}_])')"""),
)
_register(
    "refactor_apply",
    lambda s, d: text.apply_refactor(docs(s, d), "thon", "re$1named\\", 20).select("path", F.md5("new_content").alias("content_md5")),
    # twice, as neighbours share the character between them
    docs_oracle(
        """, renamed AS (SELECT path, content, regexp_replace(regexp_replace(content, '(^|[^\\p{L}\\p{N}_])thon($|[^\\p{L}\\p{N}_])', '\\1re$1named\\\\\\2', 'g'), '(^|[^\\p{L}\\p{N}_])thon($|[^\\p{L}\\p{N}_])', '\\1re$1named\\\\\\2', 'g') AS new FROM docs)
SELECT path, md5(new) AS content_md5 FROM renamed WHERE new <> content ORDER BY path LIMIT 20"""
    ),
)
_register(
    "query_symbol_by_postings",
    lambda s, d: _word_index(s, d).query_symbol("thon")[1],
    docs_oracle(
        f""", lines AS ({_LINES}) SELECT path AS file_path, nr::BIGINT AS line, trim(line) AS text, true AS external, false AS probable_test FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])thon($|[^\\p{{L}}\\p{{N}}_])')"""
    ),
)
_register(
    "query_symbol",
    lambda s, d: text.query_symbol(docs(s, d), "thon")[1],
    docs_oracle(
        f""", lines AS ({_LINES}) SELECT path AS file_path, nr::BIGINT AS line, trim(line) AS text, true AS external, false AS probable_test FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])thon($|[^\\p{{L}}\\p{{N}}_])')"""
    ),
)
_register(
    "symbol_totals",
    lambda s, d: text.symbol_totals(docs(s, d), "thon"),
    docs_oracle(f""", lines AS ({_LINES}) SELECT 0::BIGINT AS definitions, count(*) AS n_references, count(*) AS external_references, 0::BIGINT AS probable_tests FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])thon($|[^\\p{{L}}\\p{{N}}_])')"""),
)
_register(
    "path_functions",
    lambda s, d: docs(s, d).select("path", extension("path").alias("ext"), language_of("path").alias("symbol_language"), language_of("path", FILE_LANGUAGES, "unknown").alias("file_language"), page_name("path").alias("page"), without_quotes(F.concat(F.lit("'"), "path", F.lit('"'))).alias("bare")),
    docs_oracle("SELECT path, regexp_extract(path, '[.][a-z]+$') AS ext, CASE WHEN path LIKE '%.py' THEN 'python' END AS symbol_language, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'unknown' END AS file_language, regexp_replace(path, '[^A-Za-z0-9_-]', '-', 'g') AS page, path AS bare FROM docs"),
)

# Resolution, snapshots, streams --------------------------------------------------------------


def _specifiers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Imports between files as relative specifiers without their endings."""
    pairs = _imports(s, d)
    up = F.repeat(F.lit("../"), F.size(F.split("source", "/")) - 1)
    spec = F.concat(F.lit("./"), up, F.regexp_replace("target", r"\.ts$", ""))
    return pairs.select(F.col("source").alias("file_path"), spec.alias("specifier")), nodes(s, d).filter("kind = 'file'").select(F.col("file_path").alias("path"))


_register(
    "import_resolution",
    lambda s, d: resolve.resolve_imports(*_specifiers(s, d)),
    graph_oracle("SELECT file_path, './' || repeat('../', len(string_split(file_path, '/')) - 1) || regexp_replace(substr(target, 7), '[.]ts$', '') AS specifier, substr(target, 7) AS target FROM edges WHERE kind = 'imports_from'"),
)


def _references(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Calls by bare names, many of which several files define."""
    bare = F.regexp_replace(F.substring_index("target", "::", -1), r"_\d+$", "")
    calls = edges(s, d).filter("kind = 'calls'").select("kind", "source", bare.alias("target_name"), "file_path")
    symbols = nodes(s, d).filter("kind = 'function'").select(F.regexp_replace("name", r"_\d+$", "").alias("name"), "qualified_name", "file_path", F.lit(0).alias("ord"))
    return calls, symbols


_register(
    "symbol_resolution",
    lambda s, d: resolve.resolve_names(*_references(s, d)),
    graph_oracle(
        """, first AS (SELECT regexp_replace(name, '_[0-9]+$', '') AS name, arg_min(qualified_name, (file_path, qualified_name)) AS target FROM nodes WHERE kind = 'function' GROUP BY 1)
SELECT e.kind, e.source, first.target, e.file_path FROM edges e JOIN first ON first.name = regexp_replace(regexp_extract(e.target, '[^:]*$'), '_[0-9]+$', '') WHERE e.kind = 'calls'"""
    ),
)


def _sources(s: SparkSession, d: str) -> DataFrame:
    """The derived graph written out as source files (path, hash, content)."""
    bare = F.substring_index("target", "::", -1)
    e = edges(s, d)
    imported, _ = _specifiers(s, d)
    imports = imported.groupBy("file_path").agg(F.collect_list(F.concat(F.lit("import '"), "specifier", F.lit("';"))).alias("_imports"))
    called = e.filter("kind = 'calls'").groupBy(F.col("source").alias("qualified_name")).agg(F.collect_list(F.concat(F.lit("  "), bare, F.lit("(1);"))).alias("_calls"))
    body = F.concat(F.lit("export function "), "name", F.lit("(x) {\n"), F.coalesce(F.array_join("_calls", "\n"), F.lit("")), F.lit("\n}"))
    functions = nodes(s, d).filter("kind = 'function'").join(called, "qualified_name", "left").groupBy("file_path").agg(F.collect_list(body).alias("_functions"))
    bases = e.filter("kind = 'inherits'").select(F.col("source").alias("qualified_name"), F.concat(F.lit(" extends "), bare).alias("_base"))
    classes = nodes(s, d).filter("kind = 'class'").join(bases, "qualified_name", "left").select("file_path", F.concat(F.lit("export class "), "name", F.coalesce("_base", F.lit("")), F.lit(" {\n}")).alias("_class"))
    none = F.array().cast("array<string>")
    content = F.array_join(F.concat(F.coalesce("_imports", none), F.array("_class"), F.coalesce("_functions", none)), "\n")
    return classes.join(imports, "file_path", "left").join(functions, "file_path", "left").select(F.col("file_path").alias("path"), F.md5(content).alias("hash"), content.alias("content"))


_register("build_edges", lambda s, d: build.build(_sources(s, d))[1], graph_oracle("SELECT kind, source, target, file_path FROM edges"))
_register("build_nodes", lambda s, d: build.build(_sources(s, d))[0].select("kind", "name", "qualified_name", "file_path", "language"), graph_oracle("SELECT kind, name, qualified_name, file_path, language FROM nodes"))

#: Endings, and what declares a class {c} and a function {f}, of languages that symbols are told of.
_WRITTEN = {
    "python": (".py", "class {c}:\n    pass\n", "def {f}(x):\n    return x\n"),
    "rust": (".rs", "pub struct {c} {\n}\n", "fn {f}(x: i32) -> i32 {\n    x\n}\n"),
    "go": (".go", "type {c} struct {\n}\n", "func {f}(x int) int {\n    return x\n}\n"),
    "java": (".java", "class {c} {\n}\n", "class In{f} {\n    int {f}(int x) {\n        return x;\n    }\n}\n"),
    "c": (".c", "struct {c} {\n    int x;\n};\n", "int {f}(int x) {\n    return x;\n}\n"),
    "cpp": (".cpp", "class {c} {\n};\n", "int {f}(int x) {\n    return x;\n}\n"),
    "csharp": (".cs", "class {c} {\n}\n", "class In{f} {\n    int {f}(int x) {\n        return x;\n    }\n}\n"),
    "ruby": (".rb", "class {c}\nend\n", "def {f}(x)\n  x\nend\n"),
    "javascript": (".js", "export class {c} {\n}\n", "function {f}(x) {\n  return x;\n}\n"),
    "tsx": (".tsx", "export class {c} {\n}\n", "export const {f} = (x) => {\n  return x;\n};\n"),
}


def _many_languages(s: SparkSession, d: str) -> DataFrame:
    """The symbols of the derived graph written out as sources (path, content) of ten languages, by
    the length of a file's path."""
    n = nodes(s, d).filter("kind <> 'file'").withColumn("_at", F.length("file_path") % len(_WRITTEN))
    pick = lambda i: F.get(F.array(*(F.lit(w[i]) for w in _WRITTEN.values())), F.col("_at"))
    body = F.when(F.col("kind") == "class", F.replace(pick(1), F.lit("{c}"), F.col("name"))).otherwise(F.replace(pick(2), F.lit("{f}"), F.col("name")))
    told = n.select(F.concat(F.regexp_replace("file_path", "[.]ts$", ""), pick(0)).alias("path"), F.struct("kind", "name", body.alias("body")).alias("b"))
    return told.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["body"]), "\n").alias("content"))


def _in_language(i: int) -> str:
    return f"(ARRAY[{', '.join(repr(w[i]) for w in _WRITTEN.values())}])[length(file_path) % {len(_WRITTEN)} + 1]"


_register(
    "parse_ten_languages",
    lambda s, d: parse.parse_files(_many_languages(s, d)).filter("rec = 'symbol'").select("file_path", "kind", "name", "qualified_name", "container", "language"),
    graph_oracle(
        f""", written AS (
  SELECT kind, name, regexp_replace(file_path, '[.]ts$', '') || {_in_language(0)} AS path, (ARRAY[{', '.join(repr(w) for w in _WRITTEN)}])[length(file_path) % {len(_WRITTEN)} + 1] AS language FROM nodes WHERE kind <> 'file'
), told AS (
  SELECT kind, name, path, language, CASE WHEN kind = 'function' AND language IN ('java', 'csharp') THEN 'In' || name END AS outer_class FROM written
)
SELECT path AS file_path, kind, name, path || '::' || coalesce(outer_class || '.', '') || name AS qualified_name, CASE WHEN outer_class IS NULL THEN 'file::' || path ELSE path || '::' || outer_class END AS container, language FROM told
UNION ALL SELECT path, 'class', outer_class, path || '::' || outer_class, 'file::' || path, language FROM told WHERE outer_class IS NOT NULL"""
    ),
)
_UPDATED: dict[tuple[str, str], str] = {}


def _updated(s: SparkSession, d: str) -> CodeGraph:
    """A stored graph of older sources, of which some are absent, some others and some no more, brought
    up to date by its changes; made once for a session."""
    made = (s.sparkContext.applicationId, d)
    if made in _UPDATED:
        return CodeGraph.load(s, _UPDATED[made])
    now, at = durable(_sources(s, d)), fresh_dir(s, "graph")
    at_random = F.crc32("path") % 12
    old = now.filter(at_random != 0).withColumns({"content": F.when(at_random == 1, F.concat(F.lit("function old() {}\n"), F.split_part("content", F.lit("function"), F.lit(1)))).otherwise(F.col("content")), "hash": F.when(at_random == 1, "old").otherwise(F.col("hash"))})
    gone = now.filter(at_random == 2).withColumn("path", F.concat(F.lit("a/"), "path"))
    CodeGraph.refresh(conform(old.unionByName(gone), FILES), at)
    CodeGraph.refresh(conform(now, FILES), at)
    _UPDATED[made] = at
    return CodeGraph.load(s, at)


_register("build_update_edges", lambda s, d: _updated(s, d).edges.select("kind", "source", "target", "file_path"), graph_oracle("SELECT kind, source, target, file_path FROM edges"))
_register("build_update_nodes", lambda s, d: _updated(s, d).nodes.select("kind", "name", "qualified_name", "file_path", "language"), graph_oracle("SELECT kind, name, qualified_name, file_path, language FROM nodes"))
_register(
    "fallback_parse",
    lambda s, d: parse.fallback_symbols(_sources(s, d)).select("file_path", "kind", "name", "qualified_name", "container", "language"),
    graph_oracle("SELECT file_path, kind, name, qualified_name, 'file::' || file_path AS container, 'typescript' AS language FROM nodes WHERE kind <> 'file'"),
)
_register("fallback_imports", lambda s, d: parse.fallback_imports(_sources(s, d)), graph_oracle("SELECT file_path, './' || repeat('../', len(string_split(file_path, '/')) - 1) || regexp_replace(substr(target, 7), '[.]ts$', '') AS specifier FROM edges WHERE kind = 'imports_from'"))


def _listings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A listing before and after: some documents gone, some new, some touched, some changed."""
    base = docs(s, d).select("path", F.md5("content").alias("hash"), F.col("size").alias("size"), "doc_id")
    old = base.filter("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.md5("hash")).otherwise(F.col("hash")).alias("hash"), F.lit(1).cast("long").alias("mtime_ms"), "size", F.lit("full").alias("mode"))
    new = base.filter("doc_id % 11 <> 0").select("path", "hash", F.when(F.col("doc_id") % 5 <= 1, 2).otherwise(1).cast("long").alias("mtime_ms"), "size", F.lit("full").alias("mode"))
    return new, old


_register(
    "incremental_diff",
    lambda s, d: compare_listing(*_listings(s, d)),
    docs_oracle(
        """SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 5 = 0 THEN 'changed' WHEN doc_id % 5 = 1 THEN 'touched' ELSE 'same' END AS state
FROM docs WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0)"""
    ),
)
#: Documents that the rules in the tree of documents leave in it.
_LISTED = """, listed AS (
  SELECT * FROM docs WHERE NOT (source = 'src1' AND lang = 'de') AND CASE WHEN path LIKE '%21.md' THEN true WHEN path LIKE '%1.md' THEN false
    ELSE NOT (source = 'src0' AND path LIKE '%5.txt') AND NOT (source = 'src1' AND regexp_matches(path, '/doc_.7[.]py$')) END
)"""
_register(
    "repository_listing",
    lambda s, d: listing(s, derived.tree(s, d), ["**/*"], ["**/.git/**", "src2/**/*9.txt", "src3/fr/**"]).filter("path LIKE 'src%' AND extension IN ('.md', '.txt') AND size > 100").select("path", "extension", "size"),
    docs_oracle(_LISTED + "SELECT path, regexp_extract(path, '[.][a-z]+$') AS extension, strlen(content) AS size FROM listed WHERE NOT path LIKE '%.py' AND strlen(content) > 100 AND NOT (source = 'src2' AND path LIKE '%9.txt') AND NOT (source = 'src3' AND lang = 'fr')"),
)


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    """A snapshot of the tree of documents refreshed after some files are new, touched or changed."""
    root, config, at = derived.tree(s, d), SnapshotConfig(max_file_chars=300), fresh_dir(s, "snapshot")
    save_snapshot(refresh(list_files(s, root, config), None, config, root).drop("changed"), at)
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    old = load_snapshot(s, at).filter(number % 11 != 0).withColumns({"mtime_ms": F.col("mtime_ms") - F.when(number % 5 <= 1, 1).otherwise(0), "hash": F.when(number % 5 == 0, "other").otherwise(F.col("hash")), "summary": F.lit("kept")})
    return refresh(list_files(s, root, config), old, config, root).select("path", "hash", F.md5("content").alias("content_md5"), F.md5("summary").alias("summary_md5"), "changed")


_register(
    "snapshot_refresh",
    _refreshed,
    docs_oracle(
        _LISTED
        + """, lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS nr FROM listed
), normed AS (
  SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm, starts_with(line, '```') AS fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY path ORDER BY nr) % 2 AS inside FROM lines
), told AS (
  SELECT path, string_agg(norm || chr(10), '' ORDER BY nr) AS whole FROM normed WHERE CASE WHEN path LIKE '%.txt' THEN norm <> '' AND nr <= 200
    WHEN path LIKE '%.md' THEN NOT fence AND inside = 0 AND regexp_matches(norm, '^(#|- |\\* |1\\.)|Rule|Violation|MUST|must') ELSE regexp_matches(norm, '^(def |class |import |from |#)') END GROUP BY path
), cut AS (
  SELECT path, (SELECT max_by(p, len(p)) FROM (SELECT substr(whole, 1, k) AS p FROM range(0, 301) AS r(k)) WHERE strlen(p) <= 300) AS summary FROM told
)
SELECT path, sha256(content) AS hash, md5(content) AS content_md5, md5(CASE WHEN doc_id % 11 = 0 OR doc_id % 5 = 0 THEN coalesce(summary, '') ELSE 'kept' END) AS summary_md5, doc_id % 11 = 0 OR doc_id % 5 = 0 AS changed FROM listed LEFT JOIN cut USING (path)"""
    ),
)
_SESSIONS = """WITH marked AS (
  SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 700 MILLISECONDS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)
), numbered AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT event_type, min(ts) AS first_at, max(ts) + INTERVAL 700 MILLISECONDS AS fires_at, count(*) AS changes FROM numbered GROUP BY event_type, k"""
_register("debounce_sessions", lambda s, d: debounced(s.read.parquet(f"{d}/events.parquet"), "ts", "700 milliseconds", "event_type", touching=False), _SESSIONS)


def _streamed_bursts(s: SparkSession, d: str) -> DataFrame:
    """Bursts of the events as a stream: those that fired, and those that were open when it ended."""
    at = fresh_dir(s, "watch")
    # streams read folders
    s.read.parquet(f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("at")).write.parquet(f"{at}/events")
    # all files are one batch, so that none is late
    events = s.readStream.schema("event_type string, at timestamp").option("maxFilesPerTrigger", 1_000_000_000).parquet(f"{at}/events")
    fired = bursts(events, "event_type", touching=False)
    fired.writeStream.option("path", f"{at}/fired").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    both = s.read.schema(fired.schema).parquet(f"{at}/fired").unionByName(open_bursts(s, f"{at}/state"))
    return both.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "fires_at")})


_register("watch_bursts", _streamed_bursts, _SESSIONS)


def _parity(s: SparkSession, d: str) -> DataFrame:
    """Kinds and names of parts as commands, names and brands as tools."""
    parts = s.read.parquet(f"{d}/part.parquet")
    commands = parts.select(F.concat(F.lower("p_type"), F.lit("-the-"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("command")).distinct()
    tools = parts.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_of_"), F.lower(F.replace("p_brand", F.lit("#"))), F.lit("_"), F.lower("p_type")).alias("tool")).distinct()
    return parity.best_matches(commands, tools.withColumn("ord", F.reverse("tool")))


_register(
    "parity_match",
    _parity,
    """WITH c AS (SELECT DISTINCT lower(p_type) || '-the-' || replace(p_name, ' ', '-') AS command FROM part),
t AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_of_' || lower(replace(p_brand, '#', '')) || '_' || lower(p_type) AS tool FROM part),
w AS (SELECT command, list_distinct(string_split(command, '-')) AS cw FROM c), v AS (SELECT tool, reverse(tool) AS ord, list_distinct([x for x in string_split(tool, '_') if x NOT IN ('or','the','and','to','of','a','an')]) AS tw FROM t),
fit AS (SELECT command, tool, ord, len(list_intersect(cw, tw)) AS n FROM w, v WHERE len(list_intersect(cw, tw)) > 0 AND len(list_intersect(cw, tw)) >= 0.5 * least(len(cw), len(tw)))
SELECT c.command, b.tool FROM c LEFT JOIN (SELECT command, tool FROM fit QUALIFY row_number() OVER (PARTITION BY command ORDER BY n DESC, ord) = 1) b USING (command)""",
)
