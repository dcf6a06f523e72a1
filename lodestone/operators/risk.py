"""Risk of changed files. All counts are made for all files at once and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import ascii_lower, in_test_path, path_of_symbol, test_stem
from lodestone.functions.scan import carried, in_ranges, within_range

from .traverse import impact_radius

# Words that mark a changed line as security-relevant.
SECURITY_WORDS = ("auth", "token", "password", "secret", "sql", "permission", "credential", "jwt")
WEIGHTS = {"callers": 1.5, "impacted_files": 0.8, "changed_lines": 0.3, "functions": 0.7, "security_hits": 1.3}
NO_TESTS, HIGH, MEDIUM = 4.0, 16.0, 8.0
SUGGESTED_TOOLS = ("query_graph callers_of <symbol>", "query_graph tests_for <symbol>", "detect_changes", "list_flows", "architecture_overview", "semantic_search")


def security_hits(diff_lines: DataFrame, words: tuple[str, ...] = SECURITY_WORDS, strict: bool = False) -> DataFrame:
    """(file_path, security_hits) of a unified diff's lines (ord, line): how many different words
    each changed line contains, added up by file.

    A file begins with its "+++ b/" line. By default lines of a deleted file count for the file
    before, and changed lines that begin with two more signs are skipped; `strict` mends the former.
    Lines are dealt into ranges of ord, over which the last file's name is carried on.
    """
    begins = F.when(F.col("line").startswith("+++ b/"), F.trim(F.substring("line", 7, 2**31 - 1)))
    if strict:
        begins = F.coalesce(begins, F.when(F.col("line").startswith("+++ "), F.lit("")))
    changed = F.col("line").rlike("^[+-]") & ~F.col("line").startswith("+++") & ~F.col("line").startswith("---")
    # lines of context say nothing
    told = diff_lines.select("ord", "line", begins.alias("_begins")).filter(changed | F.col("_begins").isNotNull())
    ranged = in_ranges(told, "ord")
    last = F.max_by("_begins", F.when(F.col("_begins").isNotNull(), F.col("ord")))
    before, _ = carried(ranged, last, None, lambda now, own: now if own is None else own, "string")
    file = F.coalesce(F.last("_begins", ignorenulls=True).over(within_range("ord").rowsBetween(Window.unboundedPreceding, 0)), before)
    return line_hits(ranged.withColumn("file_path", file).filter(changed & F.col("file_path").isNotNull() & (F.col("file_path") != "")), words)


def line_hits(lines: DataFrame, words: tuple[str, ...] = SECURITY_WORDS) -> DataFrame:
    """(file_path, security_hits) of lines (file_path, line); files without a hit are absent."""
    lowered = F.lower("line")
    hits = sum((lowered.contains(w).cast("long") for w in words[1:]), lowered.contains(words[0]).cast("long"))
    return lines.groupBy("file_path").agg(F.sum(hits).alias("security_hits")).filter("security_hits > 0")


def _grams(text: str) -> Column:
    """The different stretches of 1 to 3 characters of a text."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.filter(F.array_distinct(F.concat(of(1), of(2), of(3))), lambda g: g != "")


def containing(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, hits) of parts (file_path, _part): how many nodes (_name, _qname) have a part in their
    name or qualified name, added up over a file's parts; files without a hit are absent.

    A part meets the nodes that share the one of its longest stretches, of 3 characters at most, that
    fewest nodes have, and only those are compared: an equi-join, whatever the number of nodes. Stretches
    are many times the nodes, which no estimate of sizes sees, so nothing here may be broadcast by one.
    """
    wanted = parts.groupBy("file_path", "_part").agg(F.count("*").alias("_times"))
    held = nodes.withColumn("_gram", F.explode(F.array_union(_grams("_name"), _grams("_qname"))))
    own = wanted.select("_part").distinct().filter("_part <> ''").withColumn("_gram", F.explode(F.filter(_grams("_part"), lambda g: F.length(g) == F.least(F.length("_part"), F.lit(3)))))
    rare = own.join(held.groupBy("_gram").agg(F.count("*").alias("_n")).hint("merge"), "_gram").groupBy("_part").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    has = F.col("_name").contains(F.col("_part")) | F.col("_qname").contains(F.col("_part"))
    found = rare.join(held.hint("merge"), "_gram").filter(has).groupBy("_part").agg(F.count("*").alias("_n"))
    # whatever has no characters is in every name
    found = found.unionByName(nodes.agg(F.lit("").alias("_part"), F.count("*").alias("_n")))
    return wanted.join(found.hint("merge"), "_part").groupBy("file_path").agg(F.sum(F.col("_n") * F.col("_times")).alias("hits")).filter("hits > 0")


def linked_tests(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_path, linked): for a file's first 100 functions by name, how many nodes in test paths
    have each one's name in theirs."""
    place = Window.partitionBy("file_path").orderBy("qualified_name")
    names = nodes.filter("kind = 'function'").join(changed.select("file_path"), "file_path", "left_semi").withColumn("_at", F.row_number().over(place)).filter("_at <= 100").select("file_path", ascii_lower("name").alias("_part"))
    tests = nodes.filter(in_test_path("file_path")).select(ascii_lower("name").alias("_name"), ascii_lower("qualified_name").alias("_qname"))
    return containing(names, tests).withColumnRenamed("hits", "linked")


def change_risk(nodes: DataFrame, edges: DataFrame, changes: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """A row for each changed file (file_path, added, deleted): its counts, score and risk.

    impacted_files is that of all changes together, without the file itself. `hits` is from
    security_hits(). Sorted by impacted files, most first, then by path.
    """
    changed = changes.select("file_path", (F.col("added") + F.col("deleted")).alias("changed_lines"))
    callers = edges.filter("kind = 'calls'").groupBy(path_of_symbol("target").alias("file_path")).agg(F.count("*").alias("callers"))
    functions = nodes.filter("kind = 'function'").groupBy("file_path").agg(F.count("*").alias("functions"))
    stems = changed.select("file_path", ascii_lower(test_stem("file_path")).alias("_part"))
    tests = nodes.filter((F.col("kind") == "function") & in_test_path("file_path")).select(ascii_lower("name").alias("_name"), ascii_lower("qualified_name").alias("_qname"))
    test_hits = containing(stems, tests).withColumnRenamed("hits", "test_hits")
    impacted = impact_radius(edges, changed, 2)
    total = impacted.agg(F.count("*").alias("_all"))
    rows = changed.join(total).join(impacted.withColumn("_in", F.lit(1)), "file_path", "left")
    for counts in (callers, functions, test_hits, linked_tests(nodes, changed)) + (() if hits is None else (hits,)):
        rows = rows.join(counts, "file_path", "left")
    if hits is None:
        rows = rows.withColumn("security_hits", F.lit(0))
    rows = rows.withColumn("impacted_files", F.col("_all") - F.coalesce("_in", F.lit(0))).fillna(0, ["callers", "functions", "test_hits", "linked", "security_hits"])
    score = sum(F.col(c) * w for c, w in WEIGHTS.items()) + F.when((F.col("test_hits") == 0) & (F.col("linked") == 0), NO_TESTS).otherwise(0.0)
    rows = rows.withColumn("risk_score", score).withColumn("risk", F.when(F.col("risk_score") >= HIGH, "high").when(F.col("risk_score") >= MEDIUM, "medium").otherwise("low"))
    return rows.select("file_path", "impacted_files", "callers", "test_hits", "changed_lines", F.col("security_hits").cast("long").alias("security_hits"), F.round("risk_score", 6).alias("risk_score"), "risk").orderBy(F.desc("impacted_files"), "file_path")


def minimal_context(risks: DataFrame) -> DataFrame:
    """One row: the highest risk, numbers of changed and impacted files, the first five files."""
    rank = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    totals = risks.agg(F.count("*").alias("changed_files"), F.coalesce(F.sum("impacted_files"), F.lit(0)).alias("impacted_files"), F.max(rank).alias("_r"))
    first = risks.orderBy(F.desc("impacted_files"), "file_path").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("impacted_files")).alias("i"), "file_path", "risk"))).alias("_t"))
    top = F.when(F.size("_t") == 0, F.array(F.lit("No changed files detected"))).otherwise(F.transform("_t", lambda t: F.format_string("%s (%s)", t["file_path"], t["risk"])))
    risk = F.when(F.col("_r") == 2, "high").when(F.col("_r") == 1, "medium").otherwise("low")
    return totals.join(first).select(risk.alias("risk"), "changed_files", "impacted_files", top.alias("top_files"), F.array(*map(F.lit, SUGGESTED_TOOLS)).alias("suggested_tools"))
