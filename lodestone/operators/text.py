"""Texts assembled from, and searched in, a snapshot of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import collapsed, extension, lines_of, word_pattern
from lodestone.functions.scan import RANGE, carried, in_ranges, within_range

from .query import clamp

TRUNCATED = "...truncated...\n"
# What lines of a summary begin with or contain, by extension.
SUMMARY_RULES = {
    (".md", ".mdx"): (("#", "- ", "* ", "1."), ("Rule", "Violation", "MUST", "must")),
    (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"): (("import ", "export ", "// ", "/*", "type ", "const ", "async "), ("function ", "class ", "interface ")),
    (".py",): (("def ", "class ", "import ", "from ", "#"), ()),
    (".rs",): (("pub ", "fn ", "struct ", "enum ", "impl ", "trait ", "use ", "//"), ()),
}
GENERIC_LINES = 200


def cut_bytes(text: Column, most: Column) -> Column:
    """The longest beginning of a text of at most so many UTF-8 bytes."""
    # continuation bytes at the cut belong to a character that doesn't fit
    raw = F.substring(F.encode(text, "UTF-8"), F.lit(1), most.cast("int"))
    last = lambda n: F.conv(F.hex(F.substring(raw, F.length(raw) - (n - 1), F.lit(1))), 16, 10).cast("int")
    back = (
        F.when(F.octet_length(text) <= most, 0)
        .when((F.length(raw) >= 1) & (last(1) >= 0xC0), 1)
        .when((F.length(raw) >= 2) & (last(2) >= 0xE0), 2)
        .when((F.length(raw) >= 3) & (last(3) >= 0xF0), 3)
        .otherwise(0)
    )
    return F.decode(F.substring(raw, F.lit(1), F.length(raw) - back), "UTF-8")


def _summary(kept: Column, max_bytes: int) -> Column:
    """Lines up to the one that reaches the budget, cut to it."""
    return cut_bytes(F.concat_ws("", F.transform(kept, lambda x: F.concat(x, F.lit("\n")))), F.lit(max_bytes))


def _picked(lines: Column, begins: tuple[str, ...], contains: tuple[str, ...]) -> Column:
    def keep(line: Column) -> Column:
        tests = [line.startswith(b) for b in begins] + [line.contains(c) for c in contains]
        found = tests[0]
        for t in tests[1:]:
            found = found | t
        return found

    return F.filter(F.transform(lines, collapsed), keep)


def outside_fences(lines: Column) -> Column:
    """Lines of Markdown outside of fenced blocks."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, line: Column) -> Column:
        fence = line.startswith("```")
        kept = F.when(fence | state["inside"], state["kept"]).otherwise(F.concat(state["kept"], F.array(line)))
        return F.struct((state["inside"] != fence).alias("inside"), kept.alias("kept"))

    return F.aggregate(lines, start, step, lambda s: s["kept"])


def summarize(content: str | Column, path: str | Column, max_bytes: int = 4000) -> Column:
    """The most telling lines of a file by its extension, in at most max_bytes bytes."""
    lines, ext = lines_of(content), extension(path)
    first = F.filter(F.transform(F.slice(lines, 1, GENERIC_LINES), collapsed), lambda x: x != "")
    out = _summary(first, max_bytes)
    for extensions, (begins, contains) in SUMMARY_RULES.items():
        own = outside_fences(lines) if ".md" in extensions else lines
        out = F.when(ext.isin(*extensions), _summary(_picked(own, begins, contains), max_bytes)).otherwise(out)
    return out


def prompt_blocks(files: DataFrame, header: str, max_bytes: int) -> DataFrame:
    """(path, block, start): blocks that begin within the budget, in path order, the last one cut
    and marked if it doesn't fit. start: bytes before it.

    Only sizes are sorted, in ranges of paths over which the total is carried on; a block's text is
    taken for those that are shown. Paths are unique.
    """
    body = F.when(F.col("mode") == "full", F.coalesce("content", F.lit(""))).otherwise(F.coalesce("summary", F.lit("")))
    blocks = files.select("path", F.concat(F.lit("### "), "path", F.lit("\n"), body, F.lit("\n\n")).alias("block")).withColumn("_bytes", F.octet_length("block").cast("long"))
    first = len(header.encode())
    ranged = in_ranges(blocks.select("path", "_bytes"), "path")
    before, reaches = carried(ranged, F.sum("_bytes"), first, lambda now, own: now + own, "long")
    # ranges that begin beyond the budget show nothing
    near = ranged.filter(F.col(RANGE).isin([r for r, start in reaches.items() if start <= max(max_bytes, first)]))
    inside = F.coalesce(F.sum("_bytes").over(within_range("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = near.select("path", (before + inside).alias("start")).filter((F.col("start") <= max_bytes) | (F.col("start") == first))
    placed = blocks.join(shown, "path")
    whole = F.col("start") + F.col("_bytes") <= max_bytes
    left = F.greatest(F.lit(max_bytes) - F.col("start"), F.lit(0))
    cut = F.when(whole, F.col("block")).otherwise(F.concat(cut_bytes(F.col("block"), left), F.lit(TRUNCATED)))
    return placed.select("path", cut.alias("block"), "start")


def format_prompt(files: DataFrame, repo: str, updated_at: str, max_bytes: int = 64_000, title: str = "snapshot") -> DataFrame:
    """One row with the prompt: a header, whose first line is the title in brackets, and the blocks."""
    count = files.count()
    header = f"[{title}]\nrepo: {repo}\nupdatedAt: {updated_at}\nfiles: {count}\n\n"
    blocks = prompt_blocks(files, header, max_bytes)
    listed = blocks.agg(F.array_sort(F.collect_list(F.struct("start", "path", "block"))).alias("b"))
    return listed.select(F.concat(F.lit(header), F.array_join(F.transform("b", lambda b: b["block"]), "")).alias("prompt"))


def _numbered(files: DataFrame, keep_last: bool) -> DataFrame:
    lines = F.split("content", "\n") if keep_last else lines_of("content")
    return files.filter("content IS NOT NULL").select(F.col("path").alias("file_path"), F.posexplode(lines).alias("_at", "_line")).withColumn("line", (F.col("_at") + 1).cast("long")).drop("_at")


def symbol_lines(files: DataFrame, symbol: str) -> DataFrame:
    """(file_path, line, _line) of the lines that hold the symbol as a word."""
    return _numbered(files.filter("content <> ''"), True).filter(F.col("_line").rlike(word_pattern(symbol)))


def preview_of(found: DataFrame, limit: int = 100) -> DataFrame:
    """(file_path, line, text): the first of found lines, by path."""
    text = F.substring(F.regexp_replace("_line", r"(?U)^\s+|\s+$", ""), 1, 180)
    return found.select("file_path", "line", text.alias("text")).orderBy("file_path", "line").limit(clamp(limit, 1, 500))


def totals_of(found: DataFrame, limit: int = 100) -> DataFrame:
    """One row: occurrences, limited like the preview, and files touched, which aren't."""
    return found.agg(F.least(F.count("*"), F.lit(clamp(limit, 1, 500))).alias("total_occurrences"), F.countDistinct("file_path").alias("files_touched"))


def refactor_preview(files: DataFrame, symbol: str, limit: int = 100) -> DataFrame:
    """(file_path, line, text): the first lines, by path, that hold the symbol as a word."""
    return preview_of(_numbered(files, False).filter(F.col("_line").rlike(word_pattern(symbol))), limit)


def refactor_totals(files: DataFrame, symbol: str, limit: int = 100) -> DataFrame:
    """totals_of() lines that hold the symbol as a word."""
    return totals_of(_numbered(files, False).filter(F.col("_line").rlike(word_pattern(symbol))), limit)


def apply_refactor(files: DataFrame, symbol: str, new_name: str, max_files: int = 50) -> DataFrame:
    """(path, new_content) of the first files, by path, that change when the symbol is renamed. The
    new name is taken as it is. Nothing is written to the sources."""
    bound = rf"(?<![\p{{L}}\p{{N}}_])\Q{symbol}\E(?![\p{{L}}\p{{N}}_])"
    plain = new_name.replace("\\", "\\\\").replace("$", "\\$")
    renamed = files.filter("content IS NOT NULL").select("path", "content", F.regexp_replace("content", bound, plain).alias("new_content"))
    return renamed.filter("new_content <> content").select("path", "new_content").orderBy("path").limit(clamp(max_files, 1, 10_000))


def query_symbol(files: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """(definitions, references): (file_path, line, kind) and (file_path, line, text, external,
    probable_test). External references lie in files without a definition; probable tests are those
    in a test folder or file."""
    return symbol_of(symbol_lines(files, symbol), symbol)


def symbol_of(lines: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """query_symbol() of lines that hold the symbol."""
    name = rf"\Q{symbol}\E($|[^\p{{L}}\p{{N}}_])"
    kinds = {
        "function": rf"(^|[^\p{{L}}\p{{N}}_])function\s+{name}",
        "class": rf"(^|[^\p{{L}}\p{{N}}_])class\s+{name}",
        "type": rf"(^|[^\p{{L}}\p{{N}}_])(type|interface|enum)\s+{name}",
        "variable": rf"(^|[^\p{{L}}\p{{N}}_])(const|let|var)\s+{name}",
        "python-function": rf"^\s*def\s+{name}",
        "python-class": rf"^\s*class\s+{name}",
    }
    kind = F.coalesce(*(F.when(F.col("_line").rlike(p), k) for k, p in kinds.items()))
    definitions = lines.select("file_path", "line", kind.alias("kind")).filter("kind IS NOT NULL")
    inside = definitions.select("file_path").distinct().withColumn("_own", F.lit(True))
    test = F.col("external") & F.col("file_path").rlike(r"(?i)(^|/)(test|tests|__tests__)/|\.(spec|test)\.")
    references = lines.join(inside, "file_path", "left").select("file_path", "line", F.trim("_line").alias("text"), F.col("_own").isNull().alias("external")).withColumn("probable_test", test)
    return definitions, references


def symbol_totals(files: DataFrame, symbol: str) -> DataFrame:
    """One row: definitions, references, external references and probable test files."""
    definitions, references = query_symbol(files, symbol)
    counted = references.agg(F.count("*").alias("n_references"), F.count_if("external").alias("external_references"), F.countDistinct(F.when(F.col("probable_test"), F.col("file_path"))).alias("probable_tests"))
    return definitions.agg(F.count("*").alias("definitions")).join(counted)
