"""Imports and names resolved to files and symbols by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import FILE_LANGUAGES, language_of, posix

# Names that aren't calls, and endings tried for relative imports, in order.
CALL_NOISE = ("if", "for", "while", "switch", "catch", "return", "new", "typeof", "await", "console")
RELATIVE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rs", ".go", ".java", ".c", ".h", ".cpp", ".hpp", "/index.ts", "/index.tsx", "/index.js", "/index.py", "/index.rs")
SNAPSHOT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs", "/__init__.py")


#: What stands before and after the base of an import by how it is written, best first; how relative ones end is given.
MODULE_ENDINGS = {
    "python": (("", ".py"), ("", "/__init__.py")),
    "rust": (("src/", ".rs"), ("src/", "/mod.rs"), ("", ".rs")),
    "java": (("", ".java"), ("src/main/java/", ".java")),
    "go": (("", ".go"), ("", "/main.go"), ("", "/index.go")),
}


def joined_path(from_file: Column, specifier: Column) -> Column:
    """A relative specifier from a file's folder, with . and .. taken out; .. at the top does nothing."""
    folder = F.slice(F.split(from_file, "/"), F.lit(1), F.size(F.split(from_file, "/")) - 1)
    parts = F.filter(F.split(specifier, "/"), lambda p: (p != "") & (p != "."))
    up = lambda at, p: F.when(p == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(p)))
    return F.array_join(F.aggregate(parts, folder, up), "/")


def import_base(from_file: Column, specifier: Column, modules: bool = True) -> Column:
    """(how, base): what all paths that an import may mean have in common; null if it can't be resolved.

    Leading dots of a Python import go up that many folders less one.
    """
    language = language_of(from_file, FILE_LANGUAGES, "unknown")
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    dotted = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.substring(specifier, dots + 1, F.length(specifier)), F.lit("."), F.lit("/")))
    slashed = F.replace(specifier, F.lit("."), F.lit("/"))
    tail = F.replace(F.regexp_replace(specifier, r"^(crate::)+", ""), F.lit("::"), F.lit("/"))
    of = lambda how, base: F.struct(F.lit(how).alias("how"), base.alias("base"))
    relative = specifier.startswith(".")
    if not modules:
        return F.when(relative, of("relative", joined_path(from_file, specifier)))
    out = F.when(relative & ~specifier.contains("/") & (language == "python"), of("python", joined_path(from_file, dotted)))
    out = out.when(relative, of("relative", joined_path(from_file, specifier)))
    return out.when(language == "python", of("python", slashed)).when(language == "rust", of("rust", tail)).when(language == "java", of("java", slashed)).when(language == "go", of("go", specifier))


def import_candidates(base: Column, relative: tuple[str, ...] = RELATIVE_ENDINGS) -> Column:
    """The paths that an import of an import_base() may mean, best first; empty without one."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for how, ends in {"relative": [("", e) for e in relative], **MODULE_ENDINGS}.items():
        out = out.when(base["how"] == how, F.array(*(F.concat(F.lit(before), base["base"], F.lit(after)) for before, after in ends)))
    return out.otherwise(F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, files: DataFrame, relative: tuple[str, ...] = RELATIVE_ENDINGS, modules: bool = True) -> DataFrame:
    """(file_path, specifier, target) of imports (file_path, specifier): the first candidate that is
    a known file (path); unresolved imports are absent, repeated ones stay.

    Files are looked up once for all imports with one base.
    """
    based = imports.withColumn("_base", import_base(posix("file_path"), F.col("specifier"), modules))
    bases = based.select("_base").distinct()
    tried = bases.select("_base", F.posexplode(import_candidates(F.col("_base"), relative)).alias("_at", "target"))
    known = files.select(posix("path").alias("target")).distinct()
    best = tried.join(known, "target").groupBy("_base").agg(F.min_by("target", "_at").alias("target"))
    return based.join(best, "_base").drop("_base")


def first_symbols(symbols: DataFrame) -> DataFrame:
    """(name, qualified_name): for each name the first symbol by path and place in its file."""
    first = F.min(F.struct("file_path", "ord", "qualified_name")).alias("_first")
    return symbols.groupBy("name").agg(first).select("name", "_first.qualified_name")


def resolve_names(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (kind, source, target_name, file_path) as edges to the first symbol of the name;
    what names no symbol is dropped, and so is noise among calls."""
    used = references.filter(~((F.col("kind") == "calls") & F.col("target_name").isin(*CALL_NOISE)))
    named = first_symbols(symbols).withColumnRenamed("name", "target_name")
    return used.join(named, "target_name").select("kind", "source", F.col("qualified_name").alias("target"), "file_path")
