"""Column helpers: identifiers, patterns, paths, languages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Language by path suffix, for symbols.
SYMBOL_LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts",),
    "tsx": (".tsx",),
    "python": (".py",),
    "rust": (".rs",),
    "go": (".go",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh"),
    "ruby": (".rb",),
    "kotlin": (".kt", ".kts"),
    "scala": (".scala",),
    "swift": (".swift",),
    "solidity": (".sol",),
    "dart": (".dart",),
    "r": (".r",),
    "perl": (".pl", ".pm", ".t", ".xs"),
    "vue": (".vue",),
    "notebook": (".ipynb",),
    "bash": (".sh", ".bash", ".zsh"),
    "php": (".php",),
    "csharp": (".cs",),
    "lua": (".lua",),
}
#: Languages that file nodes are labelled with; all others are unknown there. `.hh` isn't among them.
FILE_LANGUAGES = {k: tuple(s for s in SYMBOL_LANGUAGES[k] if s != ".hh") for k in ("python", "rust", "go", "java", "typescript", "tsx", "javascript", "c", "cpp", "csharp", "ruby", "php", "lua")}


def ascii_lower(of: str | Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(F.col(of) if isinstance(of, str) else of, _UPPER, _LOWER)


def like(of: str | Column, pattern: str) -> Column:
    """LIKE that ignores the case of A-Z; % and _ are wildcards and nothing escapes them."""
    folded, column = pattern.translate(str.maketrans(_UPPER, _LOWER)), ascii_lower(of)
    inner = folded.strip("%")
    if "%" not in inner and "_" not in inner:
        if folded == f"%{inner}%" and inner:
            return column.contains(inner)
        if folded == f"{inner}%":
            return column.startswith(inner)
        if folded == inner:
            return column == inner
    return column.rlike("(?s)^" + "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in folded) + "\\z")


def like_column(of: Column, pattern: Column) -> Column:
    """like() for a pattern from a column."""
    escaped = F.regexp_replace(ascii_lower(pattern), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    regex = F.replace(F.replace(escaped, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit("."))
    return F.regexp_like(ascii_lower(of), F.concat(F.lit("(?s)^"), regex, F.lit("\\z")))


def file_of(node: str | Column) -> Column:
    """The path of a file or symbol node; null for anything else."""
    q = F.col(node) if isinstance(node, str) else node
    return F.when(q.startswith("file::"), F.substring(q, 7, 2**31 - 1)).when(q.contains("::"), F.substring_index(q, "::", 1))


def path_of_symbol(node: str | Column) -> Column:
    """What stands before the first double colon; null without one."""
    q = F.col(node) if isinstance(node, str) else node
    return F.when(q.contains("::"), F.substring_index(q, "::", 1))


def top_segment(path: str | Column) -> Column:
    """The first part of a path; a file at the root is its own."""
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", 1)


def test_stem(path: str | Column) -> Column:
    """The file's name up to its first dot, without - and _."""
    name = F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)
    return F.translate(F.substring_index(name, ".", 1), "-_", "")


def in_test_path(path: str | Column) -> Column:
    return like(path, "%test%") | like(path, "%.spec.%")


def word_pattern(symbol: str) -> str:
    """A regex for a symbol that no letter, digit or underscore adjoins; alike in Java and RE2."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(symbol)}($|[^\p{{L}}\p{{N}}_])"


def language_of(path: str | Column, table: dict[str, tuple[str, ...]] = SYMBOL_LANGUAGES, other: str | None = None) -> Column:
    """The language by the longest suffix that the lower-cased path ends with."""
    lowered = ascii_lower(path)
    pairs = sorted(((s, name) for name, suffixes in table.items() for s in suffixes), key=lambda x: len(x[0]))
    return reduce(lambda rest, x: F.when(lowered.endswith(x[0]), F.lit(x[1])).otherwise(rest), pairs, F.lit(other))


def extension(path: str | Column) -> Column:
    """The lower-cased extension with its dot; empty without one."""
    name = F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def glob_regex(pattern: str) -> str | None:
    """A regex for a glob: ** crosses folders, * and ? don't stop at them either unless alone in a
    part; None for a broken pattern."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            before, after = i == 0 or pattern[i - 1] == "/", pattern[i + 2 : i + 3]
            if not before or after not in ("", "/"):
                return None
            out += "(?:.*/)?" if after else ".*"
            i += 3 if after else 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}\\z"


def matches_any_glob(path: str | Column, patterns: list[str]) -> Column:
    found = [r for p in patterns if (r := glob_regex(p)) is not None]
    column = F.col(path) if isinstance(path, str) else path
    return reduce(lambda a, r: a | column.rlike(r), found, F.lit(False))


def lines_of(text: str | Column) -> Column:
    """Lines as an array: a final line break starts no line, and \\r before \\n goes."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # without a final line break the last piece is a line of its own
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n"))


def collapsed(line: str | Column) -> Column:
    """White space runs as one space, none at the ends."""
    c = F.col(line) if isinstance(line, str) else line
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def page_name(name: str | Column) -> Column:
    """A file name for a wiki page: other characters than letters, digits, - and _ become -."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]", "-"), "^-+|-+$", "")


def first_quoted(text: str | Column) -> Column:
    """What the first quote opens, up to the same quote; null if it is never closed."""
    c = F.col(text) if isinstance(text, str) else text
    first = F.regexp_extract(c, "(?s)^[^'\"]*(['\"])", 1)
    rest = F.substring(c, F.length(F.regexp_extract(c, "(?s)^([^'\"]*)", 1)) + 2, F.length(c))
    return F.when((first != "") & rest.contains(first), F.split_part(rest, first, F.lit(1)))


def without_quotes(text: str | Column) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, "^['\"]|['\"]$", "")


def posix(path: str | Column) -> Column:
    return F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
