"""Symbols, imports, inheritance and calls of source files.

parse_files() is a map over files: Python sources go through the standard parser, languages with
braces and those with `end` through a scanner of tokens, and what yields neither symbols nor imports
through patterns. fallback_facts() is the pattern parser as plain DataFrame functions.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cluster import ship
from lodestone.functions.columns import SYMBOL_LANGUAGES, language_of

FACTS = "file_path string, rec string, ord int, kind string, name string, qualified_name string, container string, source string, target_name string, line_start long, line_end long, language string"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in FACTS.split(", ")])

# The pattern parser.
FUNCTION_PATTERN = (
    r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)|^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>|^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)|^\s*fn\s+([A-Za-z_][A-Za-z0-9_]*)"
)
CLASS_PATTERN = r"(?m)^\s*(?:export\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)|^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)|^\s*struct\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT_PATTERN = r"""(?m)import\s+(?:[^'"]+\s+from\s+)?['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)|^\s*use\s+([^;\n]+);"""
SNAPSHOT_IMPORTS = (r"""import\s+(?:[^'"]+\s+from\s+)?['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)""", r"""from\s+['"]([^'"]+)['"]""")

#: What a language declares classes and functions with, and what ends a block.
_CLASS_WORDS = {
    "javascript": {"class"}, "typescript": {"class"}, "tsx": {"class"}, "rust": {"struct", "trait", "impl"}, "go": {"type"}, "java": {"class", "interface"},
    "c": {"struct"}, "cpp": {"struct", "class"}, "csharp": {"class", "interface", "struct"}, "ruby": {"class", "module"},
}
_FUNCTION_WORDS = {"javascript": {"function"}, "typescript": {"function"}, "tsx": {"function"}, "rust": {"fn"}, "go": {"func"}, "ruby": {"def"}}
_TYPED = {"java", "c", "cpp", "csharp"}
_SCRIPT = {"javascript", "typescript", "tsx"}
_NOT_NAMES = set("if for while switch catch return new typeof await else do try finally throw match loop case in of sizeof using lock foreach unless until elsif yield super this function fn func def".split())
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|=>|::|->|\n|[^\s\w]|\d\w*", re.S)
_RUBY_TOKEN = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_@$][\w?!]*|\n|::|[^\s\w]|\d\w*")


def language_name(path: str) -> str | None:
    lowered = path.lower()
    found = [(len(s), name) for name, suffixes in SYMBOL_LANGUAGES.items() for s in suffixes if lowered.endswith(s)]
    return max(found)[1] if found else None


def normalize_source(path: str, content: str) -> tuple[str, str | None]:
    """(source, language): script blocks of Vue files, code cells of notebooks, Python without the
    marks of notebook cells; all else as it is."""
    lowered = path.lower()
    if lowered.endswith(".vue"):
        blocks = re.findall(r"<script[^>]*>(.*?)</script>", content, re.S)
        if not blocks:
            return content, "vue"
        return "".join(b + "\n" for b in blocks), "typescript" if re.search(r"lang=[\"']ts[\"']", content) else "javascript"
    if lowered.endswith(".ipynb"):
        return _notebook(content)
    if lowered.endswith(".py") and "# COMMAND ----------" in content:
        return content.replace("# COMMAND ----------", "\n"), "python"
    return content, language_name(path)


def _notebook(content: str) -> tuple[str, str]:
    names = {"python": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "r": "r", "scala": "scala", "sql": "notebook"}
    try:
        book = json.loads(content)
    except ValueError:
        return content, "notebook"
    book = book if isinstance(book, dict) else {}
    part = lambda d, *keys: part(d.get(keys[0]), *keys[1:]) if keys and isinstance(d, dict) else None if keys else d
    language = names.get(str(part(book, "metadata", "language_info", "name")).lower())
    out = []
    for cell in book.get("cells") or []:
        if part(cell, "cell_type") != "code":
            continue
        source = cell.get("source")
        out.append("".join(s for s in source if isinstance(s, str)) if isinstance(source, list) else source if isinstance(source, str) else "")
        language = language or names.get(str(part(cell, "metadata", "language")).lower())
    return "".join(s + "\n" for s in out), language or "notebook"


class _Facts:
    def __init__(self, path: str, language: str | None):
        self.path, self.language, self.rows, self.imports = path, language or "unknown", [], set()

    def _add(self, rec: str, **values: object) -> None:
        self.rows.append({"file_path": self.path, "rec": rec, "ord": len(self.rows), **values})

    def symbol(self, kind: str, name: str, cls: str | None, start: int, end: int) -> dict:
        own = f"{self.path}::{cls}.{name}" if cls else f"{self.path}::{name}"
        container = f"{self.path}::{cls}" if cls else f"file::{self.path}"
        self._add("symbol", kind=kind, name=name, qualified_name=own, container=container, line_start=start, line_end=end, language=self.language)
        return self.rows[-1]

    def import_(self, target: str) -> None:
        if target and target not in self.imports:
            self.imports.add(target)
            self._add("import", target_name=target)

    def reference(self, kind: str, source: str, target: str) -> None:
        self._add("reference", kind=kind, source=source, target_name=target)


def _parse_python(source: str, facts: _Facts) -> None:
    def name_of(node: ast.expr) -> str | None:
        return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None

    def walk(node: ast.AST, cls: str | None, function: str | None) -> None:
        if isinstance(node, ast.ClassDef):
            own = facts.symbol("class", node.name, None, node.lineno, node.end_lineno or node.lineno)
            for base in filter(None, map(name_of, node.bases)):
                facts.reference("inherits", own["qualified_name"], base)
            cls = node.name
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            own = facts.symbol("function", node.name, cls, node.lineno, node.end_lineno or node.lineno)
            function = own["qualified_name"]
        elif isinstance(node, ast.Import):
            for alias in node.names[:1]:
                facts.import_(alias.name)
        elif isinstance(node, ast.ImportFrom):
            facts.import_("." * node.level + (node.module or ""))
        elif isinstance(node, ast.Call) and function and (called := name_of(node.func)):
            facts.reference("calls", function, called)
        for child in ast.iter_child_nodes(node):
            walk(child, cls, function)

    walk(ast.parse(source), None, None)


class _Scanner:
    """One pass over tokens with a stack of open blocks."""

    def __init__(self, source: str, language: str, facts: _Facts):
        self.language, self.facts = language, facts
        self.tokens: list[tuple[str, int]] = []
        line = 1
        for m in (_RUBY_TOKEN if language == "ruby" else _TOKEN).finditer(source):
            text = m[0]
            if not text.startswith(("//", "/*")) and not (language == "ruby" and text.startswith("#")):
                self.tokens.append((text, line))
            line += text.count("\n")
        self.last_line = line
        #: (class, function's qualified name, symbol whose end is open)
        self.stack: list[tuple[str | None, str | None, dict | None]] = [(None, None, None)]
        self.opens: tuple[str | None, str | None, dict | None] | None = None

    def at(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def next(self, i: int) -> int:
        i += 1
        while self.at(i) == "\n":
            i += 1
        return i

    def before(self, i: int) -> str:
        i -= 1
        while i >= 0 and self.at(i) == "\n":
            i -= 1
        return self.at(i)

    def closing(self, i: int) -> int:
        """The place of the parenthesis that closes the one at i."""
        depth = 0
        while i < len(self.tokens):
            depth += {"(": 1, ")": -1}.get(self.at(i), 0)
            if not depth:
                return i
            i += 1
        return i

    def is_name(self, text: str) -> bool:
        return bool(re.match(r"[A-Za-z_$@]", text)) and text not in _NOT_NAMES

    def run(self) -> None:
        i = 0
        while i < len(self.tokens):
            i = (self.step_ruby if self.language == "ruby" else self.step)(i)
        for _, _, symbol in self.stack[1:]:
            if symbol is not None:
                symbol["line_end"] = self.last_line

    def class_(self, name: str, line: int, bases: list[str]) -> None:
        symbol = self.facts.symbol("class", name, None, line, line)
        for base in bases:
            self.facts.reference("inherits", symbol["qualified_name"], base)
        self.opens = (name, self.stack[-1][1], symbol)

    def function(self, name: str, line: int, cls: str | None) -> None:
        symbol = self.facts.symbol("function", name, cls, line, line)
        self.opens = (cls, symbol["qualified_name"], symbol)

    def push(self) -> None:
        self.stack.append(self.opens or (*self.stack[-1][:2], None))
        self.opens = None

    def pop(self, line: int) -> None:
        if len(self.stack) > 1:
            symbol = self.stack.pop()[2]
            if symbol is not None:
                symbol["line_end"] = line

    def step(self, i: int) -> int:
        text, line = self.tokens[i]
        lang, cls, function = self.language, *self.stack[-1][:2]
        if text == "{":
            self.push()
        elif text == "}":
            self.pop(line)
        elif text == ";":
            self.opens = None
        elif text in _CLASS_WORDS.get(lang, ()) and self.before(i) not in (".", "->"):
            return self.declared_class(i)
        elif text in _FUNCTION_WORDS.get(lang, ()):
            return self.declared_function(i)
        elif self.imported(i):
            return self.next(i)
        elif lang in _SCRIPT and text in ("const", "let", "var") and self.is_name(self.at(self.next(i))):
            return self.assigned(i)
        elif self.is_name(text) and (self.at(self.next(i)) == "(" or lang == "rust" and self.at(i + 1) == "!" and self.at(i + 2) in "([{"):
            return self.applied(i)
        return i + 1

    def declared_class(self, i: int) -> int:
        line, j = self.tokens[i][1], self.next(i)
        if self.language == "rust" and self.at(i) == "impl":
            names, depth = [], 0
            while self.at(j) not in ("{", ";", ""):
                depth += {"<": 1, ">": -1}.get(self.at(j), 0)
                if not depth and self.is_name(self.at(j)):
                    names.append(self.at(j))
                j += 1
            cut = names.index("where") if "where" in names else len(names)
            names = names[:cut]
            own = names[names.index("for") + 1 :] if "for" in names else names
            if own:
                self.class_(own[-1], line, [])
            return j
        name = self.at(j)
        if not self.is_name(name):
            return i + 1
        bases, k, listing = [], j + 1, False
        while self.at(k) not in ("{", ";", "", "(", "=", ")") and not (self.language == "go" and self.at(k) == "\n"):
            t = self.at(k)
            if t in ("extends", "implements", ":"):
                listing = True
            elif listing and self.is_name(t) and t not in ("public", "private", "protected", "virtual") and self.at(k + 1) not in (".", "::"):
                bases.append(t)
            k += 1
        if self.language in ("c", "cpp") and self.at(k) != "{":
            return j + 1
        self.class_(name, line, bases if self.language != "go" else [])
        return k

    def declared_function(self, i: int) -> int:
        line, j, cls = self.tokens[i][1], self.next(i), self.stack[-1][0]
        if self.language == "go" and self.at(j) == "(":
            j = self.next(self.closing(j))
        if self.at(j) == "*":
            j = self.next(j)
        if not self.is_name(self.at(j)):
            return i + 1
        self.function(self.at(j), line, cls)
        k = j + 1
        while self.at(k) not in ("(", "{", ""):
            k += 1
        return self.closing(k) + 1 if self.at(k) == "(" else k

    def assigned(self, i: int) -> int:
        j = self.next(i)
        k = self.next(j)
        while self.at(k) not in ("=", ";", "\n", ""):
            k += 1
        if self.at(k) != "=":
            return j + 1
        k = self.next(k)
        if self.at(k) == "async":
            k = self.next(k)
        body = self.next(self.closing(k)) if self.at(k) == "(" else self.next(k)
        if self.at(k) == "(":
            while self.at(body) not in ("=>", ";", "\n", "{", ""):
                body += 1
        if self.at(body) == "=>" and (self.at(k) == "(" or self.is_name(self.at(k))) or self.at(k) == "function":
            symbol = self.facts.symbol("function", self.at(j), self.stack[-1][0], self.tokens[j][1], self.tokens[min(body, len(self.tokens) - 1)][1])
            if self.at(k) == "function":
                while self.at(body) not in ("{", ""):
                    body += 1
                body -= 1
            if self.at(self.next(body)) == "{":
                self.opens = (self.stack[-1][0], symbol["qualified_name"], symbol)
            return body + 1
        return k

    def applied(self, i: int) -> int:
        text, line = self.tokens[i]
        cls, function = self.stack[-1][:2]
        j = self.next(i)
        if self.at(j) == "(":
            end = self.next(self.closing(j))
            while self.language in ("java", "csharp", "cpp") and self.is_name(self.at(end)) and self.at(end) in ("throws", "const", "override", "noexcept", "where", "final"):
                end = self.next(end)
                while self.is_name(self.at(end)) or self.at(end) == ",":
                    end = self.next(end)
            before = self.before(i)
            typed = self.language in _TYPED and self.at(end) == "{" and (self.is_name(before) or before in ("*", "&", ">", "]", "~", "::") or text == cls)
            method = self.language in _SCRIPT and cls is not None and self.stack[-1][1] is None and before not in (".", "new", "=", "(", ",")
            if method:
                k = end
                while self.at(k) not in ("{", ";", "}", "", "=") and method:
                    k += 1
                method = self.at(k) == "{"
            if (typed or method) and not (typed and before in ("new", "return")):
                self.function(text, line, cls)
                return end
        if function is not None:
            self.facts.reference("calls", function, text)
        return i + 1

    def imported(self, i: int) -> bool:
        text, lang = self.at(i), self.language
        quoted = lambda t: t[1:-1] if t[:1] in "'\"" and len(t) > 1 else None

        def up_to(ends: str) -> str:
            j, parts = i + 1, []
            while self.at(j) not in ends and self.at(j):
                parts.append(self.at(j))
                j += 1
            return "".join(" " + p if parts and re.match(r"\w", p) and k and re.match(r"\w", parts[k - 1]) else p for k, p in enumerate(parts)).strip()

        if lang in _SCRIPT and text in ("import", "from") and self.before(i) != ".":
            if (target := quoted(self.at(self.next(i)))) is not None:
                self.facts.import_(target)
                return True
        elif lang in _SCRIPT and text == "require" and self.at(i + 1) == "(" and (target := quoted(self.at(i + 2))) is not None:
            self.facts.import_(target)
        elif lang == "rust" and text == "use" or lang == "java" and text == "import" or lang == "csharp" and text == "using" and self.at(i + 1) != "(":
            self.facts.import_(up_to(";").replace("\n", ""))
            return True
        elif lang == "go" and text == "import":
            j = self.next(i)
            stop = self.closing(j) if self.at(j) == "(" else j + 1
            for k in range(j, stop):
                if (target := quoted(self.at(k))) is not None:
                    self.facts.import_(target)
            return True
        elif lang in ("c", "cpp") and text == "include" and self.at(i - 1) == "#":
            self.facts.import_(quoted(self.at(i + 1)) or up_to("\n").strip("<>"))
            return True
        return False

    def step_ruby(self, i: int) -> int:
        text, line = self.tokens[i]
        begins = self.at(i - 1) in ("\n", "", ";") or i == 0
        if text in ("class", "module") and begins and self.is_name(self.at(i + 1)):
            j, bases = i + 2, []
            if self.at(j) == "<" and self.is_name(self.at(j + 1)):
                bases.append(self.at(j + 1))
            self.class_(self.at(i + 1), line, bases)
            self.push()
            return j
        if text == "def":
            j = i + 1
            while self.at(j + 1) == ".":
                j += 2
            self.function(self.at(j), line, self.stack[-1][0])
            self.push()
            return j + 1
        if text == "do" or text in ("if", "unless", "while", "until", "case", "begin", "for") and begins:
            self.push()
        elif text == "end" and self.at(i - 1) != ".":
            self.pop(line)
        elif text in ("require", "require_relative") and begins:
            j = i + 1 + (self.at(i + 1) == "(")
            if self.at(j)[:1] in "'\"":
                self.facts.import_(self.at(j)[1:-1])
        elif self.stack[-1][1] and (self.is_name(text) and self.at(i + 1) == "(" or self.at(i - 1) == "." and text[0].isalpha()):
            self.facts.reference("calls", self.stack[-1][1], text)
        return i + 1


def _first_group(m: re.Match) -> str | None:
    return next((g for g in m.groups() if g is not None), None)


def _parse_by_pattern(source: str, facts: _Facts) -> None:
    for kind, pattern in (("function", FUNCTION_PATTERN), ("class", CLASS_PATTERN)):
        for m in re.finditer(pattern, source):
            facts.symbol(kind, _first_group(m), None, 1, 1)
    for m in re.finditer(IMPORT_PATTERN, source):
        facts.import_(_first_group(m).strip())


def parse_source(path: str, content: str) -> list[dict]:
    """The facts of one file; a file that can't be parsed has what the patterns find."""
    source, language = normalize_source(path, content)
    facts = _Facts(path, language)
    try:
        if language == "python":
            _parse_python(source, facts)
        elif language in _CLASS_WORDS:
            _Scanner(source, language, facts).run()
    except (SyntaxError, ValueError, RecursionError):
        facts = _Facts(path, language)
    if not any(r["rec"] in ("symbol", "import") for r in facts.rows):
        facts = _Facts(path, language_name(path))
        _parse_by_pattern(content, facts)
    return facts.rows


def parse_files(files: DataFrame) -> DataFrame:
    """Facts of all files (path, content); files without content have none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if rows := parse_source(path.replace("\\", "/"), content):
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    ship(files.sparkSession)
    return files.filter("content IS NOT NULL").select("path", "content").mapInArrow(parse, FACTS)


def _named(text: Column, pattern: str, groups: int) -> Column:
    """The matches' groups, of which each match has one."""
    each = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)))
    return F.transform(each, lambda m: F.concat(*(F.coalesce(m[f"g{g}"], F.lit("")) for g in range(1, groups + 1))))


def fallback_symbols(files: DataFrame) -> DataFrame:
    """(file_path, kind, name, qualified_name, container, language, ord) by patterns alone, in the JVM."""
    both = F.concat(
        F.transform(_named(F.col("content"), FUNCTION_PATTERN, 4), lambda n: F.struct(F.lit("function").alias("kind"), n.alias("name"))),
        F.transform(_named(F.col("content"), CLASS_PATTERN, 3), lambda n: F.struct(F.lit("class").alias("kind"), n.alias("name"))),
    )
    path = F.col("path")
    return files.filter("content IS NOT NULL").select(path.alias("file_path"), F.posexplode(both).alias("ord", "s")).select(
        "file_path", "s.kind", "s.name", F.concat("file_path", F.lit("::"), "s.name").alias("qualified_name"), F.concat(F.lit("file::"), "file_path").alias("container"), F.coalesce(language_of("file_path"), F.lit("unknown")).alias("language"), "ord"
    )


def fallback_imports(files: DataFrame) -> DataFrame:
    """(file_path, specifier) by patterns alone, once for each file."""
    found = F.transform(_named(F.col("content"), IMPORT_PATTERN, 3), lambda n: F.trim(n))
    return files.filter("content IS NOT NULL").select(F.col("path").alias("file_path"), F.explode(F.array_distinct(found)).alias("specifier"))


def snapshot_imports(files: DataFrame) -> DataFrame:
    """(file_path, specifier): import, require and from specifiers, once for each file."""
    found = F.concat(*(F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in SNAPSHOT_IMPORTS))
    return files.filter("content IS NOT NULL").select(F.col("path").alias("file_path"), F.explode(F.array_distinct(found)).alias("specifier"))
