"""Files of a repository as a data source of Spark, format "repository".

    spark.dataSource.register(RepositoryFiles)
    spark.read.format("repository").option("exclude", '["**/dist/**"]').load(root).filter("extension = '.py'")

has path, extension, mtime_ms and size of each file, and its content with the schema CONTENTS. The
driver lists the uppermost folders only, until there are enough of them to deal out; tasks walk what
lies below. Rules of .gitignore and .ignore files are carried down the tree, so that a folder that is
left out is never listed. Filters on path, extension, size and time are pushed into the walk: folders
that can't hold a wanted path are passed over, and no file is opened that a filter leaves out.
"""

from __future__ import annotations

import functools
import json
import os
import posixpath
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from lodestone.functions.cluster import ship
from lodestone.functions.columns import glob_regex

LISTING = "path string, extension string, mtime_ms long, size long"
CONTENTS = f"{LISTING}, raw binary"
#: Files whose rules hold in their folder and below, the stronger first.
RULE_FILES = (".ignore", ".gitignore")
#: Bytes of contents that a task hands on at a time.
STEP = 32 << 20

#: (regex of the path within the folder of the rule, folders only, takes back in)
Rule = tuple[str, bool, bool]
#: (which of RULE_FILES, folder, its rules), the deepest folder last
Rules = tuple[tuple[str, str, tuple[Rule, ...]], ...]


def open_store(root: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def ignore_rules(text: str) -> tuple[Rule, ...]:
    """The rules in a file of patterns, one a line: `/` inside or in front ties a pattern to the file's
    folder, at the end it means folders only, `!` takes back in, `#` begins a remark."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        line = re.sub(r"^\\(?=[#!])", "", line)
        folders, body = line.endswith("/"), line.rstrip("/")
        tied, body = "/" in body, body.lstrip("/")
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                out, i = out + "/.+", i + 3
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
                inner = body[i + 1 : end]
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
            else:
                i += body[i] == "\\" and i + 1 < len(body)
                out, i = out + re.escape(body[i]), i + 1
        if body:
            rules.append((f"(?s){'' if tied else '(?:.*/)?'}{out}", folders, back))
    return tuple(rules)


@functools.lru_cache(4096)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex)


def is_ignored(path: str, folder: bool, rules: Rules) -> bool:
    """Whether rules leave out a path whose folder they don't: .ignore files before .gitignore files,
    deeper files before others, and in a file the last rule that matches."""
    for kind in RULE_FILES:
        for name, base, own in reversed(rules):
            if name == kind:
                inside = path[len(base) + 1 :] if base else path
                for regex, folders, back in reversed(own):
                    if (folder or not folders) and _compiled(regex).fullmatch(inside):
                        return not back
    return False


def _globs(patterns: list[str]) -> list[re.Pattern]:
    """What glob_regex() says, for Python; broken patterns match nothing."""
    return [_compiled(r.removesuffix("\\z") + "\\Z") for p in patterns if (r := glob_regex(p)) is not None]


def extension_of(path: str) -> str:
    """The lower-cased extension with its dot; empty without one, and for names that begin with it."""
    return posixpath.splitext(posixpath.basename(path))[1].lower()


class Folder(InputPartition):
    """A folder to walk, or, if shallow, to list; with the rules from above it, and the names of files
    of rules that hold."""

    def __init__(self, path: str, rules: Rules, rule_files: tuple[str, ...], shallow: bool):
        super().__init__(path)
        self.path, self.rules, self.rule_files, self.shallow = path, rules, rule_files, shallow


#: What a pushed filter asks of a value.
_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


class Walk(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root, self.columns = options["path"].rstrip("/") or "/", columns
        listed = lambda name, default: json.loads(options.get(name, default))
        self.include, self.exclude = listed("include", '["**/*"]'), listed("exclude", "[]")
        self.rules, self.ignore_files, self.parts = options.get("rules", ""), options.get("ignorefiles", "git"), int(options.get("parts", "64"))
        #: (column, kind, value) of pushed filters
        self.tests: list[tuple[str, type, object]] = []
        if "extensions" in options:
            self.tests.append(("extension", In, tuple(json.loads(options["extensions"]))))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in ("path", "extension", "mtime_ms", "size"):
                self.tests.append((f.attribute[0], type(f), tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _wanted(self, path: str, mtime_ms: int, size: int) -> bool:
        of = {"path": path, "extension": extension_of(path), "mtime_ms": mtime_ms, "size": size}
        return all(_TESTS[kind](of[column], value) for column, kind, value in self.tests)

    def _may_hold(self, folder: str) -> bool:
        """Whether a wanted path may lie below a folder."""
        inside = f"{folder}/"
        for column, kind, value in self.tests:
            if column == "path" and kind in (EqualTo, In):
                if not any(v.startswith(inside) for v in ((value,) if kind is EqualTo else value)):
                    return False
            elif column == "path" and kind is StringStartsWith and not (value.startswith(inside) or inside.startswith(value)):
                return False
        # a glob for all that lies in a folder leaves out the folder itself
        return not any(p.endswith("/**") and any(g.search(folder) for g in _globs([p[:-3]])) for p in self.exclude)

    def _list(self, at: tuple[pafs.FileSystem, str], folder: str, rules: Rules, rule_files: tuple[str, ...]) -> tuple[list[tuple[str, int, int]], list[tuple[str, Rules]]]:
        """(files, folders) right in a folder; folders with the rules that hold in them."""
        store, base = at
        here = f"{base}/{folder}" if folder else base
        infos = sorted(store.get_file_info(pafs.FileSelector(here, allow_not_found=True)), key=lambda i: i.base_name)
        for name in rule_files:
            if any(i.base_name == name and i.is_file for i in infos):
                with store.open_input_stream(f"{here}/{name}") as text:
                    rules += ((name, folder, ignore_rules(text.read().decode(errors="replace"))),)
        files, folders = [], []
        for i in infos:
            path = f"{folder}/{i.base_name}" if folder else i.base_name
            if i.type == pafs.FileType.Directory:
                link = isinstance(store, pafs.LocalFileSystem) and os.path.islink(f"{here}/{i.base_name}")
                if not link and self._may_hold(path) and not is_ignored(path, True, rules):
                    folders.append((path, rules))
            elif i.is_file and not is_ignored(path, False, rules):
                mtime_ms, posix = i.mtime_ns // 1_000_000, path.replace("\\", "/")
                if self._wanted(posix, mtime_ms, i.size) and any(g.search(posix) for g in _globs(self.include)) and not any(g.search(posix) for g in _globs(self.exclude)):
                    files.append((path, mtime_ms, i.size))
        return files, folders

    def partitions(self) -> list[Folder]:
        at = open_store(self.root)
        if at[0].get_file_info(at[1]).type != pafs.FileType.Directory:
            raise FileNotFoundError(self.root)
        git = at[0].get_file_info(f"{at[1]}/.git").type != pafs.FileType.NotFound
        uses = {"all": RULE_FILES, "none": (), "git": RULE_FILES if git else (".ignore",)}[self.ignore_files]
        first: Rules = ((".gitignore", "", ignore_rules(self.rules)),) if self.rules else ()
        whole, shallow = [("", first)], []
        # opened folders are dealt out as well, as their own files are listed by tasks
        while whole and len(whole) + len(shallow) < self.parts:
            path, rules = whole.pop(0)
            shallow.append(Folder(path, rules, uses, True))
            whole += self._list(at, path, rules, uses)[1]
        return shallow + [Folder(path, rules, uses, False) for path, rules in whole]

    def read(self, partition: Folder) -> Iterator[tuple]:
        at, open_ = open_store(self.root), [(partition.path, partition.rules)]
        while open_:
            folder, rules = open_.pop()
            files, folders = self._list(at, folder, rules, partition.rule_files)
            if not partition.shallow:
                open_ += folders
            for path, mtime_ms, size in files:
                row = {"path": path.replace("\\", "/"), "extension": extension_of(path), "mtime_ms": mtime_ms, "size": size}
                if "raw" in self.columns:
                    row["raw"] = content_of(at, path)
                yield tuple(row[c] for c in self.columns)


class RepositoryFiles(DataSource):
    """Options: include and exclude (JSON lists of globs), rules (text as of a .gitignore at the root),
    ignorefiles (git: .ignore files, and .gitignore files if the root holds .git; all; none),
    extensions (a JSON list; like a filter), and parts, how many folders the driver deals out at least if there are as many."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Walk(dict(self.options), schema.names)


def content_of(at: tuple[pafs.FileSystem, str], path: str) -> bytes | None:
    """A file's bytes; None if it is gone or can't be read."""
    try:
        with at[0].open_input_stream(f"{at[1]}/{path}", compression=None) as source:
            return source.read()
    except OSError:
        return None


def options_of(include: list[str], exclude: list[str], rules: str = "", ignore_files: str = "git", extensions: list[str] | None = None) -> dict[str, str]:
    own = {} if extensions is None else {"extensions": json.dumps(extensions)}
    return {"include": json.dumps(include), "exclude": json.dumps(exclude), "rules": rules, "ignorefiles": ignore_files, **own}


def listing(spark: SparkSession, root: str, include: list[str], exclude: list[str], rules: str = "", ignore_files: str = "git") -> DataFrame:
    """(path, extension, mtime_ms, size) of the files under a root; nothing is read yet."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositoryFiles)
    parts = str(4 * spark.sparkContext.defaultParallelism)
    return spark.read.format("repository").options(**options_of(include, exclude, rules, ignore_files), parts=parts).load(root)


def with_contents(files: DataFrame, root: str, when: Column | None = None) -> DataFrame:
    """The rows with a column raw: the content of each file (path) for which `when` holds, else null;
    null as well for files that are gone or can't be read. Each content is read by one task, as bytes
    of about STEP at a time."""
    columns = files.columns
    asked = files.withColumn("_read", F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    schema = T.StructType([*files.schema.fields, T.StructField("raw", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = open_store(root.rstrip("/") or "/")
        for batch in batches:
            own, paths, wanted = batch.select(columns), batch.column("path").to_pylist(), batch.column("_read").to_pylist()
            begin, held, raws = 0, 0, []
            for i, path in enumerate(paths):
                raws.append(content_of(at, path) if wanted[i] else None)
                held += len(raws[-1] or b"")
                if held >= STEP or i + 1 == len(paths):
                    part = own.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raws, pa.binary())], names=[*columns, "raw"])
                    begin, held, raws = i + 1, 0, []

    ship(files.sparkSession)
    return asked.mapInArrow(read, schema)
