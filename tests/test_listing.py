import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.sources.config import SnapshotConfig
from lodestone.sources.listing import CONTENTS, ignore_rules, is_ignored, listing, with_contents
from lodestone.sources.snapshot import list_files, load_snapshot, refresh, save_snapshot


def plant(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def paths(df):
    return sorted(r.path for r in df.collect())


def test_rules():
    cases = [
        ("*.log", "a/b.log", False, True), ("/x.py", "x.py", False, True), ("/x.py", "a/x.py", False, False), ("a/x.py", "a/x.py", False, True), ("a/x.py", "b/a/x.py", False, False),
        ("build/", "build", True, True), ("build/", "build", False, False), ("**/t", "a/b/t", True, True), ("**/t", "t", False, True), ("a/**", "a/b/c", False, True), ("a/**", "a", True, False),
        ("a/**/z", "a/z", False, True), ("a/**/z", "a/b/c/z", False, True), ("f?.[ch]", "fa.c", False, True), ("f[!a]", "fa", False, False), ("\\#x", "#x", False, True), ("# x", "# x", False, False),
        ("x  ", "x", False, True), ("*\n!keep.txt", "keep.txt", False, False), ("!keep.txt\n*", "keep.txt", False, True), ("a+b", "a+b", False, True), ("", "x", False, False),
    ]
    for text, path, folder, want in cases:
        assert is_ignored(path, folder, ((".gitignore", "", ignore_rules(text)),)) is want, (text, path)
    below = ((".gitignore", "", ignore_rules("*.md")), (".gitignore", "sub", ignore_rules("!a.md\n/b.txt")))
    assert [is_ignored(p, False, below) for p in ("a.md", "sub/a.md", "sub/b.md", "sub/b.txt", "sub/x/b.txt")] == [True, False, True, True, False]
    # .ignore files have the last word
    assert is_ignored("sub/a.md", False, ((".ignore", "", ignore_rules("a.md")), *below)) is True


def test_nested_rules(spark, tmp_path):
    plant(tmp_path, {".git/HEAD": "", ".gitignore": "*.tmp\nout/\n", "a.py": "", "a.tmp": "", "out/b.py": "", "sub/.gitignore": "!keep.tmp\nlocal.*\n", "sub/keep.tmp": "", "sub/local.py": "", "sub/deep/local.md": "", "sub/deep/out/x.py": "", "local.py": "", "_x/__init__.py": "", ".github/w.yml": "k"})
    every = lambda **k: paths(listing(spark, str(tmp_path), ["**/*"], ["**/.git/**"], **k))
    assert every() == [".github/w.yml", ".gitignore", "_x/__init__.py", "a.py", "local.py", "sub/.gitignore", "sub/keep.tmp"]
    assert len(every(ignore_files="none")) == 12 and every(rules="*.py") == [".github/w.yml", ".gitignore", "sub/.gitignore", "sub/keep.tmp"]
    os.rename(tmp_path / ".git/HEAD", tmp_path / "HEAD")
    os.rmdir(tmp_path / ".git")
    assert len(every()) == 13  # rules of git hold in its repositories only
    (tmp_path / ".ignore").write_text("*.tmp\n")
    assert [p for p in every() if p.endswith(".tmp")] == []


def test_links_and_missing_roots(spark, tmp_path):
    plant(tmp_path, {"r/a.txt": "a", "else/b.txt": "b"})
    os.symlink(tmp_path / "else", tmp_path / "r/folder")
    os.symlink(tmp_path / "r", tmp_path / "r/loop")
    os.symlink(tmp_path / "else/b.txt", tmp_path / "r/link.txt")
    assert paths(listing(spark, str(tmp_path / "r"), ["**/*"], [])) == ["a.txt", "link.txt"]
    assert paths(listing(spark, f"file://{tmp_path}/r/", ["**/*"], [])) == ["a.txt", "link.txt"]
    with pytest.raises(Exception, match="FileNotFoundError"):
        listing(spark, str(tmp_path / "none"), ["**/*"], []).count()


def was_read(path):
    """Whether a file was opened since forget()."""
    return os.stat(path).st_atime > 10


def forget(root):
    for folder, _, names in os.walk(root):
        for n in names:
            os.utime(f"{folder}/{n}", (5, os.stat(f"{folder}/{n}").st_mtime))


def times_are_kept(tmp_path):
    plant(tmp_path, {"probe": "x"})
    forget(tmp_path)
    (tmp_path / "probe").read_text()
    return was_read(tmp_path / "probe")


def test_filters_reach_the_walk(spark, tmp_path):
    files = {f"d{i}/e{j}/f{k}.{e}": f"{i}{j}{k}" * (k + 1) for i in range(4) for j in range(3) for k in range(3) for e in ("py", "md")}
    plant(tmp_path / "r", files)
    can_tell = times_are_kept(tmp_path)
    read = spark.read.format("repository").schema(CONTENTS).load(str(tmp_path / "r"))
    listing(spark, str(tmp_path / "r"), ["**/*"], []).count()  # registers the source
    cases = {
        "path LIKE 'd1/e2/%' AND extension = '.py'": lambda p: p.startswith("d1/e2/") and p.endswith(".py"),
        "path = 'd0/e0/f1.md'": lambda p: p == "d0/e0/f1.md",
        "path IN ('d0/e0/f1.md', 'd3/e1/f0.py', 'none')": lambda p: p in ("d0/e0/f1.md", "d3/e1/f0.py"),
        "extension IN ('.md') AND size >= 6 AND path LIKE '%f2%'": lambda p: p.endswith("f2.md"),
        "size < 6 AND length(path) = 11 AND path LIKE '%0.py'": lambda p: p.endswith("0.py"),
    }
    for where, wanted in cases.items():
        forget(tmp_path / "r")
        found = read.filter(where)
        rows = found.collect()
        assert sorted(r.path for r in rows) == sorted(filter(wanted, files)), where
        assert all(bytes(r.raw).decode() == files[r.path] for r in rows)
        if can_tell and "length" not in where:
            assert {p for p in files if was_read(tmp_path / "r" / p)} == set(filter(wanted, files)), where


def test_only_what_changed_is_opened(spark, tmp_path):
    """Refreshing opens no file that is excluded, ignored, beyond max_files or as it was."""
    plant(tmp_path / "r", {".gitignore": "skip/\n", ".git/x.md": "", "a.md": "# a\n", "b.md": "# b\n", "c.py": "import c\n", "skip/d.md": "# d\n", "dist/e.md": "# e\n", "f.bin": "f", "z.md": "# z\n"})
    can_tell, config, at = times_are_kept(tmp_path), SnapshotConfig(max_files=3), str(tmp_path / "store")
    opened = lambda: sorted(p for p in ("a.md", "b.md", "c.py", "skip/d.md", "dist/e.md", "f.bin", "z.md") if was_read(tmp_path / "r" / p))

    def take(config):
        forget(tmp_path / "r")
        rows = refresh(list_files(spark, str(tmp_path / "r"), config), load_snapshot(spark, at), config, str(tmp_path / "r"))
        save_snapshot(rows, at)
        return {r.path: (r.changed, r.summary) for r in spark.read.parquet(f"{at}/generation-*/files").filter(F.input_file_name().contains(newest(at))).collect()}

    newest = lambda at: max(os.listdir(at), key=lambda n: (n.startswith("generation"), len(n), n))
    assert take(config) == {"a.md": (True, "# a\n"), "b.md": (True, "# b\n"), "c.py": (True, "import c\n")}
    assert not can_tell or opened() == ["a.md", "b.md", "c.py"]
    assert take(config) == {"a.md": (False, "# a\n"), "b.md": (False, "# b\n"), "c.py": (False, "import c\n")}
    assert not can_tell or opened() == []
    (tmp_path / "r/b.md").write_text("# new b\n")
    assert take(config)["b.md"] == (True, "# new b\n") and (not can_tell or opened() == ["b.md"])
    # another budget, another summary
    config.max_file_chars = 3
    assert take(config) == {"a.md": (True, "# a"), "b.md": (True, "# n"), "c.py": (True, "imp")}


def test_contents(spark, tmp_path):
    plant(tmp_path, {"a": "1", "b": "", "c": "ü" * 100})
    rows = spark.createDataFrame([("a", True), ("b", True), ("c", None), ("gone", True)], "path string, w boolean")
    got = {r.path: r.raw if r.raw is None else bytes(r.raw) for r in with_contents(rows, str(tmp_path), F.col("w")).collect()}
    assert got == {"a": b"1", "b": b"", "c": None, "gone": None}
    assert with_contents(rows.limit(0), str(tmp_path)).count() == 0
