import os
import subprocess

from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.graph import CodeGraph
from lodestone.operators import flows, query, repos, risk, search, text, traverse
from lodestone.sources import documents, git
from lodestone.sources.config import SnapshotConfig, detect_preset
from lodestone.sources.snapshot import list_files, load_snapshot, refresh, save_snapshot
from lodestone.streaming.watch import debounced, watch


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_like(spark):
    cases = [("MyFn", "%my_n%", True), ("myXfn", "my_fn", True), ("a\\b", "%\\b", True), ("É", "é", False), ("a.b", "a_b", True), ("a.b", "a*b", False), ("line\nbreak", "line%", True), ("x", "%", True), ("", "_", False), ("abc", "%B%", True)]
    for value, pattern, want in cases:
        got = one(spark, c.like(F.lit(value), pattern).alias("a"), c.like_column(F.lit(value), F.lit(pattern)).alias("b"))
        assert (got.a, got.b) == (want, want), (value, pattern)


def test_identifiers_and_paths(spark):
    got = one(spark, c.file_of(F.lit("file::a/b.ts")), c.file_of(F.lit("a/b.ts::C.m::x")), c.file_of(F.lit("zzz")), c.path_of_symbol(F.lit("file::a")), c.top_segment(F.lit("a/b")), c.top_segment(F.lit("a")), c.test_stem(F.lit("x/my-big_file.spec.ts")), c.extension(F.lit("a/B.TS")), c.extension(F.lit("a.b/c")))
    assert list(got) == ["a/b.ts", "a/b.ts", None, "file", "a", "a", "mybigfile", ".ts", ""]
    got = one(spark, c.first_quoted(F.lit("""require "it's" 'b'""")), c.first_quoted(F.lit("none")), c.first_quoted(F.lit("'open")), c.first_quoted(F.lit("x ''")), c.page_name(F.lit("/a b/ü/")), c.without_quotes(F.lit("'a\"")), c.posix(F.lit("a\\b")))
    assert list(got) == ["it's", None, None, "", "a-b", "a", "a/b"]
    for path, glob, want in [("a/b/c.ts", "**/*", True), ("c.ts", "**/*", True), ("x/node_modules/y.js", "**/node_modules/**", True), ("node_modules/y.js", "**/node_modules/**", True), ("src/a.min.js", "**/*.min.*", True), ("a.ts", "*.js", False), ("ab", "a?", True), ("a", "[!b]", True)]:
        assert one(spark, c.matches_any_glob(F.lit(path), [glob, "a**b"]).alias("m")).m is want, (path, glob)


def test_lines(spark):
    for value, want in [("", []), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("\n\n", ["", ""]), (None, [])]:
        assert one(spark, c.lines_of(F.lit(value).cast("string")).alias("l")).l == want


def test_cut_bytes(spark):
    for value in ("abc", "äöü", "a€b", "😀x", ""):
        for most in range(8):
            raw = value.encode()[:most]
            want = raw.decode(errors="ignore")
            assert one(spark, text.cut_bytes(F.lit(value), F.lit(most)).alias("t")).t == want, (value, most)


def test_summaries(spark):
    cases = [
        ("a.md", "# T\ntext\n- x\n```\n# no\n```\nYou  must\n", "# T\n- x\nYou must\n"),
        ("a.py", "import os\n\n  def f():\n    x = 1\n", "import os\ndef f():\n"),
        ("a.rs", "pub fn x\nlet y\n// c\n", "pub fn x\n// c\n"),
        ("a.ts", "import a\nlet b\nx function f\n", "import a\nx function f\n"),
        ("a.zz", "\n a \n" * 3, "a\na\na\n"),
    ]
    for path, content, want in cases:
        assert one(spark, text.summarize(F.lit(content), F.lit(path)).alias("s")).s == want
        assert one(spark, text.summarize(F.lit(content), F.lit(path), 3).alias("s")).s == want[:3]


def test_prompt(spark):
    files = spark.createDataFrame([("b", "full", "ü" * 50, None), ("a", "summary", "x", "sum"), ("c", "full", "late", None)], "path string, mode string, content string, summary string")
    got = text.format_prompt(files, "r", "now", 100).first().prompt
    head = "[snapshot]\nrepo: r\nupdatedAt: now\nfiles: 3\n\n"
    assert got.startswith(head + "### a\nsum\n\n### b\nüüü") and got.endswith(text.TRUNCATED) and len(got.encode()) <= 100 + len(text.TRUNCATED)
    assert text.format_prompt(files, "r", "now", 10_000).first().prompt == head + f"### a\nsum\n\n### b\n{'ü' * 50}\n\n### c\nlate\n\n"


def test_refactor_and_symbols(spark):
    files = spark.createDataFrame([("a.ts", "function foo() {}\nfoo(foo);\nfoobar éfoo\n"), ("t/test/b.spec.ts", " foo \n"), ("n", None)], "path string, content string")
    assert [tuple(r) for r in text.refactor_preview(files, "foo").collect()] == [("a.ts", 1, "function foo() {}"), ("a.ts", 2, "foo(foo);"), ("t/test/b.spec.ts", 1, "foo")]
    assert {r.path: r.new_content for r in text.apply_refactor(files, "foo", "$1\\x").collect()} == {"a.ts": "function $1\\x() {}\n$1\\x($1\\x);\nfoobar éfoo\n", "t/test/b.spec.ts": " $1\\x \n"}
    definitions, references = text.query_symbol(files, "foo")
    assert [tuple(r) for r in definitions.collect()] == [("a.ts", 1, "function")]
    assert sorted((r.file_path, r.external, r.probable_test) for r in references.collect()) == [("a.ts", False, False)] * 2 + [("t/test/b.spec.ts", True, True)]
    assert tuple(text.symbol_totals(files, "foo").first()) == (1, 3, 1, 1)


EDGES = [("imports_from", "file::a", "file::b", "a"), ("imports_from", "file::b", "file::c", "b"), ("imports_from", "file::c", "file::a", "c"), ("calls", "a::f", "c::g", "a"), ("calls", "a::f", "c::g", "a"), ("contains", "file::c", "c::g", "c")]
NODES = [("file", x, f"file::{x}", x, 0, 9, None) for x in "abc"] + [("function", "f", "a::f", "a", 1, 3, None), ("function", "g", "c::g", "c", 5, 4, None), ("function", "mainly", "b::mainly", "b", 1, 1, None)]


def graph(spark):
    return spark.createDataFrame(NODES, "kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string"), spark.createDataFrame(EDGES, "kind string, source string, target string, file_path string")


def test_traversal(spark):
    nodes, edges = graph(spark)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    got = lambda df: {r.file_path for r in df.collect()}
    assert got(traverse.impact_radius(edges, paths("zzz"), 3)) == {"zzz"}
    assert got(traverse.impact_radius(edges, paths("a"), 1)) == {"a", "b", "c"}
    assert got(traverse.impact_radius(edges.filter("kind = 'calls'"), paths("a"), 5)) == {"a"}
    assert got(traverse.impact_radius(edges.filter("kind <> 'imports_from'"), paths("c"), 5, contains=True)) == {"a", "c"}
    imports = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "a")], "source string, target string")
    assert {tuple(r) for r in traverse.reverse_import_impact(imports, paths("c"), 2).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    assert {tuple(r) for r in traverse.reverse_import_impact(imports, paths("c"), -1).collect()} == {("c", 0), ("b", 1)}
    listed, members = flows.flows(nodes, edges)
    assert {tuple(r) for r in listed.collect()} == {(1, "flow:f", "a::f", 2, 2, 5.0), (2, "flow:mainly", "b::mainly", 1, 1, 2.5)}
    assert members.count() == 3
    assert flows.flow_detail(listed, edges, id=1).first().nodes == ["a::f", "c::g"]
    empty = edges.limit(0)
    assert got(traverse.impact_radius(empty, paths("a"), 2)) == {"a"} and flows.flows(nodes.limit(0), empty)[0].count() == 0
    status = query.graph_status(nodes, empty).first()
    assert (status.node_count, status.edge_count) == (6, 0)


def test_repositories(spark):
    _, edges = graph(spark)
    two = edges.withColumn("repo_alias", F.lit("one")).union(edges.filter("source = 'file::a'").withColumn("repo_alias", F.lit("two")))
    changed = spark.createDataFrame([("one", "a"), ("two", "a")], "repo_alias string, file_path string")
    assert {tuple(r) for r in repos.cross_repo_impact(two, changed, 2).collect()} == {("one", "a"), ("one", "b"), ("one", "c"), ("two", "a"), ("two", "b")}
    assert repos.cross_repo_impact(two, changed, 2, ("two",)).count() == 2
    registry = spark.createDataFrame([("one", "/1", "t"), ("two", "/2", "t")], "alias string, path string, registered_at string")
    assert {(r.alias, r.edge_count) for r in repos.with_counts(registry, two, two).collect()} == {("one", 6), ("two", 1)}
    new = spark.createDataFrame([("two", "/3", "u")], registry.schema)
    assert {r.path for r in repos.upsert(registry, new).collect()} == {"/1", "/3"}
    assert repos.remove(registry, "one").count() == 1
    try:
        repos.remove(registry, "none")
        raise AssertionError("an unknown alias was removed")
    except KeyError:
        pass


def test_risk_and_diff(spark):
    diff = ["--- a/x.py", "+++ b/x.py", "+token = auth", "-password", "---- x", "--- a/gone", "+++ /dev/null", "-secret", "+++ b/y.py", "+nothing"]
    lines = spark.createDataFrame(list(enumerate(diff)), "ord long, line string")
    assert {tuple(r) for r in risk.security_hits(lines).collect()} == {("x.py", 4)}
    assert {tuple(r) for r in risk.security_hits(lines, strict=True).collect()} == {("x.py", 3)}
    stats = spark.createDataFrame([(0, "1\t2\ta"), (1, "-\t-\tbin"), (2, "bad"), (3, "3\t4\ta")], "ord long, line string")
    assert {tuple(r) for r in git.numstat(stats).collect()} == {("a", 3, 4), ("bin", 0, 0)}
    nodes, edges = graph(spark)
    changes = spark.createDataFrame([("c", 5, 5), ("new", 0, 0)], "file_path string, added long, deleted long")
    got = {r.file_path: r for r in risk.change_risk(nodes, edges, changes, risk.security_hits(lines)).collect()}
    # c: 2 callers, 3 other files, 10 lines, 1 function, no tests
    assert got["c"].risk_score == 2 * 1.5 + 3 * 0.8 + 10 * 0.3 + 0.7 + 4 and got["c"].risk == "medium"
    context = risk.minimal_context(risk.change_risk(nodes, edges, changes.limit(0))).first()
    assert (context.risk, context.changed_files, context.top_files) == ("low", 0, ["No changed files detected"])


def test_search(spark):
    v = lambda t: search.query_vector(spark, t)
    assert abs(sum(x * x for x in v("a b_c d-e a")) - 1) < 1e-9 and sum(v("")) == 0 and v("A") != v("a")
    for t in ("a b_c d-e a", "", "Straße x², ½ éa\u0301-٣ 漢字_1", "--"):
        assert all(abs(x - y) < 1e-12 for x, y in zip(v(t), one(spark, search.vectorize(F.lit(t)).alias("v")).v)), t
    assert one(spark, search.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("c")).c == 0
    nodes, _ = graph(spark)
    none = search.embed_nodes(nodes).limit(0)
    assert [r.qualified_name for r in search.semantic_search(nodes, none, " MAINLY ").collect()] == ["b::mainly"]
    failing = search.embed_nodes(nodes, "service", remote=lambda texts: 1 / 0)
    assert failing.count() == 3 and failing.first().model == "service"
    given = search.embed_nodes(nodes, "service", remote=lambda texts: [[1.0, 0.0]] * len(texts))
    assert given.first().vector == [1.0, 0.0]


def test_search_in_many_repositories(spark):
    rows = [(r, k, n, f"{p}::{n}", p) for r in "xy" for k, n, p in [("function", f"load_{i}", f"{r}{i % 3}/a.ts") for i in range(8)] + [("class", "Loader", f"{r}/b.ts"), ("function", "save", f"{r}/load.ts")]]
    nodes = spark.createDataFrame(rows, "repo_alias string, kind string, name string, qualified_name string, file_path string")
    vectors = nodes.join(search.embed_nodes(nodes), "qualified_name").select("repo_alias", "qualified_name", "vector")
    got = [tuple(r) for r in search.cross_repo_search(nodes, "load_3", 6, embeddings=vectors).collect()]
    want = []
    for repo in "xy":
        own = lambda df: df.filter(F.col("repo_alias") == repo).drop("repo_alias")  # noqa: B023, E731
        listed = search.hybrid_search(own(nodes), own(vectors), "load_3", None, 60).collect()
        want += [(repo, r.qualified_name, r.kind, r.file_path, round(1 / (61 + i), 9)) for i, r in enumerate(listed)]
    assert got == sorted(want, key=lambda r: (-r[4], r[0], r[1]))[:6]
    assert {r.repo_alias for r in search.cross_repo_search(nodes, "load", 50, ("y",)).collect()} == {"y"}


def test_documents(spark):
    readme = spark.createDataFrame([("r", "# T\n## Usage\nrun\n### sub\n\n## Next\nx ## usage\n")], "path string, content string")
    assert documents.docs_section(readme, "commands").first().section == "## Usage\nrun\n### sub"
    assert documents.docs_section(readme, "next").first().section == "## Next\nx ## usage"
    assert documents.docs_section(readme, "none").first().section == "Section not found: none"
    assert documents.docs_section_by_text(readme, "usage").first().section == "## Usage\nrun\n### sub"
    assert documents.docs_section_by_text(readme, "none").first().section == "Section not found: none"
    assert documents.prompt("architecture_map").startswith("Describe how")


def test_snapshot(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"a.ts": "import './b'\n", "b.ts": "function b() {}\n", "dist/c.ts": "x", "d.bin": "x", "sub/e.md": "# E\n", "skip/f.md": "x", "skip/none.md": "", "sub/none.py": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    config = SnapshotConfig()
    listed = list_files(spark, str(root), config, "skip/\n*.bin\n")
    first = refresh(listed, None, config, str(root))
    assert {(r.path, r.changed) for r in first.collect()} == {("a.ts", True), ("b.ts", True), ("sub/e.md", True), ("sub/none.py", True)}
    at = str(tmp_path / "store")
    assert load_snapshot(spark, at) is None
    save_snapshot(first.drop("changed"), at)
    (root / "b.ts").write_text("function b2() {}\n")
    os.utime(root / "a.ts", (1, 1))
    second = refresh(list_files(spark, str(root), config, "skip/"), load_snapshot(spark, at), config, str(root))
    got = {r.path: r for r in second.collect()}
    assert {p: r.changed for p, r in got.items()} == {"a.ts": False, "b.ts": True, "sub/e.md": False, "sub/none.py": False}
    assert got["b.ts"].content == "function b2() {}\n" and got["a.ts"].summary == "import './b'\n" and got["a.ts"].mtime_ms == 1000
    assert list_files(spark, str(root), SnapshotConfig(max_files=1)).count() == 1
    graph = CodeGraph.build(load_snapshot(spark, at))
    graph.save(str(tmp_path / "graph"))
    again = CodeGraph.load(spark, str(tmp_path / "graph"))
    assert [tuple(r) for r in again.query("imports_of", "a.ts").collect()] == [("file::a.ts", "file::b.ts", "imports_from", "a.ts")]
    assert {tuple(r) for r in again.reverse_import_impact(spark.createDataFrame([("b.ts",)], "file_path string")).collect()} == {("b.ts", 0), ("a.ts", 1)}


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"mode": "summary", "maxFiles": "many", "exclude": ["x"], "other": 1}')
    got = SnapshotConfig.load(str(tmp_path / "no"), str(path))
    assert (got.mode, got.max_files, got.exclude) == ("summary", 0, ["x"])
    path.write_text("{")
    assert SnapshotConfig.load(str(path)) == SnapshotConfig()
    assert [detect_preset(p) for p in (["nx.json", "setup.py"], ["next.config.js"], ["pyproject.toml"], [])] == ["nx", "nextjs", "python", "generic"]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x\n")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("token\ny\n")
    changes, diff = git.changes(spark, str(tmp_path))
    assert [tuple(r) for r in changes.collect()] == [("a.py", 2, 1)]
    assert [tuple(r) for r in risk.security_hits(diff).collect()] == [("a.py", 1)]
    assert git.changes(spark, str(tmp_path / "none"))[0].count() == 0


def test_streams(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.md").write_text("x")
    (folder / "b.bin").write_text("x")
    watch(spark, str(folder), lambda df, i: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()), str(tmp_path / "check"), once=True).awaitTermination(60)
    assert seen == ["a.md"]
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS ts FROM VALUES (0.0), (0.5), (1.1), (1.9) AS t(s)")
    assert sorted(r.changes for r in debounced(events).collect()) == [1, 3]
    keyed = events.withColumn("repo", F.lit("r"))
    keyed.write.parquet(str(tmp_path / "events"))
    stream = debounced(spark.readStream.schema(keyed.schema).parquet(str(tmp_path / "events")), "ts", "700 milliseconds", "repo", watermark="1 second")
    running = stream.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert {r.changes for r in spark.sql("SELECT * FROM bursts").collect()} <= {1, 3}


def test_containing_against_brute_force(spark):
    """Parts of any length, none included, in names and qualified names; repeated parts and nodes."""
    names = ["", "a", "ab", "abc", "abcd", "xabcx", "bcd", "é_%", "éa", "aaa", "aaaa", "test_abc"]
    nodes = [(n, f"{q}::{n}") for n in names for q in ("p/abc.ts", "q")] + [("abc", "q::abc")]
    parts = [(f"f{i % 4}", p) for i, p in enumerate([*names, "zzz", "::", ":", "%", "abc", "abc"])]
    got = risk.containing(spark.createDataFrame(parts, "file_path string, _part string"), spark.createDataFrame(nodes, "_name string, _qname string"))
    want = {}
    for f, p in parts:
        want[f] = want.get(f, 0) + sum(p in n or p in q for n, q in nodes)
    assert dict(map(tuple, got.collect())) == {f: n for f, n in want.items() if n}
    assert risk.containing(spark.createDataFrame([], "file_path string, _part string"), spark.createDataFrame(nodes, "_name string, _qname string")).count() == 0
