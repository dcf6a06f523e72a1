"""Stored graphs brought up to date by changes, against graphs built anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.graph import CodeGraph
from lodestone.operators import build, resolve
from lodestone.schemas import FILES
from lodestone.sources import buckets
from lodestone.sources.buckets import BucketStore, Change, WriterConflict

NAMES = [f"n{i}" for i in range(12)]
PATHS = [f"{d}/{n}.{e}" for d in ("a", "a/b", "c") for n in ("one", "two", "index") for e in ("ts", "py")]


def body(rng, path):
    lines = []
    for _ in range(rng.randrange(4)):
        other = rng.choice(PATHS)
        to = os.path.relpath(other.rsplit(".", 1)[0], os.path.dirname(path))
        lines.append(f"import x from '{to if to.startswith('.') else './' + to}';" if path.endswith("ts") else f"from {other.rsplit('.', 1)[0].replace('/', '.')} import x")
    for name in rng.sample(NAMES, rng.randrange(4)):
        calls = rng.sample(NAMES, rng.randrange(3))
        if path.endswith("ts"):
            lines += [f"function {name}() {{ {' '.join(f'{c}();' for c in calls)} }}"] if rng.random() < 0.8 else [f"class {name} extends {rng.choice(NAMES)} {{}}"]
        else:
            lines += [f"def {name}():", *(f"    {c}()" for c in calls), "    pass"]
    return "\n".join(lines) + "\n"


def snapshot(spark, files):
    rows = [(p, f"h{hash(c)}", t, len(c), "full", c, c[:10], "k") for p, (t, c) in files.items()]
    return spark.createDataFrame(rows, FILES).coalesce(1)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def tables(graph):
    return build.stored_tables(graph.files, graph.nodes, graph.edges, graph.facts)


def same_as_built(spark, at, files, names=tuple(build.TABLES)):
    full, store = tables(CodeGraph.build(snapshot(spark, files))), BucketStore(spark, at, build.TABLES)
    for name in names:
        assert rows(store.read(name)) == rows(full[name].select(store.read(name).columns)), name


def test_random_edits(spark, tmp_path):
    rng, at = random.Random(8), str(tmp_path / "graph")
    files = {p: (1, body(rng, p)) for p in PATHS[:12]}
    assert CodeGraph.refresh(snapshot(spark, files), at) == {}
    for step in range(2):
        for p in rng.sample(PATHS, 5):
            if p in files and rng.random() < 0.4:
                del files[p]
            else:
                files[p] = (step + 2, body(rng, p))
        CodeGraph.refresh(snapshot(spark, files), at)
        same_as_built(spark, at, files, tuple(build.TABLES) if step else ("nodes", "edges"))
    # nothing changed: no bucket and no generation is written
    number = BucketStore(spark, at, build.TABLES).number
    assert set(CodeGraph.refresh(snapshot(spark, files), at).values()) == {0} and BucketStore(spark, at, build.TABLES).number == number
    files.clear()
    CodeGraph.refresh(snapshot(spark, files), at)
    assert all(BucketStore(spark, at, build.TABLES).read(t).count() == 0 for t in build.TABLES)


def test_one_file_rewrites_its_buckets(spark, tmp_path):
    at = str(tmp_path / "graph")
    files = {f"d{i}/f{i}.ts": (1, f"import x from '../d{i + 1}/f{i + 1}';\nfunction g{i}() {{ g{i + 1}(); }}\n") for i in range(60)}
    CodeGraph.refresh(snapshot(spark, files), at)
    before = BucketStore(spark, at, build.TABLES)
    # other lines, the same names: no file but itself is touched, no index changes
    files["d7/f7.ts"] = (2, "import x from '../d8/f8';\n// more\nfunction g7() { g8(); }\n")
    assert CodeGraph.refresh(snapshot(spark, files), at) == {"files": 1, "facts": 1, "nodes": 1, "edges": 1, "symbols": 0, "referrers": 0, "importers": 0}
    after = BucketStore(spark, at, build.TABLES)
    for name in build.TABLES:
        a, b = (s.manifest["tables"][name]["buckets"] for s in (before, after))
        assert sum(a[k] != b[k] for k in a) == (name in ("files", "facts", "nodes", "edges"))
    assert rows(before.read("files")) != rows(after.read("files"))  # a reader keeps its generation
    # another time alone rewrites the file's row
    files["d7/f7.ts"] = (3, files["d7/f7.ts"][1])
    assert CodeGraph.refresh(snapshot(spark, files), at) == {"files": 1, "facts": 0, "nodes": 0, "edges": 0, "symbols": 0, "referrers": 0, "importers": 0}
    # a symbol that goes takes the edges of those who call it
    files["d9/f9.ts"] = (4, "function other() {}\n")
    counts = CodeGraph.refresh(snapshot(spark, files), at)
    assert counts["facts"] == counts["nodes"] == 1 and counts["edges"] <= 2 and counts["symbols"] <= 2
    # a file that goes takes the imports of those who mean it
    del files["d20/f20.ts"]
    assert CodeGraph.refresh(snapshot(spark, files), at)["edges"] <= 2
    same_as_built(spark, at, files, ("nodes", "edges", "importers"))


def test_build_parses_once(spark):
    graph = CodeGraph.build(snapshot(spark, {"a/one.ts": (1, "function f() {}\n")}))
    for df in tables(graph).values():
        assert "mapInArrow" not in df._jdf.queryExecution().toString().replace("MapInArrow", "mapInArrow")


def test_status(spark, tmp_path):
    at = str(tmp_path / "graph")
    got = CodeGraph.stored_status(spark, at).first()
    assert (got["exists"], got.node_count, got.edge_count, got.graph_path, got.updated_at) == (False, 0, 0, at, None)
    CodeGraph.refresh(snapshot(spark, {"a/one.ts": (1, "function f() {}\n")}), at)
    got = CodeGraph.stored_status(spark, at).first()
    assert (got["exists"], got.node_count, got.edge_count) == (True, 2, 1) and got.updated_at[:2] == "20"


def store_of(spark, at):
    from lodestone.sources.buckets import Table

    return BucketStore(spark, at, {"t": Table("k", "o")})


def test_store(spark, tmp_path):
    at = str(tmp_path / "store")
    frame = lambda r: spark.createDataFrame(r, "k string, o string, v long")
    first = store_of(spark, at)
    assert not first.exists and first.updated_at is None
    data = [(f"k{i}", f"o{i % 7}", i) for i in range(100)]
    first.replace({"t": frame(data)})
    keys = spark.createDataFrame([("k3",), ("k4",), ("k3",), ("none",)], "k string")
    assert sorted(r.v for r in first.rows("t", keys).collect()) == [3, 4]
    assert len({f for f in first.read("t", first.buckets_of(keys)).inputFiles()}) <= 3
    # two writers from one generation: the second fails, its folders go, what was there stays
    a, b = store_of(spark, at), store_of(spark, at)
    owners = spark.createDataFrame([("o3",)], "o string")
    change = lambda v: {"t": Change(owners, frame([("k3", "o3", v)]), frame([r for r in data if r[1] == "o3"]).select("k"))}
    a.apply(change(1000))
    with pytest.raises(WriterConflict):
        b.apply(change(2000))
    want = sorted([r for r in data if r[1] != "o3"] + [("k3", "o3", 1000)])
    assert sorted(map(tuple, store_of(spark, at).read("t").collect())) == want
    named = {p.split("/")[1] for p in store_of(spark, at)._folders(store_of(spark, at).manifest) | first._folders(first.manifest)}
    assert set(os.listdir(f"{at}/t")) == named
    # a write that fails leaves all as it was
    bad = {"t": Change(owners, frame([("k3", "o3", 1)]).withColumn("v", F.expr("raise_error('stop')").cast("long")), owners.select(F.lit("k3").alias("k")))}
    with pytest.raises(Exception, match="stop"):
        store_of(spark, at).apply(bad)
    assert sorted(map(tuple, store_of(spark, at).read("t").collect())) == want
    # old generations go, shared buckets stay
    for v in range(4):
        store_of(spark, at).apply(change(v))
    assert len([n for n in os.listdir(at) if n.startswith("manifest")]) == 2 and store_of(spark, at).read("t").count() == len(want)


def test_import_paths_are_worked_out_once(spark):
    """A specifier's path stands once in the plan, not once for each ending; files are looked up once for imports that mean the same."""
    facts = spark.createDataFrame([(f"a/f{i}.ts", "import", "../b/g", "", "") for i in range(40)], "file_path string, rec string, target_name string, kind string, source string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(build.importer_index(facts)).count("aggregate(") <= 2
    imports = facts.select("file_path", F.col("target_name").alias("specifier"))
    found = resolve.resolve_imports(imports, spark.createDataFrame([("b/g.ts",), ("b/g.tsx",)], "path string"))
    assert plan(found).count("aggregate(") <= 8 and "Aggregate [_base" in plan(found).split("Generate")[1]
    assert {r.target for r in found.collect()} == {"b/g.ts"} and found.count() == 40


def test_odd_imports(spark):
    """Nulls mean nothing, repeated imports stay, the first ending that is a file counts."""
    cases = [("a/x.ts", "./y", "a/y.ts"), ("a/x.ts", "./y", "a/y.ts"), ("a\\x.ts", "./y/", "a/y.ts"), ("x.ts", "./../../a/./y", "a/y.ts"), ("a/x.ts", "y", None), ("a/x.py", ".y", "a/y.py"), ("a/b/x.py", "..y", "a/y.py"), ("a/x.py", "./y", "a/y.ts"), ("a/x.py", "a.y", "a/y.py"),
             ("a/x.rs", "crate::m::n", "src/m/n/mod.rs"), ("a/x.java", "j.K", "src/main/java/j/K.java"), ("a/x.go", "g", "g/main.go"), (None, "./y", None), (None, "y", None), ("a/x.ts", None, None), ("a/x.py", None, None), ("a/x.ts", "", None), ("a/x.ts", ".", "a/index.js"), ("", "./q", "q")]
    files = ["a/y.ts", "a/y.ts", "a/y.py", "src/m/n/mod.rs", "src/main/java/j/K.java", "g/main.go", "g/index.go", "a/index.js", "q", "q.ts", None]
    found = resolve.resolve_imports(spark.createDataFrame([c[:2] for c in cases], "file_path string, specifier string"), spark.createDataFrame([(f,) for f in files], "path string"))
    assert found.columns == ["file_path", "specifier", "target"]
    assert sorted(map(tuple, found.collect())) == sorted(c for c in cases if c[2])


def test_differing_rows(spark):
    frame = lambda r: spark.createDataFrame(r, "k string, o string")
    old = frame([("a", "1"), ("b", "1"), ("b", "1"), (None, "1"), ("c", None), ("d", "1")])
    new = frame([("a", "1"), ("b", "1"), ("c", None), (None, "2"), ("e", "1")])
    assert sorted(map(str, (r.k for r in build._differing(old, new, "k").collect()))) == ["None", "b", "d", "e"]
    assert build._differing(old, old, "k").count() == 0


def test_few_keys_are_sent(spark, tmp_path, monkeypatch):
    """Rows that a few keys look up or replace aren't shuffled for it; by more keys they are merged, with the same rows."""
    frame = lambda r: spark.createDataFrame(r, "k string, o string, v long")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    data = [(f"k{i}" if i % 9 else None, f"o{i % 7}" if i % 11 else None, i) for i in range(60)]
    keys = spark.createDataFrame([("k3",), ("k3",), (None,), ("none",)], "k string").checkpoint()
    owners = spark.createDataFrame([("o3",), ("o3",), (None,), ("o9",)], "o string").checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent, join in ((10, "BroadcastHashJoin"), (3, "SortMergeJoin")):
            monkeypatch.setattr(buckets, "SENT", sent)
            store, written = store_of(spark, str(tmp_path / str(sent))), []
            store.replace({"t": frame(data)})
            found = store.rows("t", keys)
            assert [r.v for r in found.collect()] == [3] and join in plan(found)
            monkeypatch.setattr(BucketStore, "_write", lambda self, table, rows, n, f=BucketStore._write: written.append(rows) or f(self, table, rows, n))
            store.apply({"t": Change(owners, frame([("k3", "o3", 100)]), frame([r for r in data if r[1] == "o3"]).select("k"))})
            assert join in plan(written[0])
            want = [r for r in data if r[1] != "o3"] + [("k3", "o3", 100)]
            assert sorted(store.read("t").collect(), key=str) == sorted(frame(want).collect(), key=str)
            monkeypatch.undo()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
