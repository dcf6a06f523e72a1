import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import query, search
from lodestone.operators.grams import GramIndex, grams_of, grams_of_pattern

NODE = "kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string"
EDGE = "kind string, source string, target string, file_path string"


def graph(spark):
    rng = random.Random(4)
    names = ["main", "Main", "load_cache", "loadXcache", "a", "", "ab", "Straße", "ÄÖÜäöü", "x%y", "percent%_", "token_cache", "cacheload"]
    nodes = [("function", n, f"src/f{i % 4}.ts::{n}", f"src/f{i % 4}.ts", 1, 2, None) for i, n in enumerate(names * 2)][: len(names) + 4]
    nodes += [("file", f"src/f{i}.ts", f"file::src/f{i}.ts", f"src/f{i}.ts", 0, 9, None) for i in range(4)]
    nodes = list(dict((n[2], n) for n in nodes).values())
    edges = [(rng.choice(["calls", "imports_from", "inherits"]), rng.choice(nodes)[2], rng.choice(nodes)[2], f"src/f{i % 4}.ts") for i in range(150)]
    edges += edges[:9] + [("inherits", "src/f0.ts::main", "src/f0.ts::main", "src/f0.ts")]
    return spark.createDataFrame(nodes, NODE).coalesce(1).persist(), spark.createDataFrame(edges, EDGE).coalesce(1).persist()


def test_grams(spark):
    assert grams_of_pattern("%Cache_Lo%") == ["ach", "cac", "che"] and grams_of_pattern("a%b_") == [] and grams_of_pattern("ÄBC") == ["Äbc"]
    rows = spark.createDataFrame([("abcabc",), ("ab",), ("",), ("ÄBC",)], "t string").select(grams_of(F.col("t")).alias("g")).collect()
    assert [sorted(r.g) for r in rows] == [["abc", "bca", "cab"], [], [], ["Äbc"]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    nodes, edges = graph(spark)
    return nodes, edges, GramIndex.build(nodes, edges, str(tmp_path_factory.mktemp("grams") / "at"), "one")


def test_equal_to_scans(spark, index):
    nodes, edges, grams = index
    for target, pattern, kind in (
        ("cache", "callers_of", None), ("LOAD_cache", "related", "function"), ("f1.ts::m", "inheritance_of", None), ("file::src/f2.ts", "imports_of", None),
        ("straße", "related", None), ("zzz", "related", "function"), ("a", "inheritance_of", None), ("%", "unknown", "function"),
    ):
        got, want = grams.query_graph(pattern, target, 40), query.query_graph(nodes, edges, pattern, target, 40)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], (pattern, target)
        got, want = grams.lexical_search(target, kind, 7), search.lexical_search(nodes, target, kind, 7)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], (kind, target)


def test_reads_few_postings(spark, index):
    _, _, grams = index
    assert grams.terms_like("%token_cache%").count() == 2 and len(grams.grams_read) == 4 and "tok" in grams.grams_read
    files = grams.store.rows("postings", spark.createDataFrame([("tok",)], "gram string")).inputFiles()
    assert len(files) < len(grams.store.read("postings").inputFiles())
    assert grams.terms_like("%qqq%").count() == 0 and grams.grams_read == []
    again = GramIndex.load(spark, grams.store.at)
    assert again.of == "one" and again.terms_like("%a%").count() > 3


def test_empty(spark, tmp_path):
    nodes, edges = graph(spark)
    grams = GramIndex.build(nodes.limit(0), edges.limit(0), str(tmp_path / "at"))
    assert grams.query_graph("related", "main").count() == 0 and grams.lexical_search("a").count() == 0
    assert GramIndex.load(spark, str(tmp_path / "none")) is None
