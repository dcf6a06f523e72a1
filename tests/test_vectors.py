import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, vectors
from lodestone.operators.vectors import VectorIndex

SCHEMA = "qualified_name string, kind string, file_path string, vector array<double>"


def made_up(n, seed=1, dims=8, clusters=12):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(f"n{i:05}", f"k{i % 3}", "f", [m + rng.gauss(0, 0.15) for m in rng.choice(middles)]) for i in range(n)]


def scanned(rows, query, kind, limit):
    nodes, vectors = rows.select("qualified_name", "kind", "file_path"), rows.select("qualified_name", "vector")
    return [tuple(r) for r in search.vector_search(nodes, vectors, query, kind, limit).collect()]


def test_equal_to_a_scan(spark, tmp_path):
    data = made_up(900)
    odd = [("z1", "k0", "f", [0.0] * 8), ("z2", "k1", "f", [1.0, 2.0]), ("z3", "k1", "f", []), ("z4", "k2", "f", [1e-12] * 8), ("t1", "k0", "f", data[5][3]), ("t2", "k0", "f", [2 * x for x in data[5][3]])]
    rows = spark.createDataFrame(data + odd, SCHEMA).coalesce(2).persist()
    index = VectorIndex.build(rows, str(tmp_path / "at"))
    assert len(index.lists) > 10
    rng = random.Random(2)
    for query, kind, limit in [(data[5][3], None, 10), (data[77][3], "k1", 3), ([-x for x in data[9][3]], None, 5), ([rng.gauss(0, 1) for _ in range(8)], "k2", 8), ([0.0] * 8, None, 4), ([1.0, 1.0], None, 4)]:
        assert [tuple(r) for r in index.search(query, kind, limit).collect()] == scanned(rows, query, kind, limit), query
    index.search(data[77][3], None, 5)
    assert len(index.lists_read) < len(index.lists) / 2
    assert index.search(data[0][3], "none", 5).count() == 0 and index.search(data[0][3], None, 5000).count() == 906


def test_updates_touch_their_lists(spark, tmp_path):
    data = made_up(900)
    index = VectorIndex.build(spark.createDataFrame(data, SCHEMA), str(tmp_path / "at"))
    before = dict(index.store.manifest["tables"]["vectors"]["buckets"])
    moved = [("n00005", "k9", "f", data[8][3]), ("new", "k0", "f", data[8][3])]
    index = index.updated(spark.createDataFrame(moved, SCHEMA), spark.createDataFrame([("n00008",), ("none",)], "qualified_name string"))
    after = index.store.manifest["tables"]["vectors"]["buckets"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 3
    now = spark.createDataFrame([r for r in data if r[0] not in ("n00005", "n00008")] + moved, SCHEMA)
    again = VectorIndex.load(spark, str(tmp_path / "at"))
    for query in (data[8][3], data[400][3]):
        assert [tuple(r) for r in again.search(query, None, 12).collect()] == scanned(now, query, None, 12)


@pytest.mark.parametrize("data", [[], [("a", "k", "f", None)], [("a", "k", "f", [1.0, 0.0])]])
def test_few(spark, tmp_path, data):
    index = VectorIndex.build(spark.createDataFrame(data, SCHEMA), str(tmp_path / "at"), "me")
    assert index.search([1.0, 1.0], None, 3).count() == len(data) and index.of == "me"
    assert VectorIndex.load(spark, str(tmp_path / "none")) is None


def test_vectors_are_placed_once(spark, tmp_path, monkeypatch):
    """Placing goes through one pass in Python and no table of centroids is joined; lists tell of what is stored."""
    placed, summed = [], []
    monkeypatch.setattr(vectors, "_placed", lambda *a, f=vectors._placed: placed.append(f(*a)) or placed[-1])
    monkeypatch.setattr(vectors, "_summaries", lambda *a, f=vectors._summaries: summed.append(a[0]) or f(*a))
    index = VectorIndex.build(spark.createDataFrame(made_up(300), SCHEMA), str(tmp_path / "at"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(placed[0]).count("ArrowEvalPython") == 1 and "Join" not in plan(placed[0])
    assert "ArrowEvalPython" not in plan(summed[0]) and "FileScan parquet" in plan(summed[0])
    assert sum(r.n for r in index.lists.values()) == 300


def test_placed_as_worked_out_one_by_one(spark, monkeypatch):
    """Nearest centroids, the first of equal ones, over steps of few rows; odd vectors have no list."""
    monkeypatch.setattr(vectors, "PRODUCTS", 8)
    middles = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [-0.5, 0.5, 0.5]]
    rng = random.Random(4)
    data = [(f"n{i:03}", "k", "f", [rng.gauss(0, 1) for _ in range(3)]) for i in range(50)]
    odd = [("a", "k", "f", None), ("b", "k", "f", []), ("c", "k", "f", [0.0] * 3), ("d", "k", "f", [1.0] * 4), ("e", "k", "f", [1.0, None, 0.0]), ("g", "k", "f", [float("nan"), 1.0, 0.0]), ("h", "k", "f", [float("inf"), 1.0, 0.0]), ("i", "k", "f", [1e-9, 0.0, 0.0]), ("j", "k", "f", [0.0, 3.0, 0.0])]
    rows = vectors._measured(spark.createDataFrame(data + odd, SCHEMA).repartition(3))
    got = {r.qualified_name: r for r in vectors._placed(rows, middles, 3).collect()}
    for name, _, _, v in data:
        unit = [x / math.hypot(*v) for x in v]
        away = [math.dist(unit, c) for c in middles]
        assert got[name].list == away.index(min(away)) and math.isclose(got[name].away, min(away), rel_tol=1e-9)
    assert [got[x].list for x in "abcdeghi"] == [-1] * 8 and [got[x].away for x in "abcdghi"] == [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    assert (got["j"].list, got["j"].away) == (1, 0.0)
    assert vectors._placed(rows.limit(0), middles, 3).count() == 0
