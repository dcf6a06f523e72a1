import random
from pathlib import Path

from lodestone.operators import text
from lodestone.operators.words import WordIndex, words_of

LINES = ["function foo() {}", "foo(foo);", "foobar éfoo", "  const foo = a.b", "class foo", "type foo = x", "\tdef foo(self):", "a.b a. b", "x$y $y", "föö foo_1 1foo", "", "foo\r", "let c = 'foo'"]


def files(spark, seed, n=12):
    rng = random.Random(seed)
    rows = [(f"{d}/f{i}.ts", "\n".join(rng.choice(LINES) for _ in range(rng.randrange(12))) + rng.choice(["", "\n"])) for i in range(n) for d in (["src", "tests"][i % 2],)]
    return rows + [("none.ts", None), ("empty.ts", "")]


def own(df):
    return [tuple(r) for r in df.collect()]


def same(spark, index, rows, symbols):
    frame = spark.createDataFrame(rows, "path string, content string").coalesce(1)
    for symbol in symbols:
        assert own(index.refactor_preview(symbol, 50)) == own(text.refactor_preview(frame, symbol, 50)), symbol
        assert own(index.refactor_totals(symbol)) == own(text.refactor_totals(frame, symbol)), symbol
        for got, want in zip(index.query_symbol(symbol), text.query_symbol(frame, symbol)):
            assert sorted(own(got)) == sorted(own(want)), symbol


def test_equal_to_scans(spark, tmp_path):
    assert words_of("a.b $c") == ["a", "b", "c"] and words_of("$") == []
    rows = files(spark, 1)
    index = WordIndex.build(spark.createDataFrame(rows, "path string, content string").coalesce(1), str(tmp_path / "at"))
    same(spark, index, rows, ["foo", "a.b", "$"])
    # another body, a new file, one that is gone
    newer = [(p, c) for p, c in rows if p != "src/f2.ts"]
    newer[0] = (newer[0][0], "class foo\nlet föö = 1\n")
    newer.append(("src/new.ts", "foo a.b\n"))
    change = spark.createDataFrame([newer[0], newer[-1]], "path string, content string")
    index.updated(change, spark.createDataFrame([("src/f2.ts",)], "file_path string"))
    again = WordIndex.load(spark, str(tmp_path / "at"))
    same(spark, again, newer, ["föö"])
    plan = again.symbol_lines("foo")._jdf.queryExecution().toString()
    assert "content" not in plan and len(again.symbol_lines("new").inputFiles()) < len(again.store.read("lines").inputFiles())


def test_empty(spark, tmp_path):
    index = WordIndex.build(spark.createDataFrame([("a", None)], "path string, content string"), str(tmp_path / "at"))
    assert index.refactor_preview("foo").count() == 0 and WordIndex.load(spark, str(tmp_path / "none")) is None


def test_postings_name_buckets(spark, tmp_path):
    """However many files hold a word, its postings are as many as buckets at most; lines are kept once."""
    rows = [(f"src/f{i}.ts", f"alpha beta\nalpha gamma\nonly{i}") for i in range(300)]
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.rglob("rdd-*"))
    index = WordIndex.build(spark.createDataFrame(rows, "path string, content string"), str(tmp_path / "at"))
    assert set(shared.rglob("rdd-*")) == before
    counts = {r.word: r["count"] for r in index.store.read("places").groupBy("word").count().collect()}
    assert len(counts) == 303 and {counts[f"only{i}"] for i in range(300)} == {1}
    assert max(counts.values()) <= index.store.manifest["buckets"]
    assert own(index.refactor_preview("only7")) == [("src/f7.ts", 3, "only7")] and index.refactor_preview("beta", 1000).count() == 300
    assert len(index.symbol_lines("only7").inputFiles()) < len(index.store.read("lines").inputFiles())


def test_symbols_by_buckets(spark, tmp_path):
    """A symbol of words in several buckets is found in whole, and only buckets that hold all its words are read."""
    rows = [(f"src/f{i}.ts", f"a.b\na\nb{i}.x{i}") for i in range(60)]
    index = WordIndex.build(spark.createDataFrame(rows, "path string, content string"), str(tmp_path / "at"))
    assert index.store.read("places").columns == ["word", "place"]
    assert sorted(own(index.query_symbol("a.b")[1])) == sorted(own(text.query_symbol(spark.createDataFrame(rows, "path string, content string"), "a.b")[1]))
    assert [r[:2] for r in own(index.query_symbol("b7.x7")[1])] == [("src/f7.ts", 3)] and len(index.symbol_lines("b7.x7").inputFiles()) == 1
