import pytest
from pyspark.sql import functions as F

from lodestone.operators import search

NODE = "kind string, name string, qualified_name string, file_path string"


def service(at, fails=()):
    """A model that notes each text it is asked for, as a file; a text of `fails` fails its batch."""
    import hashlib
    import pathlib
    import uuid

    def remote(texts):
        for t in texts:
            pathlib.Path(at, uuid.uuid4().hex).write_text(t)
        if any(f in t for t in texts for f in fails):
            raise OSError("no service")
        return [[float(b) for b in hashlib.sha256(t.encode()).digest()[:4]] for t in texts]

    return remote


def asked(at):
    out = sorted(p.read_text() for p in at.iterdir())
    for p in at.iterdir():
        p.unlink()
    return out


@pytest.fixture
def at(tmp_path):
    (tmp_path / "asked").mkdir()
    return tmp_path / "asked"


def nodes(spark, *names):
    return spark.createDataFrame([("function", n, f"a::{n}", "a") for n in names] + [("file", "a", "file::a", "a")], NODE)


def test_what_is_known_is_not_asked_for(spark, at):
    first = search.embed_nodes(nodes(spark, "f", "g"), "svc", service(at)).persist()
    assert first.count() == 2 and first.filter("fallback").count() == 0 and len(asked(at)) == 2
    assert first.count() == 2 and asked(at) == []  # rows that are used again cause no request
    again = search.embed_nodes(nodes(spark, "f", "g", "h"), "svc", service(at), first)
    assert {r.qualified_name: r.vector for r in again.collect()}.items() >= {r.qualified_name: r.vector for r in first.collect()}.items()
    assert asked(at) == ["function h a::h a"]
    # another model knows nothing of it; one text of many symbols is asked for once
    other = search.embed_nodes(nodes(spark, "f").union(nodes(spark, "f")), "other", service(at), first)
    assert other.count() == 2 and asked(at) == ["function f a::f a"]


def test_failures_are_told_apart(spark, at):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = search.embed_nodes(nodes(spark, "f", "bad", "g"), "svc", service(at, ("bad",)), attempts=2)
        got = {r.qualified_name: r for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {n: r.fallback for n, r in got.items()} == {"a::f": False, "a::bad": True, "a::g": False}
    assert len(got["a::bad"].vector) == 64 and len(got["a::f"].vector) == 4
    assert sum("bad" in t for t in asked(at)) == 2
    # the next run asks for what failed alone, and searches go by true vectors alone
    again = search.embed_nodes(nodes(spark, "f", "bad", "g"), "svc", service(at), rows)
    assert again.filter("fallback").count() == 0 and asked(at) == ["function bad a::bad a"]
    assert search.own_space(rows).count() == 2
    none = search.embed_nodes(nodes(spark, "f"), "svc", service(at, ("f",)), attempts=1)
    assert [r.score for r in search.semantic_search(nodes(spark, "f"), none, "f", "function", 5, "svc").collect()] == [1.0]  # by name


def test_services_that_answer_too_little(spark, at):
    rows = search.embed_nodes(nodes(spark, "f", "g"), "svc", lambda texts: [], attempts=1)
    assert rows.filter(F.col("fallback")).count() == 2
