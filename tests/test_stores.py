import http.server
import json
import os
import threading
from pathlib import Path

import pytest

from lodestone.graph import CodeGraph
from lodestone.operators import repos, search
from lodestone.schemas import REPOS
from lodestone.sources import embedding, snapshot, stores
from lodestone.sources.buckets import WriterConflict
from lodestone.sources.config import SnapshotConfig


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry.json")
    assert stores.load_registry(spark, path).count() == 0
    one = spark.createDataFrame([("b", "/b", 1, 2, "t"), ("a", "/a", 3, 4, "t")], REPOS)
    stores.save_registry(one, path)
    assert [r["alias"] for r in json.loads((tmp_path / "registry.json").read_text())] == ["a", "b"]
    again = stores.load_registry(spark, path)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in one.collect()}
    new = spark.createDataFrame([("a", "/c", 0, 0, "u")], REPOS)
    assert {(r.alias, r.path) for r in repos.upsert(again, new).collect()} == {("a", "/c"), ("b", "/b")}
    assert {(r.alias, r.path) for r in stores.merged(again, new, ["alias"]).collect()} == {("a", "/c"), ("b", "/b")}
    (tmp_path / "registry.json").write_text("[{")
    with pytest.raises(Exception):
        stores.load_registry(spark, path).collect()


def test_wiki_and_renames(spark, tmp_path):
    pages = spark.createDataFrame([("a-b", "one"), ("c", "two")], "page string, body string")
    assert stores.write_wiki(pages, str(tmp_path / "w")) == 2 and stores.write_wiki(pages, str(tmp_path / "w")) == 0 and stores.write_wiki(pages, str(tmp_path / "w"), True) == 2
    assert stores.read_wiki_page(spark, str(tmp_path / "w"), "a b") == "one"
    with pytest.raises(OSError):
        stores.read_wiki_page(spark, str(tmp_path / "w"), "none")
    (tmp_path / "x.py").write_text("old")
    assert stores.write_refactored(spark.createDataFrame([("x.py", "new"), ("gone.py", "new")], "path string, new_content string"), str(tmp_path)) == 1
    assert (tmp_path / "x.py").read_text() == "new" and not (tmp_path / "gone.py").exists()


def test_status(spark):
    assert tuple(stores.snapshot_status(None, spark).first()) == (False, 0, 0, [])
    rows = spark.createDataFrame([("a", 2, "full"), ("b", 3, "summary")], "path string, size long, mode string")
    assert tuple(stores.snapshot_status(rows, spark).first()) == (True, 2, 5, ["full", "summary"])


def test_embedding_services(spark, monkeypatch):
    assert embedding.client("hash-v1") is None and embedding.client("ollama: ") is None

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            many = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body.get("input", []))]
            answer = json.dumps({"embedding": [float(len(body.get("prompt", ""))), 2.0], "data": many[::-1]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setenv("OLLAMA_BASE_URL", base)
    monkeypatch.setenv("OPENAI_BASE_URL", base)
    monkeypatch.setenv("OPENAI_API_KEY", "test")
    assert embedding.client("ollama:m")(["ab", "c"]) == [[2.0, 2.0], [1.0, 2.0]]
    assert embedding.client("openai:m")(["ab", "c"]) == [[2.0, 1.0], [1.0, 1.0]]
    server.shutdown()
    monkeypatch.setenv("OLLAMA_BASE_URL", "http://127.0.0.1:9")
    nodes = spark.createDataFrame([("function", "f", "a::f", "a")], "kind string, name string, qualified_name string, file_path string")
    local = search.embed_nodes(nodes).first().vector
    assert search.embed_nodes(nodes, "ollama:m", embedding.client("ollama:m")).first().vector == local


def test_incremental_saves(spark, tmp_path):
    """load, update, save to the same place, load: equal to a full build; a save that fails changes nothing."""
    root, at, config = tmp_path / "repo", str(tmp_path / "store"), SnapshotConfig()
    root.mkdir()
    (root / "a.py").write_text("from b import g\n\ndef f():\n    g()\n")
    (root / "b.py").write_text("def g():\n    pass\n")
    (root / "c.py").write_text("def gone():\n    pass\n")
    take = lambda old: snapshot.refresh(snapshot.list_files(spark, str(root), config), old, config, str(root)).drop("changed")
    own = lambda g: (sorted(map(str, g.nodes.select("kind", "qualified_name", "line_start", "line_end").collect())), sorted(map(str, g.edges.select("kind", "source", "target").collect())))
    CodeGraph.build(take(None)).save(at)
    before = own(CodeGraph.load(spark, at))
    for step in range(3):
        (root / "b.py").write_text("def g():\n    h()\n\ndef h():\n    pass\n" + f"\ndef more{step}():\n    g()\n")
        (root / "c.py").unlink(missing_ok=True)
        old = CodeGraph.load(spark, at)
        old.updated(take(old.files)).save(at)
        full = CodeGraph.build(take(None))
        assert own(CodeGraph.load(spark, at)) == own(full) != before
    held = own(CodeGraph.load(spark, at))
    assert spark.read.parquet(f"{at}/edges").count() and CodeGraph.load(spark, at).status().first()["exists"]
    broken = CodeGraph.load(spark, at)
    broken.edges = broken.edges.selectExpr("raise_error('stop') AS kind", "source", "target", "file_path")
    with pytest.raises(Exception):
        broken.save(at)
    assert own(CodeGraph.load(spark, at)) == held
    # a snapshot that can't be read is none
    snapshot.save_snapshot(take(None), f"{at}-files")
    for part in Path(snapshot.generation_dir(spark, f"{at}-files"), "files").glob("*.parquet"):
        part.write_text("not parquet")
    assert snapshot.load_snapshot(spark, f"{at}-files") is None


def test_two_writers_of_a_generation(spark, tmp_path):
    at = str(tmp_path / "store")
    one = lambda n: lambda to: spark.range(n).write.parquet(f"{to}/t")
    snapshot.save_generation(spark, at, one(1))

    def late(to):
        snapshot.save_generation(spark, at, one(2))  # another writer is done first
        one(3)(to)

    with pytest.raises(WriterConflict):
        snapshot.save_generation(spark, at, late)
    assert snapshot.load_tables(spark, at, "t")[0].count() == 2
    assert sorted(n.split("-")[:2] for n in os.listdir(at) if not n.startswith(".")) == [["complete", "1"], ["complete", "2"], ["generation", "1"], ["generation", "2"]]
    for n in (4, 5):
        snapshot.save_generation(spark, at, one(n))
    assert snapshot.load_tables(spark, at, "t")[0].count() == 5 and len([n for n in os.listdir(at) if n.startswith("generation")]) == 2
