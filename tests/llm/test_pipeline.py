"""The pipeline's stages against brute force, and what is left without this subpackage."""

import os
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import mixing, simhash, toxicity

from . import test_decontaminate, test_mixing, test_simhash
from .conftest import odd_rows, prose
from .test_toxicity import corpus

public = pytest.importorskip("public_tokenizers")
ROOT = Path(__file__).resolve().parents[2]
PLAN_DEFAULTS = mixing.plan_mix.__defaults__


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    items = [(i, prose(5000 + i, 18)) for i in range(6)]
    rows = [r for r in odd_rows() if r[0] is None or r[0] < 100 or r[0] > 104]
    toxic, labels = corpus(spark, 300)
    rows = [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in rows]
    rows += [(20_000 + i, f"{prose(7000 + i, 60)} {text} {prose(8000 + i, 9)}", "en", f"src{i % 3}") for i, text in items]
    rows += [(30_000, prose(6000, 900) + " " + items[0][1], "en", "src1")]  # too little to count
    docs = toxic.union(spark.createDataFrame(rows, toxic.schema)).selectExpr("*", "cast(length(text) as long) AS n_chars")
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, tables):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], tables).persist())
        assert frames[-1].columns == columns, name
    rows = [f.collect() for f in frames]
    assert all(len(a) > len(b) > 100 for a, b in zip(rows[:3], rows[1:]))
    own = lambda rs: sorted((str(r.doc_id), r.text or "", r.source or "") for r in rs)

    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    finder = toxicity.TermFinder(model.terms)
    clean = [r for r in rows[0] if 1 / (1 + np.exp(-model.logit(finder(r.text)))) < 0.3]
    assert own(clean) == own(rows[1])
    assert not [r for r in rows[1] if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 6 == 0]

    prints = [(r.doc_id, simhash.fingerprint(r.text)) for r in rows[1]]
    found = set(zip(test_simhash.labels_of(prints), test_simhash.component_of(prints)))
    # a row of each component, also of those in which no row has a key, or that share one
    assert len([1 for _, least in found if least is None]) == 2
    assert sorted(str(r.doc_id) for r in rows[2]) == sorted(str(least) for _, least in found)
    assert set(own(rows[2])) <= set(own(rows[1]))

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    hit = {}
    for r in rows[2]:
        n, words, _ = test_decontaminate.brute(r.text, items)
        hit[r.doc_id] = bool(words) and 20 * len(words) >= n
    assert own(rows[3]) == own(r for r in rows[2] if not hit[r.doc_id])
    assert sum(hit.values()) == 6 and 30_000 in {r.doc_id for r in rows[3]}

    size = lambda r: len(test_mixing.WORD.findall(r.text or ""))
    sizes = {}
    for r in rows[3]:
        sizes[r.source] = sizes.get(r.source, 0) + size(r)
    want, got = test_mixing.targets(sizes), dict.fromkeys(sizes, 0)
    before = {}
    for r in rows[3]:
        before.setdefault(str(r.doc_id), []).append(r.text or "")
    for r in rows[4]:
        got[r.source] += size(r)
        assert any(t.startswith(r.text) for t in before[str(r.doc_id)]) and r.n_chars == len(r.text)
    assert all(abs(got[s] - want[s]) <= 0.5 for s in sizes)

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    start, expected = 0, []
    for r in rows[4]:  # in the order of training
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    # copies of a document are apart
    assert not [a for a, b in zip(rows[4], rows[4][1:]) if a.doc_id == b.doc_id is not None and a.text == b.text]
    last = corpus_pipeline.STAGES[-1][1](spark, frames[-1], tables)
    assert sorted((tuple(r) for r in last.collect()), key=lambda r: r[1]) == expected
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, tables).collect()), key=lambda r: r[1]) == expected


def test_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_stands_alone(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'communities' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env=env, timeout=120)


def test_every_operator_is_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_files_are_in_training_order(spark, tables, tmp_path, monkeypatch):
    """The token files follow the mix, through Parquet and without; another schedule, another order."""
    orders = []
    for nr, cycle in enumerate((mixing.SCHEDULE_CYCLE, mixing.SCHEDULE_CYCLE[::-1])):
        monkeypatch.setattr(mixing.plan_mix, "__defaults__", tuple(cycle if d is mixing.SCHEDULE_CYCLE else d for d in PLAN_DEFAULTS))
        docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
        mixed = corpus_pipeline.source_mix(spark, docs, tables)
        want = [r.doc_id for r in mixed.collect()]
        mixed.write.parquet(f"{tmp_path}/{nr}")
        for frame in (spark.read.parquet(f"{tmp_path}/{nr}"), mixed):
            found = corpus_pipeline.token_files(spark, frame, tables).collect()
            assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == want
        orders.append(want)
    assert orders[0] != orders[1] and set(orders[0]) == set(orders[1])
