import io
import json
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import simple8b, tokens

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 1) | st.integers(0, 70_000), max_size=400), st.integers(1, 4))
def test_codec(values, times):
    values = values * times
    escapes = []
    words, sizes = simple8b.encode(np.array(values, np.uint64), escapes)
    assert simple8b.decode(words, sizes, len(values), np.array(escapes, np.uint64)).tolist() == values


def test_greedy_words():
    rng = random.Random(1)
    ids = [rng.choice([0, 1, 3, 200, 5000, 40_000, 2**40]) for _ in range(3000)]
    want = 0
    for b in range(0, len(ids), simple8b.BLOCK):
        block, i = ids[b : b + simple8b.BLOCK], 0
        while i < len(block):
            i += max(int(c) for c, bits in zip(simple8b.COUNTS[1:], simple8b.BITS[1:]) if all(x < 1 << int(bits) for x in block[i : i + c]))
            want += 1
    words, sizes = simple8b.encode(np.array(ids, np.uint64), [])
    assert len(words) == want == sizes.sum()


def test_file(monkeypatch):
    monkeypatch.setattr(simple8b.Writer, "STEP", simple8b.BLOCK * 2)
    rng = np.random.default_rng(0)
    docs = [(i if i != 5 else None, rng.integers(0, [60_000, 4, 2**63][i % 3], n).astype(np.uint64)) for i, n in enumerate([0, 1, 5000, 3, 1024, 2047, 0, 9000, 1])]
    file = io.BytesIO()
    writer = simple8b.Writer(file)
    for part in (docs[:3], docs[3:4], docs[4:]):
        writer.add([d for d, _ in part], np.concatenate([i for _, i in part]), np.array([len(i) for _, i in part]))
    writer.close()
    for blocks in (1, 3, 1000):
        got, parts = [], []
        for doc, ended, ids in simple8b.read(file, blocks):
            parts.append(ids)
            if ended:
                got.append((doc, np.concatenate(parts).tolist()))
                parts = []
        assert got == [(d, i.tolist()) for d, i in docs] and not parts
    empty = io.BytesIO()
    simple8b.Writer(empty).close()
    assert list(simple8b.read(empty)) == []
    with pytest.raises(ValueError):
        list(simple8b.read(io.BytesIO(b"x" * 100)))


TEXTS = ["", " ", "Hello, World! it's 12 dogs'll", "A\nb\tc\r\nd  e", "<|endoftext|>x <|startoftext|>", "ÉCOLE Straße İstanbul ΣΑΣ é ́x", "漢字 かな 😀😀", "a\x1cb\x85c\xa0d e", "don't we'RE (ok)...", "naïve,co-op;x=1", "x" * 300, "µm ªº ÷× Àÿ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(TEXTS) | st.text(alphabet="aB'é ,.\n-1", max_size=30), max_size=8))
def test_chunks_equal_whole_texts(texts):
    encoder = tokens.encoder_for(PATH)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    encoder = tokens.ChunkEncoder(PATH)
    for _ in range(2):
        for t in TEXTS:
            assert encoder.encode(pa.array([t]))[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_round_trip(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    start, want = 0, []
    for known, doc, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokens.tokenize(spark, odd, PATH)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    assert tokens.tokenize(spark, odd.limit(0), PATH).count() == 0


def test_files_in_order(spark, docs, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = f"file://{tmp_path}/files"
        manifest = tokens.write_token_files(docs, out, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 1 and json.loads((tmp_path / "files/manifest.json").read_text())["files"] == manifest
    assert sorted(os.listdir(tmp_path / "files")) == sorted([m["name"] for m in manifest] + ["manifest.json"])
    last, at = None, 0
    for m in manifest:
        assert m["start"] == at
        at += m["ids"]
        with open(tmp_path / "files" / m["name"], "rb") as f:
            keys = [d for d, ended, _ in simple8b.read(f) if ended and d is not None]
        assert keys == sorted(keys) and (last is None or not keys or keys[0] >= last)
        last = keys[-1] if keys else last
    # a leftover of a task that failed isn't read
    (tmp_path / "files/part-000000-left.s8b").write_bytes(b"broken")
    assert tokens.read_token_files(spark, out).count() == docs.count()
