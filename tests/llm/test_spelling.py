import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import spelling


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_pairs(words):
    return {(a, b) for a in words for b in words if near(a, b)}


def brute_words(rows):
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if k is None else k}:{run}".encode())
            yield run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run


def brute_groups(counts):
    pairs, form = brute_pairs(counts), {}
    by = {}
    for a, b in pairs:
        by.setdefault(a, []).append(b)
    for w, others in by.items():
        best = min(others, key=lambda o: (-counts[o], o))
        if counts[best] >= 10 * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(by.get(w, [])), counts.get(form.get(w))))
    return sorted(map(str, out))


def told(df):
    return sorted(str(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made_up(seed, n, letters="abü", least=1, most=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)}


def test_trie_against_brute_force():
    for seed, most in ((1, 4), (2, 7), (3, 12)):
        words = sorted(made_up(seed, 150, most=most) | {""})
        i, j = spelling.near_rows(np.zeros(len(words), np.int64), words)
        got = [(words[a], words[b]) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(words)
    # groups don't mix
    i, j = spelling.near_rows(np.array([0, 0, 1, 1, 2]), ["aa", "ab", "a", "ac", "aa"])
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (1, 0), (2, 3), (3, 2)]


@pytest.mark.parametrize("crowd", [10**6, 3])
def test_groups_against_brute_force(spark, crowd):
    """With prefixes as they are, and cut again and again."""
    rng = random.Random(crowd)
    words = made_up(7, 300, least=1, most=10) | {"x" * 60 + c for c in "abc"} | {"y" * 300, "y" * 301, "y" * 302} | {"漢字", "漢", "😀漢字", "a>b", "a<b", "a><b"}
    counts = {w: rng.choice([2, 3, 30, 31, 400, 5000]) for w in words}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert told(spelling.spelling_groups(vocab, crowd=crowd)) == brute_groups(counts)


def test_small_steps(spark, monkeypatch):
    """Prefixes that go on in the next batch, and tables of few letters."""
    counts = dict.fromkeys(made_up(11, 400, letters="ab", least=3, most=9), 2)
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.prefixes(vocab).orderBy("size", "prefix", "rest").toPandas()
    monkeypatch.setattr(spelling, "ROWS", 7)
    monkeypatch.setattr(spelling, "CELLS", 30)
    got = [(r.word, r.other) for step in (1, 5, 64) for part in spelling._tries(rows[i : i + step] for i in range(0, len(rows), step)) for r in part.itertuples()]
    assert set(got) == brute_pairs(counts)


def test_chains(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "aabbbbb": 100_000, "zzzzzzz": 5}
    rows = {r.word: r for r in spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {w: r.root for w, r in rows.items()} == {w: "zzzzzzz" if w[0] == "z" else "aabbbbb" for w in counts}
    assert rows["aabbbbb"].form is None and rows["aaaaaaa"].form_n == 10


def test_words(spark, odd):
    source = [(r.doc_id, r.text) for r in odd.collect()]
    source += [(i, f"Straßenbahn ÀÉÎÕÜabc×÷ {'A' * 5000} don't under_score abcdef1ghijklm{i} ÜberraschungĀabcdefgh") for i in range(40)]
    docs = spark.createDataFrame(source, "doc_id long, text string")
    want = Counter(w for w in brute_words(source) if len(w) >= 7)
    assert Counter(r.word for r in spelling.words_of(docs).collect()) == want
    counts = {w: n for w, n in want.items() if n >= 2}
    assert told(spelling.spelling_groups(spelling.vocabulary(spelling.words_of(docs)))) == brute_groups(counts)


def test_empty(spark, odd):
    for docs in (odd.limit(0), odd.filter("text IS NULL")):
        assert spelling.spelling_groups(spelling.vocabulary(spelling.words_of(docs))).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(5)
    source = [(i, " ".join(rng.choice(["Kindergarten", "kindergarden", "Geschichte", "gescichte", "extraordinary", "short"]) for _ in range(200))) for i in range(60)]
    spark.createDataFrame(source, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter(w for w in brute_words(source) if len(w) >= 7)
    got = spelling.op12_spelling_variants(spark, str(tmp_path))
    assert told(got) == brute_groups({w: n for w, n in counts.items() if n >= 2})
    assert got.filter("form IS NOT NULL").count() > 5
