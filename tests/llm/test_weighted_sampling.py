import hashlib
import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lodestone.llm import weighted_sampling as w


def bag(text):
    return Counter(x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x)


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_terms(spark):
    texts = ["a b a  c\tb a", "", None, " \n", "one", "é É é"]
    rows = w.with_terms(spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("t", F.coalesce("t", F.lit(""))), "t")
    got = {}
    for r in rows.collect():
        got.setdefault(r.i, Counter())
        if r._term is not None:
            got[r.i][r._weight] += 1
    assert got == {i: Counter(float(n) for n in bag(t).values()) for i, t in enumerate(texts)}


def test_collision_rate(spark):
    """Signatures of weighted sets agree as often as their generalised Jaccard similarity says."""
    sets = [{k: 1.0 + k % 3 for k in range(40)}, {k: 1.0 + (k + 1) % 3 for k in range(10, 50)}, {k: 5.0 for k in range(30)}, {k: 0.3 * (1 + k % 5) for k in range(20, 60)}]
    n = 512
    terms = spark.createDataFrame([(i, k, x) for i, s in enumerate(sets) for k, x in s.items()], "i long, _term long, _weight double")
    parts = [{r.i: r._signature for r in w.signatures(terms.withColumn("_term", F.xxhash64("_term", F.lit(seed))), ["i"], 32).collect()} for seed in range(n // 32)]
    signature = {i: [x for p in parts for x in p[i]] for i in range(4)}
    for i in range(4):
        for j in range(i):
            keys = set(sets[i]) | set(sets[j])
            want = sum(min(sets[i].get(k, 0), sets[j].get(k, 0)) for k in keys) / sum(max(sets[i].get(k, 0), sets[j].get(k, 0)) for k in keys)
            rate = sum(a == b for a, b in zip(signature[i], signature[j])) / n
            assert abs(rate - want) < 0.07, (i, j, rate, want)


def hash_of(data):
    return xxhash.xxh64_intdigest(data, seed=42)


def drawn(word, weight, number):
    """ln a of a word by the textbook's draws of r, c and b, made from the same hashes."""
    term = hash_of(word.encode())
    one, two = (hash_of((term ^ hash_of((2 * number + k).to_bytes(4, "little"))).to_bytes(8, "little")) for k in (0, 1))
    p, q, y = -math.log1p(-((one >> 64 - w.DIGITS) + 0.5) / 2**w.DIGITS), -math.log(((two >> 32) + 0.5) / 2**32), -math.log(((two & 0xFFFFFFFF) + 0.5) / 2**32)
    c, x = p + q, math.log((p + q) / p)
    r, b = x + y, y / (x + y)
    t = math.floor(math.log(weight) / r + b)
    return math.log(c) - r * (t - b + 1)


def test_against_a_plain_sampler(spark):
    """Every sample of a signature is the least a over the text's words."""
    texts = ["a b a c a", "one", "x y z " * 9 + "w", "é É é ü"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in w.signatures(w.with_terms(df.select("i", F.col("t").alias("_text")), "_text"), ["i"]).collect():
        for number, found in enumerate(r._signature):
            least = min(drawn(word, n, number) for word, n in bag(texts[r.i]).items())
            assert found == int(-math.expm1(-math.exp(least)) * 2**w.DIGITS)


def test_draws_are_gamma_and_uniform():
    """The derived r, c and b have the moments of Gamma(2, 1), Gamma(2, 1) and [0, 1), and a that of Exp(w)."""
    rng = random.Random(3)
    rows = []
    for _ in range(40_000):
        p, q, y = (rng.expovariate(1) for _ in range(3))
        x = math.log((p + q) / p)
        rows.append((x + y, p + q, y / (x + y)))
    mean = lambda f: sum(map(f, rows)) / len(rows)
    for got, want in ((mean(lambda v: v[0]), 2), (mean(lambda v: v[1]), 2), (mean(lambda v: v[2]), 0.5), (mean(lambda v: v[0] ** 2), 6), (mean(lambda v: v[1] ** 2), 6), (mean(lambda v: v[0] * v[1]), 4), (mean(lambda v: v[0] * v[2]), 1), (mean(lambda v: v[1] * v[2]), 1)):
        assert abs(got / want - 1) < 0.05
    for weight in (1, 2, 5, 0.3):
        a = [math.exp(drawn(f"w{i}", weight, 7)) for i in range(20_000)]
        assert abs(sum(a) / len(a) * weight - 1) < 0.04


def check(df):
    rows = [r.asDict() for r in w.fingerprints(df).collect()]
    want = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    expected, alike = [], []
    for i, (doc, text) in enumerate(want):
        after = want[(i + 1) % len(want)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest()))
        alike.append((text, edited, after))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(expected)
    by = {(str(r["doc_id"]), r["n_chars"], r["edited_sha256"]): r for r in rows}
    for key, (text, edited, after) in zip(expected, alike):
        if expected.count(key) > 1:  # rows alike but for what follows
            continue
        r = by[key]
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = bag(text), bag(other)
            assert near == 1.0 if a == b else near == 0.0 if not (a and b) else abs(near - jaccard(a, b)) < 0.45
        if bag(text) == bag(edited):
            assert r["fingerprint"] == r["edited_fingerprint"]
    return by


def test_odd_rows(odd):
    by = check(odd)
    assert len({r["fingerprint"] for k, r in by.items() if k[0] in ("3", "105", "106")}) == 1
    assert w.fingerprints(odd.limit(0)).count() == 0


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(w, "RANGE_ROWS", 3)
    rows = [(i * i % 97 * 1000 - 5 if i % 9 else None, f"w{i} w{i % 4} x y z" * (i % 5)) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    check(spark.createDataFrame([(1, "only one")], "doc_id long, text string"))
    check(spark.createDataFrame([(None, "no id"), (None, "none either")], "doc_id long, text string"))


def dealt(rows, key="doc_id"):
    """Own rows by range, and ranges by task."""
    frame = w._in_ranges(rows.select(F.col(key), F.coalesce("text", F.lit("")).alias("_text")), key).withColumn("task", F.spark_partition_id())
    own = Counter(r._range for r in frame.collect() if not r._ghost)
    return own, Counter(r.task for r in frame.select("task", "_range").distinct().collect())


def test_tasks_get_as_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(w, "RANGE_ROWS", 4)
    own, tasks = dealt(spark.createDataFrame([(i * 7, f"w{i}") for i in range(160)], "doc_id long, text string").repartition(3))
    assert len(own) == 40 and sorted(tasks.values()) == [10] * 4


def test_keys_that_fill_several_ranges(spark, monkeypatch):
    """A key of a third of the rows, no key, and long keys that are one as doubles."""
    monkeypatch.setattr(w, "RANGE_ROWS", 8)
    big = 2**62
    for keys in ([7] * 3 + [None] * 2 + ["own"] * 3, [None], [7], [big, big + 1, big + 1, "own"], [-(2**63), "own"], [2**63 - 1, 2**63 - 1, "own", None]):
        rows = [(i * 11 if (k := keys[i % len(keys)]) == "own" else k, f"{chr(0x61 + i * 37 % 26)}{i * i % 83} ü漢😀 {i} same" if i % 31 else None) for i in range(200)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        check(df)
        own, _ = dealt(df)
        assert sum(own.values()) == 200 and max(own.values()) <= 20, (keys, own)


def test_copies_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(w, "RANGE_ROWS", 5)
    rows = [(3, "a copy of a text")] * 40 + [(None, None)] * 30 + [(i, f"t{i} u") for i in range(30)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_error_of_likeness(spark):
    """As many samples as keep likenesses near exact generalised Jaccard."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(120)) for _ in range(150)]
    # each followed by a near copy of itself
    texts = [x for t in texts for x in (" ".join(t.split()[: rng.randrange(20, 121)] + [f"v{rng.randrange(9)}"]), t)]
    rows = {r.doc_id: r for r in w.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    off = []
    for i, t in enumerate(texts):
        after = texts[i - 1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        off += [abs(rows[i].near_edited - jaccard(bag(t), bag(edited))), abs(rows[i].near_next - jaccard(bag(t), bag(after)))]
    assert sum(off) / len(off) < 0.06 and sum(x > 0.1 for x in off) < 0.2 * len(off) and max(off) < 0.3
