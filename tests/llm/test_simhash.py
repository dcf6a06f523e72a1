import random

import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import components

from .conftest import prose


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels_of(prints):
    """A number for each (key, fingerprint) pair, the same for those that links connect."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i][1] ^ prints[j][1]) & (2**64 - 1)).count("1") <= 3:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def component_of(prints):
    """prints: (key, fingerprint) pairs; the least key reachable."""
    labels, least = labels_of(prints), {}
    for label, (k, _) in zip(labels, prints):
        least.setdefault(label, []).append(k)
    return [min((k for k in least[label] if k is not None), default=None) for label in labels]


def test_fingerprints(odd):
    for r in odd.collect():
        assert simhash.fingerprint(r.text) & (2**64 - 1) == brute(r.text)
    assert simhash.fingerprint("A b\x0bC") == simhash.fingerprint(" a\tB c ") and simhash.fingerprint(" ") != 0
    simhash.TEXT_STEP, step = 50, simhash.TEXT_STEP
    try:
        long = " ".join(f"w{i % 89}" for i in range(2000))
        assert simhash.fingerprint(long) & (2**64 - 1) == brute(long)
    finally:
        simhash.TEXT_STEP = step


def test_near_duplicates(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    prints = [(r.doc_id, r.fingerprint) for r in rows]
    want = component_of(prints)
    assert [r.component_id for r in rows] == want
    kept = simhash.keep_one(odd).collect()
    # a row of each component, two of which have the key 7 for unlike texts
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(str(k) for _, k in set(zip(labels_of(prints), want)))
    assert len([r for r in kept if r.doc_id == 7]) == 2
    assert kept[0].asDict().keys() == odd.first().asDict().keys()
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_crowded_entries_lose_and_add_nothing(spark):
    """Crowds of fingerprints few bits apart, linked through common points as well as by pairs."""
    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
            prints.add(x - 2**64 if x >= 2**63 else x)
    prints = sorted(prints)
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = component_of([(i, p) for i, p in enumerate(prints)])
    for crowd in (10**6, 3, 0):
        found = {r.node: r.component for r in components(simhash.links(fps, crowd)).collect()}
        least = {}
        for i, p in enumerate(prints):
            least.setdefault(found.get(p, p), i)
        assert [least[found.get(p, p)] for p in prints] == want, crowd
        for r in simhash.links(fps, crowd).collect():
            assert bin((r.fp ^ r.other) & (2**64 - 1)).count("1") <= 3


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (5, 5), (200, 200), (None, 3), (101, 103)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_without_a_key_keep_their_own(spark):
    """One row of each component stays, of unlike texts with one key or without any one each; reruns agree."""
    unlike = [prose(i, 40) for i in range(12)]
    rows = [(None, t, s) for t in unlike for s in ("a", "b", "b")] + [(5, unlike[0], "a"), (3, unlike[1], "b"), (9, unlike[1], "a"), (7, prose(50, 40), "a"), (7, prose(51, 40), "a")]
    kept = [sorted(map(tuple, simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(n)).collect()), key=str) for order, n in ((rows, 3), (rows[::-1], 4))]
    assert kept[0] == kept[1]
    assert sorted(t for k, t, _ in kept[0] if k is None) == sorted(unlike[2:])
    assert sorted(k for k, *_ in kept[0] if k is not None) == [3, 5, 7, 7]
