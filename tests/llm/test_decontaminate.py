import pickle
import random
import re

from lodestone.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(own) - m + 1):
                if own[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    names.add(name)
    return len(own), hit, sorted(names)


def cases():
    rng = random.Random(5)
    vocabulary = ["a", "B", "ç", "zz9", "Ü", "the"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(i), text(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 40, 0])] + [("3", text(13)), ("", text(15))]
    texts = [text(n) for n in (0, 1, 4, 13, 30, 200)] + [f"{text(9)} {i[1]} {text(4)}" for i in items] + [None, "", "!!"]
    long = [(f"L{i}", " ".join(f"w{rng.randrange(4)}" for _ in range(18))) for i in range(3)]
    return items, long, texts + [f"x {i[1]} y {i[1]}" for i in long]


def check(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = d.contamination(docs, bench, **options).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, names = brute(texts[r.doc_id], items, options.get("window", 13))
        assert (r.n_words, r.n_hit, r.items) == (n, len(hit), names)
        assert {k for s in r.stretches for k in range(s.start, s.end)} == hit


def test_against_brute_force(spark):
    items, long, texts = cases()
    check(spark, texts, items)
    check(spark, texts, long)  # no short items: long shifts
    check(spark, texts, items + long, window=4)
    check(spark, texts, items + long, part_words=30)  # in several parts


def test_shifts():
    rng = random.Random(9)
    item = [f"w{rng.randrange(5)}".encode() for _ in range(30)]
    whole = d.Matcher([("x", item)], 13)
    (matcher,) = whole.matchers
    patterns = {tuple(item[i : i + 13]) for i in range(18)}
    text = [f"w{rng.randrange(5)}".encode() for _ in range(3000)] + item + [b"z"] * 12
    ids = [whole.words.get(w, 0) for w in text]
    assert [s for s, _ in matcher.occurrences(ids)] == [i for i in range(len(text) - 12) if tuple(text[i : i + 13]) in patterns]
    # a block of no window lets it move by all but a word; the item's first blocks by less and less
    assert matcher.default == 12 and sorted(matcher.shifts)[-1] <= 11 and 0 in matcher.shifts


def test_matcher_against_brute_force():
    """Short and repeated items, few different words, after a round trip as the broadcast makes it."""
    rng = random.Random(1)
    for _ in range(150):
        alphabet, window = rng.choice([2, 3, 6, 30]), rng.choice([1, 2, 3, 13])
        draw = lambda n: [b"w%d" % rng.randrange(alphabet) for _ in range(n)]
        items = [(str(rng.randrange(8)), draw(rng.randrange(30))) for _ in range(rng.randrange(6))]
        doc = draw(rng.randrange(80))
        if items and rng.random() < 0.5:
            doc += rng.choice(items)[1] + draw(3)
        hit, names = set(), set()
        for name, w in items:
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for k in range(len(doc) - m + 1):
                    if doc[k : k + m] == w[i : i + m]:
                        hit |= set(range(k, k + m))
                        names.add(name)
        stretches, found = pickle.loads(pickle.dumps(d.Matcher(items, window))).match(doc)
        assert {k for a, b in stretches for k in range(a, b)} == hit and found == names


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(None, None), (None, "one"), (1, "")], "item_id long, text string")
    rows = d.contamination(odd, bench).collect()
    assert len(rows) == odd.count() and {r.doc_id for r in rows if r.n_hit} == {103} and all(r.n_words == len(words(r.text)) for r in rows)
    for empty in (bench.limit(0), bench.filter("text = ''")):
        assert all(r.n_hit == 0 and r.items == [] for r in d.contamination(odd, empty).collect())
    assert d.contamination(odd.limit(0), bench).count() == 0
    kept = d.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
