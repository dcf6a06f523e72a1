import re
import textwrap
import time

import pytest

from lodestone.llm import licenses
from lodestone.llm.licenses import TEMPLATES, bigrams_of

MIT = TEMPLATES["MIT"][3]
CASES = [
    "Released under the MIT License.",
    "intro\nreleased UNDER the mit license\nmore text",
    "Some code here. Licensed under the Apache License, Version 2.0. More follows.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 2.",
    MIT, MIT.replace("without restriction", "freely"), "\n".join(MIT[i : i + 60] for i in range(0, len(MIT), 60)) + "\n\nclass X {}",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.",
    "the license of this is unknown", "software is great and permission is nice", "", None, " \n ", "MIT", "x " * 5000 + "\nReleased under the MIT License.",
    TEMPLATES["BSD"][1] + "\n" + TEMPLATES["MPL-2.0"][0],
]


def passages(text):
    lines = re.split(r"\r?\n", text)
    return list(dict.fromkeys([*lines, *(s for line in lines for s in re.split(r"(?<=[.!?;:])\s+", line)), *re.split(r"\n\s*\n", text), text]))


def brute(text, threshold):
    best = {}
    for p in passages(text or ""):
        own = set(bigrams_of(p))
        scored = [(2 * len(own & set(bigrams_of(t))) / (len(own) + len(bigrams_of(t))), name) for name, texts in TEMPLATES.items() for t in texts]
        top = max(scored)[0]
        for dice, name in scored:
            if dice >= threshold and dice == top:
                best[name] = max(best.get(name, 0), dice)
    return {n: round(d, 9) for n, d in best.items()}


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_against_brute_force(spark, threshold):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    rows = licenses.scan_licenses(docs, threshold=threshold).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        assert {x.license: round(x.dice, 9) for x in r.licenses} == brute(r.text, threshold), r.text
    if threshold == 0.8:
        got = {r.doc_id: [x.license for x in r.licenses] for r in rows}
        assert got[0] == got[1] == got[5] == got[6] == got[7] == got[16] == ["MIT"] and got[3] == ["GPL-3.0"] and got[4] == ["GPL-2.0"] and got[8] == ["CC-BY-NC-4.0"] and got[9] == ["CC-BY-4.0"] and got[17] == ["BSD", "MPL-2.0"]
        assert all(got[i] == [] for i in (10, 11, 12, 13, 14, 15))


def test_anchors_are_exact():
    for texts in TEMPLATES.values():
        for t in texts:
            for threshold in (0.6, 0.8, 0.95):
                own = bigrams_of(t)
                anchors = licenses.anchors_of(own, threshold)
                free = [b for b in own if not anchors & set(b.split())]
                # all that has no anchor falls short, even as a passage of its own
                assert not free or 2 * len(free) / (len(own) + len(free)) < threshold


def test_odd_rows(odd):
    found = licenses.scan_licenses(odd)
    assert found.count() == odd.count() and all(r.licenses == [] for r in found.collect())
    assert licenses.scan_licenses(odd.limit(0)).count() == 0
    assert all(r.licenses == [] for r in licenses.scan_licenses(odd, templates={}).collect())
    with pytest.raises(ValueError):
        licenses.scan_licenses(odd, templates={"x": ["one"]})


def header(notice, width=60):
    """A comment header without blank lines around the notice."""
    lines = ["Widget - a small tool for graphs", "Copyright (C) 2001 Jo Doe and others", "", *textwrap.wrap(notice, width), "", "The authors thank all who sent patches, reports and ideas over the years."]
    return "/*\n" + "".join(f" * {line}\n" for line in lines) + " */\n\nint main(void) { return 0; }\n"


def test_wrapped_notices(spark):
    """Notices inside comment headers, prose and longer lines, and one right after another."""
    notices = [(name, t) for name, texts in TEMPLATES.items() for t in texts if len(t) > 100]
    prose = "We describe the tool here and then its use in some detail, as it was asked for."
    rows = [({name}, header(t)) for name, t in notices]
    rows += [({name}, "\n".join(textwrap.wrap(f"{prose} {t} {prose} {prose}", 50))) for name, t in notices]
    rows += [({"GPL-2.0", "MIT"}, header(TEMPLATES["GPL-2.0"][1] + " " + MIT)), ({"MIT"}, f"{prose[:-1]}, it is released under the MIT\nLicense and more")]
    rows += [(set(), header(prose)), (set(), header(" ".join(reversed(MIT.split())))), (set(), header(MIT[: len(MIT) // 2]))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        assert {x.license for x in r.licenses} == rows[r.doc_id][0], r.text
        assert all(x.dice == 1.0 for x in r.licenses)


def test_windows_against_brute_force(spark):
    """The best window over all starts and sizes is found, in altered and repeated notices as well."""
    words = licenses.words_of(TEMPLATES["BSD"][1])
    altered = [words, words[2:], words[:9] + ["so"] + words[9:], words[:5] + words[8:], words[:4] * 2 + words[4:], words + ["and"] + words[:8]]
    docs = spark.createDataFrame([(i, "\n".join(["some", "text", *a, "more", "words"])) for i, a in enumerate(altered)], "doc_id long, text string")
    own = set(bigrams_of(TEMPLATES["BSD"][1]))
    for r in licenses.scan_licenses(docs, templates={"BSD": TEMPLATES["BSD"][1:]}).collect():
        text, best = licenses.words_of(r.text), 0
        for i in range(len(text)):
            for j in range(i + 2, min(len(text), i + len(own) * 3 // 2 + 1) + 1):
                m = set(bigrams_of(" ".join(text[i:j])))
                best = max(best, 2 * len(m & own) / (len(m) + len(own)))
        assert [x.dice for x in r.licenses] == ([best] if best >= 0.8 else []), r.text


def test_dense_text(spark):
    """A text that repeats a notice over and over takes time by its length, not by its windows' sizes."""
    scan = lambda n: licenses.scan_licenses(spark.createDataFrame([(1, "\n".join(textwrap.wrap(f"{MIT} " * n, 70)))], "doc_id long, text string")).collect()
    scan(1)
    began = time.perf_counter()
    (row,) = scan(80)
    assert [(x.license, x.dice) for x in row.licenses] == [("MIT", 1.0)] and time.perf_counter() - began < 8
