"""Licence scans: passages compared to licence templates by Dice's coefficient over word bigrams.

A text is cut into passages: lines, sentences of lines, paragraphs and the whole. With m and n
distinct bigrams of passage and template, s of them shared, Dice is 2s / (m + n). For Dice to reach
T, sizes must satisfy n T / (2 - T) <= m <= n (2 - T) / T, which prunes templates by size; and s
must be n T / (2 - T) at least, so the passage must hold one of any n - s + 1 bigrams of the
template. Anchor words are chosen so that those with an anchor are that many: a text without any
anchor word can't match and isn't cut at all. Both bounds are exact.

A notice that is wrapped or stands among other text is no passage of its own. So windows of words
over the whole text are compared as well, line breaks and comment marks between words ignored. The
best window begins and ends with bigrams of the template, as any other at its ends only adds to m.
Only templates with enough of their bigrams in the text, and places with as many within reach, are
looked at. Of windows that overlap, the closest counts.

Everything is DataFrame functions on the row's own text: no shuffle, no state.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8

# Notices of public licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}

#: Words too common in running text to be anchors.
_COMMON = set("a an and any are as at be by for free form forms from in is it may not of on one or other that the this to under use used was with without work you your file files copy copies source".split())


def words_of(text: str) -> list[str]:
    """The words of a template: runs of a-z and 0-9 in lower case."""
    return re.findall("[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    """The distinct bigrams, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors_of(bigrams: list[str], threshold: float) -> set[str]:
    """Words such that a passage without any of them can't reach the threshold."""
    n = len(bigrams)
    need = n - math.ceil(n * threshold / (2 - threshold) - 1e-9) + 1
    chosen: set[str] = set()
    left = set(bigrams)
    while n - len(left) < need:
        gain = lambda w: (w not in _COMMON, sum(w in b.split() for b in left), w)  # noqa: B023, E731
        word = max({w for b in left for w in b.split()}, key=gain)
        chosen.add(word)
        left = {b for b in left if word not in b.split()}
    return chosen


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _passages(text: Column) -> Column:
    """Lines, their sentences, paragraphs and the whole; equal ones once."""
    lines = F.split(text, "\\r?\\n")
    sentences = F.flatten(F.transform(lines, lambda line: F.split(line, "(?<=[.!?;:])\\s+")))
    return F.array_distinct(F.concat(lines, sentences, F.split(text, "\\n\\s*\\n"), F.array(text)))


def _let(value: Column, use) -> Column:
    """use(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(text: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """(license, dice, passage) of the windows that reach the threshold and don't overlap a closer one.

    A window has as many bigrams as a template, repeats counted, times (2 - T) / T at most. Its
    passage is its words in lower case with spaces between.
    """
    entries = []
    for name, t in templates:
        own = bigrams_of(t)
        need, reach = math.ceil(len(own) * threshold / (2 - threshold) - 1e-9), math.floor((len(words_of(t)) - 1) * (2 - threshold) / threshold + 1e-9)
        entries.append(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, own)).alias("bigrams"), F.lit(need).alias("need"), F.lit(reach).alias("reach")))
    bank = F.array(*entries)
    no_windows = F.array().cast("array<struct<order:double,first:int,last:int,license:string>>")

    def of_template(t: Column, pairs: Column) -> Column:
        """The windows of a template that reach the threshold and are closer than all shorter ones of
        the same start, as bigrams at places from first to last. Others change nothing: whatever
        overlaps the shorter one and is closer overlaps and beats them too.

        A bigram is new to a window if it occurs last before its start, so one pass over the reach of
        a start counts the distinct bigrams of all its windows.
        """
        flagged = F.transform(pairs, lambda x: F.struct(x["at"].alias("at"), x["before"].alias("before"), F.array_contains(t["bigrams"], x["bigram"]).cast("int").alias("hit")))

        def from_start(places: Column, first: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                new = (x["before"] < first).cast("int")
                m, s = acc["m"] + new, acc["s"] + new * x["hit"]
                dice = 2.0 * s / (m + F.size(t["bigrams"]))
                closer = (x["hit"] == 1) & (dice >= threshold) & (dice > acc["dice"])
                window = F.struct((-dice).alias("order"), first.alias("first"), x["at"].alias("last"), t["license"].alias("license"))
                return F.struct(m.alias("m"), s.alias("s"), F.when(closer, dice).otherwise(acc["dice"]).alias("dice"), F.when(closer, F.concat(acc["found"], F.array(window))).otherwise(acc["found"]).alias("found"))

            begin = F.struct(F.lit(0).alias("m"), F.lit(0).alias("s"), F.lit(0.0).alias("dice"), no_windows.alias("found"))
            return F.aggregate(F.slice(places, first + 1, t["reach"]), begin, step, lambda acc: acc["found"])

        def among(places: Column, hits: Column) -> Column:
            n, need, reach = F.size(hits), t["need"], t["reach"]
            starts = F.filter(F.sequence(F.lit(0), n - need), lambda k: F.get(hits, k + need - 1) - F.get(hits, k) < reach)
            return F.flatten(F.transform(starts, lambda k: from_start(places, F.get(hits, k))))

        return _let(flagged, lambda places: _let(F.transform(F.filter(places, lambda x: x["hit"] == 1), lambda x: x["at"]), lambda hits: among(places, hits)))

    def placed(pairs: Column) -> Column:
        """Bigrams with their place and the place before where the same one occurs, -1 if none does."""

        def told(ordered: Column) -> Column:
            before = lambda x, k: F.when((k > 0) & (F.get(ordered, k - 1)["bigram"] == x["bigram"]), F.get(ordered, k - 1)["at"]).otherwise(F.lit(-1))
            return F.array_sort(F.transform(ordered, lambda x, k: F.struct(x["at"].alias("at"), before(x, k).alias("before"), x["bigram"].alias("bigram"))))

        return _let(F.array_sort(F.transform(pairs, lambda b, i: F.struct(b.alias("bigram"), i.alias("at")))), told)

    def closest(found: Column) -> Column:
        """Of a text with windows of one licence only the closest matters, as none overlaps another licence."""
        over = lambda x, k: (k["first"] <= x["last"]) & (x["first"] <= k["last"]) & ((k["order"] < x["order"]) | (k["license"] == x["license"]))
        kept = F.aggregate(F.array_sort(found), no_windows, lambda kept, x: F.when(F.exists(kept, lambda k: over(x, k)), kept).otherwise(F.concat(kept, F.array(x))))
        one = F.forall(found, lambda x: x["license"] == F.get(found, F.lit(0))["license"])
        return F.when(F.size(found) == 0, no_windows).when(one, F.array(F.array_min(found))).otherwise(kept)

    def in_words(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))

        def in_pairs(pairs: Column) -> Column:
            near = _let(F.array_distinct(pairs), lambda b: F.filter(bank, lambda t: F.size(F.array_intersect(t["bigrams"], b)) >= t["need"]))
            each = lambda near: F.when(F.size(near) > 0, _let(placed(pairs), lambda known: F.flatten(F.transform(near, lambda t: of_template(t, known)))))
            windows = _let(near, each)
            found = _let(F.coalesce(windows, no_windows), closest)
            passage = lambda x: F.array_join(F.slice(words, x["first"] + 1, x["last"] - x["first"] + 2), " ")
            return F.transform(found, lambda x: F.struct(x["license"].alias("license"), (-x["order"]).alias("dice"), passage(x).alias("passage")))

        return F.when(F.size(words) > 1, _let(pairs, in_pairs))

    none = F.array().cast("array<struct<license:string,dice:double,passage:string>>")
    return F.coalesce(_let(_words(text), in_words), none)


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with a column licenses: an array of (license, dice, passage), one for each licence
    found, with its best Dice and the first passage that reaches it, by licence name; passages that
    are cut come before windows.

    Null, empty and unmatched texts have an empty array. Templates need two words at least. A column
    licenses is replaced; all others stay as they are, so nothing clashes. Repeated rows stay.
    """
    templates = TEMPLATES if templates is None else templates
    named = [(name, t) for name, texts in sorted(templates.items()) for t in texts]
    listed = [(name, bigrams_of(t)) for name, t in named]
    if any(not b for _, b in listed):
        raise ValueError("a template has two words at least")
    text_column = common.text_or_empty(text)
    kind = "array<struct<license:string,dice:double,passage:string>>"
    none = F.lit(None).cast(kind)
    if not listed:
        return docs.withColumn("licenses", F.coalesce(none, F.array().cast(kind)))
    least = min(len(b) for _, b in listed) * threshold / (2 - threshold)
    most = max(len(b) for _, b in listed) * (2 - threshold) / threshold
    anchors = sorted(set().union(*(anchors_of(b, threshold) for _, b in listed)))
    may = F.lower(text_column).rlike(r"(?<![a-z0-9])(?:" + "|".join(anchors) + r")(?![a-z0-9])")
    # distinct bigrams are at most the words less one: shorter passages are out before bigrams are made
    cut = F.transform(_passages(text_column), lambda p: F.struct(p.alias("passage"), _words(p).alias("words")))
    cut = F.filter(cut, lambda p: F.size(p["words"]) - 1 >= F.lit(math.ceil(least - 1e-9)))

    def bigrams(words: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    paired = F.transform(cut, lambda p: F.struct(p["passage"].alias("passage"), bigrams(p["words"]).alias("bigrams")))
    paired = F.filter(paired, lambda p: F.size(p["bigrams"]).between(math.ceil(least - 1e-9), math.floor(most + 1e-9)))
    bank = F.array(*(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("bigrams")) for name, b in listed))

    def against(p: Column) -> Column:
        m = F.size(p["bigrams"])
        fitting = F.filter(bank, lambda t: (F.size(t["bigrams"]) * threshold <= m * (2 - threshold) + 1e-9) & (m * threshold <= F.size(t["bigrams"]) * (2 - threshold) + 1e-9))
        scored = F.transform(fitting, lambda t: F.struct(t["license"].alias("license"), (2.0 * F.size(F.array_intersect(p["bigrams"], t["bigrams"])) / (m + F.size(t["bigrams"]))).alias("dice"), p["passage"].alias("passage")))
        return F.filter(scored, lambda s: s["dice"] >= threshold)

    # a passage counts for the closest licence only, or for all that are equally close
    closest = lambda scored: F.filter(scored, lambda s: s["dice"] == F.array_max(F.transform(scored, lambda x: x["dice"])))
    found = F.concat(F.flatten(F.transform(F.transform(paired, against), closest)), _windows(text_column, named, threshold))
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda f: f["license"])))

    def best(name: Column) -> Column:
        own = F.filter("_found", lambda f: f["license"] == name)
        top = F.array_max(F.transform(own, lambda f: f["dice"]))
        return F.get(F.filter(own, lambda f: f["dice"] == top), F.lit(0))

    out = docs.withColumn("_found", F.when(may, found).otherwise(F.array().cast(kind)))
    return out.withColumn("licenses", F.transform(names, best).cast(kind)).drop("_found")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licences noticed in every document, with the closest."""
    found = scan_licenses(common.table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("licenses", "found")
    top = F.array_max(F.transform("found", lambda x: x["dice"]))
    closest = F.get(F.filter("found", lambda x: x["dice"] == top), F.lit(0))["license"]
    names = F.array_join(F.transform("found", lambda x: x["license"]), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), names.alias("licenses"), closest.alias("closest"), F.round(top, 9).alias("dice"))


def _template_rows() -> str:
    listed = [(n, i, b) for n, texts in sorted(TEMPLATES.items()) for i, t in enumerate(texts) for b in bigrams_of(t)]
    return ", ".join(f"('{n}', {i}, '{b}')" for n, i, b in listed)


#: op8_license_scan in DuckDB SQL.
OP8_SQL = f"""
WITH templates(license, nr, bigram) AS (VALUES {_template_rows()}), sizes AS (
  SELECT license, nr, count(*) AS n FROM templates GROUP BY license, nr
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, string_split_regex(coalesce(text, ''), '\\r?\\n') AS lines FROM documents
), p AS (
  SELECT r, unnest(list_distinct(list_concat(lines, flatten([string_split(regexp_replace(x, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) for x in lines]), string_split_regex(t, '\\n\\s*\\n'), [t]))) AS passage FROM d
), w AS (
  SELECT r, row_number() OVER () AS k, regexp_extract_all(lower(passage), '[a-z0-9]+') AS words FROM p
), b AS (
  SELECT r, k, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS bigrams FROM w WHERE len(words) > 1
), shared AS (
  SELECT r, k, license, nr, any_value(m) AS m, count(*) AS s FROM (SELECT r, k, len(bigrams) AS m, unnest(bigrams) AS bigram FROM b) JOIN templates USING (bigram) GROUP BY r, k, license, nr
), scored AS (
  SELECT r, k, license, 2.0::DOUBLE * s / (m + n) AS dice FROM shared JOIN sizes USING (license, nr)
), best AS (
  SELECT r, license, max(dice) AS dice FROM (SELECT *, max(dice) OVER (PARTITION BY r, k) AS top FROM scored) WHERE dice >= {THRESHOLD} AND dice = top GROUP BY r, license
), told AS (
  SELECT r, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, arg_min(license, (-dice, license)) AS closest, max(dice) AS dice FROM best GROUP BY r
)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, closest, round(dice, 9) AS dice FROM d LEFT JOIN told USING (r)
"""
