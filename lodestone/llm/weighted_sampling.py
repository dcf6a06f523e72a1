"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, each weighted by its count. For each sample, a word draws r and c from
Gamma(2, 1) and b from [0, 1), all decided by hashes of the word and the sample's number. With its
weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the word with the least a is
the sample. Two texts take the same (word, t) with the probability of their generalised Jaccard
similarity, the sum of the lesser over the sum of the greater weights. As a is decided by (word, t),
the least a stands for them, so a signature is a list of minima: any order of words and any
grouping of partial results gives the same.

Everything is DataFrame functions. Words are counted by sorting a text's own words, so no word goes
through a shuffle.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Samples of a signature. A likeness has the standard error sqrt(J (1 - J) / SAMPLES), 0.0625 at most.
SAMPLES = 64
#: Binary digits of a sample; far fewer than a double's, so rounding of logarithms doesn't show.
DIGITS = 42
#: Samples that a row of a term with another weight than 1 draws.
PER_ROW = 4
#: Documents that are put in order together, and ranges of ids at most. With more documents, ranges grow.
RANGE_ROWS, MOST_RANGES = 256, 65_536
#: Ranges of a task at most.
TASK_RANGES = 64
#: Where ranges begin: (no key, ~key, beginning of the text).
PLACE = "struct<none:boolean,down:bigint,beginning:string>"
#: Code points of a beginning; rows looked at for a cut among texts of one key, and for all such cuts.
BEGINNING, PER_CUT, MOST_SAMPLED = 64, 32, 100_000


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """A row for each distinct word of each row's text, with _term (a hash of it) and _weight (its
    count); a row with nulls for a text without words. The text goes."""
    words = df.withColumn("_words", F.sort_array(F.split(F.col(text), common.GAP))).drop(text)
    first = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: (F.get("_words", i) != "") & ((i == 0) | (F.get("_words", i - 1) != F.get("_words", i))))
    runs = words.withColumn("_first", first)
    each = runs.select(*runs.columns, F.posexplode_outer("_first").alias("_n", "_at"))
    count = F.coalesce(F.get("_first", F.col("_n") + 1), F.size("_words")) - F.col("_at")
    term = F.when(F.col("_at").isNotNull(), F.xxhash64(F.get("_words", F.col("_at"))))
    return each.withColumn("_term", term).withColumn("_weight", count.cast("double")).drop("_words", "_first", "_n", "_at")


def _hash(key: Column, number: Column, which: int) -> Column:
    return F.xxhash64(key.bitwiseXOR(F.xxhash64(number * 2 + which)))


def _exponential(of: Column, at: int) -> Column:
    """A draw of Exp(1) from 32 bits of a hash."""
    return -F.ln((F.shiftrightunsigned(of, at).bitwiseAND(F.lit((1 << 32) - 1)) + F.lit(0.5)) * F.lit(2.0**-32))


def _drawn(terms: DataFrame) -> DataFrame:
    """The columns _draw0, _draw1, ...: 1 - exp(-a) of the samples PER_ROW * _part + 0, 1, ..., as whole
    numbers of 2 ** -DIGITS, null where _part is.

    Of independent p, q and y from Exp(1), c = p + q and p / c are a Gamma(2, 1) and a uniform number,
    independent of each other; x = -ln(p / c) is Exp(1) again, so r = x + y and b = y / r are one more
    Gamma(2, 1) and uniform number. With them a = c exp(-r (t - b + 1)) is p exp(-r t). Steps are
    projections, so what is used twice is worked out once.
    """
    each, number = range(PER_ROW), lambda j: F.col("_part") * PER_ROW + j
    drawn = terms.select("*", *(_bits(F.col("_key"), number(j)).alias(f"_bits{j}") for j in each), *(_hash(F.col("_key"), number(j), 1).alias(f"_more{j}") for j in each))
    p = lambda j: F.when(F.col("_part").isNotNull(), -F.log1p((F.col(f"_bits{j}") + F.lit(0.5)) * F.lit(-(2.0**-DIGITS))))
    y = lambda j: F.when(F.col("_part").isNotNull(), _exponential(F.col(f"_more{j}"), 0))
    drawn = drawn.select("*", *(p(j).alias(f"_p{j}") for j in each), *(y(j).alias(f"_y{j}") for j in each))
    r = lambda j: F.when(F.col("_part").isNotNull(), F.log1p(_exponential(F.col(f"_more{j}"), 32) / F.col(f"_p{j}")) + F.col(f"_y{j}"))
    drawn = drawn.select("*", *(r(j).alias(f"_r{j}") for j in each))
    a = lambda j: F.col(f"_p{j}") * F.exp(-F.col(f"_r{j}") * F.floor((F.col("_log_weight") + F.col(f"_y{j}")) / F.col(f"_r{j}")))
    return drawn.select("*", *(F.when(F.col("_part").isNotNull(), -F.expm1(-a(j)) * F.lit(2.0**DIGITS)).cast("long").alias(f"_draw{j}") for j in each))


def _bits(key: Column, number: Column) -> Column:
    return F.shiftrightunsigned(_hash(key, number, 0), 64 - DIGITS)


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES, term: str = "_term", weight: str = "_weight") -> DataFrame:
    """The keys with _signature, an array of the samples of each group of weighted terms: of each the
    least 1 - exp(-a), which rises with a.

    A term that recurs in a group counts with its greatest weight's draw or a lesser one; give each
    once. A group with null terms only has an array of nulls. Terms are longs, weights are above 0.

    Weights of 1 have t = 0 and a = p, for which the bits of the hash stand as they are, without a
    logarithm. A term of another weight becomes a row for each PER_ROW samples.
    """
    plain = F.col(weight) == 1
    parts = F.when(F.col(term).isNotNull() & ~plain, F.sequence(F.lit(0), F.lit((samples - 1) // PER_ROW))).otherwise(F.array(F.lit(None).cast("int")))
    rows = terms.select(*keys, F.coalesce(term, F.lit(0)).alias("_key"), (F.col(term).isNotNull() & plain).alias("_plain"), F.ln(weight).alias("_log_weight"), F.explode(parts).alias("_part"))
    least = [F.min(F.when(F.col("_plain"), _bits(F.col("_key"), F.lit(s))).when(F.col("_part") == s // PER_ROW, F.col(f"_draw{s % PER_ROW}"))).alias(f"_s{s}") for s in range(samples)]
    found = _drawn(rows).groupBy(*keys).agg(*least)
    return found.select(*keys, F.array(*(f"_s{s}" for s in range(samples))).alias("_signature"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples on which two signatures agree, an estimate of generalised Jaccard. Two
    texts without words are alike; one with and one without have nothing in common."""
    same = [F.get(a, F.lit(s)).eqNullSafe(F.get(b, F.lit(s))).cast("int") for s in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def digits(signature: Column, samples: int = SAMPLES) -> Column:
    """A signature as text: 8 hexadecimal digits for each sample."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(F.get(signature, F.lit(s))), 32)), 8, "0") for s in range(samples))))


def _cuts(rows: DataFrame, key: str, n: int, nulls: int, total: int) -> tuple[Column, list[tuple[bool, int | None, str]]]:
    """(the place of a row, where about n ranges begin). A place is (no key, ~key, beginning), which is
    in order as documents are; the beginning is that of the text for keys that fill several ranges,
    and empty for all others.

    Of keys that fill several ranges the driver gets MOST_SAMPLED beginnings at about.
    """
    keyed = max(1, round(n * (total - nulls) / total)) if total else 1
    found = Counter(rows.stat.approxQuantile(key, [i / keyed for i in range(1, keyed)], 1 / (4 * keyed)) if keyed > 1 else [])
    down = lambda b: ~max(-(2**63), min(2**63 - 1, int(b)))
    bounds = {(False, down(b), "") for b in found}
    # quantiles are doubles, several long keys may be one of them
    shares = {b: times for b, times in found.items() if times > 1}
    if n > keyed:
        shares[None] = n - keyed
    if nulls:
        bounds.add((True, None, ""))
    several = F.coalesce(F.col(key).cast("double").isin([b for b in shares if b is not None]), F.lit(False)) | (F.col(key).isNull() & F.lit(None in shares))
    place = F.struct(F.col(key).isNull().alias("none"), F.bitwise_not(key).alias("down"), F.when(several, F.substring("_text", 1, BEGINNING)).otherwise("").alias("beginning"))
    if shares:
        share = min(1.0, MOST_SAMPLED / (sum(shares.values()) * total / n), PER_CUT * n / total)
        sampled = defaultdict(list)
        for r in rows.filter(several).sample(share, seed=1).select(F.col(key).cast("double").alias("of"), place.alias("place")).collect():
            sampled[r["of"]].append(tuple(r["place"]))
        for b, places in sampled.items():
            places.sort(key=_ordered)
            bounds |= {places[len(places) * i // shares[b]] for i in range(1, shares[b])}
        # what follows such a key begins a range of its own
        bounds |= {(False, down(b) + 1, "") for b in shares if b is not None and down(b) < 2**63 - 1}
    return place, sorted(bounds, key=_ordered)


def _ordered(place: tuple[bool, int | None, str]) -> tuple[bool, int, str]:
    return place[0], place[1] or 0, place[2]


def _in_ranges(docs: DataFrame, key: str) -> DataFrame:
    """The rows with _range, which orders the documents roughly, and _ghost: the first documents of
    each range are also put, as ghosts, in the range before, and those of the first in the last, so
    that every document meets the next one in its range. Tasks get as many ranges each.

    The driver gets the ranges' bounds and first places, about MOST_RANGES at most.
    """
    counts = docs.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    n = max(1, min(MOST_RANGES, math.ceil(counts["n"] / RANGE_ROWS)))
    tasks = min(n, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_RANGES)))
    place, bounds = _cuts(docs, key, math.ceil(n / tasks) * tasks, counts["nulls"], counts["n"])
    step = max(1, math.isqrt(len(bounds)))
    grid = [[dict(zip(("none", "down", "beginning"), b)) for b in bounds[i : i + step]] for i in range(0, len(bounds), step)]
    told = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  one literal, however many bounds
    reached = lambda some: F.size(F.filter(some, lambda b: b <= F.col("_place")))
    row = F.get(told(grid, f"array<array<{PLACE}>>"), F.col("_row") - 1)
    at = F.when(F.col("_row") > 0, (F.col("_row") - 1) * step + reached(row))
    ranged = docs.withColumn("_place", place).withColumn("_row", reached(told([r[0] for r in grid], f"array<{PLACE}>"))).withColumn("_range", F.coalesce(at, F.lit(0))).drop("_row")
    firsts = sorted(ranged.groupBy("_range").agg(F.min("_place").alias("first")).collect())
    # one row for each range
    table = docs.sparkSession.createDataFrame([(i, first, firsts[k - 1][0]) for k, (i, first) in enumerate(firsts)], f"_range int, first {PLACE}, before int")
    met = ranged.join(F.broadcast(table), "_range")
    own = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")))
    places = F.when(F.col("_place") != F.col("first"), own).otherwise(F.concat(own, F.array(F.struct(F.col("before").alias("r"), F.lit(True).alias("g")))))
    dealt = met.withColumn("_at", F.explode(places)).select(*docs.columns, F.col("_at.r").alias("_range"), F.col("_at.g").alias("_ghost"))
    return dealt.repartitionById(tasks, "_range")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's own and edited text: rows (_range, _rank, _side, key, n_chars, edited_sha256,
    _text), _side 0 for its own and 1 for the edited text.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of
    the next document's in descending order of the key; after the last comes the first. Documents
    with one key stand in the order of their texts; those without a key come last. Ghosts (see
    _in_ranges) have side 0 only and no digest.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), common.text_or_empty(text).alias("_text"))
    order = Window.partitionBy("_range").orderBy("_ghost", F.col(key).desc_nulls_last(), "_text")
    # ghosts come after all, the first of them is the next document of the last
    placed = _in_ranges(rows, key).withColumn("_next", F.lead("_text").over(order)).withColumn("_rank", F.row_number().over(order))
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    both = placed.withColumn("n_chars", n.cast("long")).withColumn("_edited", edited)
    own = F.struct(F.lit(0).alias("side"), F.col("_text").alias("text"))
    sides = F.when(F.col("_ghost"), F.array(own)).otherwise(F.array(own, F.struct(F.lit(1).alias("side"), F.col("_edited").alias("text"))))
    digest = F.when(~F.col("_ghost"), F.sha2(F.encode("_edited", "UTF-8"), 256))
    both = both.withColumn("edited_sha256", digest).withColumn("_sides", sides)
    return both.select("_range", "_rank", key, "n_chars", "edited_sha256", F.inline("_sides").alias("_side", "_text"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of
    every document.

    Null texts are empty; a text without words has a fingerprint of its own. Repeated rows each
    count as a document, so a row's next can be its copy. An empty table gives no rows. Other
    columns are dropped.

    The texts go through one shuffle, by range of the key; all that follows stays in its task.
    """
    keys = ["_range", "_rank", "_side", key, "n_chars", "edited_sha256"]
    found = signatures(with_terms(edited_pairs(docs, key, text), "_text"), keys, samples)
    # within a range: own, edited, own of the next, ...
    order = Window.partitionBy("_range").orderBy("_rank", "_side")
    rows = found.withColumn("_edited", F.lead("_signature", 1).over(order)).withColumn("_next", F.lead("_signature", 2).over(order))
    rows = rows.filter((F.col("_side") == 0) & F.col("edited_sha256").isNotNull())
    own, edited, after = F.col("_signature"), F.col("_edited"), F.col("_next")
    return rows.select(
        key, "n_chars", "edited_sha256", digits(own, samples).alias("fingerprint"), digits(edited, samples).alias("edited_fingerprint"), likeness(own, edited, samples).alias("near_edited"), likeness(own, after, samples).alias("near_next")
    )


def op1_weighted_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The fingerprints of all documents and of their edited texts."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
