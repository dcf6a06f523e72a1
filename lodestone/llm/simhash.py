"""Near-duplicates by SimHash with multi-index hashing.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its word
shingles. Fingerprints link at RADIUS or fewer differing bits. To find the links, a fingerprint is
cut in two halves. Of two that differ in 3 bits at most, one half differs in 1 bit at most, so each
half's Hamming ball of radius 1 (the half itself and its 32 neighbours) is looked up in a table of
that half, and whole distances are verified. One side of a pair suffices: a fingerprint looks up
its own half and those neighbours that set a bit.

Equal fingerprints are one entry throughout. An entry of a table that many different fingerprints
share would verify the square of their number; those are linked through common points instead
(see _crowded_links), with a fixed number of rows for each fingerprint and no link lost.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints in a table's entry above which their links go through common points.
CROWD = 512
#: Bytes of text that are cut into words at a time, and hashes whose bits are counted at a time.
TEXT_STEP, HASH_STEP = 1 << 20, 1 << 16

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about TEXT_STEP bytes each."""
    at = 0
    while len(data) - at > 2 * TEXT_STEP:
        cut = _GAP.search(data, at + TEXT_STEP)
        if cut is None:
            break
        yield data[at : cut.start()].split()
        at = cut.end()
    yield data[at:].split()


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text, as a signed 64-bit number.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles count as often
    as they occur. A text of fewer words is one shingle; one without words, or null, gets 0.
    """
    ones, n, last = np.zeros(64, dtype=np.int64), 0, []

    def count(shingles: list[bytes]) -> None:
        for i in range(0, len(shingles), HASH_STEP):
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(s, seed) for s in shingles[i : i + HASH_STEP]], dtype="<u8")
            ones[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for words in _word_lists((text or "").encode("utf-8", "surrogatepass").lower()):
        words = last + words
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
        count(shingles)
        n += len(shingles)
        last = words[max(0, len(words) - shingle + 1) :]
    if not n and last:
        count([b" ".join(last)])
        n = 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")
    common.release_memory()


def fingerprint_column(text: Column) -> Column:
    """fingerprint() of a column, by Arrow batches."""
    return F.pandas_udf(_fingerprints, "long")(text)


def _half(fp: Column, half: int) -> Column:
    """Bits 0 to 31 or 32 to 63, as a long."""
    return F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))


def _flipped(bits: Column, times: int) -> Column:
    """The array of all 32-bit values that differ from bits in exactly `times` bits, 0 to 2."""
    one = [bits.bitwiseXOR(F.lit(1 << i)) for i in range(32)]
    if times == 0:
        return F.array(bits)
    if times == 1:
        return F.array(*one)
    masks = F.array(*(F.lit((1 << i) | (1 << j)) for i in range(32) for j in range(i)))
    return F.transform(masks, lambda m: m.bitwiseXOR(bits))


def _tables(fps: DataFrame) -> DataFrame:
    """(half, entry, rest, fp): each fingerprint under both of its halves."""
    halves = F.array(*(F.struct(F.lit(h).alias("half"), _half(F.col("fp"), h).alias("entry"), _half(F.col("fp"), 1 - h).alias("rest")) for h in (0, 1)))
    return fps.select("fp", F.explode(halves).alias("t")).select("t.half", "t.entry", "t.rest", "fp")


def _lookups(tables: DataFrame) -> DataFrame:
    """(half, entry, far, rest, fp): the entries that a fingerprint looks up, far being the bits
    from its own; of two neighbours the one without the bit looks up the other."""
    up = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("entry") + F.call_function("shiftleft", F.lit(1).cast("long"), i))
    ups = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.call_function("shiftright", F.col("entry"), i).bitwiseAND(F.lit(1)) == 0, F.get(up, i))), lambda e: e.isNotNull())
    at = F.concat(F.array(F.struct(F.col("entry").alias("at"), F.lit(0).alias("far"))), F.transform(ups, lambda e: F.struct(e.alias("at"), F.lit(1).alias("far"))))
    return tables.withColumn("l", F.explode(at)).select("half", F.col("l.at").alias("entry"), "l.far", "rest", "fp")


def _crowded_links(tables: DataFrame, lookups: DataFrame) -> DataFrame:
    """The links within and into crowded entries, through common points of the other half.

    A point z of 32 bits is near a fingerprint of the entry if z and its other half differ in 1 bit
    at most. Two fingerprints of the entry whose other halves differ in 3 bits have a point near
    the one and at most 2 bits from the other. At a point that has near fingerprints, all of them,
    and all within 2 bits, link to the least near one: distances there are 2 + 1 at most. A
    fingerprint that looks up the entry from 1 bit off may only differ in 2 more, so it takes points
    within 1 bit. So all links are true, and whatever is linked stays connected.
    """
    points = lambda df, most: df.select("half", "entry", "fp", F.explode(F.concat(*(_flipped(F.col("rest"), t) for t in range(most + 1)))).alias("z"))
    centres = points(tables, 1).groupBy("half", "entry", "z").agg(F.min("fp").alias("centre"))
    reach = points(tables, 2).union(points(lookups.filter("far = 1"), 1))
    return reach.join(centres, ["half", "entry", "z"]).select("fp", F.col("centre").alias("other")).filter("fp <> other").distinct()


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (fp, other) that connect what is RADIUS or fewer bits apart; fps has distinct
    fingerprints in column fp. Outside crowded entries these are all such pairs."""
    # a fingerprint becomes about 34 lookups: dealt to as many tasks as a shuffle has, however few
    # partitions its rows fit in before
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = common.durable(_tables(fps.repartition(parts, "fp")))
    lookups = _lookups(tables)
    crowded = common.durable(tables.groupBy("half", "entry").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("half", "entry"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS
    other = tables.select("half", "entry", F.col("fp").alias("other"))
    on = ["half", "entry"]
    if not crowded.take(1):
        return lookups.join(other, on).filter(near("fp", "other") & ((F.col("far") == 1) | (F.col("fp") < F.col("other")))).select("fp", "other").distinct()
    few = lookups.join(other.join(crowded, on, "left_anti"), on).filter(near("fp", "other") & ((F.col("far") == 1) | (F.col("fp") < F.col("other")))).select("fp", "other")
    return few.union(_crowded_links(tables.join(crowded, on, "left_semi"), lookups.join(crowded, on, "left_semi"))).distinct()


def _prints(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """The columns and fp, the fingerprint, of every row, kept in the shared folder."""
    common.ship(docs.sparkSession)
    return common.durable(docs.select(*columns, fingerprint_column(F.col(text)).alias("fp")))


def _groups(prints: DataFrame, key: str, crowd: int = CROWD) -> DataFrame:
    """(fp, component, component_id) for each fingerprint; component is the least linked fingerprint."""
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = components(links(least.select("fp"), crowd))
    grouped = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    # what stands alone has its own least key, without another look at the other groups
    return grouped.join(firsts, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(key, fingerprint, component_id) for every row, fingerprint as a long.

    component_id is the least key reachable over links between fingerprints, the row's own
    included. Null texts have fingerprint 0, which links like any other. Null keys count for
    nothing in component_id unless a whole component has no key, whose component_id is then null.
    Repeated rows stay. Other columns are dropped, so their names can't clash.
    """
    prints = _prints(docs, text, F.col(key))
    return prints.join(_groups(prints, key, crowd), "fp").select(F.col(key), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each component one row with the least key stays, or of a
    component without any key one row of it.

    Of a component's rows with that key the one with the least hash of its text stays. Unlike texts
    with one key are different components, which keep a row each. Rows that are alike in all columns
    but maps are interchangeable; reruns agree.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    # rows go by what they hold, so those without a key have names of their own
    name = F.concat(F.md5(common.text_or_empty(text)), F.hex(F.xxhash64(*hashed)), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    prints = _prints(docs, text, F.col(key).alias("key"), name.alias("_name"))
    found = prints.join(_groups(prints, "key"), "fp").filter(F.col("key").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("component").agg(F.min("_name").alias("_name")).select("_name")
    # both by the same name: the texts go through one shuffle
    return docs.withColumn("_name", name).join(chosen, "_name", "left_semi").dropDuplicates(["_name"]).drop("_name")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
