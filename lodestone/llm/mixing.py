"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of tokens and a schedule: how strongly it is wanted at a time from
0 (start of training) to 1 (end). Its schedule's integral, scaled to the target, is its cumulative
demand. A source's documents stand in hashed order, pass after pass; a copy that begins after c
tokens of its source belongs at the time at which the demand reaches c, found by inverting the
integral in closed form. A range sort by that time interleaves the sources as their schedules ask,
and a copy's place in it is its training rank. The demand ends at the target, also inside a document, of which the mix then takes the first words.

Everything is DataFrame functions. Running sums go over (source, piece) groups, the pieces being
cut by a hash, so a source that holds most rows spreads over thousands of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scan

from . import common

#: Pieces of a source for its running sums: 3 hexadecimal digits of a hash.
PIECES = 4096
#: Weights of the sources in the order of their names, over and over.
WEIGHT_CYCLE = (1, 2, 3)
#: Passes over a source at most.
MAX_PASSES = 3
#: Schedules of the sources in the order of their names, over and over: wanted evenly; early; late;
#: in the middle. (time, strength) knots with straight lines between.
SCHEDULE_CYCLE = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 2.0), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 2.0), (1.0, 0.5)),
)


def source_targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHT_CYCLE, passes: int = MAX_PASSES) -> DataFrame:
    """A row for each source: its size, weight and target (source, source_size, weight, target).

    Sources stand by code point, null last, and take the weights in turn. All tokens are shared by
    weight; a target is at most `passes` times its source's size, and what is over is shared among
    the others by weight until none is above. In closed form: sources fill up in the order of
    limit / weight, so a source is full if the share per weight that is left once all before it are
    full exceeds its limit / weight, and the rest take weight times the last such share.

    The windows without a partition run over a row per source.
    """
    by_source = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    weighed = by_source.withColumn("_at", F.row_number().over(names) - 1).withColumn("weight", F.get(cycle, F.col("_at") % len(weights)))
    weighed = weighed.withColumn("_limit", passes * F.col("source_size"))
    filling = Window.orderBy(F.col("_limit") / F.col("weight"), "_at")
    before, after, all_rows = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    share = weighed.withColumn("_left", left).withColumn("_rest", F.sum("weight").over(after))
    share = share.withColumn("_full", F.col("_left") * F.col("weight") > F.col("_limit") * F.col("_rest"))
    open_share = F.min(F.when(~F.col("_full"), F.struct(F.col("_limit") / F.col("weight"), "_at", F.col("_left").alias("left"), F.col("_rest").alias("rest")))).over(Window.partitionBy())
    share = share.withColumn("_open", open_share)
    target = F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(F.col("weight") * F.col("_open.left").cast("double") / F.col("_open.rest"))
    return share.select("source", "source_size", "weight", target.alias("target"), "_at")


def _segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(demand before, demand after, start, strength at start, slope) of each straight piece, the
    demand being scaled to end at 1."""
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or whole <= 0 or any(w < 0 for _, w in knots) or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("a schedule goes from time 0 to 1 in rising steps, with strengths of 0 or more, not all 0")
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        part = (t1 - t0) * (w0 + w1) / 2 / whole
        out.append((done, done + part, t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole))
        done += part
    return out


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the cumulative demand of a schedule reaches a share of it (0 to 1)."""
    out = F.lit(1.0)
    for low, high, start, strength, slope in reversed(_segments(knots)):
        need = share - F.lit(low)
        root = F.sqrt(F.greatest(F.lit(strength**2) + F.lit(2 * slope) * need, F.lit(0.0)))
        step = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (F.lit(strength) + root))
        out = F.when(share < high, F.lit(start) + step).otherwise(out)
    return out


def plan_mix(
    sized: DataFrame, key: str, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHT_CYCLE, passes: int = MAX_PASSES, schedules: tuple = SCHEDULE_CYCLE, seed: str = "mix"
) -> DataFrame:
    """Every row with source_size, target, taken and copies.

    taken: the tokens that the mix takes of the row, repeats counted. copies: an array of (pass,
    tokens taken, position), position being the time in training from 0 to 1 at which the copy
    begins; rows that the mix leaves out have an empty array. A source's taken tokens add up to its
    target, rounded. Order within a source is a hash of seed and key, then the key, so reruns agree;
    rows with the same key and size are interchangeable. Null sources form a source; a size of 0
    takes nothing. Columns source_size, target, taken and copies are replaced if there are such.

    `sized` is read twice, once for sums by (source, piece): hand in something cheap to read.
    """
    made = ["source_size", "target", "taken", "copies"]
    columns = [c for c in sized.columns if c not in made]
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    # a name that is never null, so that the sums and the join below find the rows dealt alike
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = sized.select(*columns).withColumn("_order", mixed).withColumn("_piece", common.hex_bits(F.col("_order"), 1, 3)).withColumn("_name", name)
    pieces = rows.groupBy("_name", "_piece").agg(F.sum(size).cast("long").alias("_size"))
    named = pieces.select(F.when(F.col("_name") != "", F.substring("_name", 2, 2**31 - 1)).alias("source"), F.col("_size"))
    targets = source_targets(named, "source", "_size", weights, passes)
    targets = targets.withColumn("_name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source", "weight")
    before = Window.partitionBy("_name").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size").join(targets, "_name")
    # the running sum stays within one (source, piece); rows of a piece follow those of smaller pieces
    inside = Window.partitionBy("_name", "_piece").orderBy("_order", F.col(key), F.col(size)).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(starts, ["_name", "_piece"])
    begin = F.col("_start") + F.col("_inside")
    wanted = F.round(F.col("target")).cast("long")

    def one(k: int) -> Column:
        at = begin + k * F.col("source_size")
        take = F.greatest(F.lit(0), F.least(F.col(size), wanted - at))
        share = at / F.greatest(wanted, F.lit(1))
        position = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            position = F.when(F.col("_at") % len(schedules) == i, time_of(share, knots)).otherwise(position)
        return F.struct(F.lit(k).alias("pass"), take.cast("long").alias("tokens"), position.alias("position"))

    copies = F.filter(F.array(*map(one, range(passes))), lambda c: c["tokens"] > 0)
    out = placed.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["tokens"])
    return out.withColumn("taken", taken).select(*columns, *made)


def training_order(planned: DataFrame, text: str = "text", key: str = "doc_id", size: str = "size") -> DataFrame:
    """A row per copy in the order of training, its text cut after the tokens taken of it.

    Adds pass and position; a full copy's text is left as it is, and n_chars, where there is such a
    column, is made to fit a cut one. The sort is by ranges of the position, then by pass and key.
    """
    copies = planned.withColumn("_copy", F.explode("copies"))
    # all but the words taken of a text goes; a full copy keeps its white space as well
    whole = F.col("_copy.tokens") >= F.col(size)
    pieces = F.split(F.col(text), "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    out = copies.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(F.slice(pieces, 1, F.col("_copy.tokens").cast("int")), "")))
    if "n_chars" in planned.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length(text).cast("long")))
    out = out.withColumn("pass", F.col("_copy.pass")).withColumn("position", F.col("_copy.position")).drop("_copy", "copies")
    return out.orderBy("position", "pass", key)


def training_ranks(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per copy with pass, tokens, position and rank: its place, from 0, in the order of training.

    The range sort of training_order, ties going by the other columns: ranges of the order are kept in
    the shared folder, and each counts on from the copies in those before it. A row that the mix leaves
    out has one row, with nulls. All columns are moved and stored, so hand in rows without texts.
    Columns pass, tokens, position and rank are replaced if there are such.
    """
    others = [c for c in planned.columns if c not in ("copies", "pass", "tokens", "position", "rank")]
    copies = planned.select(*others, F.explode_outer("copies").alias("_copy")).select(*others, "_copy.pass", "_copy.tokens", "_copy.position")
    order = ["position", "pass", key, *(c for c in others if c != key)]
    ranged = scan.in_ranges(copies, *order)
    before, _ = scan.carried(ranged, F.count("position"), 0, lambda n, more: n + more, "long")
    inside = F.count("position").over(scan.within_range(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("rank", F.when(F.col("position").isNotNull(), before + inside)).drop(scan.RANGE)


def op9_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each, and when.

    Read off the copies in the order of training; documents stand where their first copy does, those
    left out come last. Sizes are counted once over whole texts and kept in the shared folder without
    the texts. Rows are told apart by a number, as keys may be null or repeated.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.token_count("text").alias("size"), F.monotonically_increasing_id().alias("_row"))
    ranked = training_ranks(plan_mix(common.durable(docs), "doc_id"))
    first = F.round(F.min_by("position", "rank"), 9).alias("first_position")
    mixed = ranked.groupBy("_row", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("taken"), first, F.min("rank").alias("_rank"))
    return mixed.orderBy(F.col("_rank").asc_nulls_last(), "doc_id", "size", "_row").select("doc_id", "size", "source_size", "target", "taken", "first_position")


#: op9_curriculum_mix in DuckDB SQL.
OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS a FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + a % 3 AS weight, 3 * source_size AS lim FROM named
), filling AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_size,
    sum(weight) OVER (ORDER BY lim / weight, a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM weighed
), opened AS (
  SELECT rest_size, rest_weight FROM filling WHERE rest_size * weight <= lim * rest_weight ORDER BY lim / weight, a LIMIT 1
), targets AS (
  SELECT f.source, f.source_size, f.a,
    CASE WHEN f.rest_size * weight > lim * f.rest_weight THEN lim::DOUBLE ELSE weight * (o.rest_size::DOUBLE) / o.rest_weight END AS target
  FROM filling f CROSS JOIN opened o
), placed AS (
  SELECT doc_id, size, source_size, target, a, round(target)::BIGINT AS wanted,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), shares AS (
  SELECT *, greatest(0, least(size, wanted - c)) + greatest(0, least(size, wanted - c - source_size)) + greatest(0, least(size, wanted - c - 2 * source_size)) AS taken,
    c::DOUBLE / greatest(wanted, 1) AS x
  FROM placed
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken = 0 THEN NULL ELSE round(CASE a % 4
    WHEN 0 THEN x
    WHEN 1 THEN 2 * x / (1.6 + sqrt(greatest(2.56 - 2.4 * x, 0)))
    WHEN 2 THEN 2 * x / (0.4 + sqrt(greatest(0.16 + 2.4 * x, 0)))
    ELSE CASE WHEN x < 0.5 THEN 2 * x / (0.4 + sqrt(greatest(0.16 + 4.8 * x, 0))) ELSE 0.5 + 2 * (x - 0.5) / (1.6 + sqrt(greatest(2.56 - 4.8 * (x - 0.5), 0))) END
  END, 9) END AS first_position
FROM shares
"""
