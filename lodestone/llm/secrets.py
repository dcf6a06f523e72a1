"""Secret scans with corpus-wide ownership frequency.

Candidates are found by patterns. Their values' hashes are counted over the whole corpus by
distinct repositories and owners: a value that many owners hold is an example that was copied
about, one that few hold and that looks live is a credential of its owner. Besides the base
patterns, a broad pattern takes any long run of letters and digits as a candidate; of those, only
live-looking values of few owners become spans. Base spans always stay and get the verdict.

Everything is DataFrame functions. The texts are read once and go through no shuffle; what is
shuffled is a row for each candidate, without its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Kinds in their order. Each has a pattern (leftmost, non-overlapping), the group with the value,
#: and the least length of the value. `owned` is the broad pattern.
KINDS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "owned": (r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+", 0, 20),
}
#: Faster patterns that match whenever one of that kind with a value long enough exists.
HINTS = {
    "assign": r"(?i)passw|secret|token|api_?key",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "owned": r"[A-Za-z0-9+/_-]{20}",
}
#: Owners and repositories from which on a value is widely copied.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 5
#: Distinct characters from which on a value looks live.
LIVE_CHARACTERS = 10
#: Parts in which the candidates with one value meet its counts, so that a value that was copied into
#: a third of all rows isn't one task's.
SALTS = 64
#: Base kinds, whose spans always stay.
BASE = ("assign", "access", "hex")


def _matches(text: Column, kind: str) -> Column:
    """(kind, rank, at, gap, width, ok, live, hash) for each match of the pattern in turn. gap: code
    points since the match before; ok: whether the value is long enough."""
    pattern, group, least = KINDS[kind]
    pattern = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(text, pattern, F.lit(group)).alias("value"))

    def one(z: Column, i: Column) -> Column:
        value = z["value"]
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        live = mixed & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)
        ok = (F.char_length(value) >= least) & (mixed if kind not in BASE else F.lit(True))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(list(KINDS).index(kind)).alias("rank"), i.alias("at"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["whole"]).alias("width"), ok.alias("ok"), live.alias("live"), F.sha2(F.encode(value, "UTF-8"), 256).alias("hash")
        )

    found = F.transform(F.filter(zipped, lambda z: z["whole"].isNotNull()), one)
    kinds = "array<struct<kind:string,rank:int,at:int,gap:int,width:int,ok:boolean,live:boolean,hash:string>>"
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(kinds)).cast(kinds)


def ownership(candidates: DataFrame, owner: str = "owner", repository: str = "repository") -> DataFrame:
    """(hash, owners, repositories, copied) of candidate values; null owners are one owner."""
    distinct = candidates.select("hash", F.coalesce(F.col(owner), F.lit("")).alias("o"), F.coalesce(F.col(repository), F.lit("")).alias("r")).distinct()
    counted = distinct.groupBy("hash").agg(F.count_distinct("o").alias("owners"), F.count_distinct("o", "r").alias("repositories"))
    return counted.withColumn("copied", (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES))


def scan_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with spans: an array of (start, rank, end, kind, copied, live,
    owners) by start, then kind; positions are code points, ends exclusive.

    A repository is named by its owner and the repository column. Null and empty texts have no
    spans. Repeated rows stay, each with its spans, and add nothing to the counts, which are of
    distinct owners. Kept columns may have any names but spans.
    """
    found = F.concat(*(_matches(F.col("_text"), kind) for kind in KINDS))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_kept"), F.col(owner).cast("string").alias("_owner"), F.col(repository).cast("string").alias("_repository"), common.text_or_empty(text).alias("_text"))
    # the row numbers are fixed by the checkpoint
    rows = common.durable(rows.select("_row", "_kept", "_owner", "_repository", found.alias("_found")))
    each = rows.select("_row", "_owner", "_repository", F.inline("_found"))
    order = Window.partitionBy("_row", "kind").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("width")).over(so_far)
    placed = each.withColumn("end", end.cast("long")).withColumn("start", (F.col("end") - F.col("width")).cast("long")).filter("ok")
    values = ownership(each.filter("ok"), "_owner", "_repository")
    # the counts, a short row for each value, are repeated; the candidates, which may be many, are dealt
    repeated = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = placed.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(repeated, ["hash", "_salt"]).drop("_salt")
    judged = judged.filter(F.col("kind").isin(*BASE) | (F.col("live") & ~F.col("copied")))
    span = F.struct("start", "rank", "end", "kind", "copied", "live", "owners")
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    # a broad candidate within or across a base span is the same secret
    apart = lambda s: ~F.exists("spans", lambda b: (b["rank"] < len(BASE)) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = spans.withColumn("spans", F.filter("spans", lambda s: (s["rank"] < len(BASE)) | apart(s)))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("_row", "_kept").join(spans, "_row", "left").select("_kept.*", F.coalesce("spans", empty).alias("spans"))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document: base spans, all spans, and what ownership tells of them."""
    found = scan_secrets(common.table(spark, sf_dir, "documents")).withColumnRenamed("spans", "found")
    of = lambda test: F.filter("found", test)
    count = lambda test: F.size(of(test)).cast("long")
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: count(lambda s: s["kind"] == kind).alias(f"n_{kind}")
    base = digest(of(lambda s: s["rank"] < len(BASE)))
    return found.select(
        "doc_id", *map(of_kind, BASE), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"), count(lambda s: s["kind"] == "owned").alias("n_owned"), count(lambda s: s["copied"]).alias("n_copied"), count(lambda s: s["live"] & ~s["copied"]).alias("n_live")
    )


#: op3_secret_scan in DuckDB SQL.
OP3_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, coalesce(lang, '') AS l FROM documents
), m AS (
  SELECT r, o, l, t, kind, rank, least, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS wholes, CASE WHEN rank = 0 THEN regexp_extract_all(t, '{KINDS["assign"][0].replace("'", "''")}', 2) ELSE regexp_extract_all(t, pattern) END AS vals
  FROM d, (VALUES ('assign', 0, 6, '{KINDS["assign"][0].replace("'", "''")}'), ('access', 1, 20, 'AKIA[A-Z0-9]+'), ('hex', 2, 24, '[0-9a-f]{{24,}}'), ('owned', 3, 20, '[A-Za-z0-9+/_-]+')) AS k(kind, rank, least, pattern)
  WHERE regexp_matches(t, pattern)
), e AS (
  SELECT r, o, l, kind, rank, least, vals[i] AS v, len(wholes[i]) AS width, list_sum([len(x) for x in gaps[1:i]]) + coalesce(list_sum([len(x) for x in wholes[1:i - 1]]), 0) AS start
  FROM m, unnest(range(1, len(wholes) + 1)) AS u(i)
  WHERE len(vals[i]) >= least AND (rank < 3 OR regexp_matches(vals[i], '[0-9]') AND regexp_matches(vals[i], '[A-Za-z]'))
), owned AS (
  SELECT v, count(DISTINCT o) AS owners, count(DISTINCT (o, l)) AS repositories FROM e GROUP BY v
), s AS (
  SELECT r, kind, rank, start::BIGINT AS start, (start + width)::BIGINT AS stop, owners >= {COPIED_OWNERS} OR repositories >= {COPIED_REPOSITORIES} AS copied,
    regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {LIVE_CHARACTERS} AS live
  FROM e JOIN owned USING (v)
), kept AS (
  SELECT * FROM s WHERE rank < 3 OR live AND NOT copied AND NOT EXISTS (SELECT 1 FROM s b WHERE b.r = s.r AND b.rank < 3 AND b.start < s.stop AND s.start < b.stop)
), told AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_owned, count(*) FILTER (copied) AS n_copied, count(*) FILTER (live AND NOT copied) AS n_live,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0)::BIGINT AS n_owned, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN told USING (r)
"""
