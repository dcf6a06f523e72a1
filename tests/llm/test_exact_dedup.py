import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup

SPACE = " \t\n\x0b\x0c\r"


def content(text):
    return "".join(c for c in text or "" if c not in SPACE)


def brute(rows):
    """For each (doc_id, text), as a sorted list: doc_id, keep_id, size, digest; and the rows kept of each content."""
    groups = {}
    for k, t in rows:
        groups.setdefault(content(t), []).append((k, t or ""))
    told, kept = [], []
    for c, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        kept.append((best[0], len(best[1]), c))
        told += [(k, best[0], len(members), hashlib.sha256(c.encode()).hexdigest()) for k, _ in members]
    return sorted(map(str, told)), sorted(map(str, kept))


def few_values(column):
    """A hash that many contents share."""
    return F.pmod(F.char_length(column), F.lit(3)).cast("string").cast("binary")


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, few_values])
def test_against_brute_force(odd, hashed):
    source = [(r.doc_id, r.text) for r in odd.collect()]
    source += [(k, f" {t}\n\n" if t else t) for k, t in source[::3]] + [(1, None), (1, None)]
    docs = odd.sparkSession.createDataFrame(source, "doc_id long, text string").repartition(4)
    told, kept = brute(source)
    rows = exact_dedup.exact_duplicates(docs, hashed=hashed).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == told
    assert sum(r.kept for r in rows) == len(kept) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    stay = exact_dedup.drop_copies(docs, hashed=hashed).collect()
    assert sorted(str((r.doc_id, len(r.text or ""), content(r.text))) for r in stay) == kept


def test_columns_and_order(spark, odd):
    """Clashing columns stay as they are; reruns over other partitions agree."""
    doubled = odd.union(odd).union(odd.withColumn("lang", F.lit("zz")))
    kept = [sorted(map(str, exact_dedup.drop_copies(doubled.repartition(n)).collect())) for n in (2, 5)]
    assert kept[0] == kept[1] and exact_dedup.drop_copies(odd).columns == odd.columns
    rows = exact_dedup.exact_duplicates(doubled).collect()
    assert len(rows) == 3 * odd.count() and sum(r.kept for r in rows) == len(kept[0])
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0 and exact_dedup.drop_copies(odd.limit(0)).count() == 0


def test_white_space(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "a b"), (4, "a\x0b\x0cb\r\n\t"), (5, "a b"), (6, "A b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_duplicates(docs).collect()) == [(1, 4), (2, 4), (3, 3), (4, 4), (5, 5), (6, 6)]


def test_one_group_holds_most_rows(spark):
    """Its rows are dealt out over the salts before they meet the group's result."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = exact_dedup.exact_duplicates(docs)
    spread = rows.filter("keep_id = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert rows.filter("keep_id = 1 AND group_size = 5400").count() == 5400 and rows.filter("kept").count() == 601
    assert spread > 1


def test_query(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = exact_dedup.op11_exact_dedup(spark, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == brute([(r.doc_id, r.text) for r in odd.collect()])[0]
