import hashlib
import re

import pytest

from lodestone.llm import common, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, weights=(1, 2, 3), most=3):
    """By sharing out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        rest = {s: weight[s] for s in names if s not in full}
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s for s, x in share.items() if x > most * sizes[s]}
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}
        left = sum(sizes.values()) - sum(full.values())


def sized(df):
    return df.withColumn("size", common.token_count("text"))


def test_against_brute_force(odd):
    rows = mixing.plan_mix(sized(odd), "doc_id").collect()
    source = [(r.source, len(WORD.findall(r.text or ""))) for r in odd.collect()]
    sizes = {s: sum(n for t, n in source if t == s) for s in {s for s, _ in source}}
    want = targets(sizes)
    assert len(rows) == len(source)
    taken = {}
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(c.tokens for c in r.copies)
        assert [c["pass"] for c in r.copies] == list(range(len(r.copies))) and all(c.tokens == r.size for c in r.copies[:-1])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.plan_mix(sized(odd.repartition(7)), "doc_id").collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.taken, str(r.copies))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_order_within_a_source(docs):
    rows = [r for r in mixing.plan_mix(sized(docs), "doc_id").collect() if r.source == "src2"]
    rows.sort(key=lambda r: hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest())
    c, wanted = 0, round(rows[0].target)
    for r in rows:
        assert r.taken == sum(max(0, min(r.size, wanted - c - k * r.source_size)) for k in range(3))
        c += r.size


@pytest.mark.parametrize("knots", [*mixing.SCHEDULE_CYCLE, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 0.0))])
def test_inverse_of_the_demand(spark, knots):
    from pyspark.sql import functions as F

    def demand(t):
        steps, whole = 20_000, 0.0
        total = 0.0
        for i in range(steps):
            x = (i + 0.5) / steps
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                if t0 <= x < t1 or x >= t1 == 1.0:
                    w = w0 + (w1 - w0) * (x - t0) / (t1 - t0)
            total += w
            whole += w if x < t else 0
        return whole / total

    for share in (0.0, 0.1, 0.5, 0.77, 0.999):
        t = spark.range(1).select(mixing.time_of(F.lit(share), knots).alias("t")).first().t
        assert abs(demand(t) - share) < 2e-4


def test_bad_schedules():
    for knots in (((0.0, 1.0),), ((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 2.0))):
        with pytest.raises(ValueError):
            mixing._segments(knots)


def test_training_order(odd):
    planned = mixing.plan_mix(odd.drop("size").withColumn("size", common.token_count("text")), "doc_id")
    rows = mixing.training_order(planned).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert sum(len(WORD.findall(r.text)) for r in rows) == sum(r.taken for r in planned.collect())
    assert all(r.n_chars == len(r.text) for r in rows)
    # a schedule that falls gives early copies, one that rises late ones; sources stand in turn
    mean = lambda s: sum(r.position for r in rows if r.source == s) / max(1, sum(r.source == s for r in rows))
    assert mean("src1") < mean("src2")


def test_training_ranks(odd):
    planned = mixing.plan_mix(sized(odd), "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken", "copies")
    least = lambda x: (x is not None, x)
    copies = [(c.position, c["pass"], least(r.doc_id), least(r.source), r.size, c.tokens) for r in planned.collect() for c in r.copies]
    rows = mixing.training_ranks(planned).collect()
    got = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(len(copies)))
    assert [(r.position, r["pass"], least(r.doc_id), least(r.source), r.size, r.tokens) for r in got] == sorted(copies)
    assert len(rows) - len(got) == sum(r.copies == [] for r in planned.collect()) > 0
    assert all(r.position is None and r.tokens is None for r in rows if r["rank"] is None)


def test_query_goes_through_the_sort(spark, odd, tmp_path):
    """A row for each document, keys null and repeated too, where its first copy stands in training."""
    odd.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op9_curriculum_mix(spark, str(tmp_path)).collect()
    planned = mixing.plan_mix(sized(odd), "doc_id").collect()
    want = [(r.doc_id, r.size, r.source_size, r.target, r.taken, round(r.copies[0].position, 9) if r.copies else None) for r in planned]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    taken = [r for r in rows if r.taken]
    assert rows[: len(taken)] == taken and len(taken) < len(rows)
    key = lambda r: (r.first_position, r.doc_id is not None, r.doc_id)
    assert taken == sorted(taken, key=key)


def test_empty(spark, docs):
    assert mixing.plan_mix(sized(docs.limit(0)), "doc_id").count() == 0
    blank = sized(docs.filter("text IS NULL OR trim(text) = ''"))
    assert all(r.taken == 0 and r.copies == [] for r in mixing.plan_mix(blank, "doc_id").collect())


def test_empty_query(spark, docs, tmp_path):
    for name, rows in (("none", docs.limit(0)), ("blank", docs.filter("text IS NULL OR trim(text) = ''"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = mixing.op9_curriculum_mix(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == rows.count() and all(r.taken == 0 and r.first_position is None for r in got)
