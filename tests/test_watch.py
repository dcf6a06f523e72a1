import os
import time

from pyspark.sql import functions as F

from lodestone.plans import catalogue
from lodestone.sources.config import SnapshotConfig
from lodestone.streaming import watch as w


def test_joined_bursts():
    assert w.joined_bursts([(10, 20, 1), (0, 11, 2), (20, 30, 1), (35, 40, 1)]) == [(0, 30, 4), (35, 40, 1)]
    assert w.joined_bursts([]) == []


def test_edits_and_deletions(spark, tmp_path):
    """Files added, changed and deleted between batches, over a restart."""
    root, told = tmp_path / "repo", []
    (root / "sub").mkdir(parents=True)
    for name in ("a.md", "b.md", "sub/c.py", "skip.bin"):
        (root / name).write_text("one")

    def heard(df, number):
        told.append(sorted((r.path.removeprefix(f"{root}/"), r.change) for r in df.collect()))

    def listen():
        w.watch(spark, str(root), heard, str(tmp_path / "state"), once=True, parts=3).awaitTermination(120)
        return told[-1] if told else None

    assert listen() == [("a.md", "added"), ("b.md", "added"), ("sub/c.py", "added")]
    (root / "a.md").write_text("other")
    os.remove(root / "b.md")
    os.remove(root / "sub/c.py")
    (root / "sub/d.py").write_text("new")
    assert listen() == [("a.md", "changed"), ("b.md", "deleted"), ("sub/c.py", "deleted"), ("sub/d.py", "added")]
    count = len(told)
    listen()
    assert len(told) == count  # nothing changed, nothing is told of
    (root / "a.md").unlink()
    (root / "sub/d.py").unlink()
    assert listen() == [("a.md", "deleted"), ("sub/d.py", "deleted")]


def test_running_watch(spark, tmp_path):
    root, told = tmp_path / "repo", []
    root.mkdir()
    (root / "a.md").write_text("one")
    (root / ".ignore").write_text("b.md\n")
    running = w.watch(spark, str(root), lambda df, n: told.extend((r.path.rsplit("/", 1)[1], r.change) for r in df.collect()), str(tmp_path / "state"), config=SnapshotConfig(), parts=2)
    try:
        def wait(what):
            until = time.time() + 90
            while what not in told and time.time() < until:
                time.sleep(0.2)
            assert what in told

        wait(("a.md", "added"))
        (root / "b.md").write_text("ignored")
        (root / "c.md").write_text("two")
        wait(("c.md", "added"))
        os.remove(root / "c.md")
        wait(("c.md", "deleted"))
        assert not [t for t in told if t[0] == "b.md"]
    finally:
        running.stop()


def test_bursts_fire_and_stay_open(spark, tmp_path):
    """A burst fires once the watermark passes its end, the last ones stay in the state; whatever the time zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        seconds = {"x": [0.0, 0.5, 1.1999, 1.9, 10.0, 10.7, 30.0], "y": [0.2, 29.0]}
        rows = spark.createDataFrame([(k, s) for k, v in seconds.items() for s in v], "key string, s double")
        events = rows.select("key", (F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long") + 1_700_000_000_000_000)).alias("at"))
        events.repartition(3).write.parquet(str(tmp_path / "events"))
        stream = w.bursts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "key")
        stream.writeStream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        own = lambda df: sorted((r.key, r.changes, r.a, r.b) for r in df.select("key", "changes", (F.unix_micros("first_at") - 1_700_000_000_000_000).alias("a"), (F.unix_micros("fires_at") - 1_700_000_000_000_000).alias("b")).collect())
        fired, held = own(spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))), own(w.open_bursts(spark, str(tmp_path / "state")))
        assert fired == sorted([("x", 2, 10_000_000, 11_400_000), ("x", 3, 0, 1_899_900), ("x", 1, 1_900_000, 2_600_000), ("y", 1, 200_000, 900_000), ("y", 1, 29_000_000, 29_700_000)])
        assert held == [("x", 1, 30_000_000, 30_700_000)]
        assert fired + held == sorted(own(w.debounced(events, "at", "700 milliseconds", "key")), key=lambda r: (r in held, r))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def exactly_apart(spark):
    """Events 700 ms apart to the microsecond, a microsecond less, one more, and at one time."""
    base = 1_700_000_000_000_000
    micros = {"x": [0, 700_000, 1_399_999, 2_100_000, 2_100_000], "y": [0, 0, 700_001, 1_400_001, 2_100_001]}
    rows = spark.createDataFrame([(k, base + m) for k, v in micros.items() for m in v], "event_type string, micros long")
    told = sorted([("x", 1, 0, 700_000), ("x", 2, 700_000, 2_099_999), ("x", 2, 2_100_000, 2_800_000), ("y", 2, 0, 700_000), ("y", 1, 700_001, 1_400_001), ("y", 1, 1_400_001, 2_100_001), ("y", 1, 2_100_001, 2_800_001)])
    own = lambda df: sorted((r.event_type, r.changes, r.a, r.b) for r in df.select("event_type", "changes", *((F.unix_micros(F.col(c).cast("timestamp")) - base).alias(n) for c, n in (("first_at", "a"), ("fires_at", "b")))).collect())
    return rows.select("event_type", F.timestamp_micros("micros").cast("timestamp_ntz").alias("ts")), told, own


def test_sessions_of_events_exactly_a_gap_apart(spark, tmp_path):
    events, told, own = exactly_apart(spark)
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert own(catalogue.queries()["debounce_sessions"](spark, str(tmp_path))) == told


def test_streamed_bursts_of_events_exactly_a_gap_apart(spark, tmp_path):
    assert w.joined_bursts([(0, 10, 1), (10, 20, 1), (19, 29, 1)], touching=False) == [(0, 10, 1), (10, 29, 2)]
    events, told, own = exactly_apart(spark)
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert own(catalogue.queries()["watch_bursts"](spark, str(tmp_path))) == told
