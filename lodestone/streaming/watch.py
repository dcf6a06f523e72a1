"""Watching a repository as a stream: what became of its files, and bursts of changes.

changes() turns listings, taken again and again, into additions, edits and deletions, against a state
that holds every file's time and size in as many parts as the files are dealt over. bursts() is the
trailing debounce: changes at most a gap apart are one burst, which fires a gap after its last; those
exactly a gap apart can be told apart.
Both are stateful operators with event-time timers, so state lives with the executors and outlives
restarts; they need Spark's RocksDB state store, which stateful() sets for the session.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.functions.cluster import ship
from lodestone.sources.config import TEXT_EXTENSIONS, SnapshotConfig
from lodestone.sources.listing import Folder, Walk, options_of

DEBOUNCE, DEBOUNCE_MS = "700 milliseconds", 700
#: Parts that a repository's files are dealt over: state and timers of each are apart.
PARTS = 64
SCANS = "part int, scan long, at timestamp, path string, mtime_ms long, size long"
CHANGES = "part int, at timestamp, path string, change string"
BURSTS = "first long, end long, changes long"
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounced(events: DataFrame, at: str = "ts", gap: str = DEBOUNCE, *keys: str, watermark: str | None = None, touching: bool = True) -> DataFrame:
    """(keys, first_at, fires_at, changes): bursts of events at most a gap apart; a burst fires a gap
    after its last event. Without `touching`, events exactly a gap apart are two bursts. On a stream,
    give a watermark for late events, and a key at least."""
    if watermark is not None:
        events = events.withWatermark(at, watermark)
    # session windows that touch are joined, so those that must not end a microsecond earlier
    window = F.session_window(at, gap if touching else f"{gap} -1 microseconds").alias("_w")
    bursts = events.groupBy(*keys, window).agg(F.count("*").alias("changes"))
    end = F.col("_w.end") if touching else F.col("_w.end") + F.expr("INTERVAL 1 MICROSECOND")
    return bursts.select(*keys, F.col("_w.start").alias("first_at"), end.alias("fires_at"), "changes")


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)


def joined_bursts(bursts: list[tuple[int, int, int]], touching: bool = True) -> list[tuple[int, int, int]]:
    """(first, end, changes) of bursts, joined where one begins before another ends, and with `touching`
    also when it ends, as session windows are; end is a gap after the last change."""
    out: list[tuple[int, int, int]] = []
    for first, end, n in sorted(bursts):
        if out and (first < out[-1][1] or touching and first == out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((first, end, n))
    return out


class _Debounce(StatefulProcessor):
    """Holds the open bursts of a key, with a timer at the end of the first; when it expires, all that
    the watermark has passed fire."""

    def __init__(self, gap_ms: int, keys: list[str], touching: bool = True):
        self.gap, self.keys, self.touching = gap_ms * 1000, keys, touching

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, end long, changes long")

    def _hold(self, bursts: list[tuple[int, int, int]]) -> None:
        if not bursts:
            self.open.clear()
            return
        self.open.put(bursts)
        due = -(-min(end for _, end, _ in bursts) // 1000)
        if due not in set(self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = [tuple(b) for b in self.open.get()]
        for batch in rows:
            # columns that are worked out arrive without their names
            held = joined_bursts(held + [(t, t + self.gap, 1) for t in batch.iloc[:, -1].tolist()], self.touching)
        self._hold(held)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(b) for b in self.open.get()]
        fired = [b for b in held if b[1] <= passed]
        if fired:
            self._hold([b for b in held if b[1] > passed])
            yield pd.DataFrame([(*key, *b) for b in fired], columns=[*self.keys, "first", "end", "changes"])

    def close(self) -> None:
        pass


def bursts(changes: DataFrame, *keys: str, at: str = "at", gap_ms: int = DEBOUNCE_MS, watermark: str | None = "0 seconds", touching: bool = True) -> DataFrame:
    """(keys, first_at, fires_at, changes) of a stream: debounced(), each burst as soon as the watermark
    passes its end. Bursts that haven't fired when a stream stops are in its state; see open_bursts().
    Events later than the watermark are dropped; pass None if the stream has a watermark."""
    spark = changes.sparkSession
    ship(spark)
    stateful(spark)
    told = changes if watermark is None else changes.withWatermark(at, watermark)
    types = {f.name: f.dataType for f in changes.schema}
    schema = T.StructType([*(T.StructField(k, types[k]) for k in keys), *T._parse_datatype_string(BURSTS).fields])
    # times go through Python as numbers, which no time zone changes
    rows = told.select(*keys, at, F.unix_micros(at).alias("_micros")).groupBy(*keys)
    fired = rows.transformWithStateInPandas(_Debounce(gap_ms, list(keys), touching), schema, "Append", "EventTime")
    return fired.select(*keys, F.timestamp_micros("first").alias("first_at"), F.timestamp_micros("end").alias("fires_at"), "changes")


def open_bursts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The bursts that a stopped stream of bursts() still holds, from its checkpoint."""
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    of = lambda c: F.timestamp_micros(F.col(f"list_element.{c}"))
    return held.select("key.*", of("first").alias("first_at"), of("end").alias("fires_at"), F.col("list_element.changes").alias("changes"))


class _Scan(InputPartition):
    def __init__(self, folder: Folder | None, scan: int, at: float):
        super().__init__(scan)
        self.folder, self.scan, self.at = folder, scan, at


class _Scans(DataSourceStreamReader):
    """A listing for each batch. Beside the files there is a row without a path for each part, so that
    parts whose last file is gone hear of it."""

    def __init__(self, options: dict[str, str]):
        self.options, self.parts = options, int(options.get("stateparts", str(PARTS)))

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[_Scan]:
        folders = Walk(self.options, ["path", "mtime_ms", "size"]).partitions()
        return [_Scan(f, end["ms"], end["ms"] / 1000) for f in [None, *folders]]

    def read(self, partition: _Scan) -> Iterator[tuple]:
        at = datetime.fromtimestamp(partition.at, UTC)
        if partition.folder is None:
            yield from ((p, partition.scan, at, None, None, None) for p in range(self.parts))
            return
        for path, mtime_ms, size in Walk(self.options, ["path", "mtime_ms", "size"]).read(partition.folder):
            yield part_of(path, self.parts), partition.scan, at, path, mtime_ms, size

    def commit(self, end: dict) -> None:
        pass


def part_of(path: str, parts: int) -> int:
    return zlib.crc32(path.encode()) % parts


class RepositoryScans(DataSource):
    """Format "repository-scans": the files of a root at each batch, with the options of "repository"."""

    @classmethod
    def name(cls) -> str:
        return "repository-scans"

    def schema(self) -> str:
        return SCANS

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Scans(dict(self.options))


class _Compare(StatefulProcessor):
    """Holds the files of a part, and tells how a scan differs from the one before."""

    def __init__(self, initial: bool):
        self.initial = initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "mtime_ms long, size long")
        self.last = handle.getValueState("last", "scan long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows))
        scan, began = int(seen["scan"].max()), self.last.exists()
        if began and self.last.get()[0] >= scan:
            return  # this scan was told of before a restart
        at, now = seen.loc[seen["scan"] == scan, "at"].iloc[0], seen[(seen["scan"] == scan) & seen["path"].notna()]
        told = []
        for path, mtime_ms, size in zip(now["path"], now["mtime_ms"], now["size"]):
            new, old = (int(mtime_ms), int(size)), self.files.getValue((path,)) if self.files.containsKey((path,)) else None
            if old is None or tuple(old) != new:
                told.append((path, "added" if old is None else "changed"))
                self.files.updateValue((path,), new)
        there = set(now["path"])
        for (path,) in [k for k in self.files.keys() if k[0] not in there]:
            told.append((path, "deleted"))
            self.files.removeKey((path,))
        self.last.update((scan,))
        if told and (began or self.initial):
            yield pd.DataFrame({"part": key[0], "at": at, "path": [t[0] for t in told], "change": [t[1] for t in told]})

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str, config: SnapshotConfig, parts: int = PARTS, initial: bool = True) -> DataFrame:
    """(part, at, path, change) of a stream: files that are added, changed or deleted from one batch's
    listing to the next. With `initial` those of the first listing are told of as added."""
    ship(spark)
    stateful(spark)
    spark.dataSource.register(RepositoryScans)
    options = options_of(config.include, config.exclude, extensions=config.text_extensions)
    scans = spark.readStream.format("repository-scans").options(**options, stateparts=str(parts)).load(root)
    return scans.groupBy("part").transformWithStateInPandas(_Compare(initial), CHANGES, "Append", "None")


def watch(spark: SparkSession, folder: str, refresh: Callable[[DataFrame, int], None], checkpoint: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, once: bool = False, config: SnapshotConfig | None = None, parts: int = PARTS) -> StreamingQuery:
    """Calls refresh(changes, batch) with (path, change, at) of each batch that has any, path being the
    whole one; what is there at first counts as added. Listings are taken a debounce interval apart,
    so what changes within one is told of together; `once` takes one listing and stops.

    Files are those of a configuration, or of the given extensions without one.
    """
    root = folder.rstrip("/")
    config = config or SnapshotConfig(text_extensions=list(extensions))

    def told(batch: DataFrame, number: int) -> None:
        held = batch.select(F.concat(F.lit(f"{root}/"), "path").alias("path"), "change", "at").persist()
        if held.take(1):
            refresh(held, number)
        held.unpersist()

    writer = changes(spark, root, config, parts).writeStream.foreachBatch(told).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
