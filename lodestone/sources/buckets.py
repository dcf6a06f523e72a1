"""Tables in hash buckets, written copy on write.

A store has tables whose rows lie in buckets by a hash of a key column. A change writes the buckets
that it touches into new folders; a manifest names the folder of each bucket of each table, so a
generation is one file, and buckets that nothing touched are shared with the generation before.
Manifests are numbered and made exclusively: of two writers that began at one generation the second
fails and changes nothing. Readers keep to the manifest they began with, whose folders stay until
KEEP further generations are there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Generations that stay readable.
KEEP = 2
#: Rows of a table, of the tables written before it and the number of buckets.
Derived = Callable[[dict[str, DataFrame], int], DataFrame]
#: Buckets of a new store: one for each ROWS rows of its first table, within these bounds.
ROWS, LEAST, MOST = 5_000, 4, 4096
#: Keys that go to all tasks at most, so that what is looked up by them needn't be shuffled; by more, rows are merged.
SENT = 10_000


class WriterConflict(RuntimeError):
    """Another writer has made a generation meanwhile."""


@dataclass
class Table:
    """key: what buckets go by; owner: what rows are replaced by; kinds: further folders below a bucket."""

    key: str
    owner: str
    kinds: tuple[str, ...] = ()


@dataclass
class Change:
    """Rows of a table in place of all its rows of some owners. keys hold the keys of all rows that
    are gone or new; rows of other keys may be given and are not looked at."""

    owners: DataFrame
    rows: DataFrame
    keys: DataFrame


def _sent(keys: DataFrame, n: int) -> DataFrame:
    """So many keys, to be sent to all tasks if they are few: plans don't know the size of what is kept."""
    return F.broadcast(keys) if n <= SENT else keys


class BucketStore:
    """The store at a place, as of its newest generation."""

    def __init__(self, spark: SparkSession, at: str, tables: dict[str, Table]):
        self.spark, self.at, self.tables = spark, at.rstrip("/"), tables
        self._kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._kind(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.number, self.manifest = self._newest()

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._kind(self.at)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._kind(self.at))]
        return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-") and n[9:].isdigit())

    def _load(self, number: int) -> dict | None:
        """A manifest; None for one that its writer hasn't ended."""
        source = self._fs.open(self._kind(f"{self.at}/manifest-{number}"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            source.close()

    def _newest(self) -> tuple[int, dict | None]:
        numbers = self._numbers()
        for n in reversed(numbers):
            if (found := self._load(n)) is not None:
                return n, found
        return 0, None

    @property
    def exists(self) -> bool:
        return self.manifest is not None

    @property
    def updated_at(self) -> str | None:
        return None if self.manifest is None else self.manifest["updated_at"]

    def bucket(self, key: Column, buckets: int | None = None) -> Column:
        """The bucket of a key, of so many, or as many as the store has."""
        return self._bucket(key, buckets or self.manifest["buckets"])

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _counts(self, keys: DataFrame) -> dict[int, int]:
        """How many rows of keys (the only column) each bucket has, of at most as many as there are."""
        return dict(map(tuple, keys.groupBy(self._bucket(F.col(keys.columns[0]), self.manifest["buckets"])).count().collect()))

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of keys (the only column): at most as many as there are."""
        return sorted(self._counts(keys))

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets, of which alone files are opened."""
        return self._read(table, self.manifest["tables"][table], buckets)

    def _read(self, table: str, told: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(told["schema"])
        paths = [f"{self.at}/{p}" for b, p in told["buckets"].items() if buckets is None or int(b) in set(buckets)]
        # folders of writes and buckets are partitions of one table
        found = self.spark.read.schema(schema).option("basePath", f"{self.at}/{table}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found.select(schema.names)

    def rows(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of keys (the only column, named as the table's key)."""
        counts = self._counts(keys)
        return self.read(table, sorted(counts)).join(_sent(keys.distinct(), sum(counts.values())), self.tables[table].key, "left_semi")

    def _write(self, table: str, rows: DataFrame, buckets: int) -> dict[int, str]:
        """The new folder of each bucket that has rows."""
        of, folder = self.tables[table], f"{table}/write={uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket(F.col(of.key), buckets)).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket", *of.kinds).parquet(f"{self.at}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._kind(f"{self.at}/{folder}"))]
        return {int(n.removeprefix("bucket=")): f"{folder}/{n}" for n in names if n.startswith("bucket=")}

    def _commit(self, manifest: dict) -> None:
        number = self.number + 1
        text = json.dumps({**manifest, "updated_at": datetime.now(UTC).isoformat()})
        try:
            out = self._fs.create(self._kind(f"{self.at}/manifest-{number}"), False)
        except Exception as e:  # noqa: BLE001  the file system's own error for files that exist
            if self._fs.exists(self._kind(f"{self.at}/manifest-{number}")):
                raise WriterConflict(f"generation {number} of {self.at} was made by another writer") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()
        self.number, self.manifest = number, self._load(number)
        self._clean()

    def _folders(self, manifest: dict | None) -> set[str]:
        return {p for t in (manifest or {"tables": {}})["tables"].values() for p in t["buckets"].values()}

    def _clean(self) -> None:
        """Removes old manifests and what they alone name."""
        old = [n for n in self._numbers() if n <= self.number - KEEP]
        kept = set().union(*(self._folders(self._load(n)) for n in self._numbers() if n > self.number - KEEP))
        for n in old:
            for path in self._folders(self._load(n)) - kept:
                self._fs.delete(self._kind(f"{self.at}/{path}"), True)
            self._fs.delete(self._kind(f"{self.at}/manifest-{n}"), False)

    def _dropping(self, made: list[str], error: BaseException) -> None:
        for path in made:
            self._fs.delete(self._kind(f"{self.at}/{path}").getParent(), True)
        raise error

    def replace(self, tables: dict[str, DataFrame | Derived], meta: dict | None = None) -> None:
        """Writes all tables whole, as a new generation, with what meta says of it; they may be read
        from the one before. All but the first may be given as what makes them of the tables written
        before them, which are read from the store instead of being worked out again."""
        first = next(iter(tables.values()))
        buckets = min(max(-(-first.count() // ROWS), LEAST), MOST)
        told, made, written = {}, [], {}
        try:
            for name, given in tables.items():
                rows = given if isinstance(given, DataFrame) else given(written, buckets)
                found = self._write(name, rows, buckets)
                made += found.values()
                told[name] = {"schema": rows.schema.jsonValue(), "buckets": {str(b): p for b, p in found.items()}}
                written[name] = self._read(name, told[name])
            self._commit({"buckets": buckets, "tables": told, "meta": meta or {}})
        except BaseException as e:  # noqa: BLE001  raised again
            self._dropping(made, e)

    def apply(self, changes: dict[str, Change]) -> dict[str, int]:
        """Rewrites the buckets that changes touch, as a new generation; how many of each table."""
        manifest, counts, made = json.loads(json.dumps(self.manifest)), {}, []
        try:
            for name, change in changes.items():
                of, touched = self.tables[name], self.buckets_of(change.keys)
                counts[name] = len(touched)
                if not touched:
                    continue
                new = change.rows.filter(self._bucket(F.col(of.key), manifest["buckets"]).isin(touched))
                owners = change.owners.select(F.col(change.owners.columns[0]).alias(of.owner))
                kept = self.read(name, touched).join(_sent(owners, owners.count()), of.owner, "left_anti")
                found = self._write(name, kept.unionByName(new.select(kept.columns)), manifest["buckets"])
                made += found.values()
                own = manifest["tables"][name]["buckets"]
                for b in touched:
                    own.pop(str(b), None)
                own.update({str(b): p for b, p in found.items()})
            if made or any(counts.values()):
                self._commit(manifest)
        except BaseException as e:  # noqa: BLE001  raised again
            self._dropping(made, e)
        return counts


@dataclass
class HeldTables:
    """Tables that are in no store, looked up in the same way."""

    tables: dict[str, Table]
    frames: dict[str, DataFrame]

    def read(self, table: str) -> DataFrame:
        return self.frames[table]

    def rows(self, table: str, keys: DataFrame) -> DataFrame:
        return self.frames[table].join(keys.distinct(), self.tables[table].key, "left_semi")

    def changed(self, changes: dict[str, Change]) -> dict[str, DataFrame]:
        """The tables after changes."""
        out = dict(self.frames)
        for name, change in changes.items():
            of = self.tables[name]
            kept = out[name].join(change.owners.select(F.col(change.owners.columns[0]).alias(of.owner)), of.owner, "left_anti")
            out[name] = kept.unionByName(change.rows.select(kept.columns))
        return out
