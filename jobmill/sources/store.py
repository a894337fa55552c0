"""Versioned snapshot folders for several writers.

The rows of a version lie in parts, each a folder of Parquet files that is written once.  A version is a commit record: a small
file, named by its number, that lists the parts, the schema and the newest batch of every stream in them.  A record is only
created if its number is free, so of two writers that start from one version one gets the next number and the
other learns of it; it then looks at the newer version, drops the rows that this one holds by now, and tries the next
number.  Readers open the parts of the newest record; what no record names is never seen, and nothing is overwritten.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from jobmill.session import broadcast_if_small
from jobmill.sources import files

MOST_PARTS = 32


class Version(NamedTuple):
    number: int
    parts: tuple[str, ...]
    schema: str
    streams: dict[str, int]
    notes: dict[str, str]
    rewrite: bool = False  # its first part holds rows of earlier versions only


class VersionConflict(RuntimeError):
    """The snapshot is no longer the version that a replacement was made for."""


class SnapshotStore:
    """``partition`` is the column that parts are laid out by; ``notes`` are small facts that are published with a version."""

    def __init__(self, spark: SparkSession, root: str, most_parts: int = MOST_PARTS, partition: str = "category") -> None:
        self.spark, self.root, self.most_parts, self.partition = spark, root, most_parts, partition

    # -------------------------------------------------------------- records

    def versions(self) -> list[int]:
        found = files.names(self.spark, f"{self.root}/commits")
        return sorted(int(name[:-5]) for name in found if name.endswith(".json") and name[:-5].isdigit())

    def version(self, number: int) -> Version:
        record = json.loads(files.read_text(self.spark, f"{self.root}/commits/{number:020d}.json"))
        return Version(number, tuple(record["parts"]), record["schema"], record["streams"], record["notes"], record["rewrite"])

    def latest(self) -> Version | None:
        numbers = self.versions()
        return self.version(numbers[-1]) if numbers else None

    @staticmethod
    def _widened(head: Version | None, rows: DataFrame) -> str:
        """The schema of ``rows`` with the columns that only the snapshot has behind; any may be null in some part."""
        held = StructType.fromJson(json.loads(head.schema)).fields if head else []
        return StructType([StructField(f.name, f.dataType) for f in (*rows.schema.fields, *(f for f in held if f.name not in rows.columns))]).json()

    def _commit(self, after: Version | None, parts: tuple[str, ...], schema: str, batch: tuple[str, int] | None, notes: dict[str, str] | None = None, rewrite: bool = False) -> Version | None:
        """The next version, or None if another writer has it."""
        streams, notes = dict(after.streams) if after else {}, {**(after.notes if after else {}), **(notes or {})}
        if batch:
            streams[batch[0]] = batch[1]
        version = Version(after.number + 1 if after else 1, parts, schema, streams, notes, rewrite)
        record = json.dumps({"parts": parts, "schema": schema, "streams": streams, "notes": notes, "rewrite": rewrite})
        return version if files.create_new(self.spark, f"{self.root}/commits/{version.number:020d}.json", record) else None

    @staticmethod
    def _holds(version: Version | None, batch: tuple[str, int] | None) -> bool:
        return bool(version and batch and version.streams.get(batch[0], -1) >= batch[1])

    def published(self, batch: tuple[str, int]) -> bool:
        """Whether this batch (stream, number), or a later one of its stream, is part of the snapshot."""
        return self._holds(self.latest(), batch)

    # -------------------------------------------------------------- rows

    def _write(self, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        # Rebalancing splits a large partition and merges crumbs, so file sizes stay even.
        rows.hint("rebalance", self.partition).write.partitionBy(self.partition).parquet(f"{self.root}/data/snapshot_part={part}")
        return part

    def _open(self, parts: tuple[str, ...], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        paths = [f"{self.root}/data/snapshot_part={part}" for part in parts]
        return self.spark.read.schema(kind).option("basePath", f"{self.root}/data").parquet(*paths).select(*kind.names)

    def _unknown(self, rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose keys are not held: the snapshot is scanned for the keys alone and, while the rows are few, not shuffled."""
        known = held.select(*keys).join(broadcast_if_small(rows.select(*keys)), keys, "left_semi")
        return rows.join(known, keys, "left_anti")

    # -------------------------------------------------------------- writers

    @staticmethod
    def _expect(head: Version | None, expected: int | None) -> None:
        if expected is not None and (head.number if head else 0) != expected:
            raise VersionConflict(f"made for version {expected}, the snapshot is version {head.number if head else 0}")

    def replace(self, rows: DataFrame, batch: tuple[str, int] | None = None, expected: int | None = None) -> int:
        """Publish ``rows`` as the whole snapshot; a batch that is published already does nothing.

        With ``expected`` the replacement is refused once the snapshot is not that version any more; without, the last one counts.
        """
        head, part = self.latest(), None
        while not self._holds(head, batch):
            self._expect(head, expected)
            part = part or self._write(rows)
            done = self._commit(head, (part,), self._widened(None, rows), batch)
            if done:
                return done.number
            head = self.latest()
        return head.number

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, keys: list[str] | None = None, expected: int | None = None, notes: dict[str, str] | None = None) -> int:
        """Publish the current snapshot plus ``rows``; only new rows are written.

        With ``keys``, rows whose keys the snapshot holds are left out (``rows`` hold a key once); where another writer comes first,
        what it added is looked up too before the next attempt.  ``rows`` may be read more than once.  With ``expected`` rows that were made
        from a version are refused once the snapshot is not that version any more.
        """
        head, fresh, seen, part = self.latest(), rows, (), None
        while not self._holds(head, batch):
            self._expect(head, expected)
            parts = head.parts if head else ()
            if part is None or keys:
                added = parts[len(seen):]
                fresh = self._unknown(fresh, self._open(added, head.schema), keys) if keys and added else fresh
                part = part if part and not added else self._write(fresh)
            done = self._commit(head, (*parts, part), self._widened(head, rows), batch, notes)
            if done:
                if len(done.parts) > self.most_parts:
                    self.compact()
                return done.number
            newer = self.latest()
            if keys:
                # Only parts that were added since need a look, unless the parts looked at are gone.
                grown = newer.parts[:len(parts)] == parts
                fresh, seen = (self._open((part,), rows.schema.json()), parts) if grown else (rows, ())
                part = part if grown and newer.parts == parts else None
            head = newer
        return head.number

    def compact(self) -> int | None:
        """Rewrite the parts of the snapshot as one; parts that others add meanwhile stay."""
        head = self.latest()
        if head is None:
            return None
        part, now = self._write(self._open(head.parts, head.schema)), head
        while now.parts[:len(head.parts)] == head.parts:
            done = self._commit(now, (part, *now.parts[len(head.parts):]), now.schema, None, rewrite=True)
            if done:
                return done.number
            now = self.latest()
        return now.number  # replaced meanwhile

    def read(self, number: int | None = None) -> DataFrame | None:
        """The published rows, of the newest version or a given one; columns that an older part lacks are null."""
        version = self.latest() if number is None else self.version(number)
        return None if version is None else self._open(version.parts, version.schema)


def latest_of(spark: SparkSession, runtime: str, base: DataFrame) -> DataFrame:
    """The newest published runtime snapshot if there is one, else the base copy."""
    current = SnapshotStore(spark, runtime).read()
    return base if current is None else current
