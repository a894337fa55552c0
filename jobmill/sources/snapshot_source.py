"""Snapshots as a data source: ``spark.read.format("jobmill_snapshot").load(root)``, batch and stream.

Options: ``version`` (a number; the newest version without it), ``partition`` (the store's layout column, ``category``).  Filters on the
layout column prune folders, so files of other categories are not opened.  A stream gives the rows that each version added; rewriting
parts adds none, and a replacement gives its rows anew.  Tasks read one Parquet file each, batch by batch, through pyarrow's file
systems; ``SnapshotStore.read`` is the way for stores that only Hadoop's classes reach.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

NAME = "jobmill_snapshot"
NULL = "__HIVE_DEFAULT_PARTITION__"


def _opened(root: str) -> tuple:
    """The file system of a path and the path in it.  pyarrow is loaded where files are read, so planning processes stay single-threaded."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class Log:
    """The commit records of a store."""

    def __init__(self, root: str) -> None:
        self.system, self.root = _opened(root.rstrip("/"))

    def _listed(self, folder: str) -> list:
        from pyarrow import fs

        return self.system.get_file_info(fs.FileSelector(folder, allow_not_found=True))

    def numbers(self) -> list[int]:
        found = self._listed(f"{self.root}/commits")
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def record(self, number: int) -> dict:
        with self.system.open_input_stream(f"{self.root}/commits/{number:020d}.json") as stream:
            return json.loads(stream.read())

    def files(self, part: str, column: str, wanted: set | None) -> Iterator[tuple[str, str | None]]:
        """(path, value of the layout column) of the files of a part whose value is wanted."""
        for folder in self._listed(f"{self.root}/data/snapshot_part={part}"):
            if folder.base_name.startswith(f"{column}="):
                value = unquote(folder.base_name.split("=", 1)[1])
                value = None if value == NULL else value
                if wanted is None or value in wanted:
                    yield from ((f.path, value) for f in self._listed(folder.path) if f.base_name.endswith(".parquet"))


class File(InputPartition):
    def __init__(self, path: str, value: str | None) -> None:
        super().__init__(path)
        self.path, self.layout = path, value


class _Files:
    """Reads the files of partitions as batches of the snapshot's schema."""

    def __init__(self, root: str, column: str, schema: StructType) -> None:
        self.root, self.column, self.kind = root, column, schema

    def read(self, partition: File) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _opened(self.root)
        kind = to_arrow_schema(self.kind)
        with system.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(8192):
                columns = []
                for field in kind:
                    if field.name == self.column:
                        columns.append(pa.array([partition.layout] * batch.num_rows, pa.string()).cast(field.type))
                    elif field.name in batch.schema.names:
                        columns.append(batch.column(field.name).cast(field.type))
                    else:
                        columns.append(pa.nulls(batch.num_rows, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=kind)


class SnapshotReader(_Files, DataSourceReader):
    def __init__(self, root: str, column: str, schema: StructType, parts: list[str]) -> None:
        _Files.__init__(self, root, column, schema)
        self.parts, self.wanted = parts, None

    def pushFilters(self, filters):
        for test in filters:
            found = {test.value} if isinstance(test, EqualTo) else set(test.value) if isinstance(test, In) else None
            if found is None or tuple(test.attribute) != (self.column,):
                yield test
            else:
                self.wanted = found if self.wanted is None else self.wanted & found

    def partitions(self) -> list[File]:
        log = Log(self.root)
        return [File(path, value) for part in self.parts for path, value in log.files(part, self.column, self.wanted)]


class SnapshotStreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": (Log(self.root).numbers() or [0])[-1]}

    def partitions(self, start: dict, end: dict) -> list[File]:
        log, out = Log(self.root), []
        before = set(log.record(start["version"])["parts"]) if start["version"] else set()
        for number in range(start["version"] + 1, end["version"] + 1):
            record = log.record(number)
            added = [p for p in record["parts"][record["rewrite"]:] if p not in before]
            out += [File(path, value) for part in added for path, value in log.files(part, self.column, None)]
            before = set(record["parts"])
        return out

    def commit(self, end: dict) -> None:
        pass


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _place(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("partition", "category")

    def _record(self) -> dict:
        log, number = Log(self.options["path"]), self.options.get("version")
        numbers = log.numbers()
        if not numbers:
            raise ValueError(f"nothing is published in {self.options['path']}")
        return log.record(int(number) if number else numbers[-1])

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._record()["schema"]))

    def reader(self, schema: StructType) -> SnapshotReader:
        return SnapshotReader(*self._place(), schema, self._record()["parts"])

    def streamReader(self, schema: StructType) -> SnapshotStreamReader:
        return SnapshotStreamReader(*self._place(), schema)


def register(spark) -> None:
    """Make the format known to a session, and let Spark hand filters to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
