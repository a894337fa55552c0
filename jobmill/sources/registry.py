"""User-defined sources: a name, a reader and an adapter that yields listing rows.

A reader gives a frame, or one frame after another (the pages of a site, say).  ``run_sources`` runs every source for itself and writes
each of its frames when it comes, so a source that fails contributes what it had by then and does not end the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.operators.serving import Watch
from jobmill.session import fresh_dir

Reader = Callable[[SparkSession], DataFrame | Iterable[DataFrame]]
Adapter = Callable[[DataFrame], DataFrame]

_SOURCES: dict[str, tuple[Reader, Adapter]] = {}


def register_source(name: str, reader: Reader, adapter: Adapter = lambda df: df) -> None:
    _SOURCES[name] = (reader, adapter)


def registered_sources() -> list[str]:
    return list(_SOURCES)


def _frames(spark: SparkSession, name: str, rank: int) -> Iterable[DataFrame]:
    reader, adapter = _SOURCES[name]
    read = reader(spark)
    for frame in [read] if isinstance(read, DataFrame) else read:
        yield adapter(frame).withColumns({"source_group": F.lit(name), "source_rank": F.lit(rank)})


def _wanted(names: list[str] | None) -> list[str]:
    return [n for n in _SOURCES if names is None or n in names]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_sources(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Union of the named sources in registration order; others are not even planned, and a fault ends the run.

    ``source_rank`` is the place in that order; a refresh puts these groups behind the fixed ones.
    """
    return _union([frame for i, n in enumerate(_wanted(names)) for frame in _frames(spark, n, i)])


class Outcome(NamedTuple):
    source: str
    rows: int
    frames: int
    error: str | None


def run_sources(spark: SparkSession, names: list[str] | None = None, at_once: int = 4) -> tuple[DataFrame | None, list[Outcome]]:
    """(what the named sources gave, an outcome for each): a failed source keeps the frames that were finished, and its error.

    Rows are counted while they are written.  None if no source finished a frame.  The list of sources is configuration, so
    a driver thread for ``at_once`` of them is all that is needed; their work runs on the cluster.
    """
    wanted = _wanted(names)

    def run(i: int) -> tuple[list[str], Outcome]:
        paths, rows, error = [], 0, None
        try:
            for frame in _frames(spark, wanted[i], i):
                watch, path = Watch(frame), fresh_dir(spark, f"source_{wanted[i]}")
                watch.rows.write.parquet(path)
                paths, rows = [*paths, path], rows + watch.total()
        except Exception as fault:  # one source's fault is that source's outcome
            error = f"{type(fault).__name__}: {fault}"
        return paths, Outcome(wanted[i], rows, len(paths), error)

    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(run, range(len(wanted))))
    paths = [path for own, _ in done for path in own]
    return (_union([spark.read.parquet(path) for path in paths]) if paths else None), [outcome for _, outcome in done]
