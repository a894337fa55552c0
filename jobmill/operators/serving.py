"""Counts and tiles of the serving pages."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.text import first_present
from jobmill.operators.dedupe import first_n, merge_by_precedence


def count_by_category(listings: DataFrame, categories: DataFrame) -> DataFrame:
    """All six categories with their number of listings, zero included."""
    counts = listings.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return categories.select("category").join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def counts_map(counts: DataFrame) -> DataFrame:
    """One row with the map category -> count; its input has one row per category."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))


def live_counts(listings: DataFrame, manual: DataFrame) -> DataFrame:
    """Scraped plus hand-entered rows per home tile that shows a count."""
    both = listings.select("category").unionByName(
        manual.where("category = 'latest_jobs'").select("category"))
    counted = both.where(F.col("category").isin(*K.COUNT_TILES))
    return counted.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def distinct_sources(listings: DataFrame, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """Facet values with their first position."""
    return listings.groupBy(first_present("source", F.lit(house)).alias("source")).agg(
        F.min("seq").alias("first_seq"))


def home_top10(listings: DataFrame, manual: DataFrame, shown: int = 10, flagged: int = 3) -> DataFrame:
    """First rows of every home tile: hand-entered before scraped, the first three flagged as new.

    Each side is cut to its own first ten per category before they meet, and every row is handed to
    the tiles of its category, so each table is read once.
    """
    scraped = first_n(listings.select("category", "seq", "title"), ["category"], "seq", shown)
    entered = first_n(manual.select("category", "seq", "title"), ["category"], "seq", shown)
    merged = merge_by_precedence([entered, scraped])
    tiles = F.array_compact(F.array(*[
        F.when((F.col("category") == category) & (F.lit(bool(key)) | (F.col("precedence") == 1)), F.lit(tile))
        for tile, (category, key) in K.HOME_TILES.items()]))
    both = merged.withColumn("tile", F.explode(tiles))
    top = first_n(both, ["tile"], ["precedence", "seq"], shown, rank="rank")
    return top.select("tile", F.col("rank").cast("bigint").alias("rank"), "title", "precedence", "seq",
                      (F.col("rank") <= flagged).alias("is_new"))


class Watch:
    """Counts of listings per category and per source group, taken while something else reads them; needs no scan of its own."""

    def __init__(self, listings: DataFrame, groups: Iterable[str] = K.SOURCE_GROUPS) -> None:
        tests = {("category", c): F.col("category") == c for c in K.CATEGORIES} if "category" in listings.columns else {}
        if "source_group" in listings.columns:
            tests |= {("source", g): F.col("source_group") == g for g in groups}
        tests["all", "rows"] = F.lit(True)
        self.names, self.seen = list(tests), Observation()
        self.rows = listings.observe(self.seen, *[F.count(F.when(test, 1)).alias(":".join(name)) for name, test in tests.items()])

    def counts(self, kind: str) -> dict[str, int]:
        """The counts by ``category`` or ``source``, once an action has read the rows."""
        try:
            found = self.seen.get
        except Py4JJavaError as error:
            if "AssertionError" not in error.java_exception.getClass().getName():
                raise
            found = {}  # Spark knew beforehand that there are no rows and read none
        return {name: found.get(f"{k}:{name}", 0) for k, name in self.names if k == kind}

    def total(self) -> int:
        return self.counts("all")["rows"]


RUN = ("status string, started_at string, finished_at string, duration_seconds double, counts map<string,bigint>, sources array<string>, "
       "source_counts map<string,bigint>, failures map<string,string>, error string")


def run_status(spark: SparkSession, counts: dict[str, int], started_at: str, finished_at: str | None, error: str | None = None, status: str | None = None,
               sources: Iterable[str] = K.RUN_SOURCES, source_counts: dict[str, int] | None = None, failures: dict[str, str] | None = None) -> DataFrame:
    """One run row.

    ``error`` makes it a failed run; it and a run that is still ``running`` (no end yet) have no counts.  A source that failed for
    itself is named in ``failures`` with its error and does not fail the run.
    """
    seconds = None if finished_at is None else round((datetime.fromisoformat(finished_at) - datetime.fromisoformat(started_at)).total_seconds(), 2)
    status = status or ("error" if error is not None else "success")
    done = status == "success"
    row = (status, started_at, finished_at, seconds, counts if done else {}, list(sources), (source_counts or {}) if done else {}, failures or {}, error)
    return spark.createDataFrame([row], RUN)


def latest_status(workspaces: DataFrame, runs: DataFrame, key: str = "workspace") -> DataFrame:
    """Newest run of every workspace; one that never ran gets the idle row."""
    newest = runs.groupBy(key).agg(
        F.max_by(F.struct("status", "started_at", "finished_at", "duration_seconds", "counts", "sources", "error"),
                 F.struct("started_at", "finished_at")).alias("_r"))
    idle = F.array(*[F.lit(s) for s in K.IDLE_SOURCES])
    return workspaces.select(key).distinct().join(newest, key, "left").select(
        key,
        F.coalesce("_r.status", F.lit("idle")).alias("status"),
        "_r.started_at", "_r.finished_at", "_r.duration_seconds",
        F.coalesce(F.col("_r.counts"), F.create_map().cast("map<string,bigint>")).alias("counts"),
        F.coalesce(F.col("_r.sources"), idle).alias("sources"),
        "_r.error",
    )
