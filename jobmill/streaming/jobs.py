"""Incremental forms of the batch jobs, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobmill.operators import admission as A
from jobmill.operators.admission import with_url_key
from jobmill.operators.dedupe import first_per_key
from jobmill.operators.validate import split_valid, validate_snapshots
from jobmill.sources.documents import parse_snapshot
from jobmill.sources.store import SnapshotStore, VersionConflict


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def new_urls(links: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each address once.  State is kept for ``delay`` of event time; later repeats count as new."""
    return links.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url_key"])


def category_counts(links: DataFrame, category: str) -> DataFrame:
    return links.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(links: DataFrame, category: str, delay: str = "1 day") -> DataFrame:
    window = F.window("ts", "1 day").alias("day")
    return links.withWatermark("ts", delay).groupBy(window, category).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("day.start").cast("date").alias("day"), category, "n")


def append_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append-mode results as Parquet files (exactly once, by the sink's own log)."""
    return (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def publish_result(stream: DataFrame, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """Complete-mode results: every batch publishes the whole result as the next version."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        store.replace(batch, (checkpoint, batch_id))

    return (stream.writeStream.outputMode("complete").foreachBatch(publish)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def merge_into_snapshot(stream: DataFrame, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """Every batch adds its new listings to the published snapshot, whoever published that, and while others do.

    Only the addresses of the batch are looked up in the snapshot (it is scanned for two columns and
    not shuffled while the batch is small), and only new rows are written.  A retried batch is known by
    its stream's checkpoint and its number and does nothing.
    """
    keys = ["category", "url_key"]

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = first_per_key(with_url_key(batch).where("url_key <> ''"), keys).persist()
        try:
            store.append(fresh, (checkpoint, batch_id), keys)
        finally:
            fresh.unpersist()

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def admit_arrivals(stream: DataFrame, store: SnapshotStore, checkpoint: str, caps: dict[str, int] | None = None) -> StreamingQuery:
    """Admission under caps that goes on from run to run: what ``store`` holds is what earlier batches and runs admitted.

    The state of a group is its admitted rows, S at most, and a batch is cut to the bounded head that can matter before it meets them.  A
    batch is admitted against one version and published right after it; if another writer was first, it is admitted again.
    """
    def admit(batch: DataFrame, batch_id: int) -> None:
        rows = with_url_key(batch).persist()
        try:
            while not store.published((checkpoint, batch_id)):
                head, held = store.latest(), store.read()
                admitted = A.admit_capped(rows, caps, None if held is None else held.select("source_group", "category", "url_key"))
                try:
                    store.append(A.admitted_rows(rows, admitted), (checkpoint, batch_id), expected=head.number if head else 0)
                except VersionConflict:
                    continue
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take_payloads(stream: DataFrame, store: SnapshotStore, accepted: SnapshotStore, quarantine: SnapshotStore, checkpoint: str, order: str = "payload_id", body: str = "body") -> StreamingQuery:
    """Submitted snapshots: each is judged; the newest good one of a batch replaces the snapshot, bad ones go to quarantine whole.

    ``accepted`` (by status) and ``quarantine`` (by reason) hold every payload once between them.  All three know a batch by its number, so
    a retried batch adds nothing to any, wherever it broke off.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        key = (checkpoint, batch_id)
        checked = validate_snapshots(batch, body).persist()
        try:
            good, bad = split_valid(checked)
            quarantine.append(bad.select(order, body, "reason"), key)
            accepted.append(good.select(order, "status"), key)
            newest = good.agg(F.max(order).alias("n")).first()["n"]
            if newest is not None:
                store.replace(parse_snapshot(good.where(F.col(order) == F.lit(newest)).select(order, body), body), key)
        finally:
            checked.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_late(stream: DataFrame, store: SnapshotStore, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Rows that a daily count with this watermark drops: their day had ended ``delay`` before the newest row of earlier runs.

    The newest time so far is published with the version that holds a batch's late rows, so both advance together.
    """
    def split(batch: DataFrame, batch_id: int) -> None:
        if store.published((checkpoint, batch_id)):
            return
        head, rows = store.latest(), batch.persist()
        try:
            mark = head.notes.get("newest") if head else None
            top = rows.agg(F.max("ts").cast("string").alias("t")).first()["t"]
            limit = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            late = rows.where(F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY") <= limit)
            notes = {"newest": max(x for x in (mark, top) if x)} if mark or top else {}
            store.append(late, (checkpoint, batch_id), notes=notes)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
