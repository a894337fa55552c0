"""Queries that write and read back: snapshots, runs, streams, the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.urls import listing_id
from jobmill.operators import dedupe as D
from jobmill.operators import serving as SV
from jobmill.operators.admission import with_url_key
from jobmill.plans import inputs
from jobmill.plans import refresh as R
from jobmill.plans import sql as Q
from jobmill.plans.inputs import table, view
from jobmill.plans.listing_queries import ADMIT_SQL, pages_sql
from jobmill.plans.registry import query
from jobmill.session import fresh_dir
from jobmill.sources import dims
from jobmill.sources.snapshot_source import NAME, register
from jobmill.sources.store import SnapshotStore, latest_of
from jobmill.streaming import jobs as ST

_DEDUPED = f"""WITH l AS (SELECT *, {Q.norm_url('original_url')} AS url_key FROM v_listings),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, url_key ORDER BY seq) AS rn FROM l) t WHERE rn = 1)
"""


def _listings(spark, sf) -> DataFrame:
    return with_url_key(view(spark, sf, "v_listings")).withColumn("id", listing_id("category", "original_url")).select(
        "seq", "category", "id", "title", "original_url", "url_key")


@query("sink_snapshot", _DEDUPED + "SELECT seq, category, md5(category || ':' || original_url) AS id, title, url_key FROM d")
def sink_snapshot(spark, sf):
    store = SnapshotStore(spark, fresh_dir(spark, "sink_snapshot"))
    store.replace(D.dedupe_category(_listings(spark, sf)))
    return store.read().select("seq", "category", "id", "title", "url_key")


@query("latest_snapshot", "SELECT seq, category, title FROM v_listings WHERE category <> 'results'")
def latest_snapshot(spark, sf):
    """Two published versions and one that never got its row in the version table."""
    rows, root = _listings(spark, sf).select("seq", "category", "title"), fresh_dir(spark, "latest_snapshot")
    store = SnapshotStore(spark, root)
    store.replace(rows.where("seq % 2 = 0"))
    version = store.replace(rows.where("category <> 'results'"))
    rows.where("category = 'results'").write.partitionBy("category").parquet(f"{root}/data/version-{version + 1}-unfinished")
    return latest_of(spark, root, rows.where("category = 'results'")).select("seq", "category", "title")


@query("snapshot_reader", """
SELECT 'newest' AS what, seq, category, title FROM v_listings WHERE seq % 4 < 3 UNION ALL SELECT 'first', seq, category, title FROM v_listings WHERE seq % 2 = 0 AND category IN ('results', 'admit_cards')
UNION ALL SELECT 'streamed', seq, category, title FROM v_listings WHERE seq % 4 < 3""")
def snapshot_reader(spark, sf):
    """A store by ``spark.read`` (the newest version, and two categories of the first one) and by ``spark.readStream`` across a compaction."""
    rows, root = _listings(spark, sf).select("seq", "category", "title"), fresh_dir(spark, "snapshot_reader")
    register(spark)
    store = SnapshotStore(spark, f"{root}/store")
    store.append(rows.where("seq % 2 = 0"))
    opened = spark.readStream.format(NAME).load(f"{root}/store")
    for step in (lambda: store.append(rows.where("seq % 4 = 1")), store.compact):
        ST.append_files(opened, f"{root}/out", f"{root}/checkpoint").awaitTermination(600)
        step()
    ST.append_files(opened, f"{root}/out", f"{root}/checkpoint").awaitTermination(600)
    newest = spark.read.format(NAME).load(f"{root}/store")
    first = spark.read.format(NAME).option("version", 1).load(f"{root}/store").where(F.col("category").isin("results", "admit_cards"))
    streamed = spark.read.parquet(f"{root}/out")
    parts = [df.select(F.lit(what).alias("what"), "seq", "category", "title") for what, df in (("newest", newest), ("first", first), ("streamed", streamed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("run_status", """
SELECT 'success' AS status, 709.0 AS duration_seconds, kind, name, n FROM (
  SELECT 'category' AS kind, category AS name, count(*) AS n FROM v_listings GROUP BY 2 UNION ALL SELECT 'source', source_group, count(*) FROM v_listings GROUP BY 2)""")
def run_status(spark, sf):
    """A run row whose counts were taken while the snapshot was written."""
    watch = SV.Watch(view(spark, sf, "v_listings").select("seq", "category", "source_group", "title"))
    SnapshotStore(spark, fresh_dir(spark, "run_status")).replace(watch.rows)
    run = SV.run_status(spark, watch.counts("category"), "2026-04-25T15:27:00+00:00", "2026-04-25T15:38:49+00:00", source_counts=watch.counts("source"))
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), F.map_entries(m).alias("m")) for kind, m in (("category", "counts"), ("source", "source_counts"))])
    return run.select("status", "duration_seconds", F.explode(both).alias("x")).select("status", "duration_seconds", "x.kind", F.explode("x.m").alias("y")).select(
        "status", "duration_seconds", "kind", F.col("y.key").alias("name"), F.col("y.value").alias("n"))


@query("idle_status", f"""
WITH r AS (SELECT o_custkey AS workspace, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
  strftime(o_orderdate, '%Y-%m-%d') || '#' || lpad(cast(o_orderkey AS string), 12, '0') AS started_at FROM orders),
x AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY started_at DESC) AS rn FROM r)
SELECT c_custkey AS workspace, coalesce(status, 'idle') AS status, started_at, CASE WHEN status IS NULL THEN '{','.join(K.IDLE_SOURCES)}' ELSE 'one' END AS sources
FROM customer LEFT JOIN x ON x.workspace = c_custkey AND rn = 1""")
def idle_status(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    runs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("workspace"), status.alias("status"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("started_at"),
        F.lit(None).cast("string").alias("finished_at"), F.lit(None).cast("double").alias("duration_seconds"),
        F.create_map().cast("map<string,bigint>").alias("counts"), F.array(F.lit("one")).alias("sources"), F.lit(None).cast("string").alias("error"))
    workspaces = table(spark, sf, "customer").select(F.col("c_custkey").alias("workspace"))
    return SV.latest_status(workspaces, runs).select("workspace", "status", "started_at", F.array_join("sources", ",").alias("sources"))


# ------------------------------------------------------------------ streams

_ADMIT_RUNS = ADMIT_SQL.replace("min(seq) AS seq FROM l GROUP BY ALL", "arg_min(seq, (seq % 3 <> 0, seq)) AS seq FROM l GROUP BY ALL").replace("ORDER BY seq) AS rn", "ORDER BY seq % 3 <> 0, seq) AS rn")


def _event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    events = ST.read_stream(spark, sf, schema, "events.parquet")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"), F.concat(
        F.lit("https://e.example.com/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("url_key"))


@query("stream_dedupe", "SELECT DISTINCT 'https://e.example.com/' || user_id || '/' || event_type AS url_key FROM events")
def stream_dedupe(spark, sf):
    """The state outlives the span of the input, so each address comes once whatever the batches."""
    root = fresh_dir(spark, "stream_dedupe")
    ST.append_files(ST.new_urls(_event_stream(spark, sf), "400 days"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("url_key")


def _published(stream: DataFrame, spark, name: str) -> DataFrame:
    root = fresh_dir(spark, name)
    store = SnapshotStore(spark, f"{root}/result")
    ST.publish_result(stream, store, f"{root}/checkpoint").awaitTermination()
    return store.read()


@query("stream_counts", "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf):
    return _published(ST.category_counts(_event_stream(spark, sf), "category"), spark, "stream_counts").select("category", "n")


@query("stream_daily_counts", "SELECT cast(ts AS date) AS day, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf):
    return _published(ST.daily_counts(_event_stream(spark, sf), "category"), spark, "stream_daily_counts").select("day", "category", "n")


@query("stream_snapshot", _DEDUPED.replace("FROM v_listings)", "FROM v_listings WHERE seq % 3 = 0 UNION ALL SELECT *, {0} FROM v_listings WHERE seq % 3 <> 0)".format(Q.norm_url("original_url"))).replace(
    "ORDER BY seq)", "ORDER BY seq % 3 <> 0, seq % 2, seq)") + "SELECT seq, category, url_key, title FROM d")
def stream_snapshot(spark, sf):
    """A published snapshot of a third of the listings, all of them streamed onto it, and a compaction in between."""
    root, schema = fresh_dir(spark, "stream_snapshot"), table(spark, sf, "orders").schema
    listings = lambda orders: spark.sql(inputs.VIEWS["v_listings"], orders=orders).select("seq", "category", "original_url", "title")
    store = SnapshotStore(spark, f"{root}/snapshot")
    first = D.first_per_key(with_url_key(listings(table(spark, sf, "orders")).where("seq % 3 = 0")), ["category", "url_key"])
    store.replace(first)
    ST.merge_into_snapshot(listings(ST.read_stream(spark, sf, schema, "orders.parquet")).where("seq % 2 = 0"), store, f"{root}/even").awaitTermination()
    store.compact()
    ST.merge_into_snapshot(listings(ST.read_stream(spark, sf, schema, "orders.parquet")).where("seq % 2 <> 0"), store, f"{root}/odd").awaitTermination()
    return store.read().select("seq", "category", "url_key", "title")


# Most days come in order; a tenth of the first twenty days' rows come with the last.
_CHUNK = "CASE WHEN event_id % 10 = 0 AND ts < timestamp '2024-01-21 00:00:00' THEN 3 WHEN ts < timestamp '2024-01-11 00:00:00' THEN 1 WHEN ts < timestamp '2024-01-21 00:00:00' THEN 2 ELSE 3 END"


@query("stream_late_rows", f"""
WITH e AS (SELECT ts, cast(ts AS date) AS day, event_type AS category, {_CHUNK} AS chunk FROM events),
m AS (SELECT max(ts) FILTER (chunk = 1) - INTERVAL 3 DAY AS w1, max(ts) FILTER (chunk <= 2) - INTERVAL 3 DAY AS w2, max(ts) - INTERVAL 3 DAY AS w3 FROM e),
j AS (SELECT e.*, w3, coalesce(CASE chunk WHEN 2 THEN day + INTERVAL 1 DAY <= w1 WHEN 3 THEN day + INTERVAL 1 DAY <= w2 END, false) AS late FROM e, m)
SELECT CASE WHEN late THEN 'late' ELSE 'counted' END AS kind, day, category, count(*) AS n FROM j WHERE late OR day + INTERVAL 1 DAY <= w3 GROUP BY ALL""")
def stream_late_rows(spark, sf):
    """Daily counts that are final once written, from three arrivals with late rows; those are kept aside.

    The state of a day is dropped three days after it ended; days that have not ended so long ago are not out yet.
    """
    root, events = fresh_dir(spark, "stream_late_rows"), table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"))
    store = SnapshotStore(spark, f"{root}/late")
    for chunk in (1, 2, 3):
        events.where(f"{_CHUNK} = {chunk}").write.mode("append").parquet(f"{root}/in")
        stream = ST.read_stream(spark, f"{root}/in", events.schema)
        ST.append_files(ST.daily_counts(stream, "category", "3 days"), f"{root}/counts", f"{root}/counts_checkpoint").awaitTermination()
        ST.keep_late(stream, store, f"{root}/late_checkpoint", "3 DAYS").awaitTermination()
    counted = spark.read.parquet(f"{root}/counts").select(F.lit("counted").alias("kind"), "day", "category", "n")
    late = store.read().groupBy(F.col("ts").cast("date").alias("day"), "category").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(late.select(F.lit("late").alias("kind"), "day", "category", "n"))


@query("admit_across_runs", _ADMIT_RUNS + "SELECT l.source_group, l.category, l.url_key, l.seq FROM l JOIN final ON l.seq = final.seq")
def admit_across_runs(spark, sf):
    """Two runs of one stream, the second with the rest of the listings: together they admit what one run over both in this order would."""
    root, schema = fresh_dir(spark, "admit_across_runs"), table(spark, sf, "orders").schema
    store = SnapshotStore(spark, f"{root}/admitted")
    for run, part in enumerate(("seq % 3 = 0", "seq % 3 <> 0")):
        orders = ST.read_stream(spark, sf, schema, "orders.parquet")
        rows = spark.sql(inputs.VIEWS["v_listings"], orders=orders).where(part).select("seq", "source_group", "category", "original_url")
        ST.admit_arrivals(rows, store, f"{root}/run-{run}").awaitTermination()
    return store.read().select("source_group", "category", "url_key", "seq")


_TEXTS = """CASE seq % 7 WHEN 0 THEN '{"results":[{"id":"' || cast(k AS string) || '","title":"t"},{"id":"x' || cast(k AS string) || '"}],"scraped_at":"x"}' WHEN 1 THEN '{"results":null,"status":"running"}'
  WHEN 2 THEN '{"latest_jobs":"' || cast(k AS string) || '"}' WHEN 3 THEN '[' || cast(k AS string) || ']' WHEN 4 THEN '{"other":[1]}' WHEN 5 THEN '{broken' ELSE '{"admit_cards":[],"results":{}}' END"""


@query("intake_payloads", f"""
WITH j AS (SELECT seq, k, seq % 7 AS kind, {_TEXTS} AS body FROM v_listings), g AS (SELECT * FROM j WHERE kind < 2)
SELECT CASE WHEN kind < 2 THEN 'accepted' ELSE 'quarantined' END AS what, seq AS payload_id, CASE kind WHEN 0 THEN 'success' WHEN 1 THEN 'running' WHEN 2 THEN 'invalid latest_jobs'
  WHEN 3 THEN 'not an object' WHEN 4 THEN 'no category' WHEN 5 THEN 'not json' ELSE 'invalid results' END AS detail, CASE WHEN kind < 2 THEN '' ELSE body END AS body FROM j
UNION ALL SELECT 'published', seq, 'results', unnest([cast(k AS string), 'x' || k]) FROM g WHERE seq = (SELECT max(seq) FROM g) AND kind = 0""")
def intake_payloads(spark, sf):
    """Submitted snapshots as a stream; the batch is delivered once more after it was taken, and nothing is added."""
    root, schema = fresh_dir(spark, "intake_payloads"), table(spark, sf, "orders").schema
    store, accepted, quarantine = (SnapshotStore(spark, f"{root}/{n}", partition=p) for n, p in (("snapshot", "category"), ("accepted", "status"), ("quarantine", "reason")))
    orders = ST.read_stream(spark, sf, schema, "orders.parquet")
    payloads = spark.sql(inputs.VIEWS["v_listings"], orders=orders).select(F.col("seq").alias("payload_id"), F.expr(_TEXTS).alias("body"))
    for _ in range(2):
        ST.take_payloads(payloads, store, accepted, quarantine, f"{root}/checkpoint").awaitTermination()
    judged = accepted.read().select(F.lit("accepted").alias("what"), "payload_id", F.col("status").alias("detail"), F.lit("").alias("body"))
    refused = quarantine.read().select(F.lit("quarantined").alias("what"), "payload_id", F.col("reason").alias("detail"), "body")
    shown = store.read().select(F.lit("published").alias("what"), "payload_id", F.col("category").alias("detail"), F.col("id").alias("body"))
    return judged.unionByName(refused).unionByName(shown)


# ------------------------------------------------------------------ the flagship


_RANK = "CASE source_group " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(K.SOURCE_GROUPS)) + " END"
_OFFER = "source_group IN ('PRIVATE', 'REMOTE')"
_CRAWLED = ", ".join(f"'{s}'" for s in K.SITE_DOMAINS)
_SCOPE = "lower(" + Q.spaces(Q.scrub("title") + " || ' ' || substring(body_text, 1, 2500)") + ")"
FLAGSHIP_SQL = f"""WITH RECURSIVE a AS (SELECT *, {Q.norm_url('original_url')} AS url_key,
  row_number() OVER (PARTITION BY source_group, category, page_seq, phase ORDER BY pos) AS in_block FROM v_arrivals),
l AS (SELECT * FROM a WHERE CASE WHEN phase = 0 THEN in_block <= {K.HOME_LIMIT} AND title <> '' AND NOT contains(original_url, 'naukri.com')
  ELSE source_group NOT IN ({_CRAWLED}) OR {Q.candidate('title', 'original_url', 'source_group', 'category', inputs.LISTING_DOMAINS)} END),{pages_sql('l')},
j AS (SELECT l.*, coalesce('Last Date: ' || a.day || ' ' || a.k * 13 || ' posts ' || a.sentence, '') AS body_text,
  CASE WHEN a.k IS NULL THEN l.title ELSE {Q.spaces('a.heading')} END AS info_title
  FROM l JOIN final ON l.seq = final.seq LEFT JOIN v_articles a ON a.url_key = l.url_key),
t AS (SELECT *, {_SCOPE} AS t FROM j), s AS (SELECT *, {Q.states('t')} AS f, {Q.applicants('body_text')} AS h FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY category, url_key ORDER BY {_RANK}, seq) AS rn FROM s)
SELECT {_RANK} AS source_rank, seq, source_group, category, md5(category || ':' || original_url) AS id, {Q.scrub(Q.spaces('title'))} AS title, url_key,
  CASE WHEN {_OFFER} THEN 'Apply ASAP' ELSE {Q.last_date('body_text')} END AS last_date, CASE WHEN {_OFFER} THEN 'See listing' ELSE {Q.vacancies('body_text')} END AS vacancies,
  CASE WHEN {_OFFER} AND category = 'remote_jobs' THEN 'Remote Job' WHEN {_OFFER} THEN 'Private Job' ELSE {Q.title_label('info_title')} END AS info_category,
  h.n AS applicant_count, CASE WHEN {_OFFER} AND category = 'remote_jobs' THEN 'Remote' ELSE {Q.state_label('t', 'f')} END AS state_label,
  CASE WHEN {_OFFER} AND category = 'remote_jobs' THEN '' ELSE {Q.portal('t', 'f')} END AS official_state_portal FROM d WHERE rn = 1"""


@query("build_snapshot", FLAGSHIP_SQL)
def build_snapshot(spark, sf):
    arrivals = view(spark, sf, "v_arrivals", heavy=True).drop("body", "posted_on", "k")
    articles = view(spark, sf, "v_articles", heavy=True).select("url_key", "site", F.expr(inputs.ARTICLE_HTML).alias("html"))
    store = SnapshotStore(spark, fresh_dir(spark, "build_snapshot"))
    store.replace(R.build_snapshot(arrivals, articles, domains=inputs.LISTING_DOMAINS))
    return store.read().select("source_rank", "seq", "source_group", "category", "id", "title", "url_key", "last_date", "vacancies", "info_category",
                               "applicant_count", "state_label", "official_state_portal")
