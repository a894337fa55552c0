"""File readers, the snapshot store, the registry and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.operators import dedupe as D
from jobmill.operators import serving as SV
from jobmill.operators.validate import split_valid, validate_snapshots
from jobmill.plans import refresh as R
from jobmill.session import broadcast_if_small, fresh_dir
from jobmill.sources import documents, registry
from jobmill.sources.store import SnapshotStore, VersionConflict
from jobmill.streaming import jobs as ST


def write(folder, name, text):
    path = folder / name
    path.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return str(path)


def test_snapshot_file(spark, tmp_path):
    path = write(tmp_path, "s.json", {"status": "success", "results": [{"id": "1", "title": "a", "skills": ["x"]}, {"id": "2"}],
                                      "admit_cards": None, "latest_jobs": [], "extra": 1})
    rows = documents.read_snapshot(spark, path).collect()
    assert [(r.category, r.pos, r.id) for r in sorted(rows, key=lambda r: r.pos)] == [("results", 0, "1"), ("results", 1, "2")]


def test_manual_file(spark, tmp_path):
    path = write(tmp_path, "m.json", {"jobs": [{"id": "test", "title": "Test Job"}], "answerkey": [{"id": "k 1", "url": ""}]})
    rows = {r.category: r for r in documents.read_manual(spark, path).collect()}
    job, key = rows["latest_jobs"], rows["answer_keys"]
    assert (job.org, job.cat, job.vac, job.last_date, job.url) == ("Official", "Job", 0, "Asified", "post.html?id=test&cat=jobs")
    assert (key.url, key.badge, key.key_type, key.objection_date) == ("post.html?id=k+1&cat=answerkey", "new", "FINAL", "Closed")


def test_directory_file(spark, tmp_path):
    entries = [{"name": "All India", "type": "central", "aliases": ["all india"]}, {"name": "Goa", "type": "state", "aliases": ["GOA", "panaji"]}]
    directory = documents.read_directory(spark, write(tmp_path, "d.json", {"states": entries}))
    assert sorted(r.alias for r in documents.explode_aliases(directory).collect()) == ["goa", "panaji"]


def test_feed_files(spark, tmp_path):
    items = [{"legal": "x"}, {"id": 7, "position": " A  B ", "salary_min": 1000.9, "salary_max": "12.5", "apply_url": "https://a.example.com/#x", "tags": ["t"]}, {"id": "8", "position": ""}]
    row = documents.read_array_feed(spark, write(tmp_path, "a.json", items)).collect()
    assert [(r.title, r.url, r.salary, r.job_location) for r in row] == [("A B", "https://a.example.com/", "From $1,000", "Remote")]
    jobs = {"jobs": [{"url": "https://b.example.com/1", "title": "T", "publication_date": "2026-01-02T03:04:05"}, {"url": "", "title": "no"}]}
    row = documents.read_jobs_feed(spark, write(tmp_path, "j.json", jobs)).collect()
    assert [(r.title, r.posted_at, r.skills) for r in row] == [("T", "02 Jan 2026", [])]
    rss = ("<rss><channel><item><title>Acme: Dev: senior</title><link>https://c.example.com/1#x</link><description>&lt;div&gt;Headquarters: Pune: IN&lt;/div&gt;</description>"
           "<pubDate>Tue, 21 Apr 2026 10:00:00 +0000</pubDate><category>A</category><category>B</category></item>"
           "<item><title>Plain</title><link>https://c.example.com/2</link></item></channel></rss>")
    rows = {r.title: r for r in documents.read_rss_feed(spark, write(tmp_path, "f.xml", rss)).collect()}
    assert (rows["Dev: senior"].company, rows["Dev: senior"].job_location, rows["Dev: senior"].skills) == ("Acme", "Pune: IN", ["A", "B"])
    assert (rows["Plain"].company, rows["Plain"].job_location) == ("We Work Remotely", "Remote")


def test_texts_that_are_no_documents_are_named(spark):
    texts = ['{"results": []}', "[]", "nope", None, '{"results": [}']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    found = lambda kind: {r.n: r.reason for r in documents.malformed(df, kind).collect()}
    assert found("snapshot") == {1: "not an object", 2: "not json", 3: "not json", 4: "not json"}
    assert found("array_feed") == {0: "not an array", 2: "not json", 3: "not json", 4: "not json"}
    feeds = spark.createDataFrame([(0, "<rss><channel><item><title>a</title></item></channel></rss>"), (1, "<rss><channel><item>"), (2, None), (3, "<rss></rss>")], "n int, body string")
    assert set(r.n for r in documents.malformed(feeds, "rss").collect()) >= {1, 2} and 0 not in {r.n for r in documents.malformed(feeds, "rss").collect()}


def test_stated_facts_and_market_fields_reach_the_snapshot(spark):
    arrivals = spark.createDataFrame([
        (0, "OFFICIAL", "UPSC", "latest_jobs", "https://o.example.com/1", "Examiner", "31/12/2026", None, "", "UPSC", None, None),
        (1, "PRIVATE", "Naukri", "private_jobs", "https://p.example.com/1", "Clerk", None, None, None, None, "Acme", "Pune"),
        (2, "PRIVATE", "Naukri", "private_jobs", "https://p.example.com/2", "Peon", None, "5", None, None, None, None)],
        "seq bigint, source_group string, source string, category string, original_url string, title string, fact_last_date string, fact_vacancies string, "
        "fact_exam_date string, fact_category string, company string, job_location string")
    page = ("https://p.example.com/2", "PRIVATE", "<script>9999 candidates applied</script><p>Office in <b>Goa</b></p><form>x</form>")
    rows = {r.seq: r for r in R.build_snapshot(arrivals, spark.createDataFrame([page], "url_key string, site string, html string")).collect()}
    assert rows[2].body_text == "Office in Goa" and rows[2].state_label == "Goa" and rows[2].applicant_count is None
    assert (rows[0].last_date, rows[0].vacancies, rows[0].exam_date, rows[0].info_category) == ("31/12/2026", "Various", "As per Schedule", "UPSC")
    assert (rows[1].last_date, rows[1].info_category, rows[1].company, rows[1].state_label) == ("Apply ASAP", "Private Job", "Acme", "Pune")
    assert (rows[2].vacancies, rows[2].exam_date, rows[2].job_location) == ("5", "Recently posted", "")


def test_validation_and_quarantine(spark):
    texts = ['{"results":[1]}', "[]", '{"results":5}', '{"x":1}', "nope", '{"status":"running","results":null}', "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "batch_id int, body string")
    got = {r.batch_id: (r.ok, r.reason, r.status) for r in validate_snapshots(df).collect()}
    assert got[0] == (True, "", "success") and got[5] == (True, "", "running")
    assert [got[i][1] for i in (1, 2, 3, 4, 6)] == ["not an object", "invalid results", "no category", "not json", "not an object"]
    good, bad = split_valid(validate_snapshots(df))
    assert (good.count(), bad.count()) == (2, 5)


def listings(spark, ids):
    return spark.createDataFrame([(i, K.CATEGORIES[i % 6], f"u{i}") for i in ids], "seq bigint, category string, url_key string")


def test_store_shows_only_published_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.read() is None and store.compact() is None
    assert store.replace(listings(spark, range(10))) == 1
    listings(spark, range(99)).write.partitionBy("category").parquet(f"{store.root}/data/version-2-died")  # a writer that died
    assert store.read().count() == 10
    assert store.append(listings(spark, range(10, 15)), ("s", 7)) == 2 and store.read().count() == 15
    assert store.append(listings(spark, range(50)), ("s", 7)) == 2 and store.read().count() == 15  # a retried batch
    assert store.append(listings(spark, [90]), ("t", 7)) == 3 and store.read().count() == 16  # another stream's batch of that number
    assert store.compact() == 4 and store.read().count() == 16
    assert store.replace(listings(spark, [1])) == 5 and store.read().count() == 1


def test_an_empty_version_reads_as_empty(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.replace(listings(spark, []))
    assert store.read().collect() == [] and store.read().columns == ["seq", "category", "url_key"]
    store.append(listings(spark, [3]))
    assert [r.seq for r in store.read().collect()] == [3]


def test_stream_onto_a_published_snapshot_and_across_compaction(spark, tmp_path):
    schema = "seq bigint, category string, original_url string, title string"
    row = lambda i: (i, "results", f"https://a.example.com/{i}", f"t{i}")
    store, source = SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    store.replace(spark.createDataFrame([(*row(i), row(i)[2]) for i in range(10)], schema + ", url_key string"))
    for step, ids in enumerate((range(5, 30), range(30, 50))):
        spark.createDataFrame([row(i) for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
        stream = ST.read_stream(spark, source, spark.read.parquet(source).schema)
        ST.merge_into_snapshot(stream, store, str(tmp_path / "cp")).awaitTermination()
        assert sorted(r.seq for r in store.read().collect()) == list(range((30, 50)[step]))
        store.compact()


def test_run_status_of_a_failed_run(spark):
    row = SV.run_status(spark, {"results": 1}, "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:10+00:00", "boom").first()
    assert (row.status, row.duration_seconds, row.counts, row.error) == ("error", 10.0, {}, "boom")


def test_refresh_publishes_and_records(spark, tmp_path):
    arrivals = spark.createDataFrame([
        (0, "SR", "SR", "results", "https://www.sarkariresult.com/ssc-result", "SSC CGL Result 2026"),
        (1, "SR", "SR", "results", "https://www.sarkariresult.com/ssc-result#x", "SSC CGL Result 2026 again"),
        (2, "SR", "SR", "results", "https://t.me/x", "SSC CGL Result 2026"),
        (3, "REMOTE", "Remotive", "remote_jobs", "https://r.example.com/1", "Engineer")],
        "seq bigint, source_group string, source string, category string, original_url string, title string")
    html = "<h1>UPSC notice</h1><div id='post'>Last Date: 15/03/2026 <b>450 posts</b><div class='sidebar'>9999 posts</div> Bihar</div>"
    pages = spark.createDataFrame([("https://www.sarkariresult.com/ssc-result", "SR", html)], "url_key string, site string, html string")
    root = str(tmp_path / "r")
    assert R.refresh(spark, arrivals, pages, root) == 1
    rows = {r.source_group: r for r in SnapshotStore(spark, f"{root}/snapshot").read().collect()}
    assert (rows["SR"].last_date, rows["SR"].vacancies, rows["SR"].info_category, rows["SR"].state_label) == ("15/03/2026", "450", "UPSC", "Bihar")
    remote = rows["REMOTE"]
    assert (remote.last_date, remote.vacancies, remote.exam_date, remote.info_category, remote.state_label) == ("Apply ASAP", "See listing", "Recently posted", "Remote Job", "Remote")
    run = spark.read.parquet(f"{root}/runs").where("status <> 'running'").first()
    assert run.status == "success" and run.counts["results"] == 1 and run.counts["answer_keys"] == 0
    with pytest.raises(Exception):
        R.refresh(spark, arrivals.drop("title"), pages, root)
    runs = spark.read.parquet(f"{root}/runs")
    assert sorted(r.status for r in runs.collect()) == ["error", "running", "running", "success"]
    last = SV.latest_status(spark.range(1).selectExpr("1 AS workspace"), runs.withColumn("workspace", F.lit(1))).first()
    assert last.status == "error" and len(last.error) > 0
    none = str(tmp_path / "none")
    R.refresh(spark, arrivals.where("seq > 99"), pages, none)  # nothing admitted: published, read and recorded all the same
    assert SnapshotStore(spark, f"{none}/snapshot").read().count() == 0
    assert sorted(r.status for r in spark.read.parquet(f"{none}/runs").collect()) == ["running", "success"]


def test_a_registered_source_reaches_the_snapshot_last(spark):
    arrivals = spark.createDataFrame([(5, "MINE", 1, "latest_jobs", "https://m.example.com/1", "Clerk"), (6, "REMOTE", None, "remote_jobs", "https://r.example.com/1", "Engineer"),
                                      (1, "OTHER", None, "latest_jobs", "https://m.example.com/1", "Clerk again")],
                                     "seq bigint, source_group string, source_rank int, category string, original_url string, title string").withColumn("source", F.col("source_group"))
    pages = spark.createDataFrame([], "url_key string, site string, html string")
    rows = R.build_snapshot(arrivals, pages).collect()
    assert {r.source_group for r in rows} == {"MINE", "REMOTE"}  # the unranked group comes after the ranked one


def test_dedupe_is_idempotent_and_first_wins(spark):
    rows = [(3, "results", "https://a.example.com/#1", "x"), (1, "results", "https://a.example.com/#2", "y"), (2, "results", "", "x"), (5, "results", "", "x"),
            (6, "results", "", ""), (7, "admit_cards", "https://a.example.com/", "z")]
    df = spark.createDataFrame(rows, "seq bigint, category string, original_url string, id string")
    once = D.dedupe_category(df)
    assert sorted(r.seq for r in once.collect()) == [1, 2, 7]
    assert sorted(r.seq for r in D.dedupe_category(once).collect()) == [1, 2, 7]


def test_registered_sources(spark):
    registry.register_source("one", lambda s: listings(s, [1, 2]))
    registry.register_source("two", lambda s: listings(s, [3]), lambda df: df.withColumn("title", F.lit("t")))
    assert {(r.seq, r.source_group) for r in registry.load_sources(spark).collect()} == {(1, "one"), (2, "one"), (3, "two")}
    assert registry.load_sources(spark, ["two"]).count() == 1


def test_broadcast_only_below_the_limit(spark):
    small = listings(spark, [1])
    assert "broadcast" in broadcast_if_small(spark.range(10))._jdf.queryExecution().logical().toString()
    assert "broadcast" not in broadcast_if_small(spark.range(10**9), 1000)._jdf.queryExecution().logical().toString()
    assert small.count() == 1


def test_shared_folder_is_the_configured_one(spark):
    folder = fresh_dir(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stream_merges_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "seq bigint, category string, original_url string, title string"
    rows = [(i, K.CATEGORIES[i % 2], f"https://a.example.com/{i % 7}#{i}", f"t{i}") for i in range(60)]
    for part in range(4):
        spark.createDataFrame(rows[part * 15:part * 15 + 15], schema).coalesce(1).write.mode("append").parquet(source)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stream = ST.read_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    ST.merge_into_snapshot(stream, store, str(tmp_path / "cp")).awaitTermination()
    got = store.read()
    assert store.latest()[0] == 4 and got.count() == got.select("category", "url_key").distinct().count() == 14
    ST.merge_into_snapshot(stream, store, str(tmp_path / "cp")).awaitTermination()  # nothing new
    assert store.read().count() == 14


def test_stream_dedupe_across_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(2):
        df = spark.range(10).select(F.timestamp_seconds(F.lit(1767225600) + F.col("id")).alias("ts"), F.concat(F.lit("u"), (F.col("id") % 5).cast("string")).alias("url_key"))
        df.coalesce(1).write.mode("append").parquet(source)
    stream = ST.read_stream(spark, source, df.schema, files_per_batch=1)
    ST.append_files(ST.new_urls(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


class Interrupted(SnapshotStore):
    """A writer that lets others publish between writing its rows and committing them."""

    others: list = []

    def _write(self, rows):
        part = super()._write(rows)
        if self.others:
            self.others.pop(0)()
        return part


KEYS = ["category", "url_key"]


def held(store):
    return sorted(r.seq for r in store.read().collect())


def test_two_appends_from_one_version_keep_every_row_once(spark, tmp_path):
    root = str(tmp_path / "s")
    store, slow = SnapshotStore(spark, root), Interrupted(spark, root)
    store.replace(listings(spark, range(10)))
    slow.others = [lambda: store.append(listings(spark, range(5, 20)), ("a", 0), KEYS), lambda: store.append(listings(spark, range(18, 25)), ("a", 1), KEYS)]
    assert slow.append(listings(spark, range(8, 30)), ("b", 0), KEYS) == 4
    assert held(store) == list(range(30)) and store.versions() == [1, 2, 3, 4]
    assert slow.append(listings(spark, range(99)), ("b", 0), KEYS) == 4 and store.append(listings(spark, range(99)), ("a", 1), KEYS) == 4  # retried batches
    slow.others = [lambda: store.append(listings(spark, [40]))]
    slow.append(listings(spark, [50]))  # without keys the part is only listed after the other's
    assert held(store) == [*range(30), 40, 50]


def test_first_writers_meet(spark, tmp_path):
    root = str(tmp_path / "s")
    store, slow = SnapshotStore(spark, root), Interrupted(spark, root)
    slow.others = [lambda: store.append(listings(spark, range(4)), keys=KEYS)]
    assert slow.append(listings(spark, range(2, 6)), keys=KEYS) == 2 and held(store) == list(range(6))


def test_compaction_and_replacement_beside_other_writers(spark, tmp_path):
    root = str(tmp_path / "s")
    store, slow = SnapshotStore(spark, root), Interrupted(spark, root)
    store.replace(listings(spark, range(5)))
    store.append(listings(spark, range(5, 8)), keys=KEYS)
    slow.others = [lambda: store.append(listings(spark, range(6, 12)), keys=KEYS)]
    slow.compact()
    assert held(store) == list(range(12)) and len(store.latest().parts) == 2
    slow.others = [lambda: store.replace(listings(spark, [1, 2]))]
    slow.append(listings(spark, range(4)), keys=KEYS)  # its first look was at rows that are gone
    assert held(store) == [0, 1, 2, 3]
    slow.others = [lambda: store.replace(listings(spark, [7]))]
    slow.compact()
    assert held(store) == [7]
    with pytest.raises(VersionConflict):
        store.replace(listings(spark, [9]), expected=store.latest().number - 1)
    slow.others = [lambda: store.append(listings(spark, [8]))]
    with pytest.raises(VersionConflict):
        slow.append(listings(spark, [9]), expected=store.latest().number)
    assert held(store) == [7, 8] and store.read(1).count() == 5


def test_many_appends_are_compacted(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), most_parts=3)
    for i in range(6):
        store.append(listings(spark, [i]).withColumn(f"c{i % 2}", F.lit(i)))
    assert held(store) == list(range(6)) and len(store.latest().parts) <= 3 and set(store.read().columns) == {"seq", "category", "url_key", "c0", "c1"}


def test_a_source_that_fails_midway_keeps_what_it_had(spark, tmp_path):
    def failing(s):
        yield listings(s, [10, 11])
        raise RuntimeError("the second page is gone")

    def broken(s):
        yield listings(s, [20])
        yield listings(s, [21]).withColumn("title", F.expr("raise_error('bad row')"))

    registry.register_source("fails", failing)
    registry.register_source("breaks", broken)
    registry.register_source("never", lambda s: s.read.parquet(str(tmp_path / "nowhere")))
    registry.register_source("works", lambda s: [listings(s, [30]), listings(s, [31])])
    names = ["fails", "breaks", "never", "works"]
    rows, outcomes = registry.run_sources(spark, names)
    assert sorted((r.seq, r.source_group) for r in rows.collect()) == [(10, "fails"), (11, "fails"), (20, "breaks"), (30, "works"), (31, "works")]
    assert [(o.source, o.rows, o.frames) for o in outcomes] == [("fails", 2, 1), ("breaks", 1, 1), ("never", 0, 0), ("works", 2, 2)]
    assert "second page" in outcomes[0].error and "bad row" in outcomes[1].error and outcomes[2].error and outcomes[3].error is None
    assert registry.run_sources(spark, ["never"])[0] is None

    def offers(ids):
        return lambda s: s.createDataFrame([(i, "latest_jobs", f"https://m.example.com/{i}", f"Clerk {i}", "M") for i in ids], "seq bigint, category string, original_url string, title string, source string")

    def half(s):
        yield offers([1, 2])(s)
        raise RuntimeError("half")

    registry.register_source("half", half)
    registry.register_source("whole", offers([3]))
    pages, root = spark.createDataFrame([], "url_key string, site string, html string"), str(tmp_path / "r")
    R.refresh_sources(spark, pages, root, ["half", "never", "whole"])
    assert held(SnapshotStore(spark, f"{root}/snapshot")) == [1, 2, 3]
    run = spark.read.parquet(f"{root}/runs").where("status = 'success'").first()
    assert set(run.failures) == {"half", "never"} and (run.source_counts["half"], run.source_counts["whole"], run.counts["latest_jobs"]) == (2, 1, 3) and "whole" in run.sources
    R.refresh_sources(spark, pages, str(tmp_path / "q"), ["never"])
    assert SnapshotStore(spark, str(tmp_path / "q/snapshot")).read().count() == 0


def test_counts_are_taken_while_writing(spark, sf_dir):
    watch = SV.Watch(listings(spark, range(12)).withColumn("source_group", F.lit("SR")))
    assert "CollectMetrics" in watch.rows._jdf.queryExecution().optimizedPlan().toString()
    watch.rows.write.format("noop").mode("overwrite").save()
    assert watch.counts("category") == dict.fromkeys(K.CATEGORIES, 2) and watch.counts("source")["SR"] == 12 and watch.total() == 12


def test_a_batch_of_payloads_that_broke_off_is_taken_once(spark, tmp_path):
    rows = [(1, '{"results":[{"id":"a"}]}'), (2, "nope"), (3, '{"results":[{"id":"b"},{"id":"c"}]}'), (4, None), (5, '{"results":5}')]
    source, at = str(tmp_path / "in"), lambda n: f"{tmp_path}/{n}"
    spark.createDataFrame(rows, "payload_id bigint, body string").coalesce(1).write.parquet(source)
    accepted, quarantine = SnapshotStore(spark, at("a"), partition="status"), SnapshotStore(spark, at("q"), partition="reason")

    class Broken(SnapshotStore):
        def replace(self, *args, **options):
            raise RuntimeError("lost")

    stream = ST.read_stream(spark, source, spark.read.parquet(source).schema)
    with pytest.raises(Exception, match="lost"):
        ST.take_payloads(stream, Broken(spark, at("s")), accepted, quarantine, at("cp")).awaitTermination()
    store = SnapshotStore(spark, at("s"))
    for _ in range(2):
        ST.take_payloads(stream, store, accepted, quarantine, at("cp")).awaitTermination()
        assert sorted(r.payload_id for r in accepted.read().collect()) == [1, 3] and sorted(r.payload_id for r in quarantine.read().collect()) == [2, 4, 5]
        assert sorted(r.id for r in store.read().collect()) == ["b", "c"]
    spark.createDataFrame([(6, "x")], "payload_id bigint, body string").coalesce(1).write.mode("append").parquet(source)
    ST.take_payloads(stream, store, accepted, quarantine, at("cp")).awaitTermination()
    assert store.read().count() == 2 and quarantine.read().count() == 4  # nothing good, so the snapshot stays


def test_admission_goes_on_where_another_run_ended(spark, tmp_path):
    from jobmill.operators import admission as A

    import random
    rng, caps = random.Random(3), {"a": 3, "b": 2, "c": 4}
    rows = [(i, f"g{rng.randint(0, 20)}", rng.choice("abcx"), f"https://a.example.com/{rng.randint(0, 9)}") for i in range(900)]
    schema = "seq bigint, source_group string, category string, original_url string"
    whole = {(r.source_group, r.seq) for r in A.admit_capped(A.with_url_key(spark.createDataFrame(rows, schema)), caps).collect()}
    source, store = str(tmp_path / "in"), SnapshotStore(spark, str(tmp_path / "s"))
    for part in range(3):
        spark.createDataFrame(rows[part * 300:part * 300 + 300], schema).coalesce(1).write.mode("append").parquet(source)
        stream = ST.read_stream(spark, source, spark.read.parquet(source).schema)
        ST.admit_arrivals(stream, store, str(tmp_path / "cp"), caps).awaitTermination()
    assert {(r.source_group, r.seq) for r in store.read().collect()} == whole and len(store.versions()) == 3


def test_homepage_state_and_official_pages_in_a_refresh(spark):
    def row(seq, group, category, phase, page, url, title="SSC CGL Result 2026", limit=10):
        return (seq, group, group, category, url, title, phase, page, seq, limit)

    site = "https://www.freejobalert.com/"
    rows = [row(i, "FJA", "results", 0, 1, f"{site}h{i}") for i in range(14)]  # ten of a block
    rows += [row(20, "FJA", "results", 0, 2, f"{site}skipped")]  # full, so the block is skipped
    rows += [row(30 + i, "FJA", "latest_jobs", 1, 40 + i // 2, f"{site}state{i}", "Recruitment 2026", 1) for i in range(4)]  # one of a page
    rows += [row(50, "FJA", "admit_cards", 0, 3, "https://www.shine.com/x"), row(51, "FJA", "admit_cards", 0, 3, f"{site}y", ""), row(52, "FJA", "admit_cards", 0, 3, "https://elsewhere.example.com/z")]
    rows += [row(60 + i, "OFFICIAL", "latest_jobs", 1, 0, f"https://u.example.com/{i}", "Notice", 12) for i in range(15)]
    rows += [row(80 + i, "OFFICIAL", "latest_jobs", 1, 3, f"https://u.example.com/{10 + i}", "Notice", 4) for i in range(9)]  # two are taken
    rows += [row(90 + i, "SR", "results", 0, 1, f"https://www.sarkariresult.com/{i}") for i in range(10)]
    rows += [row(110 + i, "SR", "results", 0, 2, f"https://www.sarkariresult.com/late{i}") for i in range(2)]  # full, but the first is tried
    df = spark.createDataFrame(rows, "seq bigint, source_group string, source string, category string, original_url string, title string, phase int, page_seq bigint, pos bigint, page_limit int")
    got = sorted(r.seq for r in R.admit(df).collect())
    assert got == [*range(10), 30, 32, 52, *range(60, 72), 82, 83, 84, 85, *range(90, 100), 110]


def test_snapshots_by_reader_options_and_as_a_stream(spark, tmp_path):
    from jobmill.sources import snapshot_source as SS

    SS.register(spark)
    root, out = str(tmp_path / "s"), str(tmp_path / "out")
    store = SnapshotStore(spark, root)
    with pytest.raises(Exception, match="nothing is published"):
        spark.read.format(SS.NAME).load(root)
    store.append(listings(spark, range(6)))
    store.append(listings(spark, range(6, 9)).withColumn("title", F.lit("t")))
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(spark.read.format(SS.NAME).load(root)) == list(range(9)) and seqs(spark.read.format(SS.NAME).option("version", 1).load(root)) == list(range(6))
    assert {r.title for r in spark.read.format(SS.NAME).load(root).collect()} == {None, "t"}
    reader = SS.SnapshotReader(root, "category", store.read().schema, list(store.latest().parts))
    left = list(reader.pushFilters([SS.EqualTo(("category",), "results"), SS.EqualTo(("seq",), 1)]))
    assert len(left) == 1 and {f.layout for f in reader.partitions()} == {"results"}
    one = spark.read.format(SS.NAME).load(root).where("category = 'results'")
    assert seqs(one) == [0, 6] and seqs(store.read().where("category = 'results'")) == [0, 6]
    stream = spark.readStream.format(SS.NAME).load(root)
    assert ST.append_files(stream, out, str(tmp_path / "cp")).awaitTermination(300)
    store.compact()
    store.append(listings(spark, [20]).withColumn("title", F.lit("t")))
    assert ST.append_files(stream, out, str(tmp_path / "cp")).awaitTermination(300)
    assert seqs(spark.read.parquet(out)) == [*range(9), 20]
