"""What the physical plans must and must not hold."""

import re

import numpy as np
import pyarrow as pa
import pytest

from jobmill.operators import joins as J
from jobmill.plans.catalog import QUERIES

WRITERS = {"sink_snapshot", "latest_snapshot", "build_snapshot", "stream_dedupe", "stream_counts", "stream_daily_counts", "stream_snapshot",
           "stream_late_rows", "admit_across_runs", "intake_payloads", "run_status", "search_postings", "snapshot_reader"}
# Conditions without any equality, against a fixed table of at most 84 rows.
PROBES = {"count_jobs_by_state", "search_states", "join_exam_eligibility",
          "join_detail_pages"}  # whose pages are all of one site, so they meet its one row of rules


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITERS])
def test_plan_has_no_product_and_no_row_at_a_time_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert ("BroadcastNestedLoopJoin" in plan) == (name in PROBES)


@pytest.mark.parametrize("name,columns", [
    ("dedupe_category", {"o_orderkey", "o_custkey"}), ("admit_capped", {"o_orderkey", "o_custkey"}), ("format_indian", {"o_orderkey", "o_totalprice"}),
    ("extract_links", {"page_id", "url", "html"}), ("file_ext_category", {"doc_id", "source"})])
def test_scan_reads_only_what_is_needed(spark, sf_dir, name, columns):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    relation = [line for line in plan.splitlines() if "Relation [" in line]
    assert relation
    executed = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
    read = executed.toString().split("ReadSchema: struct<")[1].split(">")[0]
    assert {part.split(":")[0] for part in read.replace("...", "").split(",") if ":" in part} <= columns


@pytest.mark.parametrize("name", ["cap_official_source", "home_block_slice", "filter_locker_quota", "admit_capped"])
def test_caps_limit_rows_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["tag_states", "build_listing", "extract_links", "html_to_text", "html_deep_clean", "extract_last_date", "card_view"])
def test_row_wise_work_does_not_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Exchange hashpartitioning" not in plan and plan.count("Exchange") <= 1  # the spread of a small table


@pytest.mark.parametrize("name", ["extract_cards", "extract_sections", "join_panel"])
def test_pages_are_read_and_tokenized_once(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1


def test_lookup_is_dealt_out_by_salt(spark):
    requests = spark.range(300).selectExpr("id AS request_id", "IF(id % 2 = 0, 'hot', concat('x', id)) AS id", "CAST(NULL AS string) AS requested")
    listings = spark.createDataFrame([("hot", "results", "t", 1), ("hot", "admit_cards", "u", 0), ("x7", "latest_jobs", "v", 2)], "id string, category string, title string, seq bigint")
    found = J.lookup_posts(requests, listings)
    assert "_salt" in plan_of(found) and {(r.id, r.title) for r in found.collect()} == {("hot", "t"), ("x7", "v")} and found.count() == 151


def test_wide_rows_are_not_sorted_by_key(spark, sf_dir):
    assert "SortAggregate" not in plan_of(QUERIES["dedupe_category"](spark, sf_dir))


def test_the_refresh_moves_no_html(spark, sf_dir):
    """Admitted addresses are broadcast under a checked bound, and pages are parsed where they are read."""
    from jobmill.plans import refresh as R
    from pyspark.sql import functions as F

    arrivals = spark.range(30).select(F.col("id").alias("seq"), F.lit("REMOTE").alias("source_group"), F.lit("r").alias("source"), F.lit("remote_jobs").alias("category"),
                                      F.concat(F.lit("https://r.example.com/"), F.col("id").cast("string")).alias("original_url"), F.lit("Clerk").alias("title"))
    pages = spark.range(10**9).select(F.concat(F.lit("https://r.example.com/"), F.col("id").cast("string")).alias("url_key"), F.lit("REMOTE").alias("site"), F.lit("<p>x</p>").alias("html"))
    plan = plan_of(R.build_snapshot(arrivals, pages))
    below = plan[plan.index("ArrowEvalPython"):].split("Range (0, 1000000000")[0]
    assert "BroadcastHashJoin" in below and "Exchange hashpartitioning" not in below and "SortMergeJoin" not in below


def test_a_search_reads_its_own_buckets(spark, sf_dir, tmp_path):
    from jobmill.operators import search as S
    from jobmill.operators.predicates import search_listings
    from jobmill.plans.listing_queries import _served

    listings, path = _served(spark, sf_dir), str(tmp_path / "postings")
    S.write_postings(listings, "seq", path)
    found = S.search_postings(spark, path, listings, "seq", "Engineer")
    assert {r.seq for r in found.collect()} == {r.seq for r in search_listings(listings, "Engineer").collect()}
    plan = plan_of(found)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(gram", plan)


def test_lookups_copy_the_listings_of_hot_ids_only(spark):
    requests = spark.range(300).selectExpr("id AS request_id", "IF(id % 2 = 0, 'hot', concat('x', id)) AS id", "IF(id % 3 = 0, 'results', NULL) AS requested")
    listings = spark.createDataFrame([("hot", "results", "t", 1), ("hot", "results", "s", 4), ("hot", "admit_cards", "u", 0), ("x7", "latest_jobs", "v", 2)], "id string, category string, title string, seq bigint")
    answers = lambda **o: sorted(map(tuple, J.lookup_posts(requests, listings, **o).collect()))
    assert answers(hot=100) == answers(hot=10**6) == answers(salts=1) and len(answers()) == 151
    assert answers(salts=2**22, hot=10**6) == answers()  # nothing is copied, or this would make 8 million rows
    assert re.search(r"_n#\d+L > 100000\)", plan_of(J.lookup_posts(requests, listings)))


def test_tasks_grow_with_narrow_tables(spark, sf_dir):
    from jobmill.session import spread

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    size = int(str(orders._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert spread(orders, True, most_bytes=size // 40).rdd.getNumPartitions() >= 40
    parts = orders.repartition(8)
    assert spread(parts, False, most_bytes=1).rdd.getNumPartitions() == 8  # a split for every core, and perhaps wide


def test_postings_are_made_by_all_cores(spark, sf_dir):
    from jobmill.operators import search as S
    from jobmill.plans.listing_queries import _served

    assert "Exchange RoundRobinPartitioning" in plan_of(S.postings(_served(spark, sf_dir, heavy=True), "seq"))


def _some_listings(spark, n, key="id"):
    words = "element_at(array('Engineer', 'ÉCOLE clerk', '', 'a', 'Nurse 𝔘𝔫', 'xyz'), CAST(hash({0}) % 3 + 3 AS int))"
    return spark.range(n).selectExpr(f"{key} AS seq", words.format("id * 7 + 1") + " AS title", words.format("id + 5") + " AS company", "'Pune' AS job_location", "'' AS state_label", "CAST(id AS string) AS salary",
                                     "NULL AS experience", "array('SQL', NULL) AS skills", "IF(id % 3 = 0, NULL, 'Remotive') AS source")


def test_a_posting_is_a_row_for_a_block_and_not_for_a_listing(spark):
    from jobmill.operators import search as S

    rows = S.postings(_some_listings(spark, 4000).coalesce(1), "seq")
    assert rows.select("gram").distinct().count() == rows.count() < 4000


@pytest.mark.parametrize("key", ["id", "concat('k', id)", "nullif(id, 9)", "date_add(date '2020-01-01', CAST(id AS int))"])
def test_postings_of_many_blocks_find_what_a_scan_finds(spark, tmp_path, monkeypatch, key):
    from jobmill.operators import search as S
    from jobmill.operators.predicates import search_listings

    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "CHARS", 200)
    listings, path = _some_listings(spark, 300, key).repartition(3), str(tmp_path / "postings")
    S.write_postings(listings, "seq", path)
    for query, source in (("engineer", "all"), (" ÉCOLE", "Remotive"), ("𝔘𝔫", "all"), ("e 𝔘𝔫 ", "all"), ("pune", "Remotive"), ("29", "all"), ("no such", "all"), ("sql  remotive", "all")):
        scan = sorted(str(r.seq) for r in search_listings(listings, query, source).collect() if r.seq is not None or len(query.strip()) < 3)
        assert sorted(str(r.seq) for r in S.search_postings(spark, path, listings, "seq", query, source).collect()) == scan
        assert scan or query == "no such"


def test_trigrams_places_and_keys_of_a_block():
    import random

    from jobmill.operators import search as S

    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab é𝔘") for _ in range(rnd.randint(0, 9))) for _ in range(200)]
    want = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 2):
            want.setdefault(t[at:at + 3], set()).add(i)
    assert {g: p.tolist() for g, p in S.grams_of(texts)} == {g: sorted(p) for g, p in want.items()} and S.grams_of(["", "ab"]) == []
    letters = "".join(map(chr, range(0x20, 0xD800)))
    assert S.grams_of([letters, *["abc"] * 60_000]) is None
    for size, many in ((1 << 16, 9), (1 << 16, 40_000), (70_000, 3), (70_000, 69_999), (1, 1), (5, 0)):
        places = np.sort(np.random.default_rng(many).choice(size, many, replace=False))
        assert np.flatnonzero(S.unpacked_places(S.packed_places(places, size), size)).tolist() == places.tolist()
    for keys in (pa.array([5, -3, 1 << 62, -(1 << 62), 5]), pa.array([7], pa.int32()), pa.array(["b", "", "é"]), pa.array([True, False]), pa.array([1.5, 2.0])):
        assert S.unpacked_keys(S.packed_keys(keys)).to_pylist() == keys.to_pylist()


def test_costly_tests_of_the_refresh_stay_above_the_spread(spark):
    """A plain filter moves below it, into the few tasks that read the table, and pages that nobody wants are parsed for it."""
    from jobmill.plans import refresh as R

    pages = spark.createDataFrame([("u", "SR", "<h1>a</h1>")], "url_key string, site string, html string").repartition(4)
    assert plan_of(R.article_texts(pages)).count("ArrowEvalPython") == 1
    arrivals = spark.createDataFrame([(1, "SR", "results", "https://a.example.com/1", "Clerk")], "seq bigint, source_group string, category string, original_url string, title string").repartition(4)
    plan = R.admit(arrivals)._jdf.queryExecution().optimizedPlan().toString().lower()
    below = [part.split("logicalrdd")[0] for part in plan.split("repartition 4")[1:]]  # what stands between the spread and its table
    assert "rlike" in plan and below and all("rlike" not in part for part in below)
