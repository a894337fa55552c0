"""The cut-down fold against a plain loop, on many random groups in one job."""

import random

import pytest
from pyspark.sql import functions as F

from jobmill.operators import admission as A

CAPS = {"a": 3, "b": 2, "c": 4}


def greedy(rows, caps):
    """rows: (category, url, seq) in order."""
    taken, counts, out = set(), dict.fromkeys(caps, 0), []
    for category, url, seq in rows:
        if url and category in caps and url not in taken and counts[category] < caps[category]:
            taken.add(url)
            counts[category] += 1
            out.append(seq)
    return out


def greedy_pages(rows, caps, home_limit, late):
    """rows: dicts of one group; walks home blocks, then pages, as a reader would."""
    taken, counts, out = set(), dict.fromkeys(caps, 0), []
    pages = {}
    for row in sorted(rows, key=lambda r: (r["phase"], r["page_seq"], r["pos"])):
        pages.setdefault((row["phase"], row["page_seq"]), []).append(row)
    for (phase, _), page in pages.items():
        category = page[0]["category"]
        if phase == 0 and not late and counts[category] >= home_limit:
            continue
        limit, added = min(page[0]["page_limit"], caps[category] - counts[category]), 0
        if phase == 1 and limit <= 0:
            continue
        for row in page:
            ok = row["url_key"] not in taken and counts[category] < caps[category]
            if ok:
                taken.add(row["url_key"])
                counts[category] += 1
                added += 1
                out.append(row["seq"])
            if phase == 0 and (counts[category] >= home_limit or counts[category] >= caps[category]):
                break
            if phase == 1 and (added >= limit or counts[category] >= caps[category]):
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_admit_capped_equals_greedy(spark, seed):
    rng, rows, expected = random.Random(seed), [], set()
    for g in range(150):
        urls = rng.choice([4, 8, 15, 40])
        case = [(rng.choice("abcx"), rng.choice(["", *[f"u{i}" for i in range(urls)]]), i) for i in range(rng.choice([5, 30, 80]))]
        rows += [(f"g{g}", c, u, s) for c, u, s in case]
        expected |= {(f"g{g}", s) for s in greedy(case, CAPS)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source_group string, category string, url_key string, seq bigint")
    got = {(r.source_group, r.seq) for r in A.admit_capped(df, CAPS).collect()}
    assert got == expected


@pytest.mark.parametrize("seed,late", [(3, ()), (4, ("late",)), (5, ("late",))])
def test_admit_pages_equals_the_walk(spark, seed, late):
    rng, rows, expected = random.Random(seed), [], set()
    for g in range(150):
        group, case, seq = f"g{g}", [], 0
        urls = [f"u{i}" for i in range(rng.choice([3, 8, 20, 60]))]
        for page in range(rng.choice([1, 4, 12, 30])):
            phase, category = int(page >= rng.choice([0, 2, 6])), rng.choice("abc")
            if case and phase < case[-1]["phase"]:
                phase = 1
            for pos in range(rng.choice([1, 3, 9])):
                case.append({"source_group": group, "category": category, "phase": phase, "page_seq": page, "pos": pos,
                             "url_key": rng.choice(urls), "seq": seq, "page_limit": rng.choice([1, 2]) if pos == 0 else case[-1]["page_limit"]})
                seq += 1
        is_late = bool(late) and g % 2 == 0
        for row in case:
            row["source_group"] = name = f"late{g}" if is_late else group
        rows += case
        expected |= {(name, s) for s in greedy_pages(case, CAPS, 2, is_late)}
    schema = "source_group string, category string, phase int, page_seq bigint, pos bigint, url_key string, seq bigint, page_limit int"
    df = spark.createDataFrame(rows, schema)
    names = tuple({r["source_group"] for r in rows if r["source_group"].startswith("late")})
    got = {(r.source_group, r.seq) for r in A.admit_pages(df, CAPS, 2, 1, home_limit=2, late_check=names).collect()}
    assert got == expected


def test_refused_for_room_may_enter_elsewhere(spark):
    rows = [("g", "b", "x", 0), ("g", "b", "y", 1), ("g", "b", "late", 2), ("g", "a", "late", 3)]
    df = spark.createDataFrame(rows, "source_group string, category string, url_key string, seq bigint")
    assert {(r.category, r.seq) for r in A.admit_capped(df, CAPS).collect()} == {("b", 0), ("b", 1), ("a", 3)}
    reasons = {r.seq: r.reason for r in A.admission_outcomes(df, CAPS).collect()}
    assert reasons == {0: "admitted", 1: "admitted", 2: "full", 3: "admitted"}


def test_fold_sees_a_bounded_head_of_a_hot_group(spark):
    """A million rows of one group and category: at most S rows reach the fold."""
    df = spark.range(1_000_000).select(
        F.expr("if(id < 0, 'x', 'hot')").alias("source_group"), F.expr("if(id < 0, 'b', 'a')").alias("category"), (F.col("id") % 700_000).cast("string").alias("url_key"), F.col("id").alias("seq"))
    assert A.head_of_categories(df, CAPS).count() == A.total_cap(CAPS)
    plan = A.head_of_categories(df, CAPS)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pages_head_is_bounded_when_pages_repeat(spark):
    rows = spark.range(200_000).select(
        F.lit("hot").alias("source_group"), F.lit("a").alias("category"), F.lit(1).alias("phase"), F.col("id").alias("page_seq"),
        F.lit(0).cast("bigint").alias("pos"), F.lit("same").alias("url_key"), F.col("id").alias("seq"), F.lit(2).alias("page_limit"))
    assert A.head_of_pages(rows, CAPS, 2, 2).count() <= max(CAPS.values()) // 2 + 1
    assert [r.seq for r in A.admit_pages(rows, CAPS, 2, 2).collect()] == [0]


def test_the_fold_holds_one_page_at_a_time():
    import pyarrow as pa

    names = ("source_group", "phase", "page_seq", "category", "url_key", "is_head", "page_limit", "seq")
    rows = [(g, p // 4, p, "results", f"u{i % 9}-{p % 5}", i == 0, 3, 100 * p + i) for g in ("FJA", "SR", None) for p in range(12) for i in range(10)]
    whole = pa.table([pa.array(list(c)) for c in zip(*rows)], names=names).to_batches()[0]
    fold = A._fold_rows({"results": 20, "admit_cards": 5}, 10, ("SR",))
    read = lambda batches: [tuple(r.values()) for b in fold(iter(batches)) for r in b.to_pylist()]
    assert read([whole.slice(i, 7) for i in range(0, whole.num_rows, 7)]) == read([whole]) and len(read([whole])) >= 60
    assert read([]) == []


def test_rows_without_a_place_come_last_and_are_pages_alone(spark):
    rows = [("FJA", "results", 0, None, i, f"n{i}", i, 1) for i in range(3)] + [("FJA", "results", 0, 5, i, f"p{i}", 10 + i, 1) for i in range(2)] + [("FJA", "results", 0, 6, i, f"q{i}", 20 + i, None) for i in range(2)]
    frame = spark.createDataFrame(rows, "source_group string, category string, phase int, page_seq bigint, pos bigint, url_key string, seq bigint, page_limit int")
    found = {r.url_key for r in A.admit_pages(frame, {"results": 5, "latest_jobs": 10}, page_limit=5, min_page_limit=1).collect()}
    assert found == {"p0", "p1", "q0", "q1", "n0"}
