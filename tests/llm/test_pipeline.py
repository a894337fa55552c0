"""The pipeline, stage by stage, against plain loops, and its guards."""

import random

import pytest
from test_llm_text import brute_links, brute_repeats

import corpus_pipeline as P
from jobmill.llm import langid, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, request):
    """Prose with exact and near copies, shared passages, noise, empty and missing texts."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rnd = random.Random(8)
    prose = [r for r in rows if 120 < len(r[1].split()) < 400][:12]
    new = 10_000
    for i, (_, text, lang, *_) in enumerate(prose):
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        for copy in (text, " ".join(words)) if i % 2 else (prose[0][1][:260] + "\n" + " ".join(rnd.sample(words, len(words))),):
            rows.append((new, copy, lang, "copy", len(copy)))
            new += 1
    rows += [(20_000, None, "en", "odd", None), (20_001, "", "en", "odd", 0), (20_002, "12 34", None, "odd", 5), (20_003, " ".join("xqzj#kv"[rnd.randint(0, 6)] * rnd.randint(1, 9) for _ in range(300)), "en", "odd", 9)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_every_stage_against_plain_loops(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        rows = after.collect()
        if name != "best_fit_packing":
            assert after.columns == columns and len({r.doc_id for r in rows}) == len(rows)
        if name == "language_id":
            found = {r.doc_id: r for r in langid.identify(docs).collect()}
            assert {r.doc_id for r in rows} == {i for i, r in found.items() if r.lang_pred != "und" and r.main >= 0.5} and not {20_000, 20_001, 20_002} & {r.doc_id for r in rows}
        elif name == "quality_rules":
            assert {r.doc_id for r in rows} == {r.doc_id for r in quality.judge(docs).collect() if r.kept} and 20_003 not in {r.doc_id for r in rows}
        elif name == "ngram_jaccard":
            links = brute_links([(i, r.text) for i, r in before.items()], 0.8)
            assert {r.doc_id for r in rows} == {i for i, (_, group, _) in links.items() if group == i} and len(rows) < len(before)
        elif name == "suffix_dedup":
            cut = brute_repeats([(i, r.text) for i, r in before.items()], 100)
            assert sum(c[1] for c in cut.values()) > 0 and {r.doc_id for r in rows} == {i for i, c in cut.items() if c[0] > c[1]}
            for r in rows:
                assert r.n_chars == len(r.text)
                assert (r.text == before[r.doc_id].text) == (cut[r.doc_id][1] == 0) and len(r.text.encode()) <= cut[r.doc_id][0] - cut[r.doc_id][1]
        else:
            assert {r.doc_id for r in rows} == set(before)
            placed = {}
            for r in rows:
                placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert all(sum(n for _, n in parts) <= 1024 and sorted(parts)[0][0] == 0 for parts in placed.values())
        if name in ("language_id", "quality_rules", "ngram_jaccard"):
            assert all(r == before[r.doc_id] for r in rows)
        docs = after


def test_run_equals_its_stages_and_odd_tables(spark, sf, tmp_path):
    whole = P.run(spark, sf).collect()
    assert whole and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(whole[0].asDict())
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "ngram_jaccard", "suffix_dedup", "best_fit_packing"] and P.ORACLE_SQL is None
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_stages_with_repeated_ids_and_extra_columns(spark):
    text = next(r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").collect() if 150 < len(r.text.split()) < 300 and r.text.count("the") > 3)
    rows = [(1, text, "en", "s", 1, 7), (1, text, "en", "s", 1, 8), (None, text[:400], "en", "s", 1, 9), (2, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS + ", doc int")
    near, cut = P.near_copies(spark, docs, ""), P.passages(spark, docs, "")
    assert near.columns == cut.columns == docs.columns
    assert sorted(r.doc or 0 for r in near.collect())[0] == 0 and near.where("doc_id = 1").count() == 1
    assert cut.where("doc_id = 1 OR doc_id IS NULL").count() in (2, 3) and cut.where("doc_id = 2").count() == 1
    for stage in (P.language, P.rules):
        assert stage(spark, docs, "").columns == docs.columns


def test_texts_in_two_and_three_languages_pass_the_language_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prose = {}
    for r in docs.where("lang IS NOT NULL").orderBy("doc_id").collect():
        words = [w for w in (r.text or "").split() if w.isalpha()]
        if len(words) >= 120:
            prose.setdefault(r.lang, []).append(" ".join(words[:120]))
    names = sorted(prose)
    mixed = ["\n".join(prose[x][i] for x in own) for i in range(3) for own in (names[:2], names[1:3], names[:3], names[1:4], names[:4])]
    rnd = random.Random(3)
    crumbs = ["12 34 !!", "", " ".join(str(rnd.random()) for _ in range(90))]
    rows = [(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(mixed + crumbs)]
    kept = {r.doc_id - 10**6 for r in P.language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), "").where("doc_id >= 1000000").collect()}
    assert kept == set(range(len(mixed)))
    assert langid.identify(docs.limit(0)).columns == ["doc_id", "held_out", "lang_pred", "score", "main", "spans"]
