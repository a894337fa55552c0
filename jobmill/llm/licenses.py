"""License scan by diagonal voting and verification.

Every rolling pair of words of every document is joined to all pairs of the templates.  A match at word ``pos`` with
template word ``tpos`` votes for the diagonal ``pos - tpos``, the place where the template would begin.  The join compares the words
themselves besides their hash, so a vote is a verified match.  A phrase is found where all its pairs vote on
one diagonal, which is the same as its words standing there one after another.

A notice may have a word more or less inside, so the votes of diagonals up to ``NEIGHBOURS`` apart are merged around each diagonal.
Where enough votes meet, the span is verified: going through the template in order, each pair takes its first match behind
the last one.  The words of the pairs taken must make up ``LEAST_COVERAGE`` of the template, and the pairs that tell it from other
licences (its version, "by nc", "attribution sharealike") must all be among them; so a notice's votes are only counted in documents
that hold them.  Of verified spans that overlap the fullest stands.

The templates are a fixed list, so broadcasting them is bounded (and checked); documents are exploded and combined before the
shuffle, and no key holds more than one document's votes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmill.llm.common import picked

#: Phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening words of common notices, label, and the pairs of words that tell the licence from others.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ("gnu general", "version 3")),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", ("gnu general", "version 2")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", ("gnu general", "public license")),
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license", "version 2", "2 0")),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0", ("this file", "obtain a")),
    ("released under the mit license", "mit-notice", ("mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ("hereby granted", "this software")),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ("binary forms", "conditions are")),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ("by nc", "nc 4", "4 0")),
    ("licensed under cc by 4 0", "cc-by-4.0", ("by 4", "4 0")),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0", ("attribution sharealike", "sharealike 4", "4 0")),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", ("attribution 4", "4 0")),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ("mozilla public", "v 2", "2 0")),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEIGHBOURS = 2
LEAST_COVERAGE = 0.8
MOST_BROADCAST_ROWS = 100_000


def template_rows(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, label, is_phrase, n_template, n_pairs, n_required, tpos, gram, required) for every pair."""
    rows = []
    for number, (text, label, *pairs) in enumerate((*phrases, *notices)):
        words, needed = text.split(), set(pairs[0]) if pairs else set()
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        marks = [g in needed for g in grams]
        if sum(marks) != len(needed) or len(words) < 2:
            raise ValueError(f"{text!r}: two words or more, among them each of {sorted(needed)} once")
        rows += [(number, label, number < len(phrases), len(words), len(grams), sum(marks), i, g, m) for i, (g, m) in enumerate(zip(grams, marks, strict=True))]
    return rows


_TEMPLATE = "template int, label string, is_phrase boolean, n_template int, n_pairs int, n_required int, tpos int, gram string, required boolean"
def _possible(grams, phrases, notices) -> F.Column:
    """The templates whose telling pairs are all among a document's pairs: the only ones that its words can verify."""
    telling = [set(pairs[0]) if pairs else set() for _, _, *pairs in (*phrases, *notices)]
    texts = lambda grams: F.array(*[F.lit(g) for g in sorted(grams)]).cast("array<string>")
    present = F.array_intersect(grams, texts(set().union(*telling)))
    return F.get(F.transform(F.array(present), lambda held: F.array_compact(F.array(*[F.when(F.size(F.array_except(texts(own), held)) == 0, F.lit(i)) for i, own in enumerate(telling)]))), F.lit(0))


_OF_SPAN = ("row", "doc_id", "n_words", "template", "label", "is_phrase", "n_template", "n_pairs", "n_required")


def _verified(hits) -> F.Column:
    """(last pair, its place, words covered, required pairs, first place) after going through the hits, sorted by pair and place."""
    start = F.struct(F.lit(-2).cast("long").alias("t"), F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("needed"), F.lit(-1).cast("long").alias("first"))

    def take(so_far, hit):
        step = F.struct(hit.t.alias("t"), hit.p.alias("p"), (so_far.covered + F.when(hit.t == so_far.t + 1, 1).otherwise(2)).alias("covered"),
                        (so_far.needed + hit.needed).alias("needed"), F.when(so_far["first"] < 0, hit.p).otherwise(so_far["first"]).alias("first"))
        return F.when((hit.t > so_far.t) & (hit.p > so_far.p), step).otherwise(so_far)

    return F.aggregate(hits, start, take)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES,
                  least: float = LEAST_COVERAGE, neighbours: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its word count, spans).  A phrase or notice needs two words or more.

    Null text is empty; a document without words gets zeros and empty labels; repeated rows and null ids are documents of
    their own; an empty table gives no rows.  Spans: row, template, label, is_phrase, start (the diagonal), first_word, last_word, coverage.
    """
    spark = docs.sparkSession
    rows = template_rows(phrases, notices)
    templates = spark.createDataFrame(rows, _TEMPLATE).withColumn("hash", F.xxhash64("gram")).withColumnRenamed("gram", "t_gram")
    templates = F.broadcast(templates) if len(rows) <= MOST_BROADCAST_ROWS else templates
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")
    pairs = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    exploded = (
        picked(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", words.alias("words")).select("row", "doc_id", F.size("words").cast("long").alias("n_words"), pairs.alias("grams"))
        .withColumn("possible", _possible(F.col("grams"), phrases, notices))
        .select("row", "doc_id", "n_words", "possible", F.posexplode_outer("grams").alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    )
    hits = exploded.join(templates, (exploded["hash"] == templates["hash"]) & (F.col("gram") == F.col("t_gram")) & F.array_contains("possible", F.col("template")), "left")
    hits = hits.where("template IS NOT NULL OR pos IS NULL OR pos = 0")  # the first word keeps documents without a match
    hit = F.struct(F.col("tpos").cast("long").alias("t"), F.col("pos").cast("long").alias("p"), F.col("required").cast("long").alias("needed"))
    votes = hits.groupBy(*_OF_SPAN, (F.col("pos") - F.col("tpos")).cast("long").alias("diagonal")).agg(F.collect_list(F.when(F.col("template").isNotNull(), hit)).alias("hits"))  # a template's pairs at most
    around = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-neighbours, neighbours)
    merged = votes.withColumn("near", F.when(F.col("is_phrase"), F.col("hits")).otherwise(F.flatten(F.collect_list("hits").over(around))))
    # A pair covers two words, so fewer votes than half of the words asked for cannot do.
    enough = F.when(F.col("is_phrase"), F.size("near") == F.col("n_pairs")).otherwise(2 * F.size("near") >= least * F.col("n_template"))
    checked = merged.withColumn("v", F.when(enough, _verified(F.array_sort("near")))).drop("hits", "near")
    coverage = F.col("v.covered") / F.col("n_template")
    enough_covered = (coverage >= least) & (F.col("v.needed") == F.col("n_required"))
    found = F.coalesce(F.when(F.col("is_phrase"), F.col("v").isNotNull()).otherwise(enough_covered), F.lit(False))
    per_row = checked.select(*_OF_SPAN, "diagonal", found.alias("found"), F.when(F.col("is_phrase"), F.lit(1.0)).otherwise(coverage).alias("coverage"),
                             F.col("v.first").alias("first"), (F.col("v.p") + 1).alias("last"))
    spans = per_row.where("found").select("row", "doc_id", "template", "label", "is_phrase", F.col("diagonal").alias("start"), F.col("first").alias("first_word"), F.col("last").alias("last_word"), "coverage")
    fullest = W.partitionBy("row", "template", "last_word").orderBy(F.desc("coverage"), "start")  # neighbouring diagonals verify the same place
    spans = spans.withColumn("nth", F.row_number().over(fullest)).where("nth = 1").drop("nth")
    base = F.col("found") & F.col("is_phrase")
    joined = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    result = per_row.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("diagonal"))).alias("first_word"), F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"), F.coalesce(F.max(F.when(F.col("found"), F.col("coverage"))), F.lit(0.0)).alias("score"))
    return result.drop("row"), spans


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {str(p).lower()}, {n}, {m}, {r}, {i}, '{g}', {int(q)})" for t, label, p, n, m, r, i, g, q in template_rows())


#: The rule itself: of the pairs that match around a place, one after another in order; their words, and the pairs that must be there.
SQL = f"""
WITH t(template, label, is_phrase, n_template, n_pairs, n_required, tpos, gram, required) AS (VALUES {_values()}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(len(words))) AS pos, unnest(list_transform(range(len(words)), lambda i: words[i + 1] || ' ' || coalesce(words[i + 2], ''))) AS gram FROM w),
h AS (SELECT doc_id, t.*, pos, pos - tpos AS diagonal FROM g JOIN t USING (gram)),
c AS (SELECT DISTINCT doc_id, template, diagonal FROM h),
m AS (SELECT c.doc_id, c.diagonal, h.template, h.label, h.is_phrase, h.n_template, h.n_pairs, h.n_required,
  list({{'t': cast(h.tpos AS bigint), 'p': cast(h.pos AS bigint), 'covered': cast(0 AS bigint), 'needed': cast(h.required AS bigint)}} ORDER BY h.tpos, h.pos) AS near
  FROM c JOIN h ON h.doc_id IS NOT DISTINCT FROM c.doc_id AND h.template = c.template AND abs(h.diagonal - c.diagonal) <= CASE WHEN h.is_phrase THEN 0 ELSE {NEIGHBOURS} END GROUP BY ALL),
v AS (SELECT * EXCLUDE (near), len(near) AS n, list_reduce(list_concat([{{'t': cast(-2 AS bigint), 'p': cast(-1 AS bigint), 'covered': cast(0 AS bigint), 'needed': cast(0 AS bigint)}}], near),
  lambda a, x: CASE WHEN x.t > a.t AND x.p > a.p THEN {{'t': x.t, 'p': x.p, 'covered': a.covered + CASE WHEN x.t = a.t + 1 THEN 1 ELSE 2 END, 'needed': a.needed + x.needed}} ELSE a END) AS v FROM m),
f AS (SELECT *, CASE WHEN is_phrase THEN 1.0::DOUBLE ELSE v.covered::DOUBLE / n_template END AS coverage,
  CASE WHEN is_phrase THEN n = n_pairs ELSE v.covered::DOUBLE / n_template >= {LEAST_COVERAGE} AND v.needed = n_required END AS found FROM v),
r AS (SELECT doc_id, count(*) FILTER (found AND is_phrase) AS n_base, min(diagonal) FILTER (found AND is_phrase) AS first_word, max(diagonal) FILTER (found AND is_phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found AND is_phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels,
  max(coverage) FILTER (found) AS score FROM f GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN r ON w.doc_id IS NOT DISTINCT FROM r.doc_id
"""
