"""Readers of the JSON and XML texts that listings arrive in.

Every reader has two forms: ``read_*`` opens files, ``parse_*`` takes a frame with one raw text per
row (as a table of fetched pages or feeds holds them).  A text is parsed where it lies; only the
rows it contains travel on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill import schemas
from jobmill.functions.dates import format_market_date
from jobmill.functions.html import text_of, tokenize, select, Select, node_text, let
from jobmill.functions.numbers import format_currency_range
from jobmill.functions.text import (first_present, normalize_spaces, present, split_company_role, strip_spaces,
                                    text_or_empty)
from jobmill.functions.urls import url_normalize

# ------------------------------------------------------------------ snapshots


def _long_snapshot(parsed: DataFrame, keep: list[str], categories: tuple[str, ...]) -> DataFrame:
    """One row per listing with its category and position; missing and NULL arrays hold none."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"_doc.{c}").alias("items"))
                      for c in categories])
    per_category = parsed.select(*keep, "_doc.status", F.explode(pairs).alias("_p"))
    per_item = per_category.select(*keep, "status", "_p.category", F.posexplode("_p.items").alias("pos", "_item"))
    return per_item.select(*keep, "status", "category", F.col("pos").cast("bigint").alias("pos"), "_item.*")


def parse_snapshot(docs: DataFrame, body: str = "body") -> DataFrame:
    keep = [c for c in docs.columns if c != body]
    schema = schemas.snapshot_schema(K.CATEGORIES)
    return _long_snapshot(docs.select(*keep, F.from_json(body, schema).alias("_doc")), keep, K.CATEGORIES)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.snapshot_schema(K.CATEGORIES)).option("multiLine", True).json(path)
    return _long_snapshot(raw.select(F.struct("*").alias("_doc")), [], K.CATEGORIES)


# ------------------------------------------------------------------ hand-entered rows


def _long_manual(parsed: DataFrame, keep: list[str]) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(key).alias("key"), F.lit(category).alias("category"), F.lit(org).alias("_org"),
                 F.lit(cat).alias("_cat"), F.col(f"_doc.{key}").alias("items"))
        for key, (category, org, cat) in K.MANUAL_KEYS.items()])
    rows = parsed.select(*keep, F.explode(pairs).alias("_p")).select(
        *keep, "_p.key", "_p.category", "_p._org", "_p._cat", F.posexplode("_p.items").alias("pos", "_i"))
    is_jobs = F.col("key") == "jobs"
    link = F.concat(F.lit("post.html?id="), F.url_encode(text_or_empty("_i.id")), F.lit("&cat="), F.col("key"))
    return rows.select(
        *keep, "category", F.col("pos").cast("bigint").alias("pos"), "_i.id", "_i.title",
        first_present("_i.org", "_org").alias("org"), first_present("_i.cat", "_cat").alias("cat"),
        F.when(is_jobs, first_present("_i.state", F.lit("All India"))).otherwise("All India").alias("state_label"),
        first_present("_i.url", link).alias("url"),
        F.when(is_jobs, F.coalesce("_i.vac", F.lit(0))).alias("vac"),
        F.when(is_jobs, first_present("_i.lastDate", F.lit("Asified"))).alias("last_date"),
        F.when(is_jobs, F.col("_i.badge")).when(F.col("key") == "results", first_present("_i.badge", F.lit("out")))
        .when(F.col("key") == "admitcard", "out").otherwise("new").alias("badge"),
        F.when(is_jobs, F.col("_i.note")).alias("note"),
        F.when(F.col("key") == "results", first_present("_i.type", F.lit("Result"))).alias("type"),
        F.when(F.col("key") == "results", first_present("_i.cutoff", F.lit("Available"))).alias("cutoff"),
        F.when(F.col("key") == "results", first_present("_i.date", F.lit("Just Now"))).alias("date"),
        F.when(F.col("key") == "results", "OUT")
        .when(F.col("key") == "admitcard", first_present("_i.status", F.lit("OUT"))).alias("status"),
        F.when(F.col("key") == "admitcard", first_present("_i.examDate", F.lit("Check specific notice"))).alias("exam_date"),
        F.when(F.col("key") == "admitcard", first_present("_i.relDate", F.lit("Just Now"))).alias("release_date"),
        F.when(F.col("key") == "answerkey", first_present("_i.keytype", F.lit("FINAL"))).alias("key_type"),
        F.when(F.col("key") == "answerkey", first_present("_i.objDate", F.lit("Closed"))).alias("objection_date"),
    )


def parse_manual(docs: DataFrame, body: str = "body") -> DataFrame:
    keep = [c for c in docs.columns if c != body]
    schema = schemas.manual_schema(tuple(K.MANUAL_KEYS))
    return _long_manual(docs.select(*keep, F.from_json(body, schema).alias("_doc")), keep)


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.manual_schema(tuple(K.MANUAL_KEYS))).option("multiLine", True).json(path)
    return _long_manual(raw.select(F.struct("*").alias("_doc")), [])


# ------------------------------------------------------------------ state directories


def parse_directory(docs: DataFrame, body: str = "body") -> DataFrame:
    """Directory texts -> (name, type, portal_url, aliases, dir_pos)."""
    keep = [c for c in docs.columns if c != body]
    parsed = docs.select(*keep, F.from_json(body, schemas.DIRECTORY).alias("_doc"))
    rows = parsed.select(*keep, F.posexplode("_doc.states").alias("dir_pos", "_s"))
    return rows.select(*keep, F.col("dir_pos").cast("bigint").alias("dir_pos"), "_s.name", "_s.type",
                       text_or_empty("_s.portal_url").alias("portal_url"), "_s.aliases")


def explode_aliases(directory: DataFrame, types: tuple[str, ...] = ("state", "ut")) -> DataFrame:
    """One row per alias; aliases of central entries are never used."""
    rows = directory.where(F.col("type").isin(*types))
    return rows.withColumn("alias", F.explode("aliases")).withColumn("alias", F.lower("alias")).drop("aliases")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return parse_directory(spark.read.option("wholetext", True).text(path), "value")


# ------------------------------------------------------------------ feeds


def _amount(value: str) -> Column:
    """A JSON amount as text: numbers lose their fraction, texts stay as they are."""
    is_number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    number = F.try_variant_get(value, "$", "double").cast("bigint").cast("string")
    return F.when(is_number, number).otherwise(F.try_variant_get(value, "$", "string"))


def array_feed_rows(items: DataFrame, keep: list[str]) -> DataFrame:
    """Items of the array-shaped feed as market rows; items without id or position are dropped."""
    rows = items.where(present("_i.id").isNotNull() & present("_i.position").isNotNull())
    rows = rows.select(
        *keep,
        normalize_spaces("_i.position").alias("title"),
        url_normalize(first_present("_i.url", "_i.apply_url")).alias("url"),
        normalize_spaces("_i.company").alias("company"),
        normalize_spaces(first_present("_i.location", F.lit("Remote"))).alias("job_location"),
        format_currency_range(_amount("_i.salary_min"), _amount("_i.salary_max")).alias("salary"),
        F.lit("See listing").alias("experience"),
        format_market_date("_i.date").alias("posted_at"),
        F.coalesce("_i.tags", F.array().cast("array<string>")).alias("skills"),
        text_or_empty("_i.description").alias("summary_html"),
    )
    return rows.where("url <> ''")


def parse_array_feed(feeds: DataFrame, body: str = "body") -> DataFrame:
    keep = [c for c in feeds.columns if c != body] + ["pos"]
    schema = f"array<{schemas.as_struct(schemas.ARRAY_FEED_ITEM)}>"
    items = feeds.select(*keep[:-1], F.posexplode(F.from_json(body, schema)).alias("pos", "_i"))
    return array_feed_rows(items.withColumn("pos", F.col("pos").cast("bigint")), keep)


def read_array_feed(spark: SparkSession, path: str) -> DataFrame:
    return parse_array_feed(spark.read.option("wholetext", True).text(path), "value")


def parse_jobs_feed(feeds: DataFrame, body: str = "body") -> DataFrame:
    keep = [c for c in feeds.columns if c != body]
    schema = f"struct<jobs:array<{schemas.as_struct(schemas.JOBS_FEED_ITEM)}>>"
    items = feeds.select(*keep, F.posexplode(F.from_json(body, schema)["jobs"]).alias("pos", "_i"))
    rows = items.select(
        *keep,
        F.col("pos").cast("bigint").alias("pos"),
        normalize_spaces("_i.title").alias("title"),
        url_normalize("_i.url").alias("url"),
        normalize_spaces("_i.company_name").alias("company"),
        normalize_spaces("_i.candidate_required_location").alias("job_location"),
        normalize_spaces("_i.salary").alias("salary"),
        F.lit("See listing").alias("experience"),
        format_market_date("_i.publication_date").alias("posted_at"),
        F.coalesce("_i.tags", F.array().cast("array<string>")).alias("skills"),
        text_or_empty("_i.description").alias("summary_html"),
    )
    return rows.where("title <> '' and url <> ''")


def read_jobs_feed(spark: SparkSession, path: str) -> DataFrame:
    return parse_jobs_feed(spark.read.option("wholetext", True).text(path), "value")


def _rss_rows(items: DataFrame, keep: list[str]) -> DataFrame:
    """RSS items as market rows; the location stands in the description's headquarters line."""
    items = items.withColumn("_title", normalize_spaces("_i.title")).withColumn(
        "_url", url_normalize("_i.link")).where("_title <> '' and _url <> ''")
    items = items.withColumn("_tokens", tokenize(text_or_empty("_i.description")))

    def headquarters(tokens):
        texts = F.transform(select(tokens, Select(tags=("p", "div"))), lambda n: node_text(tokens, n))
        found = F.filter(texts, lambda t: F.lower(t).startswith("headquarters:"))
        return let(F.get(found, F.lit(0)), lambda t: strip_spaces(F.substring(t, len("headquarters:") + 1, 1 << 30)))

    split = split_company_role("_title")
    return items.withColumn("_split", split).select(
        *keep,
        F.col("_split.role").alias("title"),
        F.col("_url").alias("url"),
        F.col("_split.company").alias("company"),
        first_present(headquarters(F.col("_tokens")), F.lit("Remote")).alias("job_location"),
        F.lit("See listing").alias("salary"),
        F.lit("See listing").alias("experience"),
        format_market_date("_i.pubDate").alias("posted_at"),
        F.coalesce("_i.category", F.array().cast("array<string>")).alias("skills"),
        text_or_empty("_i.description").alias("summary_html"),
    )


def parse_rss_feed(feeds: DataFrame, body: str = "body") -> DataFrame:
    keep = [c for c in feeds.columns if c != body]
    schema = f"struct<channel:struct<item:array<{schemas.as_struct(schemas.RSS_ITEM)}>>>"
    items = feeds.select(*keep, F.posexplode(F.from_xml(F.col(body), schema)["channel"]["item"]).alias("pos", "_i"))
    return _rss_rows(items.withColumn("pos", F.col("pos").cast("bigint")), [*keep, "pos"])


def read_rss_feed(spark: SparkSession, path: str) -> DataFrame:
    items = spark.read.format("xml").option("rowTag", "item").schema(schemas.RSS_ITEM).load(path)
    return _rss_rows(items.select(F.struct("*").alias("_i")), [])


# ------------------------------------------------------------------ texts that are no documents

_SHAPES = {"snapshot": "OBJECT", "manual": "OBJECT", "directory": "OBJECT", "jobs_feed": "OBJECT", "array_feed": "ARRAY"}


def malformed(docs: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """The rows whose text is no document of its kind, with a ``reason``; the parsers yield nothing for them.

    A null text is malformed too.  Nothing is counted away: rows here and rows that parse are all rows.
    """
    if kind == "rss":
        schema = f"struct<channel:struct<item:array<{schemas.as_struct(schemas.RSS_ITEM)}>>,_broken:string>"
        parsed = F.from_xml(F.col(body), schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
        reason = F.when(F.col(body).isNull() | parsed.isNull() | parsed["_broken"].isNotNull(), "not xml").when(parsed["channel"].isNull(), "no channel")
    else:
        value = F.try_parse_json(F.col(body))
        reason = F.when(value.isNull(), "not json").when(~F.schema_of_variant(value).startswith(_SHAPES[kind]), f"not an {_SHAPES[kind].lower()}")
    return docs.withColumn("reason", reason).where("reason IS NOT NULL")


__all__ = ["malformed"] + [n for n in dir() if n.startswith(("parse_", "read_", "explode_"))]
