"""Assembling listings: facts, states, market fields and the serving projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.extract import (applicant_columns, classify_title, extract_applicants, extract_exam_date,
                                       extract_last_date, extract_vacancies)
from jobmill.functions.states import matched_states, scope_kind, scope_text, state_words, tag_states
from jobmill.functions.text import (brand_scrub, clean_skills, col, first_present, normalize_spaces, present,
                                    text_or_empty)
from jobmill.functions.urls import listing_id, url_normalize
from jobmill.session import broadcast_if_small

INFO = ("last_date", "vacancies", "exam_date", "info_category")


def with_facts(df: DataFrame, title: str = "title", body: str = "body_text") -> DataFrame:
    """Key facts and applicant totals read from the body; the label comes from the title."""
    df = df.withColumns({
        "last_date": extract_last_date(body),
        "vacancies": extract_vacancies(body),
        "exam_date": extract_exam_date(body),
        "info_category": classify_title(title),
        "_content": normalize_spaces(body),
    })
    df = df.withColumn("_hit", extract_applicants("_content"))
    return df.withColumns(applicant_columns("_hit")).drop("_hit", "_content")


def with_explicit_info(df: DataFrame, explicit: dict[str, Column]) -> DataFrame:
    """An explicit fact wins over an extracted one only when it is not empty."""
    return df.withColumns({name: first_present(value, name) for name, value in explicit.items()})


def with_states(df: DataFrame, title: str = "title", body: str = "body_text",
                house: str = K.DEFAULT_HOUSE, length: int | None = K.TEXT_SLICE) -> DataFrame:
    """Materialise the searched text and the matches once, then derive the three columns."""
    df = df.withColumn("_scope", scope_text(col(title), col(body), house, length))
    df = df.withColumns({"_words": state_words(F.col("_scope")), "_kind": scope_kind(F.col("_scope"))})
    df = df.withColumn("_states", matched_states("_scope", "_words"))
    return df.withColumns(tag_states(F.col("_kind"), F.col("_states"))).drop("_scope", "_words", "_states", "_kind")


def build_listing(links: DataFrame, explicit: dict[str, Column] | None = None,
                  house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """Listings from (category, original_url, title, body_text) rows."""
    df = links.withColumn("title", normalize_spaces("title"))
    df = with_facts(df)
    df = with_explicit_info(df, explicit or {})
    df = with_states(df, house=house)
    return df.withColumns({
        "id": listing_id("category", "original_url"),
        "url_key": url_normalize("original_url"),
        "title": brand_scrub("title", house),
    })


def build_market_listing(rows: DataFrame, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """Listings of private and remote sources.

    ``rows`` has category, original_url, title, body_text, company, job_location, salary, experience,
    posted_at, skills.  A known location replaces the state label and clears states and portal.
    """
    remote = F.col("category") == "remote_jobs"
    df = build_listing(rows, {
        "last_date": F.lit(K.MARKET_DEFAULTS["last_date"]),
        "vacancies": F.lit(K.MARKET_DEFAULTS["vacancies"]),
        "exam_date": first_present("posted_at", F.lit(K.MARKET_DEFAULTS["exam_date"])),
        "info_category": F.when(remote, "Remote Job").otherwise("Private Job"),
    }, house)
    location = F.when(present("job_location").isNotNull(), brand_scrub("job_location", house)).when(
        remote, "Remote").otherwise("")
    df = df.withColumns({
        "company": brand_scrub("company", house),
        "job_location": location,
        "salary": brand_scrub("salary", house),
        "experience": brand_scrub("experience", house),
        "skills": clean_skills("skills", house),
    })
    known = F.col("job_location") != ""
    return df.withColumns({
        "state_label": F.when(known, F.col("job_location")).otherwise(F.col("state_label")),
        "states": F.when(known, F.array().cast("array<string>")).otherwise(F.col("states")),
        "official_state_portal": F.when(known, "").otherwise(F.col("official_state_portal")),
    })


def market_body(df: DataFrame, most_skills: int | None = K.SKILL_SLICE) -> Column:
    """The text of a market listing, as its summary lines put it, with the text of its summary (``summary_text``) if it has one."""
    def line(label: str, name: str) -> Column:
        return F.when(present(name).isNotNull(), F.concat(F.lit(label + ": "), F.col(name)))

    skills = F.array_join(F.col("skills") if most_skills is None else F.slice(F.col("skills"), 1, most_skills), " ")
    return F.concat_ws(" ", line("Company", "company"), line("Location", "job_location"),
                       line("Compensation", "salary"), line("Experience", "experience"),
                       line("Posted / updated", "posted_at"), present(skills),
                       *([present("summary_text")] if "summary_text" in df.columns else []))


def with_market_columns(df: DataFrame) -> DataFrame:
    """The fields of a market listing, empty where a source does not carry them."""
    for name in ("company", "job_location", "salary", "experience", "posted_at"):
        df = df.withColumn(name, text_or_empty(name) if name in df.columns else F.lit(""))
    skills = F.coalesce(F.col("skills"), F.array().cast("array<string>")) if "skills" in df.columns else F.array().cast("array<string>")
    return df.withColumn("skills", skills)


def card_view(listings: DataFrame, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    nowhere = F.when(F.col("category") == "remote_jobs", K.CARD_DEFAULTS["remote_location"]).otherwise(
        K.CARD_DEFAULTS["location"])
    return listings.select(
        "seq", "category", "id", "title",
        first_present("job_location", "state_label", nowhere).alias("location"),
        first_present("company", "source", F.lit(house)).alias("company"),
        first_present("salary", "experience", "state_label", F.lit(K.CARD_DEFAULTS["highlight"])).alias("highlight"),
        F.slice(F.coalesce("skills", F.array().cast("array<string>")), 1, 3).alias("top_skills"),
        first_present("posted_at", F.lit(K.CARD_DEFAULTS["posted"])).alias("posted"),
        first_present("original_url", F.lit("#")).alias("open_url"),
    )


def post_link(listing_id_col: Column | str, category: Column | str) -> Column:
    return F.concat(F.lit("post.html?id="), F.url_encode(col(listing_id_col)), F.lit("&cat="),
                    F.url_encode(col(category)))


def state_link(state: Column | str) -> Column:
    """Space becomes ``+``; everything else is percent-encoded."""
    return F.concat(F.lit("latestjobs.html?state="), F.url_encode(col(state)))


def rich_view(listings: DataFrame, constants: DataFrame) -> DataFrame:
    """Category-page rows: a listing plus the constants of its category (a four-row table)."""
    rows = listings.join(broadcast_if_small(constants), "category")
    return rows.select(
        "seq", "category", "id", F.col("title").alias("t"),
        F.concat(F.lit("Live Update ("), first_present("source", F.lit("Scraped")), F.lit(")")).alias("org"),
        F.lit("Live").alias("cat"),
        first_present("state_label", F.lit("All India")).alias("st"),
        post_link("id", "category").alias("url"),
        text_or_empty("applicant_count_display").alias("app_disp"),
        text_or_empty("applicant_metric_label").alias("app_label"),
        text_or_empty("applicant_metric_note").alias("app_note"),
        "badge", "type", "status", "date",
    )


def post_view(listings: DataFrame, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    return listings.select(
        "seq", "category", "id", "title",
        first_present("source", F.lit(house)).alias("source"),
        first_present("state_label", F.lit(K.POST_DEFAULTS["coverage"])).alias("coverage"),
        first_present("applicant_count_display", F.lit(K.POST_DEFAULTS["applicants"])).alias("applicants"),
        F.concat(first_present("applicant_metric_label", F.lit(K.POST_DEFAULTS["label"])), F.lit(". "),
                 first_present("applicant_metric_note", F.lit(K.POST_DEFAULTS["note"]))).alias("applicants_note"),
    )
