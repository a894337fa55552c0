"""Dimension tables.  All come from fixed values and are inline tables of the plan, so the optimizer knows
their size and joins may check it before they broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobmill import constants as K


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small inline table; ``schema`` is ``name type, ...``."""
    def literal(value) -> str:
        if isinstance(value, list):
            return "array(" + ", ".join(literal(v) for v in value) + ")"
        if isinstance(value, bool):
            return str(value).lower()
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else repr(value)

    names, types = zip(*(part.strip().split(" ", 1) for part in schema.split(", ")))
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f"cast({n} AS {t}) AS {n}" for n, t in zip(names, types))
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({', '.join(names)})")


def state_dim(spark: SparkSession) -> DataFrame:
    rows = [(name, kind, portal, aliases, i) for i, (name, kind, portal, aliases) in enumerate(K.STATE_DIRECTORY)]
    return inline(spark, rows, "name string, type string, portal_url string, aliases array<string>, dir_pos bigint")


def alias_dim(spark: SparkSession) -> DataFrame:
    rows = [(name, alias.lower(), i) for i, (name, kind, _, aliases) in enumerate(K.STATE_DIRECTORY)
            if kind in ("state", "ut") for alias in aliases]
    return inline(spark, rows, "name string, alias string, dir_pos bigint")


def page_config_rows() -> list[tuple[int, str, str, str, str, int]]:
    """(run order, site, url, category, state or '', page limit)."""
    pages = [(site, url, category, "", K.PAGE_LIMIT) for site, entries in K.SITE_PAGES.items()
             for url, category in entries]
    states = [("FJA", url, "latest_jobs", state, K.STATE_PAGE_LIMIT) for state, url in K.STATE_PAGES.items()]
    return [(i, *row) for i, row in enumerate(pages + states)]


def page_config(spark: SparkSession) -> DataFrame:
    return inline(spark, page_config_rows(),
        "config_seq bigint, site string, page_url string, category string, state string, page_limit bigint")


def category_dim(spark: SparkSession, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    rows = [(c, i, K.CATEGORY_LABELS[c].format(house=house), K.CATEGORY_SECTIONS[c])
            for i, c in enumerate(K.CATEGORIES)]
    return inline(spark, rows, "category string, category_rank int, category_label string, sections array<string>")


def exam_rules(spark: SparkSession) -> DataFrame:
    return inline(spark, list(K.EXAM_RULES),
        "exam string, min_age double, max_gen double, max_obc double, max_scst double, max_pwd double")


def checklist_dim(spark: SparkSession) -> DataFrame:
    rows = [(item, item.lower().split(" ")[0], i) for i, item in enumerate(K.LOCKER_CHECKLIST)]
    return inline(spark, rows, "item string, first_word string, item_pos bigint")


def locker_dim(spark: SparkSession) -> DataFrame:
    return inline(spark, list(K.LOCKER_LABELS.items()), "category string, category_label string")


def rich_dim(spark: SparkSession) -> DataFrame:
    rows = [(c, *values) for c, values in K.RICH_CONSTANTS.items()]
    return inline(spark, rows, "category string, badge string, type string, status string, date string")


def card_rules(spark: SparkSession) -> DataFrame:
    """One row per site, card selector and field; ``nth`` -1 stands for all matches."""
    rows = [(site, card, card_sel, field, sel, attr, nth, nth < 0, K.CARD_FALLBACKS.get((site, field), ""), K.CARD_WORDS.get((site, field), []))
            for site, card, card_sel, fields in K.CARD_SELECTORS for field, sel, attr, nth in fields]
    return inline(spark, rows, "site string, card int, card_sel string, field string, sel string, attr string, nth int, every boolean, fallback string, words array<string>")
