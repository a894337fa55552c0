"""Joins between listings, pages and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.text import first_present, state_key, text_or_empty
from jobmill.session import broadcast_if_small

HOT_REQUESTS = 100_000  # of one id; more are dealt out


def join_content(links: DataFrame, pages: DataFrame, key: str = "url_key",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Links with their page body; a link without a page, or with an empty one, keeps an empty body.

    ``pages`` holds one row per address.  Unhinted, so adaptive execution may split a hot address on either side.
    """
    body = pages.select(key, *carry, F.col("body_text").alias("_body"))
    return links.join(body, key, "left").withColumn("body_text", text_or_empty("_body")).drop("_body")


def alias_matches(listings: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """One row per (listing, alias) hit against an alias table; ``text`` is in lower case.

    An alias stands between bounds of words, so its first run of letters is a word of the text: the distinct words are joined to the
    aliases that begin with them, and only those few pairs are tested for the whole alias.
    """
    quoted = F.regexp_replace("alias", r"([^a-z0-9 ])", r"\\$1")
    table = aliases.withColumns({"_first": F.regexp_extract("alias", "[a-z]+", 0), "_p": F.concat(F.lit("(?<![a-z])"), quoted, F.lit("(?![a-z])"))})
    words = listings.withColumn("_word", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[a-z]+"), F.lit(0)))))
    hits = words.join(broadcast_if_small(table), F.col("_word") == F.col("_first"))
    return hits.where(F.col(text).contains(F.col("alias")) & F.expr(f"{text} rlike _p")).drop("_p", "_first", "_word")


def collect_states(matches: DataFrame, key: str) -> DataFrame:
    """Ordered array of the distinct states of each listing; at most one entry per state."""
    pairs = F.array_sort(F.collect_set(F.struct("dir_pos", "name")))
    return matches.groupBy(key).agg(F.transform(pairs, lambda p: p["name"]).alias("states"))


def join_portal(listings: DataFrame, directory: DataFrame) -> DataFrame:
    """Portal of the only state, or of the scope for listings without states."""
    dim = broadcast_if_small(directory.select(F.col("name").alias("_name"), F.col("portal_url").alias("_portal"),
                                       F.col("type").alias("_type")))
    scope = F.col("state_label").isin("All India", "Central Govt")
    key = F.when(F.size("states") == 1, F.get(F.col("states"), F.lit(0))).when(
        (F.size("states") == 0) & scope, F.col("state_label"))
    joined = listings.withColumn("_key", key).join(dim, F.col("_key") == F.col("_name"), "left")
    return joined.withColumn("portal", text_or_empty("_portal")).drop("_key", "_name", "_portal", "_type")


def count_jobs_by_state(listings: DataFrame, directory: DataFrame) -> DataFrame:
    """Every state with the number of latest jobs whose label contains its name.

    Labels repeat, so they are counted first; the ``contains`` join then runs over distinct labels.
    """
    label = state_key(first_present("state_label", F.lit("")))
    labels = (listings.where("category = 'latest_jobs'").select(label.alias("_label")).where("_label <> ''")
              .groupBy("_label").agg(F.count(F.lit(1)).alias("_n")))
    hubs = directory.where("type <> 'central'").select("name", "type", "dir_pos")
    named = broadcast_if_small(hubs.withColumn("_name", state_key("name")))
    counts = (labels.join(named, F.col("_label").contains(F.col("_name")))
              .groupBy("name").agg(F.sum("_n").alias("_jobs")))
    return hubs.join(counts, "name", "left").select(
        "name", "type", "dir_pos", F.coalesce("_jobs", F.lit(0)).cast("bigint").alias("jobs"))


def lookup_posts(requests: DataFrame, listings: DataFrame, salts: int = 32, hot: int = HOT_REQUESTS) -> DataFrame:
    """First listing of each requested id: the requested category first, then the fixed order.

    ``requests`` has request_id, id and requested.  Only the first listing of an id in each category
    can be the answer, so the listings are cut to those (at most six per id) first.  Handing them to the requests is a join in which
    an id that more than ``hot`` requests name is dealt out over ``salts`` tasks; there are fewer of these than requests / ``hot``,
    so they are broadcast, and the listings of all other ids move once.
    """
    def first_in(category: str) -> Column:
        mine = F.col("category") == category
        return F.min_by(F.when(mine, F.struct("category", "title", "seq")), F.when(mine, F.col("seq")))

    by_id = listings.groupBy("id").agg(F.array_compact(F.array(*[first_in(c) for c in K.CATEGORIES])).alias("_hits")).where("size(_hits) > 0")
    many = F.broadcast(requests.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("id", F.lit(True).alias("_hot")))
    held = by_id.join(many, "id", "left").select("id", "_hits", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    asked = requests.join(many, "id", "left").select("request_id", "id", F.coalesce("requested", F.lit("")).alias("_r"), F.when(
        F.col("_hot"), F.pmod(F.xxhash64("request_id"), F.lit(salts)).cast("int")).otherwise(0).alias("_salt"))
    # The array is in the fixed order of the categories, so its first entry is the default answer.
    wanted = F.filter("_hits", lambda h: h.category == F.col("_r"))
    best = F.coalesce(F.get(wanted, F.lit(0)), F.get(F.col("_hits"), F.lit(0)))
    return asked.join(held, ["id", "_salt"]).select("request_id", "id", best.alias("_b")).select("request_id", "id", "_b.*")


def join_category_labels(listings: DataFrame, categories: DataFrame, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """Display label and default sections; an unknown category gets the general label."""
    dim = broadcast_if_small(categories.select("category", "category_label", "sections"))
    fallback = F.array(*[F.lit(s) for s in K.CATEGORY_SECTIONS["latest_jobs"]])
    return listings.join(dim, "category", "left").withColumns({
        "category_label": F.coalesce("category_label", F.lit(K.CATEGORY_LABEL_DEFAULT.format(house=house))),
        "sections": F.coalesce(F.col("sections"), fallback),
    })


