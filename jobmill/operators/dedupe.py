"""First-wins dedupe, plain caps and unions.  Order is the ``seq`` column throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.text import col, first_present
from jobmill.functions.urls import url_normalize


def first_per_key(df: DataFrame, keys: list[str], order: str | list[str] = "seq") -> DataFrame:
    """The row with the smallest ``order`` per key.

    By one column (unique within a key): its minimum per key is a hash aggregate over narrow rows, combined before the
    shuffle, and the rows are semi-joined to it, so wide rows are neither sorted nor gathered by key.  By several columns:
    ``min_by``, for inputs that are small already.
    """
    if isinstance(order, str):
        first = df.groupBy(*keys).agg(F.min(order).alias("_first")).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_first")
        same = [df[k].eqNullSafe(first[f"_{i}"]) for i, k in enumerate(keys)]
        return df.join(first, reduce(lambda a, b: a & b, [df[order] == first["_first"], *same]), "left_semi")
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def dedupe_category(listings: DataFrame, order: str | list[str] = "seq") -> DataFrame:
    """Per category keep the first row per address without fragment (else per id)."""
    keyed = listings.withColumn("_key", first_present(url_normalize("original_url"), "id"))
    keyed = keyed.where(F.col("_key").isNotNull())
    return first_per_key(keyed, ["category", "_key"], order).drop("_key")


def anti_seen(links: DataFrame, seen: DataFrame, key: str = "url_key") -> DataFrame:
    """Links whose address is not taken yet."""
    return links.join(seen.select(key).distinct(), key, "left_anti")


def cap_by(df: DataFrame, caps: dict[str, int], name: str, order: str = "seq", default: int = K.PAGE_LIMIT,
           within: tuple[str, ...] = ()) -> DataFrame:
    """First ``caps[name]`` rows of every value of ``name`` (and ``within``).

    The literal bound lets Spark keep only the top rows per task before the shuffle.
    """
    window = Window.partitionBy(*within, name).orderBy(order)
    limit = F.lit(default)
    for value, cap in caps.items():
        limit = F.when(F.col(name) == value, cap).otherwise(limit)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    ranked = ranked.where(F.col("_rank") <= max([default, *caps.values()]))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


def dedupe_then_cap(listings: DataFrame) -> DataFrame:
    """First row per (source group, address), then the first rows of each category up to its cap."""
    keyed = listings.withColumn("_key", url_normalize("original_url")).where(F.col("_key") != "")
    unique = first_per_key(keyed, ["source_group", "_key"]).drop("_key")
    return cap_by(unique, K.CATEGORY_CAPS, "category", within=("source_group",))


def first_n(df: DataFrame, by: list[str], order: str | list[str], n: int, rank: str = "_rank") -> DataFrame:
    """First ``n`` rows per group, with their rank kept only if it is named."""
    order = [order] if isinstance(order, str) else order
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ranked = ranked.where(F.col(rank) <= n)
    return ranked.drop(rank) if rank == "_rank" else ranked


def in_source_order(df: DataFrame, groups: tuple[str, ...] = K.SOURCE_GROUPS) -> DataFrame:
    """Rows with the place of their source group in a run; ``(source_rank, seq)`` is the order of the run.

    A source that brings its own ``source_rank`` keeps it (behind the fixed groups); groups that nobody ranks come last and
    none is dropped.
    """
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("source_group"))
    own = F.col("source_rank") + len(groups) if "source_rank" in df.columns else F.lit(None)
    last = F.lit(2**31 - 1)
    return df.withColumn("source_rank", F.when(place > 0, place - 1).otherwise(F.coalesce(own, last)).cast("int"))


def union_in_order(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames; ``part`` is the place of the frame, so (part, old order) is the order of the whole."""
    ranked = [df.withColumn("part", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def merge_by_precedence(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames with a ``precedence`` column, smaller first."""
    ranked = [df.withColumn("precedence", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Newest version per key; changes win over current rows of the same version."""
    both = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    rest = [c for c in current.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(col(version), F.col("_side"))).alias("_n")
    return both.groupBy(key).agg(newest).select(key, "_n.*").select(*current.columns)


def delete_keys(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return rows.join(doomed.select(key).distinct(), key, "left_anti")
