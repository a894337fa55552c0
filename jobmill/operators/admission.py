"""Admission of listings under per-source, per-category caps, in arrival order.

Per source group one run keeps a set of admitted addresses and a count per category.  A row is
admitted when its address is new to the whole group and its category still has room.  An address
refused for room is not remembered, so it may still enter through another category.  That makes
the result depend on order and cannot be written as rank windows; it is a fold.

What makes it scale is that only a bounded head of each group can matter.  Everything below cuts
rows that provably cannot change the result; the fold then sees a bounded number of rows per
group, whatever the size of the input and however skewed the groups are.

Let S be the sum of all caps (at most S addresses are ever admitted in one group).

* Within one category the first occurrence of an address decides: it is admitted, refused as
  taken, or refused for room, and none of these can turn into an admission later.  So one row per
  (group, category, address) suffices (``head_of_categories``).
* Of the distinct addresses of a (group, category) only the first S matter: at most S of them
  are refused as taken, the others are admitted until the category is full.

With page limits a page stops early, so an address can be passed over on one page and admitted from
a later one.  Then (``head_of_pages``):

* a page is stopped by its limit only after admitting that many rows, which can happen at most
  cap/limit times before the category is full; so only the first cap/limit + 1 occurrences of an
  address can matter;
* on one page only the first limit + S distinct addresses can be reached;
* a page on which nothing is admitted holds only taken addresses, and each of those is left on at
  most cap/limit + 1 pages; so only the first S * (cap/limit + 1) + cap pages of a category matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.urls import url_normalize

SALTS = 64
_FOLD_COLUMNS = ("source_group", "category", "phase", "page_seq", "pos", "url_key", "seq")


def total_cap(caps: dict[str, int]) -> int:
    return sum(caps.values())


def _capped_only(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Rows with an address and a known category; the others are always refused."""
    return rows.where(F.col("category").isin(*caps) & (F.col("url_key") != ""))


def head_of_categories(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """First S distinct addresses of every (group, category), one row each."""
    first = rows.groupBy("source_group", "category", "url_key").agg(F.min("seq").alias("seq"))
    window = Window.partitionBy("source_group", "category").orderBy("seq")
    return first.withColumn("_rank", F.row_number().over(window)).where(
        F.col("_rank") <= total_cap(caps)).drop("_rank")


def head_of_pages(rows: DataFrame, caps: dict[str, int], min_limit: int, max_limit: int) -> DataFrame:
    """The rows of listing pages that can matter, see the module text."""
    total = total_cap(caps)
    repeats = max(caps.values()) // min_limit + 1
    page = ["source_group", "category", "page_seq"]
    keep = [c for c in rows.columns if c not in (*page, "url_key", "pos")]
    per_page = rows.groupBy(*page, "url_key").agg(
        F.min("pos").alias("pos"), F.min_by(F.struct(*keep), "pos").alias("_k")).select(
        *page, "url_key", "pos", "_k.*")
    per_page = per_page.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*page).orderBy("pos"))).where(
        F.col("_rank") <= max_limit + total)
    per_page = per_page.withColumn("_rank", F.row_number().over(
        Window.partitionBy("source_group", "category", "url_key").orderBy("page_seq"))).where(
        F.col("_rank") <= repeats).drop("_rank")
    # First pages of each category: ranked within salts first, so no task sorts all pages of one.
    bound = total * repeats + max(caps.values())
    pages = per_page.select(*page).distinct().withColumn(
        "_salt", F.pmod(F.xxhash64("page_seq"), F.lit(SALTS)))
    for by in (["source_group", "category", "_salt"], ["source_group", "category"]):
        pages = pages.withColumn("_rank", F.row_number().over(
            Window.partitionBy(*by).orderBy("page_seq"))).where(F.col("_rank") <= bound)
    return per_page.join(pages.select(*page), page, "left_semi")


def head_of_home(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Homepage rows: the first occurrence of an address, and its first one at the head of a block.

    A block of a full category is skipped or, for sites that check late, tried with its first row
    only; so these two occurrences are all that can matter, and of each kind the first S.
    """
    block = ["source_group", "category", "page_seq"]
    ranked = rows.withColumn("_head", F.row_number().over(Window.partitionBy(*block).orderBy("pos")) == 1)
    keep = [c for c in rows.columns if c not in ("source_group", "category", "url_key")]
    order = F.struct("page_seq", "pos")
    key = ["source_group", "category", "url_key"]
    any_first = ranked.groupBy(*key).agg(F.min_by(F.struct(*keep, "_head"), order).alias("_k"))
    head_first = ranked.where("_head").groupBy(*key).agg(F.min_by(F.struct(*keep, "_head"), order).alias("_k"))
    window = Window.partitionBy("source_group", "category").orderBy("page_seq", "pos")

    def head(df: DataFrame) -> DataFrame:
        flat = df.select(*key, "_k.*")
        return flat.withColumn("_rank", F.row_number().over(window)).where(
            F.col("_rank") <= total_cap(caps)).drop("_rank")

    return head(any_first).unionByName(head(head_first)).distinct()


class _Group:
    """State of one source group during its run."""

    def __init__(self, caps: dict[str, int]) -> None:
        self.caps = caps
        self.counts = dict.fromkeys(caps, 0)
        self.taken: set[str] = set()

    def full(self) -> bool:
        return self.counts == self.caps

    def room(self, category: str) -> int:
        return self.caps[category] - self.counts[category]

    def admit(self, category: str, url: str) -> bool:
        if url in self.taken or self.room(category) <= 0:
            return False
        self.taken.add(url)
        self.counts[category] += 1
        return True


def _fold_rows(caps: dict[str, int], home_limit: int, late_check: tuple[str, ...]):
    """The fold over rows that come by group, phase, page and place: only the page at hand and what a group has admitted are held."""
    columns = ("source_group", "phase", "page_seq", "category", "url_key", "is_head", "page_limit", "seq")

    def admitted_of(source: str, rows: Iterator[tuple]) -> list[tuple]:
        late, group, admitted = source in late_check, _Group(caps), []
        for _, page in groupby(rows, key=lambda row: object() if None in row[1:3] else row[1:3]):  # a row without a place is a page alone
            if group.full():
                break
            page = list(page)
            phase, category, page_limit = page[0][1], page[0][3], page[0][6]
            if phase == 0:
                room = min(home_limit, caps[category]) - group.counts[category]
                if room <= 0:
                    # Full: the block is skipped, or its first row is still tried by a late check.
                    page, room = [row for row in page if late and row[5]], 1
            else:
                room = group.room(category) if page_limit is None else min(page_limit, group.room(category))
            for row in page:
                if room <= 0:
                    break
                if group.admit(row[3], row[4]):
                    room -= 1
                    admitted.append((source, row[3], row[4], row[7]))
        return admitted

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for source, own in groupby(rows, key=lambda row: row[0]):
            found = admitted_of(source, own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                                 ["source_group", "category", "url_key", "seq"])

    return fold


_ADMITTED = "source_group string, category string, url_key string, seq bigint"


def admit_capped(rows: DataFrame, caps: dict[str, int] | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Admitted (source_group, category, url_key, seq) of plain arrival order, without pages.

    ``taken`` (source_group, category, url_key) are addresses that earlier runs admitted: a group goes on with them and with the room they
    leave.  They are S at most in a group, so the first S addresses of a category are all that can matter then too.
    """
    caps = caps or K.CATEGORY_CAPS
    head = head_of_categories(_capped_only(rows, caps), caps)

    def fold(frame: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        group = _Group(caps)
        if before is not None:
            for category, url in zip(before["category"], before["url_key"]):
                group.taken.add(url)
                group.counts[category] += 1
        frame = frame.sort_values("seq")
        mask = [group.admit(c, u) for c, u in zip(frame["category"], frame["url_key"])]
        return frame.loc[mask, ["source_group", "category", "url_key", "seq"]]

    if taken is None:
        return head.groupBy("source_group").applyInPandas(lambda frame: fold(frame), _ADMITTED)
    held = _capped_only(taken, caps).select("source_group", "category", "url_key")
    return head.groupBy("source_group").cogroup(held.groupBy("source_group")).applyInPandas(lambda frame, before: fold(frame, before), _ADMITTED)


def admit_pages(rows: DataFrame, caps: dict[str, int] | None = None, page_limit: int = K.PAGE_LIMIT,
                min_page_limit: int | None = None, home_limit: int = K.HOME_LIMIT,
                late_check: tuple[str, ...] = ("SR",)) -> DataFrame:
    """Admission with homepage blocks (phase 0) and limited listing pages (phase 1).

    ``rows`` has source_group, category, phase, page_seq, pos, url_key, seq and page_limit; a
    page belongs to one category, and ``page_seq`` is its place in the run of its group.
    """
    caps = caps or K.CATEGORY_CAPS
    rows = _capped_only(rows, caps).select(*_FOLD_COLUMNS, "page_limit")
    home = head_of_home(rows.where("phase = 0"), caps).withColumnRenamed("_head", "is_head")
    pages = head_of_pages(rows.where("phase = 1"), caps, min_page_limit or page_limit, page_limit)
    both = home.unionByName(pages.withColumn("is_head", F.lit(False)), allowMissingColumns=True).drop("_rank")
    ordered = both.repartition("source_group").sortWithinPartitions("source_group", *[F.col(c).asc_nulls_last() for c in ("phase", "page_seq", "pos")])
    return ordered.mapInArrow(_fold_rows(caps, home_limit, late_check), _ADMITTED)


def admitted_rows(rows: DataFrame, admitted: DataFrame) -> DataFrame:
    """The full rows behind an admission.

    Unhinted: the admitted side is tiny for a fixed list of sources, but it grows with the number
    of groups, so adaptive execution decides from its real size.
    """
    return rows.join(admitted.select("source_group", "seq"), ["source_group", "seq"], "left_semi")


def admission_outcomes(rows: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Every row with its outcome: admitted, no_url, unknown_category, seen or full.

    A refused row counts as ``seen`` when its address was admitted before it, else as ``full``.
    """
    caps = caps or K.CATEGORY_CAPS
    admitted = admit_capped(rows, caps).select(
        "source_group", "url_key", F.col("seq").alias("_seq"), F.col("category").alias("_category"))
    joined = rows.join(admitted, ["source_group", "url_key"], "left")
    reason = (
        F.when(F.col("url_key") == "", "no_url")
        .when(~F.col("category").isin(*caps), "unknown_category")
        .when(F.col("_seq") == F.col("seq"), "admitted")
        .when(F.col("_seq") < F.col("seq"), "seen")
        .otherwise("full")
    )
    return joined.withColumn("reason", reason).drop("_seq", "_category")


def admission_stats(rows: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    return admission_outcomes(rows, caps).groupBy("source_group", "category", "reason").agg(
        F.count(F.lit(1)).alias("n"))


def with_url_key(df: DataFrame, url: str = "original_url") -> DataFrame:
    return df.withColumn("url_key", url_normalize(url))

