"""The whole refresh: arrivals and raw pages in, published snapshot and run row out."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions import html as H
from jobmill.functions.text import text_or_empty
from jobmill.operators import admission as A
from jobmill.operators import dedupe as D
from jobmill.operators import joins as J
from jobmill.operators import listings as L
from jobmill.operators import pages as PG
from jobmill.operators import predicates as P
from jobmill.operators import serving as SV
from jobmill.session import checkpointed, where_spread
from jobmill.sources.registry import Outcome, run_sources
from jobmill.sources.store import SnapshotStore


def article_texts(pages: DataFrame, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """(url_key, page_title, body_text): of article pages the body picked by its site's rule, deep-cleaned; of offers the whole fragment."""
    df = PG.tokenized(pages)
    df = df.withColumn("page_title", H.nth_text(F.col(PG.TOKENS), H.Select(tags=("h1",))))
    offer = F.coalesce(F.col("site").isin(*K.MARKET_GROUPS), F.lit(False))
    fragment = H.text_of(H.clean_fragment(F.col(PG.TOKENS), F.col("url_key"), K.MARKET_DROP_TAGS))
    df = PG.with_main_content(df.withColumn("_fragment", F.when(offer, fragment)), F.col("site"))
    df = where_spread(df, F.col("_main").isNotNull() | offer)
    df = PG.deep_cleaned(df, "_main", F.col("site"), root=False, house=house)
    # As read: the searched text is cut to its length before blanks are collapsed.
    return df.select("url_key", "page_title", F.coalesce("_fragment", H.text_of(F.col("_deep"))).alias("body_text"))


MOST_BROADCAST_ROWS = 200_000


def admit(arrivals: DataFrame, domains: dict[str, str] = K.SITE_DOMAINS, caps: dict[str, int] | None = None) -> DataFrame:
    """Arrivals that enter the snapshot.

    Only narrow columns take part, and the bodies of refused rows are never looked at: admission
    depends on address, category and page alone, so it runs before any page is joined or parsed.

    Arrivals with ``phase``, ``page_seq``, ``pos`` and ``page_limit`` are admitted page by page.  Phase 0 is a site's homepage: of each block the
    first links count, whatever they are, and titled ones that lead to no competitor are tried.  Phase 1 are pages that stop at their own
    limit: listing pages, state pages, and the pages of official sources and markets, whose limits are their caps.
    """
    caps = caps or K.CATEGORY_CAPS
    crawled = F.col("source_group").isin(*K.SITE_DOMAINS)
    listed = ~crawled | P.is_listing_candidate("title", "original_url", "source_group", "category", domains)
    if "page_seq" not in arrivals.columns:
        narrow = A.with_url_key(where_spread(arrivals, listed)).select("source_group", "category", "url_key", "seq")
        admitted = A.admit_capped(narrow, caps)
    else:
        first = D.first_n(arrivals.where("phase = 0"), ["source_group", "category", "page_seq"], "pos", K.HOME_LIMIT)
        home = first.where((text_or_empty("title") != "") & (text_or_empty("original_url") != "") & ~P.is_competitor("original_url", "source_group"))
        both = A.with_url_key(home.unionByName(where_spread(arrivals.where("phase = 1"), listed)))
        admitted = A.admit_pages(both, caps, page_limit=max(caps.values()), min_page_limit=1)
    # The admitted rows are candidates already, so the other side need not be tested again.
    return A.with_url_key(A.admitted_rows(arrivals, admitted))


def build_snapshot(arrivals: DataFrame, pages: DataFrame, domains: dict[str, str] = K.SITE_DOMAINS,
                   caps: dict[str, int] | None = None, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """Listings of one refresh.

    ``arrivals`` has seq, source_group, source, category, original_url, title, may say on which page it stood (see ``admit``), and may carry the fields of market listings
    (company, job_location, salary, experience, posted_at, skills), facts of its source (``fact_last_date``,
    ``fact_vacancies``, ``fact_exam_date``, ``fact_category``) and ``source_rank``; ``pages`` has
    url_key, site, html.  A row without a page is built from its title alone.  Private and remote groups become market
    listings, the others are read from their page; a fact that the source states wins where it is not empty.
    """
    rows = checkpointed(admit(arrivals, domains, caps))
    # The caps bound the admitted rows of a group; while they are few, the pages are cut to theirs where they are read.
    wanted = rows.select("url_key").distinct()
    needed = pages.join(F.broadcast(wanted) if rows.count() <= MOST_BROADCAST_ROWS else wanted, "url_key", "left_semi")
    texts = article_texts(needed, house).dropDuplicates(["url_key"])
    joined = J.join_content(rows, texts, carry=("page_title",))
    joined = joined.withColumn("info_title", F.coalesce("page_title", "title")).drop("page_title")
    market = F.coalesce(F.col("source_group").isin(*K.MARKET_GROUPS), F.lit(False))
    stated = {name: F.col(f"fact_{name.removeprefix('info_')}") for name in L.INFO if f"fact_{name.removeprefix('info_')}" in joined.columns}
    pages_built = L.build_listing(joined.where(~market), house=house)
    pages_built = L.with_explicit_info(pages_built.withColumn("info_category", L.classify_title("info_title")), stated)
    offers = L.with_market_columns(joined.where(market)).withColumn("summary_text", F.col("body_text"))
    offers = L.with_explicit_info(L.build_market_listing(offers.withColumn("body_text", L.market_body(offers)), house), stated)
    built = pages_built.unionByName(offers, allowMissingColumns=True).drop("info_title", "summary_text")
    return D.dedupe_category(D.in_source_order(built), ["source_rank", "seq"])


def utc_now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def refresh(spark: SparkSession, arrivals: DataFrame, pages: DataFrame, root: str, outcomes: Iterable[Outcome] = (), **options) -> int:
    """Build, publish and record one run: a row ``running`` before, one with the outcome after.

    Listings are counted per category and source while they are written.  ``outcomes`` of sources that ran before go into the row.  A
    failure at any point, publishing included, is recorded with its whole text and raised again.
    """
    store, started, outcomes = SnapshotStore(spark, f"{root}/snapshot"), utc_now(), list(outcomes)
    groups = (*K.SOURCE_GROUPS, *(o.source for o in outcomes if o.source not in K.SOURCE_GROUPS))
    facts = {"sources": groups, "failures": {o.source: o.error for o in outcomes if o.error is not None}}

    def record(counts: dict[str, int], finished: str | None, **more) -> None:
        SV.run_status(spark, counts, started, finished, **facts, **more).coalesce(1).write.mode("append").parquet(f"{root}/runs")

    record({}, None, status="running")
    try:
        watch = SV.Watch(build_snapshot(arrivals, pages, **options), groups)
        version = store.replace(watch.rows)
        record(watch.counts("category"), utc_now(), source_counts=watch.counts("source"))
    except Exception as error:
        record({}, utc_now(), error=str(error))
        raise
    return version


def refresh_sources(spark: SparkSession, pages: DataFrame, root: str, names: list[str] | None = None, **options) -> int:
    """A refresh of registered sources: those that fail give what they had, and their errors stand in the run row."""
    arrivals, outcomes = run_sources(spark, names)
    if arrivals is None:
        arrivals = spark.createDataFrame([], "seq bigint, source_group string, source string, category string, original_url string, title string")
    return refresh(spark, arrivals, pages, root, outcomes, **options)
