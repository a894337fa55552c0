"""Filters on listings and links."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.extract import max_year
from jobmill.functions.text import (contains_any, first_present, has_word, normalize_spaces, present,
                                    quote, state_key, text_or_empty)
from jobmill.session import broadcast_if_small


def is_social(url: Column | str) -> Column:
    """Bare substring test on the whole address; short hosts hit inside longer ones."""
    return contains_any(F.lower(text_or_empty(url)), K.SOCIAL_HOSTS)


def _keyed_match(key: Column | str, text: Column, patterns: dict[str, str], always: str = "",
                 flags: str = "") -> Column:
    """Match ``text`` against the pattern of its ``key``; ``always`` applies to every key.

    Key and text are joined and tested by one alternation, so the expression behind ``text``
    stands in the plan once, however many keys there are.
    """
    branches = [f"^{quote(name)}\\|(?:{pattern})" for name, pattern in patterns.items()]
    if always:
        branches.append(f"^[^|]*\\|(?:{always})")
    return F.concat(text_or_empty(key), F.lit("|"), text).rlike(f"(?s{flags})" + "|".join(branches))


def _words(words: Iterable[str]) -> str:
    return ".*(?:" + "|".join(quote(w) for w in words) + ")"


def is_competitor(url: Column | str, site: Column | str) -> Column:
    """A listed competitor string or app-store phrase; parts of the site's own domain are exempt."""
    sites = {s: _words([c for c in K.COMPETITORS if c not in domain]) for s, domain in K.OWN_DOMAINS.items()}
    others = "|".join(f"{quote(s)}\\|" for s in sites)
    lowered = F.lower(text_or_empty(url))
    listed = F.concat(text_or_empty(site), F.lit("|"), lowered).rlike(
        "(?s)" + "|".join([f"^{quote(s)}\\|{p}" for s, p in sites.items()]
                          + [f"^(?!{others})[^|]*\\|{_words(K.COMPETITORS)}",
                             f"^[^|]*\\|{_words(K.APP_PHRASES)}"]))
    return listed


def same_domain(url: Column | str, site: Column | str, domains: dict[str, str] = K.SITE_DOMAINS) -> Column:
    """The host of a web address contains the site's domain."""
    return _keyed_match(site, text_or_empty(url), {
        s: f"(?i:[a-z][a-z0-9+.-]*://[^/?#]*{quote(domain)})" for s, domain in domains.items()})


def is_web_address(url: Column | str) -> Column:
    return text_or_empty(url).rlike("(?i)^https?:")


def has_title_signal(title: Column | str, url: Column | str, category: Column | str) -> Column:
    """A year 2024-2039, or a term of the category, in title or address."""
    text = F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(url)))
    return _keyed_match(category, text, {name: _words(words) for name, words in K.SIGNAL_TERMS.items()},
                        always=".*" + K.SIGNAL_YEAR, flags="U")


def on_skipped_path(url: Column | str, site: Column | str) -> Column:
    """The path is one of the site's section pages or lies below one."""
    address = "(?i:[a-z][a-z0-9+.-]*://[^/?#]*"
    return _keyed_match(site, text_or_empty(url), {
        name: address + "(?:" + "|".join(quote(p.rstrip("/")) for p in skips) + ")(?:[/?#;]|$))"
        for name, skips in K.SKIP_PATHS.items()})


def is_listing_candidate(title: Column | str, url: Column | str, site: Column | str, category: Column | str,
                         domains: dict[str, str] = K.SITE_DOMAINS) -> Column:
    """All tests a link of a listing page must pass, cheap ones first."""
    clean = normalize_spaces(title)
    return (
        present(url).isNotNull()
        & (F.length(clean) >= K.MIN_TITLE_LENGTH) & ~F.lower(clean).isin(*K.SKIP_TITLES)
        & is_web_address(url) & same_domain(url, site, domains)
        & ~is_social(url) & ~on_skipped_path(url, site)
        & has_title_signal(clean, url, category)
    )


def passes_allow_deny(org: Column | str, role: Column | str) -> Column:
    text = normalize_spaces(F.concat_ws(" ", text_or_empty(org), text_or_empty(role)))
    return ~has_word(text, K.DENY_WORDS) & has_word(text, K.ALLOW_WORDS)


def is_current_notice(text: Column | str, as_of_year: int) -> Column:
    return F.coalesce(max_year(text) >= as_of_year, F.lit(True))


def with_required(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose listed columns are all neither NULL nor empty."""
    for name in names:
        df = df.where(present(name).isNotNull())
    return df


def searched_text(house: str = K.DEFAULT_HOUSE) -> Column:
    """What a search looks at: eight fields joined by blanks, in lower case."""
    fields = [text_or_empty(c) for c in ("title", "company", "job_location", "state_label", "salary", "experience")]
    fields += [text_or_empty(F.array_join("skills", " ", "")), first_present("source", F.lit(house))]
    parts = [p for f in fields for p in (f, F.lit(" "))][:-1]
    return F.lower(F.concat(*parts))


def search_listings(listings: DataFrame, query: str, source: str = "all",
                    house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """Facet on the source and substring search over the searched text."""
    found = searched_text(house).contains(query.strip().lower())
    if source != "all":
        found = found & (first_present("source", F.lit(house)) == source)
    return listings.where(found)


def search_states(searches: DataFrame, directory: DataFrame, query: str = "query") -> DataFrame:
    """Directory rows, central ones left out, whose name contains the normalised query."""
    hubs = broadcast_if_small(directory.where(F.col("type") != "central")
                       .withColumn("_name", state_key("name")))
    keyed = searches.withColumn("_q", state_key(query))
    return keyed.join(hubs, F.col("_name").contains(F.col("_q"))).drop("_name", "_q")


def gate_status(snapshots: DataFrame) -> DataFrame:
    """Snapshots with a status other than success are not shown."""
    return snapshots.where(first_present("status", F.lit("success")) == "success")
