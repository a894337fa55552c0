"""Jobs over tables of raw pages: links, cards, sections, article bodies, cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions import html as H
from jobmill.functions import selectors as S
from jobmill.functions.html import Select
from jobmill.functions.text import contains_any, first_present, normalize_spaces, strip_spaces, text_or_empty
from jobmill.functions.urls import join_site_path, url_absolute, url_normalize
from jobmill.operators.predicates import is_competitor
from jobmill.session import broadcast_if_small

TOKENS = "_tokens"


def tokenized(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their token column instead of the raw text."""
    return pages.withColumn(TOKENS, H.tokenize(html)).drop(html)


def _others(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c not in (TOKENS, "html")]


def extract_links(pages: DataFrame) -> DataFrame:
    """Every anchor with an address, in document order: title, href, absolute full_url."""
    df = tokenized(pages)
    tokens = F.col(TOKENS)
    anchors = H.select(tokens, Select(tags=("a",), attr="href"))
    rows = F.transform(anchors, lambda a: F.struct(
        H.node_text(tokens, a).alias("title"), a.attrs["href"].alias("href")))
    flat = df.select(*_others(df), F.posexplode(rows).alias("pos", "_l"))
    return flat.select(*_others(df), F.col("pos").cast("bigint").alias("pos"), "_l.title", "_l.href",
                       url_absolute("_l.href", "url").alias("full_url"))


# ------------------------------------------------------------------ cards


def by_site(site: Column, cases: dict[str, Column], otherwise: Column | None = None) -> Column:
    """The expression of the row's site; only that one is evaluated for a row."""
    names = list(cases)
    out = F.when(site == names[0], cases[names[0]])
    for name in names[1:]:
        out = out.when(site == name, cases[name])
    return out if otherwise is None else out.otherwise(otherwise)


def with_cards(pages: DataFrame, rules: DataFrame, site: Column | None = None) -> DataFrame:
    """Pages with ``_cards`` instead of their html: the cards that the rules of their site (by default the column ``site``) find.

    ``rules`` (see ``dims.card_rules``) is a table; its text per site is joined to the pages, by broadcast while it is small,
    and every page is read in one pass.  Pages of a site without rules have no cards and are left out.
    """
    texts = broadcast_if_small(S.rules_by_site(rules).withColumnRenamed("site", "_site"))
    named = pages.withColumn("_site", F.col("site") if site is None else site)
    return named.join(texts, "_site").withColumn("_cards", S.card_values("html", "_rules")).drop("html", "_rules", "_site")


def card_columns(card: Column, fields: Iterable[str]) -> list[Column]:
    """The named fields of a card as columns; a field that its site lacks is empty."""
    return [F.coalesce(F.try_element_at(card["values"], F.lit(name)), F.lit("")).alias(name) for name in fields]


def extract_cards(pages: DataFrame, rules: DataFrame, fields: Iterable[str]) -> DataFrame:
    """One row per card with its fields; ``pages`` has a ``site`` column, lists are joined by commas."""
    # The outer form, as the other would read every page once more to see whether it has cards.
    cards = with_cards(pages, rules).select(*_others(pages), F.posexplode_outer("_cards").alias("pos", "_card")).where("pos IS NOT NULL")
    return cards.select(*_others(pages), F.col("pos").cast("bigint").alias("pos"), *card_columns(F.col("_card"), fields))


def detail_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, upload_date, detail_text) of detail pages: the first container of the first kind that a page has; '' if it has none."""
    found = with_cards(pages.select("url", "html"), rules, F.lit("upsc_detail"))
    return found.select("url", *card_columns(F.get("_cards", F.lit(0)), ("upload_date", "detail_text")))


def listed_details(lists: DataFrame, pages: DataFrame, rules: DataFrame, cap: int) -> DataFrame:
    """Anchors of list pages with what their detail pages say: (page columns), pos, title, detail_url, exam_date, detail_text.

    On every list page anchors without a title or address are skipped, the first of equal addresses counts and the first ``cap`` stay:
    all of that happens within the row of the page.  Only pages that an anchor leads to are parsed.  Where the detail page is missing or
    shows no date, the usual phrase stands.
    """
    df = with_cards(lists, rules, F.lit("upsc_active"))
    read = F.transform("_cards", lambda c: F.struct(c["values"]["title"].alias("title"), url_normalize(url_absolute(c["values"]["href"], F.col("url"))).alias("detail_url")))
    named = F.filter(read, lambda c: (c.title != "") & (c.detail_url != ""))
    first = H.let(named, lambda all_of: H.let(F.transform(all_of, lambda c: c.detail_url), lambda urls: F.filter(all_of, lambda c, i: F.array_position(urls, c.detail_url) == i + 1)))
    keep = [c for c in lists.columns if c != "html"]
    rows = df.select(*keep, F.posexplode_outer(F.slice(first, 1, cap)).alias("pos", "_a")).where("pos IS NOT NULL").select(*keep, F.col("pos").cast("bigint").alias("pos"), "_a.title", "_a.detail_url")
    wanted = rows.select(F.col("detail_url").alias("url")).distinct()
    details = detail_pages(pages.join(wanted, "url", "left_semi").dropDuplicates(["url"]), rules).withColumnRenamed("url", "detail_url")
    joined = rows.join(details, "detail_url", "left")
    return joined.select(*keep, "pos", "title", "detail_url", first_present("upload_date", F.lit(K.UPSC_EXAM_DATE)).alias("exam_date"), text_or_empty("detail_text").alias("detail_text"))


def recruitment_title(title: Column | str) -> Column:
    """The title of an advertisement, with the commission's name in front unless it is there."""
    title = F.col(title) if isinstance(title, str) else title
    return F.when(F.lower(title).startswith(K.UPSC_PREFIX.lower()), title).otherwise(F.concat(F.lit(K.UPSC_PREFIX + " "), title))


_RAC_CARD = Select(tags=("div",), attr="data-bs-target", attr_starts="#offcanvas")


def _first_piece(card: Column, words: list[str]) -> Column:
    """The first text piece of a card that holds one of the words."""
    pieces = F.transform(F.filter(card, lambda t: t.kind == "text"), lambda t: normalize_spaces(t.text))
    return F.coalesce(F.get(F.filter(pieces, lambda p: contains_any(F.lower(p), words)), F.lit(0)), F.lit(""))


def rac_notices(pages: DataFrame) -> DataFrame:
    """Announcement blocks joined with the details panel of their page; blocks without one are dropped.

    The page is tokenized once and the join happens inside its row: only elements that a block points at become
    panels, so nothing is shuffled and ids that nobody points at cost nothing.  Columns: target, number, summary, title,
    card_text, panel_text, links (pos, label, href; absolute, a blank label is replaced), primary_url.
    """
    df = tokenized(pages)
    tokens = F.col(TOKENS)
    blocks = H.select(tokens, _RAC_CARD)
    target_of = lambda b: F.regexp_replace(strip_spaces(b.attrs["data-bs-target"]), "^#+", "")

    def links(part: Column) -> Column:
        return F.transform(H.select(part, Select(tags=("a",), attr="href")), lambda a, i: F.struct(
            i.alias("pos"), F.coalesce(F.nullif(H.node_text(part, a), F.lit("")), F.lit(K.OFFICIAL_LINK_LABEL)).alias("label"),
            url_normalize(url_absolute(a.attrs["href"], F.col("url"))).alias("href")))

    def panel(node: Column) -> Column:
        return H.let(H.subtree(tokens, node), lambda part: F.struct(
            node.attrs["id"].alias("target"), normalize_spaces(H.text_of(part)).alias("panel_text"),
            F.filter(links(part), lambda x: x.href != "").alias("links")))

    def panels(targets: Column) -> Column:
        named = F.filter(tokens, lambda t: (t.kind == "open") & F.coalesce((t.attrs["id"] != "") & F.array_contains(targets, t.attrs["id"]), F.lit(False)))
        return F.transform(named, panel)

    def joined(found: Column, targets: Column, parts: Column) -> Column:
        return F.transform(found, lambda b, i: F.struct(H.subtree(tokens, b).alias("card"), H.let(F.get(targets, i), lambda name: F.get(
            F.filter(parts, lambda p: p.target == name), F.lit(0))).alias("panel")))

    # Blocks, targets and panels are bound, as each would otherwise be made again for every token or block that looks at it.
    pairs = H.let(blocks, lambda found: H.let(F.transform(found, target_of), lambda targets: H.let(
        panels(targets), lambda parts: F.filter(joined(found, targets, parts), lambda x: x.panel.isNotNull()))))
    keep = _others(df)
    rows = df.select(*keep, F.explode(pairs).alias("_b"))
    card = F.col("_b.card")
    fields = (H.nth_text(card, Select(classes=("advtHeading",))), _first_piece(card, K.CARD_WORDS["rac", "summary"]), normalize_spaces(H.text_of(card)))
    rows = rows.select(*keep, *[f.alias(n) for f, n in zip(fields, ("number", "summary", "card_text"), strict=True)], "_b.panel.*")
    title = strip_spaces(F.concat(F.lit(K.RAC_TITLE), F.col("number")))
    named = F.filter("links", lambda x: F.lower(x.label).contains("advertisement"))
    return rows.withColumns({"title": F.when(F.col("summary") == "", title).otherwise(F.concat(title, F.lit(" - "), "summary")),
                             "primary_url": F.coalesce(F.get(named, F.lit(0)).href, F.col("url"))})


def first_links(links: Column | str) -> Column:
    """The first link of every address, in their order."""
    links = F.col(links) if isinstance(links, str) else links
    hrefs = F.transform(links, lambda x: x.href)
    return H.let(hrefs, lambda all_of: F.filter(links, lambda x, i: F.array_position(all_of, x.href) == i + 1))


# ------------------------------------------------------------------ homepage sections


def heading_category(site: str, heading: Column) -> Column:
    """Category of the first heading word, in the site's order, that the heading contains."""
    lowered = F.lower(heading)
    result = F.when(F.lit(False), F.lit(""))
    for word, category in K.HEADING_MAPS[site]:
        result = result.when(lowered.contains(word), category)
    return result


def _list_after(tokens: Column, heading: Column) -> Column:
    """The next sibling list, else the next list in the document."""
    lists = F.filter(tokens, lambda t: (t.kind == "open") & (t.tag == "ul") & (t.pos > heading.pos))
    sibling = F.filter(lists, lambda t: (t.parent == heading.parent) & (t.pos > heading.close))
    return F.coalesce(F.get(sibling, F.lit(0)), F.get(lists, F.lit(0)))


def _sections(tokens: Column, site: str, limit: int) -> Column:
    """Blocks of one site's homepage: heading and the first anchors."""
    if site == "SR":
        blocks = H.select(tokens, Select(tags=("div",), id="post"))
        heading = lambda b: strip_spaces(F.get(F.split(strip_spaces(
            H.whole_text(H.subtree(tokens, b))), "\n"), F.lit(0)))
        area = lambda b: b
    else:
        tags = ("h2", "h3") if site == "FJA" else ("h2", "h3", "h4")
        plain = H.select(tokens, Select(tags=tags))
        if site == "FJA":
            marked = H.select(tokens, Select(tags=("h2", "h3", "div", "span"), class_pattern=K.SECTION_HEADING_CLASS))
            blocks = H.let(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(plain))
        else:
            blocks = plain
        heading = lambda b: strip_spaces(H.whole_text(H.subtree(tokens, b)))
        area = lambda b: _list_after(tokens, b)

    def anchors(node: Column) -> Column:
        def rows(part: Column) -> Column:
            found = F.slice(H.select(part, Select(tags=("a",))), 1, limit)
            return F.transform(found, lambda a: F.struct(
                strip_spaces(H.whole_text(H.subtree(part, a))).alias("title"),
                text_or_empty(a.attrs["href"]).alias("href")))
        return H.let(H.subtree(tokens, node), rows)

    return F.transform(blocks, lambda b: F.struct(heading(b).alias("heading"), anchors(area(b)).alias("links")))


def extract_sections(pages: DataFrame, homes: dict[str, str], limit: int = K.HOME_LIMIT) -> DataFrame:
    """Homepage blocks: category by heading, the first anchors of each block.

    ``pages`` has a ``site`` column, ``homes`` the address of each site; pages of all sites are read and tokenized once.
    The anchors are counted before any filter.
    """
    df = tokenized(pages)
    site = F.col("site")
    sections = by_site(site, {s: _sections(F.col(TOKENS), s, limit) for s in homes})
    keep = _others(df)
    flat = df.select(*keep, F.posexplode(sections).alias("section_pos", "_s"))
    category = by_site(site, {s: heading_category(s, F.col("_s.heading")) for s in homes})
    flat = flat.withColumn("category", category).where("category is not null")
    flat = flat.select(*keep, "section_pos", F.col("_s.heading").alias("heading"), "category",
                       F.posexplode("_s.links").alias("link_pos", "_l"))
    return flat.select(
        *keep, F.col("section_pos").cast("bigint").alias("section_pos"), "heading", "category",
        F.col("link_pos").cast("bigint").alias("link_pos"), "_l.title", "_l.href",
        by_site(site, {s: join_site_path("_l.href", home) for s, home in homes.items()}).alias("full_url"))


# ------------------------------------------------------------------ article bodies


def _body_candidates(tokens: Column, site: Column) -> Column:
    """Candidate elements with (rule, weight); weight ranks tables by their written length."""
    def ranked(found: Column, rule: int) -> Column:
        return F.transform(found, lambda n: F.struct(
            F.lit(rule).alias("rule"), F.lit(0).alias("weight"), n.alias("node")))

    tables = F.transform(H.select(tokens, Select(tags=("table",))), lambda n: F.struct(
        F.lit(9).alias("rule"), F.length(H.to_html(H.subtree(tokens, n))).alias("weight"), n.alias("node")))
    def by_class(name: str) -> Column:
        return ranked(H.select(tokens, Select(tags=("div",), class_pattern=K.BODY_CLASS[name])), 1)

    first = F.concat(ranked(H.select(tokens, Select(tags=("div",), id="post")), 0), by_class("SR"))
    others = F.concat(by_class("FJA"), ranked(H.select(tokens, Select(tags=("article",))), 2))
    return F.concat(F.when(site == "SR", first).otherwise(others), tables)


def with_main_content(df: DataFrame, site: Column) -> DataFrame:
    """Adds ``_main`` (the tokens of the article body, NULL if none) and ``main_rule``.

    Best candidate: lowest rule, then largest weight, then first in the document.
    """
    tokens = F.col(TOKENS)
    ranked = F.transform(_body_candidates(tokens, site), lambda c: F.struct(
        c.rule.alias("rule"), (-c.weight).alias("lighter"), c.node.pos.alias("pos"), c.node.close.alias("close")))
    df = df.withColumn("_best", F.array_min(ranked))
    return df.withColumns({
        "_main": F.slice(tokens, F.col("_best.pos") + 1, F.col("_best.close") - F.col("_best.pos") + 1),
        "main_rule": F.col("_best.rule").cast("bigint"),
    }).drop("_best")


def extract_main_content(pages: DataFrame, site: Column) -> DataFrame:
    df = with_main_content(tokenized(pages), site)
    text = F.when(F.col("_main").isNull(), "").otherwise(H.text_of(F.col("_main")))
    return df.select(*[c for c in _others(df) if c not in ("_main", "main_rule")], "main_rule", text.alias("text"))


def largest_block(pages: DataFrame, tag: str = "p") -> DataFrame:
    """The element of ``tag`` with the longest text per page, first one on ties."""
    df = tokenized(pages)
    tokens = F.col(TOKENS)
    blocks = F.transform(H.select(tokens, Select(tags=(tag,))), lambda n: H.let(
        H.node_text(tokens, n), lambda text: F.struct(
            (-F.length(text)).alias("shorter"), n.pos.alias("pos"), text.alias("text"))))
    df = df.withColumn("_best", F.array_min(blocks)).where("_best is not null")
    return df.select(*[c for c in _others(df) if c != "_best"], (-F.col("_best.shorter")).cast("bigint").alias("block_length"),
                     F.col("_best.text").alias("block_text"))


# ------------------------------------------------------------------ text and cleaning


def html_to_text(pages: DataFrame) -> DataFrame:
    """Text of each page; a value without both angle brackets is text already."""
    marked = pages.withColumn("_plain", F.when(~H.looks_like_html(F.col("html")), F.col("html")))
    df = tokenized(marked)
    return df.withColumn("text", F.coalesce("_plain", H.text_of(F.col(TOKENS)))).drop(TOKENS, "_plain")


def html_clean(pages: DataFrame, drop_tags: tuple[str, ...] = K.OFFICIAL_DROP_TAGS) -> DataFrame:
    """Listed elements dropped, links absolute: clean_html, clean_text and the link addresses."""
    df = tokenized(pages)
    df = df.withColumn("_clean", H.clean_fragment(F.col(TOKENS), F.col("url"), drop_tags))
    clean = F.col("_clean")
    links = F.transform(H.select(clean, Select(tags=("a",), attr="href")), lambda a: a.attrs["href"])
    return df.withColumns({"clean_html": H.to_html(clean), "clean_text": H.text_of(clean), "links": links}).drop(
        "_clean", TOKENS)


def deep_cleaned(df: DataFrame, tokens: str = TOKENS, site: Column | None = None, root: bool = True,
                 house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """Adds ``_deep``, the cleaned tokens, and ``_dropped``, the spans that went.

    ``site`` exempts the page's own domain from the competitor test.
    """
    site = F.lit("") if site is None else site
    source = F.col(tokens)
    df = df.withColumn("_junk", H.junk_spans(source, root))
    df = df.withColumn("_kept", H.without(source, F.col("_junk")))
    df = df.withColumn("_foreign", H.foreign_spans(F.col("_kept"), lambda url: is_competitor(url, site)))
    df = df.withColumn("_dropped", F.array_sort(F.concat("_junk", "_foreign")))
    df = df.withColumn("_deep", H.scrub_tokens(H.without(source, F.col("_dropped")), house))
    return df.drop("_junk", "_kept", "_foreign")


def html_deep_clean(pages: DataFrame, site: Column | None = None, house: str = K.DEFAULT_HOUSE) -> DataFrame:
    """clean_html, clean_text and the number of dropped elements per tag."""
    df = deep_cleaned(tokenized(pages), site=site, house=house)
    gone = F.transform(F.col("_dropped"), lambda s: F.get(F.col(TOKENS), s.pos).tag)
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(gone)), lambda tag: F.struct(
        tag, F.size(F.filter(gone, lambda g: g == tag)).cast("bigint"))))
    return df.withColumns({"clean_html": H.to_html(F.col("_deep")), "clean_text": H.text_of(F.col("_deep")),
                           "dropped_tags": counts}).drop("_deep", "_dropped", TOKENS)
