"""Queries over raw pages and raw feed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions import extract as X
from jobmill.functions import text as T
from jobmill.functions import urls as U
from jobmill.operators import joins as J
from jobmill.operators import pages as PG
from jobmill.operators import predicates as P
from jobmill.operators import validate as V
from jobmill.plans import sql as Q
from jobmill.plans.inputs import table, view
from jobmill.plans.registry import query
from jobmill.sources import dims
from jobmill.sources import documents as DOC

# ------------------------------------------------------------------ pages as they are


@query("extract_links", r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a,
  generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos FROM pages)
SELECT page_id, pos, trim(replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&')) AS title, replace(regexp_extract(a, '"([^"]*)"', 1), '&amp;', '&') AS href,
  split_part(regexp_extract(url, '^[a-z]+://[^/]*') || replace(regexp_extract(a, '"([^"]*)"', 1), '&amp;', '&'), '#', 1) AS full_url FROM a""")
def extract_links(spark, sf):
    return PG.extract_links(table(spark, sf, "pages", heavy=True)).select("page_id", "pos", "title", "href", "full_url")


@query("html_to_text", f"SELECT page_id, {Q.PAGE_TEXT} AS text FROM pages")
def html_to_text(spark, sf):
    return PG.html_to_text(table(spark, sf, "pages", heavy=True)).select("page_id", "text")


@query("html_clean", f"""
SELECT page_id, {Q.PAGE_TEXT} AS clean_text, array_to_string(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h:
  split_part(regexp_extract(url, '^[a-z]+://[^/]*') || replace(h, '&amp;', '&'), '#', 1)), ' ') AS links,
  contains(html, '<script') OR contains(html, '<style') OR contains(html, '<meta') AS had_scripts, false AS has_scripts FROM pages""")
def html_clean(spark, sf):
    pages = table(spark, sf, "pages", heavy=True)
    clean = PG.html_clean(pages.withColumn("had_scripts", F.expr("html like '%<script%' or html like '%<style%' or html like '%<meta%'")))
    has = F.expr("clean_html like '%<script%' or clean_html like '%<style%' or clean_html like '%<meta%'")
    return clean.select("page_id", "clean_text", F.array_join("links", " ").alias("links"), "had_scripts", has.alias("has_scripts"))


_EXTRA = ("""'<div class="lead-in">sponsored</div><p title="Sarkari Result">Sarkari Result ' || page_id || """
          """'</p><a href="https://t.me/x">join</a><a href="/ok">Get App</a><img src="a.png" alt="Sarkari logo"><a href="/see">see get app store</a>"""
          """<a href="https://docs.example.gov.in/n" target="_b">notice</a>'""")


@query("html_deep_clean", f"""
SELECT page_id, {Q.PAGE_TEXT} || ' {K.DEFAULT_HOUSE} ' || page_id || ' notice' AS clean_text, 'a:3 div:1 img:1 meta:1 script:1 style:1' AS dropped FROM pages""")
def html_deep_clean(spark, sf):
    pages = table(spark, sf, "pages", heavy=True).withColumn("html", F.concat("html", F.expr(_EXTRA.replace("|| page_id ||", "|| cast(page_id as string) ||"))))
    pairs = F.transform(F.map_entries("dropped_tags"), lambda e: F.concat(e.key, F.lit(":"), e.value.cast("string")))
    return PG.html_deep_clean(pages).select("page_id", "clean_text", F.array_join(F.array_sort(pairs), " ").alias("dropped"))


@query("extract_main_content", f"""
SELECT page_id, cast(2 AS bigint) AS main_rule, {Q.PAGE_TEXT.replace('regexp_replace(html,', "regexp_replace(regexp_extract(html, '<article>.*</article>', 0, 's'),")} AS text FROM pages""")
def extract_main_content(spark, sf):
    return PG.extract_main_content(table(spark, sf, "pages", heavy=True), F.lit("FJA")).select("page_id", "main_rule", "text")


@query("largest_block", r"""
WITH t AS (SELECT page_id, string_split_regex(regexp_replace(regexp_extract(html, '<body>.*', 0, 's'), '<!--.*?-->', '', 'gs'), '<li>') AS items FROM pages),
i AS (SELECT page_id, unnest(items[2:]) AS item, generate_subscripts(items[2:], 1) AS pos FROM t),
x AS (SELECT page_id, pos, trim(replace(regexp_extract(item, '^<a[^>]*>([^<]*)</a>', 1), '&amp;', '&')) AS text FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, pos) AS rn FROM x)
SELECT page_id, length(text) AS block_length, text AS block_text FROM r WHERE rn = 1""")
def largest_block(spark, sf):
    return PG.largest_block(table(spark, sf, "pages", heavy=True), "li").select("page_id", "block_length", "block_text")


@query("scan_page_config", f"""
SELECT p.page_id, c.site, c.page_url, c.category, c.state, cast(c.page_limit AS bigint) AS page_limit FROM pages p JOIN
{Q.values(dims.page_config_rows(), 'config_seq, site, page_url, category, state, page_limit')} c ON c.config_seq = p.page_id % {len(dims.page_config_rows())}""")
def scan_page_config(spark, sf):
    config = F.broadcast(dims.page_config(spark))
    pages = table(spark, sf, "pages").select("page_id", (F.col("page_id") % len(dims.page_config_rows())).alias("config_seq"))
    return pages.join(config, "config_seq").drop("config_seq")


@query("join_link_content", f"""
WITH l AS (SELECT seq, k, title FROM v_listings)
SELECT l.seq, l.title, coalesce({Q.PAGE_TEXT}, '') AS body_text FROM l LEFT JOIN pages p ON p.page_id = l.k""")
def join_link_content(spark, sf):
    links = view(spark, sf, "v_listings", heavy=True).select("seq", "title", U.url_normalize(
        F.concat(F.lit("https://jobs.example.com/p/"), F.col("k").cast("string"), F.lit("#x"))).alias("url_key"))
    pages = PG.html_to_text(table(spark, sf, "pages", heavy=True)).select(
        F.concat(F.lit("https://jobs.example.com/p/"), F.col("page_id").cast("string")).alias("url_key"), F.col("text").alias("body_text"))
    return J.join_content(links, pages).select("seq", "title", "body_text")


# ------------------------------------------------------------------ pages built from the tables

_K = "cast(k AS string)"
# One page per listing, each site's markup in turn; every page holds two cards, the second without optional parts.
CARD_PAGES = [
    ("internshala", f"""'<div class="x individual_internship"><h3><a class="job-title-href" href="/job/' || {_K} || '?a=1#z">Clerk  ' || {_K} ||
      '</a></h3><p class="company-name"> Acme ' || {_K} || ' </p><div class="locations"><span>Pune</span></div><div class="detail-row-1">
      <div class="row-1-item">now</div><div class="row-1-item">Rs ' || {_K} || '</div><div class="row-1-item">2 yrs</div></div>
      <span class="job_skill">Excel</span><span class="job_skill">SQL</span><div class="status-success">Today</div></div>
      <div class="individual_internship"><a class="job-title-href" href="x/y">Peon</a><p class="company-name">Beta</p></div>'"""),
    ("freshersworld", f"""'<div class="job-container" job_display_url="https://fw.example.com/' || {_K} || '#q"><div class="job-new-title">
      <span class="wrap-title seo_title">Clerk ' || {_K} || ' <b>More</b></span></div><h3 class="company-name">Acme ' || {_K} || '</h3>
      <span class="job-location">Pune</span><span class="experience">2 yrs</span><div class="qualification-block">
      <span class="job-details-span">Rs ' || {_K} || '</span><span class="job-details-span">BA, BCom,</span></div>Posted: Today Save</div>
      <div class="job-container" job_display_url="https://fw.example.com/p"><div class="job-new-title"><span class="wrap-title seo_title">Peon</span></div>
      <h3 class="company-name">Beta</h3></div>'"""),
    ("naukri", f"""'<div class="srp-jobtuple-wrapper"><a class="title" href="https://n.example.com/' || {_K} || '">Clerk ' || {_K} || '</a>
      <a class="comp-name">Acme ' || {_K} || '</a><span class="locWdth">Pune</span><span class="expwdth">2 yrs</span></div>
      <div class="jobTuple">no card</div><article class="jobTuple"><a class="title" href="https://n.example.com/p">Peon</a><a class="comp-name">Beta</a></article>'"""),
    ("indeed", f"""'<table><tr><td class="resultContent"><h2 class="jobTitle"><a href="/rc?k=' || {_K} || '">new Clerk ' || {_K} || '</a></h2>
      <span class="companyName">Acme ' || {_K} || '</span><div class="companyLocation">Pune</div></td></tr><tr><td class="resultContent">
      <h2 class="jobTitle"><a href="/rc?p">Peon</a></h2><span class="companyName">Beta</span></td></tr></table>'"""),
    ("flexjobs", f"""'<ul><li class="m-0 row"><a class="job-title" href="/j/' || {_K} || '">Clerk ' || {_K} || '</a><p class="job-description">Do  it</p></li>
      <li class="m-0"><a class="job-title" href="/j/p">Peon</a></li></ul>'"""),
    ("ibps", f"""'<a href="https://ibpsreg.ibps.in/' || {_K} || '"><div class="detail-list"><div class="detail-first-heading">Acme ' || {_K} || '</div>
      <div class="detail-second-heading">Clerk ' || {_K} || '</div><div class="detail-third-heading"><div class="detail-heading"><div>01-01-2026</div><div>31-01-2026</div>
      </div></div></div></a><a href="https://ibpsreg.ibps.in/p">Peon</a>'"""),
    ("upsc_active", f"""'<div class="view-content"><div class="views-row"><a href="/exam/' || {_K} || '">Clerk ' || {_K} || '</a></div>
      <div class="views-row"><a href="/exam/p">Peon</a></div></div><div class="views-row"><a href="/z">outside</a></div>'"""),
    ("upsc_recruitment", f"""'<div class="view-content"><ul><li>Clerk ' || {_K} || ' (123 KB) <a href="/f.pdf?k=' || {_K} || '"></a></li><li>Peon</li></ul></div>'"""),
]


def _by_number(texts: list[str], number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(texts)) + " END"


def _card_pages(spark, sf) -> DataFrame:
    """One page per listing, each site's markup in turn."""
    rows = view(spark, sf, "v_listings", heavy=True).select("seq", "k")
    site = F.element_at(F.array(*[F.lit(s) for s, _ in CARD_PAGES]), (F.col("seq") % len(CARD_PAGES) + 1).cast("int"))
    html = F.expr(_by_number([text for _, text in CARD_PAGES], f"seq % {len(CARD_PAGES)}"))
    return rows.select("seq", site.alias("site"), F.lit("https://cards.example.com/list/").alias("url"), html.alias("html"))


def _plain_cards(cards: DataFrame) -> DataFrame:
    """The adapters' fields on common columns, cleaned as each site needs."""
    site = F.col("site")
    title = PG.by_site(site, {"ibps": T.first_present("role", "card_text"), "upsc_recruitment": PG.recruitment_title(T.strip_size_note("title"))}
                       | {name: rule("title") for name, rule in T.CARD_TITLES.items()}, F.col("title"))
    company = PG.by_site(site, {"ibps": F.col("org")}, F.col("company"))
    extra = PG.by_site(site, {
        "internshala": F.concat_ws("|", "experience", "posted_at", "skills"),
        "freshersworld": F.concat_ws("|", "experience", F.array_join(T.split_qualification("qualification"), ","), X.extract_notice_dates("card_text")["posted"]),
        "ibps": F.concat_ws("|", "start_date", "end_date"), "flexjobs": F.concat(F.col("summary"))}, F.lit(""))
    return cards.select("site", "seq", "pos", title.alias("title"), company.alias("company"), "job_location", "salary",
                        U.url_absolute("href", "url").alias("url"), extra.alias("extra"))


_CARD_SQL = {
    "internshala": ("'https://cards.example.com/job/' || k || '?a=1'", "'https://cards.example.com/list/x/y'", "'Acme ' || k", "'Beta'", "'Pune'", "'Rs ' || k",
                    "'2 yrs|Today|Excel,SQL'", "'||'"),
    "freshersworld": ("'https://fw.example.com/' || k", "'https://fw.example.com/p'", "'Acme ' || k", "'Beta'", "'Pune'", "'Rs ' || k", "'2 yrs|BA,BCom|Today'", "'||'"),
    "naukri": ("'https://n.example.com/' || k", "'https://n.example.com/p'", "'Acme ' || k", "'Beta'", "'Pune'", "''", "''", "''"),
    "indeed": ("'https://cards.example.com/rc?k=' || k", "'https://cards.example.com/rc?p'", "'Acme ' || k", "'Beta'", "'Pune'", "''", "''", "''"),
    "flexjobs": ("'https://cards.example.com/j/' || k", "'https://cards.example.com/j/p'", "''", "''", "''", "''", "'Do it'", "''"),
    "ibps": ("'https://ibpsreg.ibps.in/' || k", "'https://ibpsreg.ibps.in/p'", "'Acme ' || k", "'IBPS'", "''", "''", "'01-01-2026|31-01-2026'", "'|'"),
    "upsc_active": ("'https://cards.example.com/exam/' || k", "'https://cards.example.com/exam/p'", "''", "''", "''", "''", "''", "''"),
    "upsc_recruitment": ("'https://cards.example.com/f.pdf?k=' || k", "'https://cards.example.com/list/'", "''", "''", "''", "''", "''", "''"),
}


def _card_oracle() -> str:
    parts = []
    for i, (site, _) in enumerate(CARD_PAGES):
        url0, url1, company0, company1, place, salary, extra0, extra1 = _CARD_SQL[site]
        where = f"FROM v_listings WHERE seq % {len(CARD_PAGES)} = {i}"
        prefix = "UPSC " if site == "upsc_recruitment" else ""
        parts.append(f"SELECT '{site}' AS site, seq, cast(0 AS bigint) AS pos, '{prefix}Clerk ' || k AS title, {company0} AS company, {place} AS job_location, "
                     f"{salary} AS salary, {url0} AS url, {extra0} AS extra {where}")
        parts.append(f"SELECT '{site}', seq, 1, '{prefix}Peon', {company1}, '', '', {url1}, {extra1} {where}")
    return "\nUNION ALL ".join(parts)


@query("extract_cards", _card_oracle())
def extract_cards(spark, sf):
    rules = dims.card_rules(spark)
    fields = sorted({name for site, _, _, own in K.CARD_SELECTORS if site in dict(CARD_PAGES) for name, *_ in own})
    return _plain_cards(PG.extract_cards(_card_pages(spark, sf), rules, fields))


# One list page per 20 customers: an anchor each, some without a title, some twice.  Every fourth detail page is missing, others have
# another container, none at all, or no date.
_ANCHOR = """'<div class="views-row"><a href="/exam/' || cast(k AS string) || '">' || CASE WHEN k % 7 = 3 THEN ' ' ELSE 'Exam  ' || cast(k AS string) END || '</a>' ||
  CASE WHEN k % 5 = 0 THEN '<a href="/exam/' || cast(k AS string) || '#top">Again</a>' ELSE '' END || '</div>'"""
_DETAIL = """'<html><body><div class="view-filters"><span class="date-display-single">no</span></div>' || CASE k % 3 WHEN 0 THEN '<div class="region-content">later</div><div class="view-content">'
  WHEN 1 THEN '<div class="region-content">' ELSE '<div class="other">' END || CASE WHEN k % 2 = 0 THEN '<p><span class="date-display-single"> ' || cast(k % 28 + 1 AS string) ||
  '/02/2026</span></p><span class="date-display-single">01/01/2025</span>' ELSE '<p>None</p>' END || '</div></body></html>'"""


@query("join_detail_pages", """
WITH a AS (SELECT c_custkey AS k, c_custkey // 20 AS list_id, unnest(CASE WHEN c_custkey % 5 = 0 THEN [0, 1] ELSE [0] END) AS nth FROM customer),
t AS (SELECT *, CASE WHEN nth = 1 THEN 'Again' WHEN k % 7 = 3 THEN '' ELSE 'Exam ' || k END AS title FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY list_id, k ORDER BY nth) AS rn FROM t WHERE title <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY k) - 1 AS pos FROM f WHERE rn = 1)
SELECT list_id, pos, title, 'https://u.example.com/exam/' || k AS detail_url, CASE WHEN k % 4 <> 1 AND k % 3 < 2 AND k % 2 = 0 THEN (k % 28 + 1) || '/02/2026' ELSE 'As per UPSC schedule' END AS exam_date,
  CASE WHEN k % 4 = 1 OR k % 3 = 2 THEN '' WHEN k % 2 = 0 THEN (k % 28 + 1) || '/02/2026 01/01/2025' ELSE 'None' END AS detail_text FROM r WHERE pos < 12""")
def join_detail_pages(spark, sf):
    customers = table(spark, sf, "customer", heavy=True).select(F.col("c_custkey").alias("k"))
    lists = customers.groupBy(F.expr("k div 20").alias("list_id")).agg(F.sort_array(F.collect_list(F.struct("k", F.expr(_ANCHOR).alias("a")))).alias("a"))  # 20 at most
    lists = lists.select("list_id", F.lit("https://u.example.com/exams").alias("url"), F.concat(F.lit('<div class="view-content">'), F.array_join("a.a", ""), F.lit("</div>")).alias("html"))
    pages = customers.where("k % 4 <> 1").select(F.concat(F.lit("https://u.example.com/exam/"), F.col("k").cast("string")).alias("url"), F.expr(_DETAIL).alias("html"))
    found = PG.listed_details(lists, pages, dims.card_rules(spark), K.OFFICIAL_SOURCE_CAPS["upsc_active"])
    return found.select("list_id", "pos", "title", "detail_url", "exam_date", "detail_text")


# Every third page has no summary; every fourth block points at a panel that is not there.
_RAC = f"""'<div data-bs-target="#offcanvas' || {_K} || '"><span class="advtHeading"> ' || {_K} || ' </span>' ||
  CASE WHEN k % 3 = 0 THEN '' ELSE '<p>Selection of Scientist B ' || {_K} || '</p>' END ||
  'Last updated: 01-02-2026 Closing date: 28 Feb ' || cast(2024 + k % 4 AS string) || '</div><div data-bs-target="#offcanvasmissing"><span class="advtHeading">0</span></div>
  <div id="offcanvas' || {_K} || '"><a href="/home">Home</a>' || CASE WHEN k % 5 = 0 THEN '' ELSE '<a href="/adv/' || {_K} || '.pdf#p2">Advertisement  PDF</a>' END ||
  '<a href="/adv/x.pdf">Corrigendum</a><a href="/home#top">Home page</a><a href="/blank"> </a><a href="#"></a></div>'"""


def _rac_pages(spark, sf) -> DataFrame:
    rows = view(spark, sf, "v_listings", heavy=True)
    return rows.select(F.col("seq").alias("page_id"), F.lit("https://rac.example.gov.in/").alias("url"), F.expr(_RAC).alias("html"))


@query("join_panel", """
SELECT seq AS page_id, 'offcanvas' || k AS target, 'DRDO RAC Advertisement No. ' || k || CASE WHEN k % 3 = 0 THEN '' ELSE ' - Selection of Scientist B ' || k END AS title,
  '01-02-2026' AS updated, '28 Feb ' || (2024 + k % 4) AS closing,
  'https://rac.example.gov.in/' || CASE WHEN k % 5 = 0 THEN '' ELSE 'adv/' || k || '.pdf' END AS primary_url FROM v_listings WHERE 2024 + k % 4 >= 2026""")
def join_panel(spark, sf):
    notices = PG.rac_notices(_rac_pages(spark, sf)).withColumn("dates", X.extract_notice_dates("card_text"))
    notices = notices.where(P.is_current_notice(F.concat_ws(" ", "title", "summary", "dates.closing"), 2026))
    return notices.select("page_id", "target", "title", "dates.updated", "dates.closing", "primary_url")


@query("official_links", """
SELECT seq AS page_id, pos, label, 'https://rac.example.gov.in/' || href AS href FROM v_listings,
  LATERAL (VALUES (0, 'Home', 'home'), (1, 'Advertisement PDF', 'adv/' || k || '.pdf'), (2, 'Corrigendum', 'adv/x.pdf'), (4, 'Official link', 'blank'), (5, 'Official link', '')) t(p, label, href),
  LATERAL (SELECT CASE WHEN k % 5 = 0 AND p > 1 THEN p - 1 ELSE p END AS pos) q WHERE NOT (k % 5 = 0 AND p = 1)""")
def official_links(spark, sf):
    """The links of each page's panel, the first per address; a link without a label gets the usual one."""
    links = PG.rac_notices(_rac_pages(spark, sf)).select("page_id", F.explode(PG.first_links("links")).alias("_l"))
    return links.select("page_id", F.col("_l.pos").alias("pos"), "_l.label", "_l.href")


_HOME = {
    "SR": f"""'<div id="post">Latest  Result\n<ul><li><a href="/r/' || {_K} || '"> One </a><a href="https://x.example.com/2#f">Two</a></li></ul></div>
      <div id="post">Other<a href="/o">no</a></div><div id="post">Answer Key<a href="k">Three</a></div>'""",
    "FJA": f"""'<h2>Result</h2><ul><li><a href="/ignored">x</a></li></ul><div class="a nutitle">Admit Card 2026</div><p>p</p><ul><a href="/r/' || {_K} || '">One</a>
      <a href="https://x.example.com/2#f">Two</a></ul><span class="section-head">Updates</span><div><ul><a href="k">Three</a></ul></div>'""",
    "SE": f"""'<h4>Exam  Answer Key</h4><ul><a href="/r/' || {_K} || '">One</a><a href="https://x.example.com/2#f">Two</a></ul><h1>Result</h1>
      <div><h3>New Updates</h3></div><ul><a href="k">Three</a></ul>'""",
}


def _home_oracle() -> str:
    parts = []
    shown = {"SR": [("results", "Latest  Result", 0), ("answer_keys", "Answer KeyThree", 2)],
             "FJA": [("admit_cards", "Admit Card 2026", 0), ("latest_jobs", "Updates", 1)],
             "SE": [("results", "Exam  Answer Key", 0), ("latest_jobs", "New Updates", 1)]}
    for i, site in enumerate(_HOME):
        (c1, h1, p1), (c2, h2, p2) = shown[site]
        where = f"FROM v_listings WHERE seq % 3 = {i}"
        parts += [
            f"SELECT '{site}' AS site, seq, cast({p1} AS bigint) AS section_pos, '{h1}' AS heading, '{c1}' AS category, cast(0 AS bigint) AS link_pos, 'One' AS title, "
            f"'https://home.example.com/r/' || k AS full_url {where}",
            f"SELECT '{site}', seq, {p1}, '{h1}', '{c1}', 1, 'Two', 'https://x.example.com/2#f' {where}",
            f"SELECT '{site}', seq, {p2}, '{h2}', '{c2}', 0, 'Three', 'https://home.example.com/k' {where}"]
    return "\nUNION ALL ".join(parts)


@query("extract_sections", _home_oracle())
def extract_sections(spark, sf):
    rows = view(spark, sf, "v_listings", heavy=True).select("seq", "k")
    site = F.element_at(F.array(*[F.lit(s) for s in _HOME]), (F.col("seq") % 3 + 1).cast("int"))
    html = F.expr(_by_number([h.replace("\n<ul>", "' || chr(10) || '<ul>") for h in _HOME.values()], "seq % 3"))
    pages = rows.select("seq", site.alias("site"), html.alias("html"))
    return PG.extract_sections(pages, dict.fromkeys(_HOME, "https://home.example.com/")).select(
        "site", "seq", "section_pos", "heading", "category", "link_pos", "title", "full_url")


# ------------------------------------------------------------------ raw feed and snapshot texts


def _item(**fields):
    return F.struct(*[(v if not isinstance(v, str) else F.col(v)).alias(n) for n, v in fields.items()])


@query("scan_snapshot", """
SELECT l.seq, 'success' AS status, l.category, i AS pos, l.category || l.seq || '-' || i AS id, l.title || ' ' || i AS title, l.source
FROM v_listings l, range(2) r(i) WHERE l.seq % 10 <> 0 AND i < CASE WHEN l.seq % 3 = 0 THEN 2 ELSE 1 END""")
def scan_snapshot(spark, sf):
    rows = view(spark, sf, "v_listings", heavy=True)

    def item(i):
        return _item(id=F.concat("category", F.col("seq").cast("string"), F.lit(f"-{i}")), title=F.concat("title", F.lit(f" {i}")), source="source")

    items = F.when(F.col("seq") % 3 == 0, F.array(item(0), item(1))).otherwise(F.array(item(0)))
    doc = F.to_json(F.struct(F.lit("success").alias("status"), *[F.when(F.col("category") == c, items).alias(c) for c in K.CATEGORIES]))
    body = F.when(F.col("seq") % 10 == 0, F.lit('{"status":"success","results":null}')).otherwise(doc)
    docs = rows.select("seq", body.alias("body"))
    return DOC.parse_snapshot(docs).select("seq", "status", "category", "pos", "id", "title", "source")


@query("scan_manual", """
SELECT c_custkey, 'latest_jobs' AS category, cast(0 AS bigint) AS pos, 'j' || c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Official' END AS org,
  'Job' AS cat, 'All India' AS state_label, 'post.html?id=j' || c_custkey || '&cat=jobs' AS url, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS vac, 'Asified' AS last_date, NULL AS badge, NULL AS exam_date, NULL AS key_type FROM customer
UNION ALL SELECT c_custkey, 'results', 0, 'r', c_name, 'Official', 'Result', 'All India', 'https://r.example.com', NULL, NULL, 'out', NULL, NULL FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'admit_cards', 0, 'a', c_name, 'Official', 'Updates', 'All India', 'post.html?id=a&cat=admitcard', NULL, NULL, 'out', 'Check specific notice', NULL FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, 'answer_keys', 0, 'k', c_name, 'Official', 'Updates', 'All India', 'post.html?id=k&cat=answerkey', NULL, NULL, 'new', NULL, 'FINAL' FROM customer WHERE c_custkey % 3 = 2""")
def scan_manual(spark, sf):
    rows = table(spark, sf, "customer")
    even, third = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3
    job = _item(id=F.concat(F.lit("j"), F.col("c_custkey").cast("string")), title="c_name",
                org=F.when(even, F.col("c_mktsegment")).otherwise(""), vac=F.when(even, F.col("c_custkey")))
    doc = F.to_json(F.struct(
        F.array(job).alias("jobs"),
        F.when(third == 0, F.array(_item(id=F.lit("r"), title="c_name", url=F.lit("https://r.example.com")))).alias("results"),
        F.when(third == 1, F.array(_item(id=F.lit("a"), title="c_name"))).alias("admitcard"),
        F.when(third == 2, F.array(_item(id=F.lit("k"), title="c_name", keytype=F.lit("")))).alias("answerkey")))
    manual = DOC.parse_manual(rows.select("c_custkey", doc.alias("body")))
    return manual.select("c_custkey", "category", "pos", "id", "title", "org", "cat", "state_label", "url", "vac", "last_date", "badge",
                         "exam_date", "key_type")


@query("scan_state_dim", """
SELECT c_custkey, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'state' ELSE 'ut' END AS type, '' AS portal_url, cast(0 AS bigint) AS dir_pos, alias
FROM customer, LATERAL (VALUES (lower(c_name)), (lower(c_mktsegment))) t(alias) WHERE c_custkey % 3 <> 2""")
def scan_state_dim(spark, sf):
    kind = F.element_at(F.array(F.lit("state"), F.lit("ut"), F.lit("central")), (F.col("c_custkey") % 3 + 1).cast("int"))
    entry = _item(name="c_name", type=kind, portal_url=F.lit(None).cast("string"), aliases=F.array("c_name", "c_mktsegment"))
    docs = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.array(entry).alias("states"))).alias("body"))
    return DOC.explode_aliases(DOC.parse_directory(docs))


def _feed_docs(spark, sf, render) -> DataFrame:
    rows = view(spark, sf, "v_market", heavy=True)
    return rows.select("seq", render(rows).alias("body"))


@query("scan_json_array_feed", f"""
WITH t AS (SELECT *, {Q.whole('salary_min')} AS lo, {Q.whole('salary_max')} AS hi FROM v_market)
SELECT seq, cast(1 AS bigint) AS pos, {Q.spaces('title')} AS title, original_url || CASE WHEN seq % 2 = 0 THEN '/apply' ELSE '' END AS url, {Q.spaces('company')} AS company,
  coalesce(nullif(job_location, ''), 'Remote') AS job_location, {Q.CURRENCY} AS salary, {Q.market_date('posted_raw')} AS posted_at,
  CASE WHEN seq % 4 = 0 THEN '' ELSE replace(skills_text, ',', '|') END AS skills FROM t""")
def scan_json_array_feed(spark, sf):
    def render(rows):
        even = F.col("seq") % 2 == 0
        job = _item(id="seq", position="title", company="company", location="job_location", salary_min="salary_min", salary_max="salary_max",
                    date="posted_raw", tags=F.when(F.col("seq") % 4 != 0, F.split("skills_text", ",")),
                    url=F.when(even, "").otherwise(F.concat("original_url", F.lit("#f"))), apply_url=F.concat("original_url", F.lit("/apply")))
        return F.concat(F.lit('[{"legal":"notice"},'), F.to_json(job), F.lit(',{"id":7,"position":""}]'))

    rows = DOC.parse_array_feed(_feed_docs(spark, sf, render))
    return rows.select("seq", "pos", "title", "url", "company", "job_location", "salary", "posted_at", F.array_join("skills", "|").alias("skills"))


@query("scan_json_jobs_feed", f"""
SELECT seq, cast(0 AS bigint) AS pos, {Q.spaces('title')} AS title, original_url AS url, {Q.spaces('company')} AS company, {Q.spaces('job_location')} AS job_location,
  {Q.spaces('salary_max')} AS salary, {Q.market_date('posted_raw')} AS posted_at, replace(skills_text, ',', '|') AS skills FROM v_market""")
def scan_json_jobs_feed(spark, sf):
    def render(rows):
        job = _item(url=F.concat("original_url", F.lit("#f")), title="title", company_name="company", candidate_required_location="job_location",
                    salary="salary_max", publication_date="posted_raw", tags=F.split("skills_text", ","))
        return F.to_json(F.struct(F.array(job, _item(
            url=F.lit(""), title=F.lit("no address"), company_name="company", candidate_required_location="job_location", salary="salary_max",
            publication_date="posted_raw", tags=F.split("skills_text", ","))).alias("jobs")))

    rows = DOC.parse_jobs_feed(_feed_docs(spark, sf, render))
    return rows.select("seq", "pos", "title", "url", "company", "job_location", "salary", "posted_at", F.array_join("skills", "|").alias("skills"))


@query("scan_rss_feed", f"""
SELECT seq, cast(0 AS bigint) AS pos, {Q.spaces('title')} AS title, original_url AS url, CASE WHEN seq % 2 = 0 THEN 'Acme' ELSE 'We Work Remotely' END AS company,
  CASE WHEN job_location = '' THEN 'Remote' ELSE job_location END AS job_location, {Q.market_date('posted_raw')} AS posted_at, 'Design|Remote' AS skills FROM v_market""")
def scan_rss_feed(spark, sf):
    def render(rows):
        title = F.concat(F.when(F.col("seq") % 2 == 0, "Acme: ").otherwise(""), "title")
        text = F.when(F.col("job_location") == "", "&lt;p&gt;Hello&lt;/p&gt;").otherwise(
            F.concat(F.lit("&lt;p&gt;Hi&lt;/p&gt;&lt;div&gt;&lt;b&gt;Headquarters:&lt;/b&gt; "), "job_location", F.lit("&lt;/div&gt;")))
        return F.concat(
            F.lit("<rss><channel><title>feed</title><item><title>"), title, F.lit("</title><link>"), "original_url", F.lit("</link><description>"),
            text, F.lit("</description><pubDate>"), "posted_raw", F.lit("</pubDate><category>Design</category><category>Remote</category></item>"
            "<item><title></title><link>x</link></item></channel></rss>"))

    rows = DOC.parse_rss_feed(_feed_docs(spark, sf, render))
    return rows.select("seq", "pos", "title", "url", "company", "job_location", "posted_at", F.array_join("skills", "|").alias("skills"))


@query("gate_status", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1""")
def gate_status(spark, sf):
    states = F.array(F.lit("success"), F.lit("running"), F.lit(""), F.lit(None).cast("string"))
    snapshots = table(spark, sf, "orders").select(
        "o_orderkey", F.element_at(states, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("status"))
    return P.gate_status(snapshots).select("o_orderkey")


_PAYLOADS = ["{\"results\":[{\"id\":\"%\"}],\"scraped_at\":\"x\"}", "{\"results\":null,\"status\":\"running\"}", "{\"latest_jobs\":\"%\"}", "[%]", "{\"other\":[%]}",
             "{broken %", "{\"status\":\"success\",\"admit_cards\":[],\"results\":{}}"]


@query("validate_snapshot", """
SELECT seq AS batch_id, seq % 7 IN (0, 1) AS ok, CASE seq % 7 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'invalid latest_jobs' WHEN 3 THEN 'not an object' WHEN 4 THEN 'no category'
  WHEN 5 THEN 'not json' ELSE 'invalid results' END AS reason, CASE seq % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'running' END AS status FROM v_listings""")
def validate_snapshot(spark, sf):
    texts = F.array(*[F.lit(p) for p in _PAYLOADS])
    rows = view(spark, sf, "v_listings", heavy=True).select(F.col("seq").alias("batch_id"), F.replace(
        F.element_at(texts, (F.col("seq") % 7 + 1).cast("int")), F.lit("%"), F.col("k").cast("string")).alias("body"))
    return V.validate_snapshots(rows).select("batch_id", "ok", "reason", "status")
