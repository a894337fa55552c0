"""Queries over listings: assembly, joins, counts, dedupe, admission, serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.states import scope_text
from jobmill.functions.urls import listing_id, url_normalize
from jobmill.operators import admission as A
from jobmill.operators import dedupe as D
from jobmill.operators import joins as J
from jobmill.operators import listings as L
from jobmill.operators import people as PE
from jobmill.operators import predicates as P
from jobmill.operators import search as S
from jobmill.operators import serving as SV
from jobmill.plans import sql as Q
from jobmill.plans.inputs import table, view
from jobmill.plans.registry import query
from jobmill.session import fresh_dir
from jobmill.sources import dims
from jobmill.functions.dates import format_market_date
from jobmill.functions.numbers import format_currency_range

_SCOPE = "lower(" + Q.spaces(Q.scrub("title") + " || ' ' || substring(body, 1, 2500)") + ")"
_LISTING_SQL = f"""
WITH t AS (SELECT *, {_SCOPE} AS t FROM v_listings),
f AS (SELECT *, {Q.states('t')} AS f, {Q.applicants('body')} AS h FROM t)
"""

# ------------------------------------------------------------------ assembling


@query("build_listing", _LISTING_SQL + f"""
SELECT seq, md5(category || ':' || original_url) AS id, {Q.scrub(Q.spaces('title'))} AS title, {Q.norm_url('original_url')} AS url_key,
  coalesce(CASE WHEN seq % 2 = 0 THEN 'See UPSC notification' END, {Q.last_date('body')}) AS last_date, {Q.vacancies('body')} AS vacancies,
  {Q.exam_date('body')} AS exam_date, {Q.title_label('title')} AS info_category, h.n AS applicant_count,
  {Q.applicant_label('h.basis')} AS applicant_metric_label, {Q.kept_states('t', 'f')} AS states, {Q.state_label('t', 'f')} AS state_label,
  {Q.portal('t', 'f')} AS official_state_portal FROM f""")
def build_listing(spark, sf):
    rows = view(spark, sf, "v_listings", heavy=True).withColumnRenamed("body", "body_text")
    explicit = {"last_date": F.when(F.col("seq") % 2 == 0, "See UPSC notification").otherwise("")}
    built = L.build_listing(rows, explicit)
    return built.select(
        "seq", "id", "title", "url_key", "last_date", "vacancies", "exam_date", "info_category", "applicant_count",
        "applicant_metric_label", F.array_join("states", " / ").alias("states"), "state_label", "official_state_portal")


def market_rows(spark, sf):
    rows = view(spark, sf, "v_market", heavy=True).withColumns({
        "salary": format_currency_range("salary_min", "salary_max"),
        "posted_at": format_market_date("posted_raw"),
        "skills": F.split("skills_text", ","),
    })
    return rows.withColumn("body_text", L.market_body(rows))


_MARKET_TEXT = """concat_ws(' ', CASE WHEN company <> '' THEN 'Company: ' || company END,
  CASE WHEN job_location <> '' THEN 'Location: ' || job_location END, CASE WHEN salary <> '' THEN 'Compensation: ' || salary END,
  CASE WHEN experience <> '' THEN 'Experience: ' || experience END,
  CASE WHEN posted_at <> '' THEN 'Posted / updated: ' || posted_at END, replace(skills_text, ',', ' '))"""
_MARKET_SQL = f"""
WITH m0 AS (SELECT *, {Q.whole('salary_min')} AS lo, {Q.whole('salary_max')} AS hi, {Q.market_date('posted_raw')} AS posted_at FROM v_market),
m1 AS (SELECT *, {Q.CURRENCY} AS salary FROM m0),
m2 AS (SELECT *, {_MARKET_TEXT} AS body FROM m1),
m3 AS (SELECT *, lower({Q.spaces(Q.scrub(Q.spaces('title')) + " || ' ' || substring(body, 1, 2500)")}) AS t FROM m2),
m AS (SELECT *, {Q.states('t')} AS f, CASE WHEN job_location <> '' THEN {Q.scrub('job_location')} WHEN category = 'remote_jobs' THEN 'Remote' ELSE '' END AS loc,
  array_to_string(list_filter(list_transform(string_split(skills_text, ','), lambda p: {Q.scrub('p')}), lambda p: p <> ''), '|') AS skills FROM m3)
"""


@query("build_market_listing", _MARKET_SQL + f"""
SELECT seq, category, md5(category || ':' || original_url) AS id, {Q.scrub(Q.spaces('title'))} AS title, {Q.scrub('company')} AS company,
  loc AS job_location, {Q.scrub('salary')} AS salary, {Q.scrub('experience')} AS experience, posted_at, skills, 'Apply ASAP' AS last_date,
  'See listing' AS vacancies, CASE WHEN posted_at = '' THEN 'Recently posted' ELSE posted_at END AS exam_date,
  CASE category WHEN 'remote_jobs' THEN 'Remote Job' ELSE 'Private Job' END AS info_category,
  CASE WHEN loc <> '' THEN loc ELSE {Q.state_label('t', 'f')} END AS state_label,
  CASE WHEN loc <> '' THEN '' ELSE {Q.kept_states('t', 'f')} END AS states,
  CASE WHEN loc <> '' THEN '' ELSE {Q.portal('t', 'f')} END AS official_state_portal FROM m""")
def build_market_listing(spark, sf):
    return L.build_market_listing(market_rows(spark, sf)).select(
        "seq", "category", "id", "title", "company", "job_location", "salary", "experience", "posted_at",
        F.array_join("skills", "|").alias("skills"), "last_date", "vacancies", "exam_date", "info_category", "state_label",
        F.array_join("states", " / ").alias("states"), "official_state_portal")


def _served(spark, sf, heavy=False):
    """Stored market rows as a serving page reads them, some fields missing."""
    rows = view(spark, sf, "v_market", heavy)
    return rows.select(
        "seq", "category", listing_id("category", "original_url").alias("id"), "title", "company", "job_location",
        F.when(F.col("seq") % 5 == 0, "Bihar").otherwise("").alias("state_label"), F.col("salary_max").alias("salary"),
        "experience", F.split("skills_text", ",").alias("skills"),
        F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"),
        F.col("posted_raw").alias("posted_at"), "original_url")


_SERVED = """WITH s AS (SELECT seq, category, md5(category || ':' || original_url) AS id, title, company, job_location,
  CASE WHEN seq % 5 = 0 THEN 'Bihar' ELSE '' END AS state_label, salary_max AS salary, experience, string_split(skills_text, ',') AS skills,
  CASE WHEN seq % 3 = 0 THEN NULL ELSE source END AS source, posted_raw AS posted_at, original_url FROM v_market)
"""


@query("card_view", _SERVED + f"""
SELECT seq, category, id, title, coalesce(nullif(job_location, ''), nullif(state_label, ''),
    CASE category WHEN 'remote_jobs' THEN 'Remote' ELSE 'Location not specified' END) AS location,
  coalesce(nullif(company, ''), source, '{K.DEFAULT_HOUSE}') AS company,
  coalesce(nullif(salary, ''), nullif(experience, ''), nullif(state_label, ''), 'See listing') AS highlight,
  array_to_string(skills[1:3], '|') AS top_skills, coalesce(nullif(posted_at, ''), 'Recently updated') AS posted, original_url AS open_url FROM s""")
def card_view(spark, sf):
    cards = L.card_view(_served(spark, sf))
    return cards.withColumn("top_skills", F.array_join("top_skills", "|"))


@query("search_listings", _SERVED + f"""
SELECT seq, id, title FROM s WHERE contains(lower(title || ' ' || company || ' ' || job_location || ' ' || state_label || ' ' || salary
  || ' ' || experience || ' ' || array_to_string(skills, ' ') || ' ' || coalesce(source, '{K.DEFAULT_HOUSE}')), 'engineer')
  AND coalesce(source, '{K.DEFAULT_HOUSE}') = 'Remotive'""")
def search_listings(spark, sf):
    return P.search_listings(_served(spark, sf), " Engineer ", "Remotive").select("seq", "id", "title")


_SEARCHES = (("engineer", "Remotive"), (" Remote ", "all"), ("a", "Remote OK"), ("no such text", "all"))


@query("search_postings", _SERVED + ", x AS (SELECT *, " + f"""lower(title || ' ' || company || ' ' || job_location || ' ' || state_label || ' ' || salary
  || ' ' || experience || ' ' || array_to_string(skills, ' ') || ' ' || coalesce(source, '{K.DEFAULT_HOUSE}')) AS t, coalesce(source, '{K.DEFAULT_HOUSE}') AS shown FROM s)
""" + " UNION ALL ".join(f"SELECT '{q}' AS query, seq, id, title FROM x WHERE contains(t, '{q.strip().lower()}')" + ("" if f == "all" else f" AND shown = '{f}'") for q, f in _SEARCHES))
def search_postings(spark, sf):
    """The same search by trigram postings that are written beside the listings."""
    listings, path = _served(spark, sf), fresh_dir(spark, "postings")
    S.write_postings(_served(spark, sf, heavy=True), "seq", path)  # all cores make them; the searches need no dealing out
    found = [S.search_postings(spark, path, listings, "seq", q, f).select(F.lit(q).alias("query"), "seq", "id", "title") for q, f in _SEARCHES]
    return reduce(lambda a, b: a.unionByName(b), found)


def _stored(spark, sf):
    """Stored government rows with label and applicant columns, some missing."""
    rows = view(spark, sf, "v_listings")
    return rows.select(
        "seq", "category", "original_url", listing_id("category", "original_url").alias("id"), "title", "source", "source_group",
        F.when(F.col("seq") % 4 == 0, "").when(F.col("k") % 3 == 0, "Bihar / Goa").when(F.col("k") % 3 == 1, "Uttar+Pradesh ")
        .otherwise("All India").alias("state_label"),
        F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise("2,50,000").alias("applicant_count_display"),
        F.when(F.col("seq") % 3 == 0, "").otherwise("Applied").alias("applicant_metric_label"),
        F.lit(None).cast("string").alias("applicant_metric_note"))


_STORED = """WITH s AS (SELECT seq, category, original_url, md5(category || ':' || original_url) AS id, title, source, source_group,
  CASE WHEN seq % 4 = 0 THEN '' WHEN k % 3 = 0 THEN 'Bihar / Goa' WHEN k % 3 = 1 THEN 'Uttar+Pradesh ' ELSE 'All India' END AS state_label,
  CASE WHEN seq % 3 = 0 THEN NULL ELSE '2,50,000' END AS applicant_count_display,
  CASE WHEN seq % 3 = 0 THEN '' ELSE 'Applied' END AS applicant_metric_label FROM v_listings)
"""
_LINK = "'post.html?id=' || id || '&cat=' || category"


@query("rich_view", _STORED + f"""
SELECT seq, s.category, id, title AS t, 'Live Update (' || coalesce(nullif(source, ''), 'Scraped') || ')' AS org, 'Live' AS cat,
  coalesce(nullif(state_label, ''), 'All India') AS st, 'post.html?id=' || id || '&cat=' || s.category AS url,
  coalesce(applicant_count_display, '') AS app_disp, applicant_metric_label AS app_label, '' AS app_note, r.badge, r.type, r.status, r.date
FROM s JOIN {Q.values([(c, *v) for c, v in K.RICH_CONSTANTS.items()], 'category, badge, type, status, date')} r ON s.category = r.category""")
def rich_view(spark, sf):
    return L.rich_view(_stored(spark, sf), dims.rich_dim(spark))


@query("post_view", _STORED + f"""
SELECT seq, category, id, title, coalesce(nullif(source, ''), '{K.DEFAULT_HOUSE}') AS source,
  coalesce(nullif(state_label, ''), 'All India') AS coverage, coalesce(applicant_count_display, 'Not disclosed yet') AS applicants,
  coalesce(nullif(applicant_metric_label, ''), 'Not officially disclosed') || '. {K.POST_DEFAULTS['note']}' AS applicants_note FROM s""")
def post_view(spark, sf):
    return L.post_view(_stored(spark, sf))


@query("post_link", _STORED + f"""
SELECT seq, {_LINK} AS link, 'latestjobs.html?state=' || replace(replace(replace(state_label, '+', '%2B'), '/', '%2F'), ' ', '+') AS state_link FROM s""")
def post_link(spark, sf):
    return _stored(spark, sf).select("seq", L.post_link("id", "category").alias("link"),
                                     L.state_link("state_label").alias("state_link"))


# ------------------------------------------------------------------ states


_TEXT_SQL = f"WITH t AS (SELECT seq, {_SCOPE} AS t FROM v_listings)\n"


def _scoped(spark, sf):
    return view(spark, sf, "v_listings", heavy=True).select("seq", scope_text(F.col("title"), F.col("body")).alias("t"))


_HITS = ", ".join(
    f"CASE WHEN {Q.alias_hit('t', [alias])} THEN {{'name': '{name}', 'alias': '{alias}', 'dir_pos': cast({i} AS bigint)}} END"
    for i, (name, kind, _, aliases) in enumerate(K.STATE_DIRECTORY) if kind != "central" for alias in aliases)


@query("join_state_alias", _TEXT_SQL + f"""
, h AS (SELECT seq, unnest(list_filter([{_HITS}], lambda h: h IS NOT NULL)) AS h FROM t)
SELECT seq, h.name AS name, h.alias AS alias, h.dir_pos AS dir_pos FROM h""")
def join_state_alias(spark, sf):
    return J.alias_matches(_scoped(spark, sf), dims.alias_dim(spark), "t").select("seq", "name", "alias", "dir_pos")


@query("collect_states", _TEXT_SQL + f"""
, f AS (SELECT seq, {Q.states('t')} AS f FROM t) SELECT seq, array_to_string(f, ' / ') AS states FROM f WHERE len(f) > 0""")
def collect_states(spark, sf):
    matches = J.alias_matches(_scoped(spark, sf), dims.alias_dim(spark), "t")
    return J.collect_states(matches, "seq").select("seq", F.array_join("states", " / ").alias("states"))


@query("join_portal", _LISTING_SQL + f"""
, j AS (SELECT seq, {Q.state_label('t', 'f')} AS state_label, f, {Q.kept_states('t', 'f')} AS k FROM f)
SELECT seq, state_label, coalesce(d.portal_url, '') AS portal FROM j LEFT JOIN {Q.DIRECTORY} d
  ON d.name = CASE WHEN k <> '' AND len(f) = 1 THEN f[1] WHEN k = '' AND state_label IN ('All India', 'Central Govt') THEN state_label END""")
def join_portal(spark, sf):
    tagged = L.with_states(view(spark, sf, "v_listings", heavy=True), body="body")
    return J.join_portal(tagged, dims.state_dim(spark)).select("seq", "state_label", "portal")


@query("count_jobs_by_state", _STORED + f"""
SELECT d.name, d.type, cast(d.dir_pos AS bigint) AS dir_pos, count(s.seq) AS jobs FROM {Q.DIRECTORY} d LEFT JOIN s
  ON s.category = 'latest_jobs' AND s.state_label <> '' AND contains(lower(trim(replace(s.state_label, '+', ' '))), lower(d.name))
WHERE d.type <> 'central' GROUP BY ALL""")
def count_jobs_by_state(spark, sf):
    return J.count_jobs_by_state(_stored(spark, sf), dims.state_dim(spark))


_SEARCH = ("CASE k % 7 WHEN 0 THEN 'bihar' WHEN 1 THEN ' Uttar+' WHEN 2 THEN 'DELHI' WHEN 3 THEN 'goa ' WHEN 4 THEN 'India' "
           "WHEN 5 THEN 'pradesh' ELSE 'zz' END")


@query("search_states", f"""
WITH s AS (SELECT seq, {_SEARCH} AS query FROM v_listings)
SELECT s.seq, s.query, d.name, d.type FROM s JOIN {Q.DIRECTORY} d ON d.type <> 'central'
  AND contains(lower(d.name), lower(trim(replace(s.query, '+', ' '))))""")
def search_states(spark, sf):
    searches = view(spark, sf, "v_listings").select("seq", F.expr(_SEARCH).alias("query"))
    return P.search_states(searches, dims.state_dim(spark)).select("seq", "query", "name", "type")


# ------------------------------------------------------------------ other joins


_LOOKUP_SQL = _STORED + """
, r AS (SELECT seq AS request_id, CASE WHEN seq % 5 = 4 THEN 'missing' ELSE md5(CASE seq % 2 WHEN 0 THEN 'results' ELSE category END || ':' || original_url) END AS id,
  CASE seq % 3 WHEN 0 THEN 'admit_cards' WHEN 1 THEN category END AS requested FROM v_listings),
c AS (SELECT id, category, title, seq FROM s),
h AS (SELECT r.request_id, r.id, c.category, c.title, c.seq, row_number() OVER (PARTITION BY r.request_id ORDER BY
  coalesce(c.category <> r.requested, true), list_position(['results', 'admit_cards', 'latest_jobs', 'answer_keys', 'private_jobs', 'remote_jobs'], c.category), c.seq) AS rn
  FROM r JOIN c ON r.id = c.id)
SELECT request_id, id, category, title, seq FROM h WHERE rn = 1"""


@query("lookup_post", _LOOKUP_SQL)
def lookup_post(spark, sf):
    rows = view(spark, sf, "v_listings")
    seq = F.col("seq")
    asked = F.when(seq % 2 == 0, "results").otherwise(F.col("category"))
    requests = rows.select(
        seq.alias("request_id"),
        F.when(seq % 5 == 4, "missing").otherwise(listing_id(asked, "original_url")).alias("id"),
        F.when(seq % 3 == 0, "admit_cards").when(seq % 3 == 1, F.col("category")).alias("requested"))
    stored = _stored(spark, sf).select("id", "category", "title", "seq")
    return J.lookup_posts(requests, stored)


@query("anti_seen_urls", f"""
SELECT seq, {Q.norm_url('original_url')} AS url_key FROM v_listings WHERE {Q.norm_url('original_url')} NOT IN
  (SELECT {Q.norm_url("'https://jobs' || (c_custkey % 7) || '.example.com/p/' || c_custkey || '#x'")} FROM customer WHERE c_mktsegment = 'BUILDING')""")
def anti_seen_urls(spark, sf):
    seen = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(url_normalize(F.concat(
        F.lit("https://jobs"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example.com/p/"), F.col("c_custkey").cast("string"),
        F.lit("#x"))).alias("url_key"))
    links = A.with_url_key(view(spark, sf, "v_listings")).select("seq", "url_key")
    return D.anti_seen(links, seen).select("seq", "url_key")


@query("join_category_labels", f"""
SELECT s.seq, coalesce(c.category_label, '{K.CATEGORY_LABEL_DEFAULT.format(house=K.DEFAULT_HOUSE)}') AS category_label,
  coalesce(c.sections, '{'|'.join(K.CATEGORY_SECTIONS['latest_jobs'])}') AS sections
FROM (SELECT seq, CASE WHEN seq % 8 = 0 THEN 'other' ELSE category END AS category FROM v_listings) s LEFT JOIN
{Q.values([(c, K.CATEGORY_LABELS[c].format(house=K.DEFAULT_HOUSE), '|'.join(K.CATEGORY_SECTIONS[c])) for c in K.CATEGORIES], 'category, category_label, sections')} c
  ON s.category = c.category""")
def join_category_labels(spark, sf):
    rows = view(spark, sf, "v_listings").select(
        "seq", F.when(F.col("seq") % 8 == 0, "other").otherwise(F.col("category")).alias("category"))
    joined = J.join_category_labels(rows, dims.category_dim(spark))
    return joined.select("seq", "category_label", F.array_join("sections", "|").alias("sections"))


# ------------------------------------------------------------------ counts


@query("count_by_category", f"""
SELECT c.category, count(l.seq) AS n FROM {Q.CATEGORY_TABLE} c LEFT JOIN v_listings l
  ON c.category = l.category GROUP BY c.category""")
def count_by_category(spark, sf):
    return SV.count_by_category(view(spark, sf, "v_listings"), dims.category_dim(spark))


@query("counts_map", """
SELECT category, count(*) AS n FROM v_listings GROUP BY category""")
def counts_map(spark, sf):
    counted = SV.counts_map(SV.count_by_category(view(spark, sf, "v_listings"), dims.category_dim(spark)))
    return counted.select(F.explode("counts").alias("category", "n"))


@query("live_counts", """
SELECT category, count(*) AS n FROM (SELECT category FROM v_listings UNION ALL SELECT 'latest_jobs' FROM customer) t
WHERE category IN ('latest_jobs', 'private_jobs', 'remote_jobs') GROUP BY category""")
def live_counts(spark, sf):
    manual = table(spark, sf, "customer").select(F.lit("latest_jobs").alias("category"))
    return SV.live_counts(view(spark, sf, "v_listings"), manual)


@query("distinct_sources", f"""
SELECT coalesce(nullif(source, ''), '{K.DEFAULT_HOUSE}') AS source, min(seq) AS first_seq FROM v_listings GROUP BY 1""")
def distinct_sources(spark, sf):
    return SV.distinct_sources(view(spark, sf, "v_listings"))


# ------------------------------------------------------------------ dedupe, caps, unions


_KEYED = f"""WITH l AS (SELECT *, {Q.norm_url('original_url')} AS url_key FROM v_listings)
"""


@query("dedupe_category", _KEYED + """
SELECT seq, category, url_key FROM (SELECT *, row_number() OVER (PARTITION BY category, url_key ORDER BY seq) AS rn FROM l) t WHERE rn = 1""")
def dedupe_category(spark, sf):
    rows = view(spark, sf, "v_listings").withColumn("id", listing_id("category", "original_url"))
    rows = rows.select("seq", "category", "original_url", "id")
    return D.dedupe_category(rows).select("seq", "category", url_normalize("original_url").alias("url_key"))


_CAP = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in K.CATEGORY_CAPS.items()) + " END"


@query("dedupe_then_cap", _KEYED + f"""
, u AS (SELECT *, row_number() OVER (PARTITION BY source_group, url_key ORDER BY seq) AS rn FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY source_group, category ORDER BY seq) AS pos FROM u WHERE rn = 1)
SELECT seq, source_group, category, url_key FROM r WHERE pos <= {_CAP}""")
def dedupe_then_cap(spark, sf):
    rows = view(spark, sf, "v_listings").select("seq", "source_group", "category", "original_url")
    return D.dedupe_then_cap(rows).select("seq", "source_group", "category", url_normalize("original_url").alias("url_key"))


# The fold as a recursion: one step per arrival, carrying the admitted addresses and the counts.
ADMIT_SQL = _KEYED.replace("WITH ", "WITH RECURSIVE ") + f"""
, f AS (SELECT source_group, category, url_key, min(seq) AS seq FROM l GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source_group ORDER BY seq) AS rn, {_CAP} AS cap FROM f),
steps(source_group, rn, taken, seqs, cats) AS (
  SELECT source_group, cast(0 AS bigint), cast([] AS varchar[]), cast([] AS bigint[]), cast([] AS varchar[]) FROM n WHERE rn = 1
  UNION ALL
  SELECT s.source_group, n.rn,
    CASE WHEN ok THEN list_append(s.taken, n.url_key) ELSE s.taken END, CASE WHEN ok THEN list_append(s.seqs, n.seq) ELSE s.seqs END,
    CASE WHEN ok THEN list_append(s.cats, n.category) ELSE s.cats END
  FROM steps s JOIN n ON n.source_group = s.source_group AND n.rn = s.rn + 1,
  LATERAL (SELECT NOT list_contains(s.taken, n.url_key) AND len(list_filter(s.cats, lambda c: c = n.category)) < n.cap AS ok) o),
final AS (SELECT source_group, unnest(seqs) AS seq FROM (SELECT source_group, seqs, row_number() OVER (PARTITION BY source_group ORDER BY rn DESC) AS last FROM steps) z WHERE last = 1)
"""


def _arrivals(spark, sf):
    return A.with_url_key(view(spark, sf, "v_listings")).select("source_group", "category", "url_key", "seq")


@query("admit_capped", ADMIT_SQL + "SELECT l.source_group, l.category, l.url_key, l.seq FROM l JOIN final ON l.seq = final.seq")
def admit_capped(spark, sf):
    return A.admit_capped(_arrivals(spark, sf))


@query("admission_stats", ADMIT_SQL + """
SELECT l.source_group, l.category, CASE WHEN a.seq = l.seq THEN 'admitted' WHEN a.seq < l.seq THEN 'seen' ELSE 'full' END AS reason, count(*) AS n
FROM l LEFT JOIN (SELECT final.source_group, final.seq, x.url_key FROM final JOIN l x ON x.seq = final.seq) a
  ON a.source_group = l.source_group AND a.url_key = l.url_key GROUP BY ALL""")
def admission_stats(spark, sf):
    return A.admission_stats(_arrivals(spark, sf))


# The same recursion with the state of the current page: its rows admitted so far and its limit.  A homepage block of a category that is full
# is skipped, except that SR still tries its first link (limit -1).
def pages_sql(rows: str) -> str:
    """The fold over ``rows`` (source_group, category, url_key, phase, page_seq, page_limit, seq), up to ``final`` (seq)."""
    return f"""
p AS (SELECT source_group, category, url_key, phase, page_seq, page_limit, min(seq) AS seq FROM {rows} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source_group ORDER BY phase, page_seq, seq) AS rn, {_CAP} AS cap,
  row_number() OVER (PARTITION BY source_group, phase, page_seq, category ORDER BY seq) = 1 AS is_head FROM p),
steps(source_group, rn, taken, seqs, cats, page, added, lim) AS (
  SELECT source_group, cast(0 AS bigint), cast([] AS varchar[]), cast([] AS bigint[]), cast([] AS varchar[]), '', cast(0 AS bigint), cast(0 AS bigint)
  FROM n WHERE rn = 1
  UNION ALL
  SELECT s.source_group, n.rn, CASE WHEN ok THEN list_append(s.taken, n.url_key) ELSE s.taken END,
    CASE WHEN ok THEN list_append(s.seqs, n.seq) ELSE s.seqs END, CASE WHEN ok THEN list_append(s.cats, n.category) ELSE s.cats END,
    here, done + CASE WHEN ok THEN 1 ELSE 0 END, room
  FROM steps s JOIN n ON n.source_group = s.source_group AND n.rn = s.rn + 1,
  LATERAL (SELECT n.phase || '/' || n.page_seq || '/' || n.category AS here, len(list_filter(s.cats, lambda c: c = n.category)) AS have) h,
  LATERAL (SELECT CASE WHEN here = s.page THEN s.added ELSE 0 END AS done, CASE WHEN here = s.page THEN s.lim WHEN n.phase = 1 THEN least(n.page_limit, n.cap - have)
    WHEN have < least({K.HOME_LIMIT}, n.cap) THEN least({K.HOME_LIMIT}, n.cap) - have WHEN n.source_group = 'SR' AND have < n.cap THEN -1 ELSE 0 END AS room) r,
  LATERAL (SELECT (done < room OR room = -1 AND n.is_head) AND NOT list_contains(s.taken, n.url_key) AS ok) o),
final AS (SELECT unnest(seqs) AS seq FROM (SELECT seqs, row_number() OVER (PARTITION BY source_group ORDER BY rn DESC) AS last FROM steps) z WHERE last = 1)"""


_ARRIVED = f"WITH RECURSIVE l AS (SELECT *, {Q.norm_url('original_url')} AS url_key FROM v_arrivals)"


@query("cap_per_page", f"{_ARRIVED},{pages_sql('l')}\nSELECT l.source_group, l.category, l.url_key, l.seq FROM l JOIN final ON l.seq = final.seq")
def cap_per_page(spark, sf):
    """Homepage blocks, listing pages, state pages, official sources and markets, each with its own limit."""
    rows = A.with_url_key(view(spark, sf, "v_arrivals"))
    return A.admit_pages(rows, page_limit=max(K.CATEGORY_CAPS.values()), min_page_limit=K.STATE_PAGE_LIMIT)


@query("cap_official_source", """
WITH o AS (SELECT seq, title, CASE k % 4 WHEN 0 THEN 'upsc_active' WHEN 1 THEN 'upsc_recruitment' WHEN 2 THEN 'ibps_recruitment' ELSE 'rac_recruitment' END AS source
  FROM v_listings WHERE source_group = 'OFFICIAL'),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM o)
SELECT seq, title, source FROM r WHERE rn <= CASE source WHEN 'upsc_recruitment' THEN 6 WHEN 'rac_recruitment' THEN 4 ELSE 12 END""")
def cap_official_source(spark, sf):
    names = F.array(*[F.lit(s) for s in K.OFFICIAL_SOURCE_CAPS])
    rows = view(spark, sf, "v_listings").where("source_group = 'OFFICIAL'").select(
        "seq", "title", F.element_at(names, (F.col("k") % 4 + 1).cast("int")).alias("source"))
    return D.cap_by(rows, K.OFFICIAL_SOURCE_CAPS, "source")


@query("home_block_slice", """
SELECT seq, source_group, category, posted_on FROM (SELECT *, row_number() OVER (PARTITION BY source_group, category, posted_on ORDER BY seq) AS rn
  FROM v_listings) t WHERE rn <= 10""")
def home_block_slice(spark, sf):
    rows = view(spark, sf, "v_listings").select("seq", "source_group", "category", "posted_on")
    return D.first_n(rows, ["source_group", "category", "posted_on"], "seq", K.HOME_LIMIT)


def _manual(spark, sf):
    keys = F.array(F.lit("latest_jobs"), F.lit("results"), F.lit("admit_cards"))
    return table(spark, sf, "customer").select(
        F.element_at(keys, (F.col("c_custkey") % 3 + 1).cast("int")).alias("category"), F.col("c_custkey").alias("seq"),
        F.col("c_name").alias("title"))


_MANUAL = """m AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'latest_jobs' WHEN 1 THEN 'results' ELSE 'admit_cards' END AS category, c_custkey AS seq,
  c_name AS title FROM customer)"""


@query("home_top10", f"""
WITH {_MANUAL},
t AS (SELECT * FROM {Q.values([(t, c, 1 if k else 0) for t, (c, k) in K.HOME_TILES.items()], 'tile, category, entered')}),
b AS (SELECT tile, 0 AS precedence, seq, title FROM m JOIN t USING (category) WHERE entered = 1
  UNION ALL SELECT tile, 1, seq, title FROM v_listings JOIN t USING (category)),
r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY precedence, seq) AS rank FROM b)
SELECT tile, rank, title, precedence, seq, rank <= 3 AS is_new FROM r WHERE rank <= 10""")
def home_top10(spark, sf):
    return SV.home_top10(view(spark, sf, "v_listings"), _manual(spark, sf))


_RANKED = "SELECT CASE source_group " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(
    K.SOURCE_GROUPS)) + " END AS source_rank, seq, category, title, NULL AS company, 0 AS part FROM v_listings"


@query("union_sources", _RANKED + " UNION ALL SELECT NULL, seq, category, title, company, 1 FROM v_market")
def union_sources(spark, sf):
    """All groups of one table in their order, then the rows of another table with more columns."""
    crawled = D.in_source_order(view(spark, sf, "v_listings")).select("source_rank", "seq", "category", "title")
    market = view(spark, sf, "v_market").select("seq", "category", "title", "company")
    return D.union_in_order([crawled, market])


@query("merge_manual_home", f"""
WITH {_MANUAL} SELECT category, seq, title, 0 AS precedence FROM m UNION ALL SELECT category, seq, title, 1 FROM v_listings""")
def merge_manual_home(spark, sf):
    scraped = view(spark, sf, "v_listings").select("category", "seq", "title")
    return D.merge_by_precedence([_manual(spark, sf), scraped])


@query("merge_manual_pages", f"""
WITH {_MANUAL} SELECT category, seq, title, 0 AS precedence FROM v_listings UNION ALL SELECT category, seq, title, 1 FROM m
UNION ALL SELECT 'latest_jobs', p_partkey, p_name, 2 FROM part""")
def merge_manual_pages(spark, sf):
    scraped = view(spark, sf, "v_listings").select("category", "seq", "title")
    static = table(spark, sf, "part").select(
        F.lit("latest_jobs").alias("category"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"))
    return D.merge_by_precedence([scraped, _manual(spark, sf), static])


# ------------------------------------------------------------------ people and lockers


_RULES = Q.values(list(K.EXAM_RULES), "exam, min_age, max_gen, max_obc, max_scst, max_pwd")


def _eligible(day: str) -> str:
    return f"""
SELECT person_id, category, exam, years, months, cast(min_age AS double) AS min_age, cast(lim AS double) AS max_age FROM (
  SELECT a.*, r.*, CASE category WHEN 'obc' THEN max_obc WHEN 'sc' THEN max_scst WHEN 'pwd' THEN max_pwd ELSE max_gen END AS lim
  FROM (SELECT person_id, category, y - CASE WHEN m < 0 THEN 1 ELSE 0 END AS years, CASE WHEN m < 0 THEN m + 12 ELSE m END AS months, d AS days
    FROM (SELECT *, year(date '{day}') - year(dob) AS y,
        month(date '{day}') - month(dob) - CASE WHEN day(date '{day}') < day(dob) THEN 1 ELSE 0 END AS m,
        day(date '{day}') - day(dob) + CASE WHEN day(date '{day}') < day(dob)
          THEN day(date_trunc('month', date '{day}') - interval 1 day) ELSE 0 END AS d FROM v_persons WHERE dob < date '{day}') x) a, {_RULES} r) e
WHERE cast(years AS double) + months / 12.0::double + days / 365.0::double BETWEEN min_age AND lim"""


@query("join_exam_eligibility", _eligible("2026-03-01"))
def join_exam_eligibility(spark, sf):
    return PE.exam_eligibility(view(spark, sf, "v_persons"), dims.exam_rules(spark), "2026-03-01")


_DOCS = """WITH docs AS (SELECT *, lower(regexp_extract(name, '([^.]*)$', 1)) AS ext,
  CASE WHEN lower(regexp_extract(name, '([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png') THEN 'photo' ELSE 'other' END AS category FROM v_uploads)
"""


def _docs(spark, sf):
    from jobmill.functions.numbers import file_category, file_extension

    return view(spark, sf, "v_uploads").withColumns({"ext": file_extension("name"), "category": file_category("name")})


@query("filter_locker_quota", _DOCS + """
SELECT owner, id, name, size, ext, category, uploaded_at FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY uploaded_at, id) AS rn
  FROM docs WHERE size <= 5242880) t WHERE rn <= 20""")
def filter_locker_quota(spark, sf):
    return PE.accept_uploads(view(spark, sf, "v_uploads"))


@query("filter_locker_category", _DOCS + "SELECT owner, id, name FROM docs WHERE category = 'photo'")
def filter_locker_category(spark, sf):
    return PE.of_category(_docs(spark, sf), "photo").select("owner", "id", "name")


@query("join_locker_category", """
SELECT id, CASE id % 6 WHEN 0 THEN 'Certificate' WHEN 1 THEN 'Marksheet' WHEN 2 THEN 'ID Proof' WHEN 3 THEN 'Photo' ELSE 'Other' END AS category_label
FROM v_uploads""")
def join_locker_category(spark, sf):
    names = F.array(*[F.lit(c) for c in [*K.LOCKER_LABELS, "unknown"]])
    docs = view(spark, sf, "v_uploads").select(
        "id", F.element_at(names, (F.col("id") % 6 + 1).cast("int")).alias("category"))
    return PE.with_category_label(docs, dims.locker_dim(spark)).select("id", "category_label")


@query("join_checklist", f"""
SELECT o.owner, i.item, cast(i.item_pos AS bigint) AS item_pos, coalesce(bool_or(contains(lower(u.name), i.word)), false) AS done
FROM (SELECT DISTINCT owner FROM v_uploads) o, {Q.values([(item, item.lower().split(' ')[0], i) for i, item in enumerate(K.LOCKER_CHECKLIST)], 'item, word, item_pos')} i
LEFT JOIN v_uploads u ON u.owner = o.owner GROUP BY ALL""")
def join_checklist(spark, sf):
    uploads = view(spark, sf, "v_uploads")
    return PE.checklist(uploads, uploads)


@query("locker_summary", _DOCS + """
SELECT owner, category, count(*) AS documents, cast(sum(size) AS bigint) AS bytes FROM docs GROUP BY ALL""")
def locker_summary(spark, sf):
    return PE.locker_summary(_docs(spark, sf))


@query("delete_docs", "SELECT owner, id, name FROM v_uploads WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_docs(spark, sf):
    doomed = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return D.delete_keys(view(spark, sf, "v_uploads").select("owner", "id", "name"), doomed, "id").select("owner", "id", "name")


@query("delete_user", """
SELECT owner, id, name FROM v_uploads WHERE owner NOT IN (SELECT 'u' || (doc_id % 40) FROM labels WHERE quality = 0 AND toxic = 1)""")
def delete_user(spark, sf):
    doomed = table(spark, sf, "labels").where("quality = 0 and toxic = 1").select(
        F.concat(F.lit("u"), (F.col("doc_id") % 40).cast("string")).alias("owner"))
    return D.delete_keys(view(spark, sf, "v_uploads").select("owner", "id", "name"), doomed, "owner").select("owner", "id", "name")


@query("upsert_docs", _DOCS + """
SELECT d.id, coalesce(CASE WHEN l.quality = 1 THEN 'certificate' ELSE 'marksheet' END, d.category) AS category,
  CASE WHEN l.doc_id IS NULL THEN d.uploaded_at ELSE d.uploaded_at + 1 END AS version
FROM docs d LEFT JOIN labels l ON l.doc_id = d.id WHERE l.doc_id IS NOT NULL
UNION ALL SELECT d.id, d.category, d.uploaded_at FROM docs d WHERE d.id NOT IN (SELECT doc_id FROM labels)""")
def upsert_docs(spark, sf):
    current = _docs(spark, sf).select("id", "category", F.col("uploaded_at").alias("version"))
    changes = table(spark, sf, "labels").join(current.withColumnRenamed("id", "doc_id"), "doc_id").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "certificate").otherwise("marksheet").alias("category"),
        (F.col("version") + 1).alias("version"))
    return D.upsert(current, changes, "id", "version")
