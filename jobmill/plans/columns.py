"""Queries over column expressions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions import dates as D
from jobmill.functions import extract as X
from jobmill.functions import numbers as N
from jobmill.functions import text as T
from jobmill.functions import urls as U
from jobmill.operators import predicates as P
from jobmill.plans import sql as Q
from jobmill.plans.inputs import table, view
from jobmill.plans.registry import query

# ------------------------------------------------------------------ addresses


@query("url_normalize", f"""
SELECT seq, {Q.norm_url("'  ' || original_url || ' '")} AS url_key FROM v_listings""")
def url_normalize(spark, sf):
    padded = F.concat(F.lit("  "), "original_url", F.lit(" "))
    return view(spark, sf, "v_listings").select("seq", U.url_normalize(padded).alias("url_key"))


@query("url_absolute", r"""
WITH b AS (SELECT page_id, split_part(url, '#', 1) AS url,
  regexp_extract(url, '^[a-z]+://[^/?#]*') AS root,
  regexp_replace(regexp_extract(url, '^[a-z]+://[^?#]*'), '[^/]*$', '') AS folder FROM pages)
SELECT page_id, root || '/jobs/a' AS rooted, folder || 'x.html?q=1' AS relative,
  regexp_extract(url, '^[^?]*') || '?p=2' AS query_only, regexp_extract(url, '^[a-z]+:') || '//cdn.example.com/z' AS other_host,
  root || '/b' AS dotted, url AS same_page, 'https://x.example.com/y' AS full_address FROM b""")
def url_absolute(spark, sf):
    # Page addresses have the form /<language>/<number>, so '../../b' climbs to the root.
    def at(href):
        return U.url_absolute(F.lit(href), "url")

    return table(spark, sf, "pages").select(
        "page_id", at("/jobs/./a#s").alias("rooted"), at("x.html?q=1").alias("relative"), at("?p=2").alias("query_only"),
        at("//cdn.example.com/z").alias("other_host"), at("../../../b").alias("dotted"), at("#here").alias("same_page"),
        at("https://x.example.com/y#z").alias("full_address"))


@query("url_parts", f"""
SELECT page_id, {Q.scheme('url')} AS scheme, {Q.host('url')} AS host, {Q.path('url')} AS path FROM pages""")
def url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.url_parts("url").alias("p")).select("page_id", "p.*")


@query("listing_id", "SELECT seq, md5(category || ':' || original_url) AS id FROM v_listings")
def listing_id(spark, sf):
    return view(spark, sf, "v_listings").select("seq", U.listing_id("category", "original_url").alias("id"))


# ------------------------------------------------------------------ text


@query("normalize_spaces", f"SELECT doc_id, {Q.spaces('text')} AS text FROM documents")
def normalize_spaces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_spaces("text").alias("text"))


@query("brand_scrub", f"""
SELECT seq, {Q.scrub("title || ' get application Free Job Alert ' || body")} AS clean FROM v_listings""")
def brand_scrub(spark, sf):
    text = F.concat("title", F.lit(" get application Free Job Alert "), "body")
    return view(spark, sf, "v_listings", heavy=True).select("seq", T.brand_scrub(text).alias("clean"))


@query("escape_html", """
SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
  chr(39), '&#39;') AS safe FROM documents""")
def escape_html(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.escape_html("text").alias("safe"))


@query("type_label", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'UT' WHEN 1 THEN 'Central' ELSE 'State' END AS label FROM customer""")
def type_label(spark, sf):
    kind = F.element_at(F.array(F.lit("ut"), F.lit("central"), F.lit("state")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", T.type_label(kind).alias("label"))


@query("state_key", """
SELECT seq, lower(trim(replace('+' || replace(title, ' ', '+') || ' ', '+', ' '))) AS key FROM v_listings""")
def state_key(spark, sf):
    raw = F.concat(F.lit("+"), F.replace("title", F.lit(" "), F.lit("+")), F.lit(" "))
    return view(spark, sf, "v_listings").select("seq", T.state_key(raw).alias("key"))


@query("strip_size_note", """
SELECT seq, title || CASE WHEN seq % 3 = 2 THEN ' (draft)' ELSE '' END AS title FROM v_listings""")
def strip_size_note(spark, sf):
    note = F.element_at(F.array(F.lit(" ( 1,234.5 KB )"), F.lit("(2mb)"), F.lit(" (draft)")), (F.col("seq") % 3 + 1).cast("int"))
    return view(spark, sf, "v_listings").select("seq", T.strip_size_note(F.concat("title", note)).alias("title"))


@query("clean_card_title", f"""
SELECT seq, CASE seq % 3 WHEN 0 THEN 'newspaper ' || {Q.spaces('title')} || ' offer Moreover'
  WHEN 1 THEN 'spaper ' || {Q.spaces('title')} || ' More offer Less Moreover'
  ELSE 'newspaper ' || {Q.spaces('title')} || ' More offer Less Moreover' END AS title FROM v_listings""")
def clean_card_title(spark, sf):
    """The same raw title by the rule of each site: one drops the expander words, one the badge, the others nothing."""
    raw = F.concat(F.lit("newspaper "), "title", F.lit("  More offer Less  Moreover "))
    site = F.element_at(F.array(F.lit("freshersworld"), F.lit("indeed"), F.lit("naukri")), (F.col("seq") % 3 + 1).cast("int"))
    return view(spark, sf, "v_listings").select("seq", T.clean_card_title(raw, site).alias("title"))


@query("split_company_role", """
SELECT seq, CASE WHEN seq % 2 = 0 THEN source_group ELSE 'We Work Remotely' END AS company,
  CASE WHEN seq % 2 = 0 THEN title || ': senior' ELSE title END AS role FROM v_listings""")
def split_company_role(spark, sf):
    raw = F.when(F.col("seq") % 2 == 0, F.concat("source_group", F.lit(": "), "title", F.lit(": senior"))).otherwise(
        F.col("title"))
    return view(spark, sf, "v_listings").select("seq", T.split_company_role(raw).alias("s")).select("seq", "s.*")


@query("split_qualification", """
SELECT seq, array_to_string(list_filter(list_transform(string_split(skills_text, ','), lambda p: trim(p)),
  lambda p: p <> ''), '|') AS skills FROM v_market""")
def split_qualification(spark, sf):
    return view(spark, sf, "v_market").select(
        "seq", F.array_join(T.split_qualification("skills_text"), "|").alias("skills"))


@query("filter_skills", f"""
SELECT seq, array_to_string(list_filter(list_transform(string_split(skills_text, ','), lambda p: {Q.scrub('p')}),
  lambda p: p <> ''), '|') AS skills FROM v_market""")
def filter_skills(spark, sf):
    return view(spark, sf, "v_market", heavy=True).select(
        "seq", F.array_join(T.clean_skills(F.split("skills_text", ",")), "|").alias("skills"))


@query("slice_text", """
SELECT doc_id, substring(text, 1, 2500) AS head, array_to_string(string_split(text, ' ')[1:10], ' ') AS first_words
FROM documents""")
def slice_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.slice_text("text").alias("head"),
        F.array_join(F.slice(F.split("text", " "), 1, K.SKILL_SLICE), " ").alias("first_words"))


# ------------------------------------------------------------------ facts in text


@query("extract_last_date", f"""
SELECT seq, {Q.last_date('body')} AS last_date, {Q.last_date("'last date March ' || (seq % 28 + 1) || ', 2026'")} AS named,
  {Q.last_date("'Last Date: ' || (seq % 28 + 1) || ' March 2026'")} AS day_first FROM v_listings""")
def extract_last_date(spark, sf):
    day = (F.col("seq") % 28 + 1).cast("string")
    return view(spark, sf, "v_listings").select(
        "seq", X.extract_last_date("body").alias("last_date"),
        X.extract_last_date(F.concat(F.lit("last date March "), day, F.lit(", 2026"))).alias("named"),
        X.extract_last_date(F.concat(F.lit("Last Date: "), day, F.lit(" March 2026"))).alias("day_first"))


@query("extract_vacancies", f"""
SELECT seq, {Q.vacancies('body')} AS vacancies, {Q.vacancies("(seq % 30) || ' Seats'")} AS seats FROM v_listings""")
def extract_vacancies(spark, sf):
    return view(spark, sf, "v_listings").select(
        "seq", X.extract_vacancies("body").alias("vacancies"),
        X.extract_vacancies(F.concat((F.col("seq") % 30).cast("string"), F.lit(" Seats"))).alias("seats"))


@query("extract_exam_date", f"""
SELECT seq, {Q.exam_date("replace(body, 'Last Date', 'Exam date')")} AS exam_date FROM v_listings""")
def extract_exam_date(spark, sf):
    text = F.replace("body", F.lit("Last Date"), F.lit("Exam date"))
    return view(spark, sf, "v_listings").select("seq", X.extract_exam_date(text).alias("exam_date"))


@query("classify_title", f"SELECT seq, {Q.title_label('title')} AS label FROM v_listings")
def classify_title(spark, sf):
    return view(spark, sf, "v_listings").select("seq", X.classify_title("title").alias("label"))


@query("extract_applicants", f"""
WITH h AS (SELECT seq, {Q.applicants('body')} AS h FROM v_listings)
SELECT seq, h.n AS applicant_count, coalesce({Q.indian('h.n')}, '') AS applicant_count_display,
  {Q.applicant_label('h.basis')} AS applicant_metric_label, {Q.applicant_note('h.basis', Q.indian('h.n'))} AS applicant_metric_note,
  coalesce(h.basis, 'not_disclosed') AS applicant_metric_basis FROM h""")
def extract_applicants(spark, sf):
    hits = view(spark, sf, "v_listings", heavy=True).select("seq", X.extract_applicants(T.normalize_spaces("body")).alias("hit"))
    return hits.select("seq", *[c.alias(n) for n, c in X.applicant_columns("hit").items()])


@query("parse_count", f"""
WITH t AS (SELECT seq, format('{{:,}}', seq * 37) AS n, (seq % 40) || '.' || (seq % 10) AS d,
  CASE seq % 4 WHEN 0 THEN 'Lakh' WHEN 1 THEN 'crore' WHEN 2 THEN 'million' ELSE '' END AS u FROM v_listings)
SELECT seq, {Q.count_of('n', "''")} AS plain, {Q.count_of('d', 'u')} AS scaled FROM t""")
def parse_count(spark, sf):
    unit = F.element_at(F.array(F.lit("Lakh"), F.lit("crore"), F.lit("million"), F.lit("")), (F.col("seq") % 4 + 1).cast("int"))
    decimal = F.concat((F.col("seq") % 40).cast("string"), F.lit("."), (F.col("seq") % 10).cast("string"))
    return view(spark, sf, "v_listings").select(
        "seq", N.parse_count(F.format_number(F.col("seq") * 37, 0), F.lit("")).alias("plain"),
        N.parse_count(decimal, unit).alias("scaled"))


@query("extract_notice_dates", r"""
SELECT seq, strftime(posted_on, '%d-%m-%Y') AS updated, strftime(posted_on, '%d %b %Y') || ' 5 pm' AS closing, seq % 9 || ' days ago' AS posted
FROM v_listings""")
def extract_notice_dates(spark, sf):
    text = F.concat(F.lit("Posted: "), (F.col("seq") % 9).cast("string"), F.lit(" days ago View & Apply Last updated: "),
                    F.date_format("posted_on", "dd-MM-yyyy"), F.lit(" Closing date: "),
                    F.date_format("posted_on", "dd MMM yyyy"), F.lit(" 5 pm"))
    return view(spark, sf, "v_listings").select("seq", X.extract_notice_dates(text).alias("d")).select("seq", "d.*")


@query("max_year", """
SELECT seq, list_max(list_transform(regexp_extract_all(title || ' ' || posted_on || ' in 1999 or 20261', '\\b(20\\d{2})\\b', 1),
  lambda y: cast(y AS bigint))) AS year FROM v_listings""")
def max_year(spark, sf):
    text = F.concat("title", F.lit(" "), F.col("posted_on").cast("string"), F.lit(" in 1999 or 20261"))
    return view(spark, sf, "v_listings").select("seq", X.max_year(text).alias("year"))


_SCOPE = f"lower({Q.spaces(Q.scrub('title') + chr(124) * 2 + chr(39) + ' ' + chr(39) + chr(124) * 2 + 'substring(body, 1, 2500)')})"


@query("tag_states", f"""
WITH t AS (SELECT seq, {_SCOPE} AS t FROM v_listings), f AS (SELECT seq, t, {Q.states('t')} AS f FROM t)
SELECT seq, {Q.kept_states('t', 'f')} AS states, {Q.state_label('t', 'f')} AS state_label,
  {Q.portal('t', 'f')} AS official_state_portal FROM f""")
def tag_states(spark, sf):
    from jobmill.operators.listings import with_states

    df = with_states(view(spark, sf, "v_listings", heavy=True), body="body")
    return df.select("seq", F.array_join("states", " / ").alias("states"), "state_label", "official_state_portal")


# ------------------------------------------------------------------ numbers and dates


@query("format_indian", f"SELECT o_orderkey, {Q.indian('cast(floor(o_totalprice * 37) AS bigint)')} AS shown FROM orders")
def format_indian(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", N.format_indian(F.floor(F.col("o_totalprice") * 37)).alias("shown"))


@query("format_currency_range", f"""
WITH t AS (SELECT seq, {Q.whole('salary_min')} AS lo, {Q.whole('salary_max')} AS hi FROM v_market)
SELECT seq, {Q.CURRENCY} AS salary FROM t""")
def format_currency_range(spark, sf):
    return view(spark, sf, "v_market").select(
        "seq", N.format_currency_range("salary_min", "salary_max").alias("salary"))


@query("format_market_date", f"SELECT seq, {Q.market_date('posted_raw')} AS posted_at FROM v_market")
def format_market_date(spark, sf):
    return view(spark, sf, "v_market").select("seq", D.format_market_date("posted_raw").alias("posted_at"))


def _age_sql(day: str) -> str:
    return f"""
SELECT person_id, '{day}' AS as_of, y - CASE WHEN m < 0 THEN 1 ELSE 0 END AS years,
  CASE WHEN m < 0 THEN m + 12 ELSE m END AS months, d AS days, total_days, total_days // 7 AS total_weeks,
  (y - CASE WHEN m < 0 THEN 1 ELSE 0 END) * 12 + CASE WHEN m < 0 THEN m + 12 ELSE m END AS total_months,
  total_days * 24 AS total_hours, total_days * 1440 AS total_minutes, dayname(dob) AS birth_weekday,
  date_diff('day', date '{day}', CASE WHEN this_year <= date '{day}' THEN next_year ELSE this_year END) AS days_to_birthday
FROM (SELECT *, date_diff('day', dob, date '{day}') AS total_days, year(date '{day}') - year(dob) AS y,
    month(date '{day}') - month(dob) - CASE WHEN day(date '{day}') < day(dob) THEN 1 ELSE 0 END AS m,
    day(date '{day}') - day(dob) + CASE WHEN day(date '{day}') < day(dob)
      THEN day(date_trunc('month', date '{day}') - interval 1 day) ELSE 0 END AS d,
    cast(make_date(year(date '{day}'), month(dob), 1) + to_days(cast(day(dob) - 1 AS int)) AS date) AS this_year,
    cast(make_date(year(date '{day}') + 1, month(dob), 1) + to_days(cast(day(dob) - 1 AS int)) AS date) AS next_year
  FROM v_persons) x WHERE dob < date '{day}'"""


@query("age_ymd", _age_sql("2026-01-01") + " UNION ALL " + _age_sql("2026-03-01"))
def age_ymd(spark, sf):
    days = F.explode(F.array(F.lit("2026-01-01"), F.lit("2026-03-01")))
    people = view(spark, sf, "v_persons").withColumn("as_of", days).where("dob < cast(as_of AS date)")
    return people.select("person_id", "as_of", D.age_ymd("dob", F.col("as_of").cast("date")).alias("a")).select(
        "person_id", "as_of", "a.*")


@query("age_years", """
SELECT person_id, date_sub('year', dob, date '2026-02-28') AS age, date_sub('year', dob, date '2026-02-28') || ' years' AS shown
FROM v_persons""")
def age_years(spark, sf):
    day = F.lit("2026-02-28").cast("date")
    return view(spark, sf, "v_persons").select(
        "person_id", D.age_years("dob", day).alias("age"), D.age_text("dob", day).alias("shown"))


@query("format_long_date", "SELECT person_id, strftime(dob, '%d %B %Y') AS shown FROM v_persons")
def format_long_date(spark, sf):
    return view(spark, sf, "v_persons").select("person_id", D.format_long_date("dob").alias("shown"))


@query("size_label", """
SELECT id, CASE WHEN size > 1048576 THEN printf('%.1f', floor(size / 1048576.0 * 10 + 0.5) / 10) || ' MB'
  ELSE cast(floor(size / 1024.0 + 0.5) AS bigint) || ' KB' END AS label FROM v_uploads""")
def size_label(spark, sf):
    return view(spark, sf, "v_uploads").select("id", N.size_label("size").alias("label"))


@query("file_ext_category", """
SELECT id, lower(regexp_extract(name, '([^.]*)$', 1)) AS ext,
  CASE WHEN lower(regexp_extract(name, '([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png') THEN 'photo' ELSE 'other' END AS category
FROM v_uploads""")
def file_ext_category(spark, sf):
    return view(spark, sf, "v_uploads").select(
        "id", N.file_extension("name").alias("ext"), N.file_category("name").alias("category"))


# ------------------------------------------------------------------ filters


def _kept(spark, sf, test):
    df = view(spark, sf, "v_links", heavy=True)
    return df.where(test).select("seq", "site", "category", "url", "title")


_LINK_COLUMNS = "seq, site, category, url, title"


@query("filter_listing_candidate", f"SELECT {_LINK_COLUMNS} FROM v_links WHERE {Q.candidate('title', 'url', 'site', 'category')}")
def filter_listing_candidate(spark, sf):
    return _kept(spark, sf, P.is_listing_candidate("title", "url", "site", "category"))


@query("filter_title_signal", f"SELECT {_LINK_COLUMNS} FROM v_links WHERE {Q.signal('title', 'url', 'category')}")
def filter_title_signal(spark, sf):
    return _kept(spark, sf, P.has_title_signal("title", "url", "category"))


@query("filter_same_domain", f"SELECT {_LINK_COLUMNS} FROM v_links WHERE {Q.same_domain('url', 'site', K.SITE_DOMAINS)}")
def filter_same_domain(spark, sf):
    return _kept(spark, sf, P.same_domain("url", "site"))


@query("filter_social", f"SELECT {_LINK_COLUMNS} FROM v_links WHERE NOT {Q.social('url')}")
def filter_social(spark, sf):
    return _kept(spark, sf, ~P.is_social("url"))


def _competitor_sql() -> str:
    tests = [f"contains(lower(url), '{p}')" for p in K.APP_PHRASES]
    for text in K.COMPETITORS:
        own = ", ".join(f"'{s}'" for s, d in K.OWN_DOMAINS.items() if text in d)
        tests.append(f"(contains(lower(url), '{text}')" + (f" AND site NOT IN ({own}))" if own else ")"))
    return "(" + " OR ".join(tests) + ")"


@query("filter_competitor", f"SELECT {_LINK_COLUMNS} FROM v_links WHERE NOT {_competitor_sql()}")
def filter_competitor(spark, sf):
    return _kept(spark, sf, ~P.is_competitor("url", "site"))


_BANK = "CASE k % 5 WHEN 0 THEN 'SBI' WHEN 1 THEN 'Union  Bank' WHEN 2 THEN 'PNBX' WHEN 3 THEN 'Indian bank' ELSE 'IBPS' END"
_ROLE = "CASE seq % 4 WHEN 0 THEN 'PGIP 2026' WHEN 1 THEN 'Clerk' WHEN 2 THEN 'Co-operative officer' ELSE 'PO idbi' END"


@query("filter_allow_deny", f"""
WITH t AS (SELECT seq, {_BANK} AS org, {_ROLE} AS role FROM v_listings)
SELECT seq, org, role FROM t WHERE NOT {Q.words(Q.spaces("org || ' ' || role"), K.DENY_WORDS)}
  AND {Q.words(Q.spaces("org || ' ' || role"), K.ALLOW_WORDS)}""")
def filter_allow_deny(spark, sf):
    rows = view(spark, sf, "v_listings").select("seq", F.expr(_BANK).alias("org"), F.expr(_ROLE).alias("role"))
    return rows.where(P.passes_allow_deny("org", "role"))


@query("filter_current_notice", """
SELECT seq, title FROM v_listings WHERE coalesce(list_max(list_transform(
  regexp_extract_all(CASE WHEN seq % 7 = 0 THEN 'no year' ELSE title END, '\\b(20\\d{2})\\b', 1), lambda y: cast(y AS int))) >= 2026, true)""")
def filter_current_notice(spark, sf):
    text = F.when(F.col("seq") % 7 == 0, "no year").otherwise(F.col("title"))
    return view(spark, sf, "v_listings").where(P.is_current_notice(text, 2026)).select("seq", "title")


@query("filter_required_fields", """
SELECT seq, title, company, url FROM (SELECT seq, title, company, CASE WHEN seq % 4 = 0 THEN '' ELSE original_url END AS url FROM v_market) t
WHERE title <> '' AND company <> '' AND url <> ''""")
def filter_required_fields(spark, sf):
    url = F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("original_url")).alias("url")
    rows = view(spark, sf, "v_market").select("seq", "title", "company", url)
    return P.with_required(rows, "title", "company", "url")
