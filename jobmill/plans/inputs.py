"""Input views over the given tables, in SQL that both engines read.

The tables hold no job listings, so these views derive some from every row of ``orders``, ``customer``,
``documents`` and ``pages``.  Nothing is sampled or cut: the views grow with the tables.
``{orders}`` and the like stand for a table, ``{v_...}`` for another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from jobmill import constants as K
from jobmill.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
NARROW = ("customer", "orders")  # many short rows, from which the views make long ones


def pick(expression: str, values: list[str]) -> str:
    """CASE over ``expression`` modulo the number of values."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {expression} % {len(values)} {whens} ELSE '{values[-1]}' END"


_ORGS = ["SSC CGL", "RRB NTPC", "Bihar  BPSC", "Uttar Pradesh UPSSSC", "Sarkari Result Delhi",
         "All India Post", "Goa and Kerala PSC", "Municipal"]
_KINDS = ["Result", "Admit Card", "Online Form", "Answer Key", "Engineer", "Remote Engineer"]
_SENTENCES = ["Over 2.5 lakh candidates have applied", "1,234 applicants registered",
              "total candidates applied: 3 crore", "45000 students have appeared", "no totals"]

VIEWS: dict[str, str] = {}

# One listing per order; many orders share a customer, so addresses repeat within and across categories.
VIEWS["v_listings"] = f"""
SELECT o_orderkey AS seq, o_custkey AS k,
  {pick('o_custkey', list(K.SOURCE_GROUPS))} AS source_group,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE {pick('o_custkey', list(K.SOURCE_GROUPS))} END AS source,
  {pick('o_orderkey', list(K.CATEGORIES))} AS category,
  'https://jobs' || cast(o_custkey % 7 AS string) || '.example.com/p/' || cast(o_custkey AS string)
    || CASE WHEN o_orderkey % 5 = 0 THEN '#frag' ELSE '' END AS original_url,
  {pick('o_custkey', _ORGS)} || ' ' || {pick('o_orderkey', _KINDS)} || ' '
    || cast(2020 + o_custkey % 9 AS string) AS title,
  'Last Date: ' || lpad(cast(o_custkey % 28 + 1 AS string), 2, '0') || '/'
    || lpad(cast(o_custkey % 12 + 1 AS string), 2, '0') || '/2026 . ' || cast(o_custkey * 13 AS string)
    || ' posts . ' || {pick('o_orderkey', _SENTENCES)} AS body,
  cast(o_orderdate AS date) AS posted_on
FROM {{orders}}"""

# The same as a run meets them: homepage blocks of one day, some links of them to a competitor; listing pages of one day; state
# pages; one page per official source; market pages that only the category's cap ends.
_DAY = "(year(posted_on) * 10000 + month(posted_on) * 100 + day(posted_on))"
_PLACE_OF = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(K.CATEGORIES)) + " END"
_HOME = "source_group IN ('SR', 'FJA', 'SE') AND seq % 4 = 0"
_STATE_PAGE = "source_group = 'FJA' AND category = 'latest_jobs' AND seq % 4 = 3"
_CAPS = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in K.CATEGORY_CAPS.items()) + " END"
VIEWS["v_arrivals"] = f"""
SELECT seq, k, source_group, source, title, body, posted_on, CASE WHEN source_group = 'OFFICIAL' THEN 'latest_jobs' ELSE category END AS category,
  original_url || CASE WHEN {_HOME} AND seq % 12 = 8 THEN '?via=naukri.com' ELSE '' END AS original_url, CASE WHEN {_HOME} THEN 0 ELSE 1 END AS phase,
  CASE WHEN source_group = 'OFFICIAL' THEN cast(k % 4 AS bigint) ELSE cast({_DAY} AS bigint) * 10 + {_PLACE_OF} + CASE WHEN {_STATE_PAGE} THEN 10000000000 ELSE 0 END END AS page_seq, seq AS pos,
  cast(CASE WHEN source_group = 'OFFICIAL' THEN CASE k % 4 {' '.join(f'WHEN {i} THEN {n}' for i, n in enumerate(K.OFFICIAL_SOURCE_CAPS.values()))} END
    WHEN source_group IN ('PRIVATE', 'REMOTE') THEN {_CAPS} WHEN {_STATE_PAGE} THEN {K.STATE_PAGE_LIMIT} ELSE {K.PAGE_LIMIT} END AS int) AS page_limit
FROM {{v_listings}}"""

# Links of listing pages: real and foreign hosts, skipped paths, social and mail addresses.
_DOMAIN = pick("o_custkey", ["www.sarkariresult.com", "www.freejobalert.com", "www.SarkariExam.com", "sarkariujala.com"])
VIEWS["v_links"] = f"""
SELECT o_orderkey AS seq, {pick('o_custkey', ['SR', 'FJA', 'SE', 'SU'])} AS site,
  {pick('o_orderkey', list(K.CATEGORIES))} AS category,
  {pick('o_orderkey', ['https://', 'https://t.me', 'https://recruitment.mea.gov.in', 'mailto:jobs@', 'https://',
                       'https://jobs.example.com/naukri.com', 'HTTPS://', '', 'http://'])}
    || CASE WHEN o_orderkey % 9 IN (0, 4, 6, 8) THEN {_DOMAIN} ELSE '' END
    || {pick('o_orderkey', ['/category/', '/', '/', '', '/2026/', '/', '/Result/', '', '/p/'])}
    || CASE WHEN o_orderkey % 9 = 7 THEN '' ELSE cast(o_custkey AS string) END
    || {pick('o_orderkey', ['', '', '', '', '#top', '', '', '', '?ref=shine.com'])} AS url,
  CASE o_orderkey % 7 WHEN 0 THEN '  View  More ' WHEN 1 THEN 'Exam Results' WHEN 2 THEN ''
    ELSE {pick('o_custkey', _ORGS)} || ' ' || {pick('o_orderkey', _KINDS)}
      || CASE WHEN o_orderkey % 2 = 0 THEN ' ' || cast(2020 + o_custkey % 9 AS string) ELSE '' END END AS title
FROM {{orders}}"""

# Rows of private and remote sources.
VIEWS["v_market"] = f"""
SELECT o.o_orderkey AS seq, {pick('o.o_orderkey', ['private_jobs', 'remote_jobs'])} AS category,
  {pick('o.o_custkey', ['Internshala', 'Freshersworld', 'Remote OK', 'Remotive'])} AS source,
  'https://market.example.com/j/' || cast(o.o_custkey AS string) AS original_url,
  {pick('o.o_orderkey', ['Data  Engineer', 'Police Clerk', 'Sarkari Naukri Tutor', 'Nurse'])} || ' '
    || c.c_mktsegment AS title,
  CASE WHEN o.o_orderkey % 11 = 0 THEN '' ELSE c.c_name END AS company,
  {pick('o.o_orderkey', ['', 'Pune, Maharashtra', 'Remote', 'Delhi'])} AS job_location,
  CASE o.o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '12.5'
    ELSE cast(cast(floor(o.o_totalprice) AS bigint) AS string) END AS salary_min,
  CASE o.o_orderkey % 3 WHEN 0 THEN '' ELSE cast(cast(floor(o.o_totalprice * 2) AS bigint) AS string) END AS salary_max,
  {pick('o.o_orderkey', ['', '2 years', 'See listing'])} AS experience,
  CASE o.o_orderkey % 4 WHEN 0 THEN ''
    WHEN 1 THEN cast(cast(o.o_orderdate AS date) AS string) || 'T23:30:00-05:00'
    WHEN 2 THEN 'Tue, 21 Apr 2026 10:00:00 +0000' ELSE '3 days ago' END AS posted_raw,
  o.o_orderpriority || ', ,get app,' || c.c_mktsegment || ',Sarkari  Exam' AS skills_text
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey"""

VIEWS["v_persons"] = f"""
SELECT c_custkey AS person_id, c_name AS name,
  date '1980-01-01' + cast(c_custkey * 37 % 10000 AS int) AS dob,
  {pick('c_custkey', ['general', 'obc', 'sc', 'pwd', 'exsm'])} AS category
FROM {{customer}}"""

VIEWS["v_uploads"] = f"""
SELECT 'u' || cast(doc_id % 40 AS string) AS owner, doc_id AS id,
  CASE doc_id % 6 WHEN 0 THEN 'Aadhar card ' WHEN 1 THEN 'PAN ' WHEN 2 THEN 'my 12th sheet ' ELSE '' END
    || source || '.' || {pick('doc_id', ['PDF', 'jpg', 'Png', 'docx'])} AS name,
  n_chars * 4096 AS size, doc_id * 7 % 1000 AS uploaded_at
FROM {{documents}}"""


# One article page per customer, except every sixth, at the address that customer's listings have.
_PLACE = f"'https://jobs' || cast(c_custkey % 7 AS string) || '.example.com/p/' || cast(c_custkey AS string)"
VIEWS["v_articles"] = f"""
SELECT {_PLACE} AS url_key, {pick('c_custkey', list(K.SOURCE_GROUPS))} AS site, c_custkey AS k,
  {pick('c_custkey', ['Railway Board', '', 'Police  Bharti'])} AS heading,
  lpad(cast(c_custkey % 28 + 1 AS string), 2, '0') || '/' || lpad(cast(c_custkey % 12 + 1 AS string), 2, '0') || '/2026' AS day,
  {pick('c_custkey', _SENTENCES)} AS sentence
FROM {{customer}} WHERE c_custkey % 6 <> 5"""
# Offers are fragments of a feed, the others whole pages.
ARTICLE_HTML = """CASE WHEN site IN ('PRIVATE', 'REMOTE') THEN '<script>99999 candidates applied</script><p>Last Date: ' || day || '</p><p>' || cast(k * 13 AS string)
  || ' posts</p><form>Kerala</form><p>' || sentence || '</p>' ELSE '<html><body><nav>menu</nav><h1>' || heading || '</h1><div id="post" class="entry-content"><p>Last Date: ' || day
  || '</p><div class="share-bar">99999 posts</div><p>' || cast(k * 13 AS string) || ' posts</p><a href="https://t.me/x">Goa</a><p>' || sentence
  || '</p></div><footer>Kerala</footer></body></html>' END"""
LISTING_DOMAINS = {"SR": "jobs0.example.com", "FJA": "jobs1.example.com", "SE": "jobs2.example.com", "SU": "jobs3.example.com"}


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False, narrow: bool = False) -> DataFrame:
    """A given table; ``heavy`` uses all cores on a table of few splits, and more tasks the larger a ``narrow`` table is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, narrow) if heavy else df


def view(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    sql = VIEWS[name]
    frames = {n: view(spark, sf_dir, n, heavy) if n in VIEWS else table(spark, sf_dir, n, heavy, n in NARROW) for n in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **frames)


def duckdb_text(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
