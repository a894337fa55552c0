"""Golden values: one literal row per rule that is easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions import dates as D
from jobmill.functions import extract as X
from jobmill.functions import numbers as N
from jobmill.functions import states as S
from jobmill.functions import text as T
from jobmill.functions import urls as U
from jobmill.operators import listings as L
from jobmill.operators import predicates as P


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(text):
    return F.lit(text)


@pytest.mark.parametrize("text,expected", [
    ("Last Date: 15 March 2026", "15"), ("Last Date: March 15, 2026", "March 15, 2026"),
    ("Last Date 15/03/2026", "15/03/2026"), ("nothing", "See Notification"), ("LAST  DATE : 1-2-2026 x", "1-2-2026")])
def test_last_date(spark, text, expected):
    assert value(spark, X.extract_last_date(lit(text))) == expected


@pytest.mark.parametrize("text,expected", [
    ("Recruitment 2026 Posted. 450 posts", "2026"), ("5 posts", "Various"), ("1,250 Vacancies", "1,250")])
def test_vacancies(spark, text, expected):
    assert value(spark, X.extract_vacancies(lit(text))) == expected


@pytest.mark.parametrize("text,expected", [
    ("get application", "lication"), ("SARKARI  RESULT. com x", f"{K.DEFAULT_HOUSE} x"), ("Free Job Alert", K.DEFAULT_HOUSE),
    ("download now the app", ""), ("geget appt app", "get app"), ("plain", "plain"), ("ſarkari result", K.DEFAULT_HOUSE)])
def test_brand_scrub(spark, text, expected):
    assert value(spark, T.brand_scrub(lit(text))) == expected


def test_every_scrubbed_phrase_has_a_hint():
    for phrase in K.APP_PHRASES:
        assert any(h in phrase for h in K.SCRUB_HINTS)


def test_spaces_are_unicode(spark):
    assert value(spark, T.normalize_spaces(lit(" a  b\u001f\n"))) == "a b"
    assert value(spark, T.normalize_spaces(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("number,expected", [(0, "0"), (999, "999"), (1000, "1,000"), (100000, "1,00,000"), (123456789, "12,34,56,789")])
def test_indian_grouping(spark, number, expected):
    assert value(spark, N.format_indian(F.lit(number))) == expected


@pytest.mark.parametrize("number,unit,expected", [("2.5", "lakh", 250000), ("3", "Crore", 30000000), ("0.5", "", 0), ("1.5", "", 2),
                                                  ("1,234", "", 1234), ("", "", 0), ("2.5", "", 2)])
def test_parse_count(spark, number, unit, expected):
    assert value(spark, N.parse_count(lit(number), lit(unit))) == expected


def test_parse_count_reads_what_format_indian_writes(spark):
    df = spark.range(0, 10**9, 7654321).withColumn("s", N.format_indian("id"))
    assert df.where(N.parse_count("s", lit("")) != F.col("id")).count() == 0


@pytest.mark.parametrize("low,high,expected", [("10000", "20000", "$10,000 - $20,000"), ("10000", "", "From $10,000"),
                                               ("12.5", "70000", "Up to $70,000"), ("x", "0", "")])
def test_currency_range(spark, low, high, expected):
    assert value(spark, N.format_currency_range(lit(low), lit(high))) == expected


@pytest.mark.parametrize("text,expected", [
    ("2026-04-21T23:30:00-05:00", "21 Apr 2026"), ("2026-04-21T23:30:00Z", "21 Apr 2026"), ("Tue, 21 Apr 2026 10:00:00 +0000", "21 Apr 2026"),
    ("20260421T101010", "21 Apr 2026"), ("2026-04-21", "2026-04-21"), ("3 days ago", "3 days ago"), ("", ""), ("2026-13-41T00:00:00Z", "2026-13-41T00:00:00Z")])
def test_market_date(spark, text, expected):
    assert value(spark, D.format_market_date(lit(text))) == expected


@pytest.mark.parametrize("born,day,expected", [
    ("2000-01-31", "2026-03-01", (26, 1, -2)), ("2000-03-01", "2026-03-01", (26, 0, 0)), ("1999-12-31", "2026-01-01", (26, 0, 1))])
def test_age_ymd(spark, born, day, expected):
    got = value(spark, D.age_ymd(lit(born).cast("date"), lit(day).cast("date")))
    assert (got.years, got.months, got.days) == expected
    days = (dt.date.fromisoformat(day) - dt.date.fromisoformat(born)).days
    assert (got.total_days, got.total_weeks, got.total_hours) == (days, days // 7, days * 24)


def test_age_years_on_leap_day(spark):
    assert value(spark, D.age_years(lit("2000-02-29").cast("date"), lit("2001-02-28").cast("date"))) == 0


@pytest.mark.parametrize("size,expected", [(1048576, "1024 KB"), (1048577, "1.0 MB"), (3407872, "3.3 MB"), (1536, "2 KB"), (0, "0 KB")])
def test_size_label(spark, size, expected):
    assert value(spark, N.size_label(F.lit(size))) == expected


@pytest.mark.parametrize("base,href,expected", [
    ("https://h.example.com/a/b.html?x=1", "c", "https://h.example.com/a/c"), ("https://h.example.com/a/b", "../c#f", "https://h.example.com/c"),
    ("https://h.example.com/a/b", "/x//y", "https://h.example.com/x/y"), ("https://h.example.com", "c", "https://h.example.com/c"),
    ("https://h.example.com/a/", "./", "https://h.example.com/a/"), ("https://h.example.com/a/b", "?q", "https://h.example.com/a/b?q"),
    ("http://h.example.com/a", "//o.example.com/z", "http://o.example.com/z"), ("http://h.example.com/a", "mailto:x@y", "mailto:x@y"),
    ("http://h.example.com/a", "", "http://h.example.com/a")])
def test_url_absolute(spark, base, href, expected):
    assert value(spark, U.url_absolute(lit(href), lit(base))) == expected


@pytest.mark.parametrize("url,hit", [("https://recruitment.mea.gov.in/x", True), ("https://T.ME/jobs", True), ("https://jobs.example.com", False)])
def test_social_is_a_bare_substring(spark, url, hit):
    assert value(spark, P.is_social(lit(url))) is hit


@pytest.mark.parametrize("url,site,hit", [
    ("https://www.sarkariresult.com/x", "SR", False), ("https://www.sarkariresult.com/x", "FJA", True), ("https://sarkariujala.com/naukri.com", "SU", True),
    ("https://www.sarkariresult.com/x", "SU", True), ("https://play.google.com/x", "SR", True), ("https://example.com", "SR", False), ("", "SR", False)])
def test_competitor_exempts_only_the_own_domain(spark, url, site, hit):
    assert value(spark, P.is_competitor(lit(url), lit(site))) is hit


@pytest.mark.parametrize("text,basis,count", [
    ("Over 2.5 lakh candidates have applied", "applied", 250000), ("0 candidates applied, 12 students appeared", "appeared", 12),
    ("total registered candidates: 1,00,000", "registered", 100000), ("5 applications were received", "applications received", 5), ("none", None, None)])
def test_applicants_take_the_first_positive_pattern(spark, text, basis, count):
    got = value(spark, X.extract_applicants(lit(text)))
    assert (got and (got.basis, got.n)) == (basis and (basis, count))


@pytest.mark.parametrize("title,body,states,label", [
    ("Work from home Remote role in Bihar", "", [], "Remote"), ("All India Post Bihar", "", [], "All India"),
    ("Goa and Kerala PSC", "", ["Goa", "Kerala"], "Goa / Kerala"), ("SSC CGL", "", [], "Central Govt"), ("Municipal", "", [], "All India"),
    ("J&K police", "", ["Jammu and Kashmir"], "Jammu and Kashmir"), ("bihar2026 goan", "", ["Bihar"], "Bihar"),
    ("A&N Islands", "", ["Andaman and Nicobar Islands"], "Andaman and Nicobar Islands"),
    ("x", "Goa Kerala Bihar Punjab", ["Bihar", "Goa", "Kerala", "Punjab"], "All States"), ("x", "y" * 2499 + " Goa", [], "All India")])
def test_state_tags(spark, title, body, states, label):
    df = spark.createDataFrame([(title, body)], "title string, body_text string")
    row = L.with_states(df).first()
    assert (row.states, row.state_label) == (states, label)


def test_state_aliases_all_match_themselves(spark):
    rows = [(a, n) for n, kind, _, aliases in K.STATE_DIRECTORY if kind != "central" for a in aliases]
    df = spark.createDataFrame(rows, "title string, name string").withColumn("body_text", F.lit(""))
    assert L.with_states(df).where(~F.array_contains("states", F.col("name"))).count() == 0


def test_state_portals():
    assert S.PORTALS["Goa"].startswith("https://gpsc") and set(S.SCOPE_PORTALS) == {"All India", "Central Govt"}


def test_search_keeps_blanks_of_missing_fields(spark):
    row = [("Clerk", None, "", "Goa", None, "", ["SQL"], None)]
    df = spark.createDataFrame(row, "title string, company string, job_location string, state_label string, salary string, "
                                    "experience string, skills array<string>, source string")
    assert P.search_listings(df, "clerk   goa").count() == 1
    assert P.search_listings(df, "clerk goa").count() == 0
    assert P.search_listings(df, "", K.DEFAULT_HOUSE).count() == 1


def test_a_plain_page_is_read_without_the_parser(monkeypatch):
    from jobmill.functions import html as H

    def parsed(page):
        parser = H._Tokens()
        parser.feed(page)
        return parser.finish()

    plain = ['<DIV class="a"> <p>one &amp; two</b>\n three</p></div>', '<ul><li id="x"><a href="/a">b<br>c', "<pre>  </pre>  \n", "", "text", "<template><p>x</p></template>"]
    others = ["<p x=1>a</p>", '<a href="?a=1&amp;b">x</a>', "<script>1<2</script>", "<!-- <p> -->", "a < b", '<a title="x>y">z</a>', "<br/>"]
    wanted = [parsed(page) for page in plain + others]
    assert [H.tokenize_page(page) for page in plain + others] == wanted
    assert all(H._read_plain(page) is None for page in others)

    def refuse(*_):
        raise AssertionError("parsed")

    monkeypatch.setattr(H._Tokens, "feed", refuse)
    assert [H.tokenize_page(page) for page in plain] == wanted[:len(plain)]


@pytest.mark.parametrize("function", [T.brand_scrub, D.format_market_date, N.whole_number, lambda v: N.format_currency_range(v, F.lit("7"))])
def test_the_value_of_a_text_rule_is_made_once(spark, function):
    """Else each of its steps makes it again, in one generated method too long to be compiled."""
    plan = spark.range(3).select(function(F.repeat(F.col("id").cast("string"), 2)).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1


def test_scrubbing_goes_on_in_order_after_the_first_change(spark):
    scrub = lambda text: value(spark, T.brand_scrub(F.lit(text)))
    assert scrub("get app") == "" and scrub("a get app b") == "a  b" and scrub("Sarkari  Exam") == "JobMill" and scrub("apple alert") == "apple alert"
    assert scrub("androget appid app") == "" and scrub("get android appapp") == "get app"  # what a deletion joins may only be a later phrase
