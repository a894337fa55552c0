"""HTML tokens, selection and cleaning on literal pages."""

import pytest
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions import html as H
from jobmill.functions import selectors as S
from jobmill.functions.html import Select
from jobmill.operators import pages as PG
from jobmill.sources import dims


def page(spark, html, url="https://h.example.com/a/b"):
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


def tokens(spark, html):
    return PG.tokenized(page(spark, html))


def one(df, column):
    return df.select(column.alias("x")).first().x


def tok():
    return F.col(PG.TOKENS)


@pytest.mark.parametrize("html,expected", [
    ("<p>a<p>b</p>", "<p>a<p>b</p></p>"), ("<b>x<br>y", "<b>x<br/>y</b>"), ("</i>x<i>", "x<i></i>"), ("<ul><li>1<li>2</ul>z", "<ul><li>1<li>2</li></li></ul>z"),
    ("a &amp; b &lt; c", "a &amp; b &lt; c"), ("<a title='say \"hi\"'>x</a>", "<a title='say \"hi\"'>x</a>"), ("<div/>t", "<div></div>t"),
    ("<!-- c --><script>if(a<b){}</script>", "<!-- c --><script>if(a<b){}</script>"), ("", "")])
def test_pages_are_repaired_and_written_back(spark, html, expected):
    assert one(tokens(spark, html), H.to_html(tok())) == expected


def test_text_skips_scripts_styles_and_comments(spark):
    html = "<style>p{}</style> <p> a\n <b>b</b><!-- no --></p><script>x</script><template><p>no</p></template>c"
    assert one(tokens(spark, html), H.text_of(tok())) == "a b c"


def test_plain_text_passes_unchanged(spark):
    assert PG.html_to_text(page(spark, "a &amp; b  > c")).first().text == "a &amp; b  > c"


def test_select_by_ancestor_child_and_attribute(spark):
    df = tokens(spark, '<div class="a x"><p id="1"><i class="b" data-u="/jobs">in</i></p><i class="b">direct</i></div><i class="b">out</i>')
    inside = Select(classes=("b",), inside=Select(tags=("div",), classes=("a",)))
    child = Select(classes=("b",), inside=Select(classes=("a",)), child=True)
    assert one(df, H.all_texts(tok(), inside)) == ["in", "direct"]
    assert one(df, H.all_texts(tok(), child)) == ["direct"]
    assert one(df, H.all_texts(tok(), Select(attr="data-u", attr_contains="job"))) == ["in"]
    assert one(df, H.nth_text(tok(), inside, 1)) == "direct" and one(df, H.nth_text(tok(), inside, 5)) == ""


def test_clean_fragment_absolutises_links(spark):
    html = '<svg>x</svg><a rel="me" href="../c#f">t</a><a name="n">u</a><img src="i.png">'
    row = PG.html_clean(page(spark, html)).first()
    assert row.clean_html == '<a rel="nofollow noopener" href="https://h.example.com/c" target="_blank">t</a><a name="n">u</a>'
    assert row.links == ["https://h.example.com/c"]


def test_deep_clean(spark):
    html = ('<div class="lead-in">junk<p>more</p></div><p title="Sarkari Result">Sarkari Result x<!-- naukri sarkari exam --><a href="https://t.me/x">j</a>'
            '<a target="x" href="/p">ok <b>k</b></a><img src="x.png" alt="Sarkari logo"><a href="http://z.example.com" target="_b" onclick="u()">zz</a>'
            '<a href="/get"><span class="widget-a">no</span>Get App now</a><a href="https://x.gov.in/" target="_b">g</a></p>')
    row = PG.html_deep_clean(page(spark, html), house="House").first()
    assert row.clean_html == ('<p title="House">House x naukri House <a target="x" href="/p">ok <b>k</b></a><a href="http://z.example.com">zz</a>'
                              '<a href="https://x.gov.in/" target="_b">g</a></p>')
    assert row.clean_text == "House x naukri House ok k zz g"
    assert row.dropped_tags == {"a": 2, "div": 1, "img": 1, "span": 1}


def test_comment_without_a_brand_stays_a_comment(spark):
    row = PG.html_deep_clean(page(spark, "a<!-- note -->b")).first()
    assert row.clean_html == "a<!-- note -->b" and row.clean_text == "a b"


@pytest.mark.parametrize("site,html,rule,text", [
    ("SR", "<div class='postab'>class</div><div id='post'>id</div>", 0, "id"), ("SR", "<article>no</article><table><tr><td>t</td></tr></table>", 9, "t"),
    ("FJA", "<article>art</article><div class='x entry-content'>class</div>", 1, "class"), ("SE", "<article>art</article><table>long long</table>", 2, "art"),
    ("SU", "<table>a</table><table>longer</table><table>short</table>", 9, "longer"), ("SU", "<table>ab</table><table>cd</table>", 9, "ab"), ("SU", "<p>x</p>", None, "")])
def test_main_content(spark, site, html, rule, text):
    row = PG.extract_main_content(page(spark, html), F.lit(site)).first()
    assert (row.main_rule, row.text) == (rule, text)


def test_largest_block_keeps_the_first_of_equals(spark):
    assert PG.largest_block(page(spark, "<p>aa</p><p>bb</p><p>c</p>")).first().block_text == "aa"


def test_section_anchors_are_counted_before_filtering(spark):
    links = "".join(f"<a href='/{i}'>t{i}</a>" for i in range(15))
    rows = PG.extract_sections(page(spark, f"<h2>Result</h2><ul>{links}</ul><h2>Contact</h2><ul><a href='/x'>x</a></ul>").withColumn("site", F.lit("SE")), {"SE": "https://h.example.com/"}).collect()
    assert [r.link_pos for r in sorted(rows, key=lambda r: r.link_pos)] == list(range(10))


def test_many_dropped_elements_cost_one_pass(spark):
    html = "".join(f"<div class='ad-{i}'>x</div>k{i} " for i in range(3000))
    assert one(PG.html_deep_clean(page(spark, html)), F.length("clean_text")) == len(" ".join(f"k{i}" for i in range(3000)))


@pytest.mark.parametrize("html,date", [
    ("<div class='view-content'><span class='date-display-single'>01/02/2026</span><span class='date-display-single'>x</span></div>", "01/02/2026"),
    ("<div class='region-content'><i class='date-display-single'>no</i></div><div class='view-content'>t</div>", ""),
    ("<div class='region-content'><i class='date-display-single'>3</i></div><div class='region-content'><i class='date-display-single'>4</i></div>", "3"), ("<p class='date-display-single'>no</p>", "")])
def test_detail_pages_fall_back_to_the_second_container(spark, html, date):
    assert PG.detail_pages(page(spark, html), dims.card_rules(spark)).first().upload_date == date


@pytest.mark.parametrize("selector,paths", [
    ("a", [[(False, "a", (), "", ())]]), (".x.y > b , #i", [[(False, "", ("x", "y"), "", ()), (True, "b", (), "", ())], [(False, "", (), "i", ())]]),
    ("div[data-a^='#o'] a[href]", [[(False, "div", (), "", (("data-a", "^=", "#o"),)), (False, "a", (), "", (("href", "", ""),))]]),
    ('P[x*="a b"][y=c]', [[(False, "p", (), "", (("x", "*=", "a b"), ("y", "=", "c")))]])])
def test_selectors_are_parsed(selector, paths):
    assert [[tuple(t) for t in path] for path in S.parse(selector)] == paths


@pytest.mark.parametrize("selector", ["", " ", "a >", "> a", "a,", "a > > b", "a[", "a:hover", ",a"])
def test_what_is_no_selector_is_refused(selector):
    with pytest.raises(ValueError):
        S.parse(selector)


def test_the_automaton_agrees_with_testing_every_element(spark):
    import random

    rng = random.Random(5)
    selectors = [".a .b > i", "p > .a, i[x*=u] b", "#k i", "b b", "*", "p p > p", "i[x^=u]", ".a.b", "b > *", ".a > .a > .b"]

    def fits(chain, path):
        if not path[-1].fits(chain[-1][0], frozenset(chain[-1][1].get("class", "").split()), chain[-1][1].get("id", ""), chain[-1][1]):
            return False
        if len(path) == 1:
            return True
        tops = [chain[:-1]] if path[-1].child else [chain[:n] for n in range(1, len(chain))]
        return any(t and fits(t, path[:-1]) for t in tops)

    for _ in range(60):
        automaton, chain, state = S.Automaton(selectors), [], 0
        for _ in range(7):
            attrs = {n: v for n, v in (("class", rng.choice(["", "a", "b", "a b"])), ("id", rng.choice(["", "k"])), ("x", rng.choice(["", "u", "vu"]))) if v}
            chain.append((rng.choice("pib"), attrs))
            matched, state = automaton.step(state, *chain[-1])
            assert list(matched) == [n for n, s in enumerate(selectors) if any(fits(chain, p) for p in S.parse(s))]


def test_cards_lie_in_cards_and_sites_without_rules_have_none(spark):
    rules = spark.createDataFrame([("s", 0, ".c", "t", ".t", "", 0, False, "none", []), ("s", 0, ".c", "all", ".t", "", 0, True, "", []), ("s", 0, ".c", "id", "", "id", 0, False, "", []),
                                   ("s", 0, ".c", "w", "", "", 0, False, "", ["zwei"])],
                                  "site string, card int, card_sel string, field string, sel string, attr string, nth int, every boolean, fallback string, words array<string>")
    html = "<div class='c' id='1'>eins<div class='c' id='2'><b class='t'>a</b> Zwei  drei</div><b class='t'>b</b></div><b class='t'>out</b><div class='c'>x"
    pages = page(spark, html).withColumn("site", F.lit("s")).unionByName(page(spark, html).withColumn("site", F.lit("other")))
    rows = [(r.pos, r.t, r["all"], r.id, r.w, r.no) for r in PG.extract_cards(pages, rules, ["t", "all", "id", "w", "no"]).collect()]
    assert sorted(rows) == [(0, "a", "a,b", "1", "Zwei drei", ""), (1, "a", "a", "2", "Zwei drei", ""), (2, "none", "", "", "", "")]


def test_every_site_has_rules_and_the_notice_blocks_are_found(spark):
    html = "<div data-bs-target='#offcanvas3'><b class='advtHeading'>7</b><p>Selection of Scientist B</p></div><div data-bs-target='#x'></div>"
    row = PG.extract_cards(page(spark, html).withColumn("site", F.lit("rac")), dims.card_rules(spark), ["target", "number", "summary"]).collect()
    assert [(r.target, r.number, r.summary) for r in row] == [("#offcanvas3", "7", "Selection of Scientist B")]
    assert {r.site for r in dims.card_rules(spark).collect()} == {site for site, *_ in K.CARD_SELECTORS}


def test_tokens_and_cuts_take_linear_time(spark):
    import time

    from jobmill.functions.html import tokenize_page

    def seconds(n):
        start = time.process_time()
        rows = tokenize_page("<p>x" * n + "</i></p>" * n)
        assert len(rows) == 3 * n and rows[0][1] == 3 * n - 1
        return time.process_time() - start

    seconds(1000)
    assert seconds(32_000) < 3 + 40 * seconds(4_000)
    page = "<div>" + "<i>a<i>b</i></i><u>c</u>" * 8_000 + "</div>"
    start = time.time()
    df = spark.createDataFrame([(page,)], "html string").select(H.tokenize("html").alias("t"))
    got = df.select(H.text_of(H.without(F.col("t"), H.spans(F.col("t"), lambda t: t.tag == "i")), "").alias("x")).first().x
    assert got == "c" * 8_000 and time.time() - start < 30


def test_tokens_are_made_some_pages_at_a_time():
    import pyarrow as pa

    from jobmill.functions import html as H

    pages = pa.array([f"<p>{i}<b>x</b></p>" for i in range(200)] + [None, "<i>" + "y" * 2 * H.STEP_CHARS, "z"])
    steps = list(H._steps(pages))
    assert max(len(s) for s in steps) <= H.STEP_PAGES and len(steps) > 3 and pa.concat_arrays(steps) == H._tokenize_slice(pages)
    assert list(H._steps(pages.slice(0, 0))) == []
