"""Main text and URL verdicts."""

import re
import time

import pytest
from pyspark.sql import functions as F

from civicpulse.llm.htmltext import extract_main_text, main_text
from civicpulse.llm.urls import host_of, judge_urls, lexical_values, path_of, rule_for

FURNISHED = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many of them, on every page.</p></div>
<article><h1>Head &amp; title</h1><p>First   paragraph, with
commas, and enough words to count.</p><div class="ad">Buy, buy, buy now, cheap and good offers here.</div>
<p>Second <b>bold</b><br>line &lt;kept&gt;.</p><section id="comments"><p>A reader says this, that, and more than that.</p></section>
<form><p>Sign up, please, with your name and your address.</p></form></article>
<aside><p>Side text, long, with commas, that is not the article.</p></aside><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        (FURNISHED, "Head & title\n\nFirst paragraph, with commas, and enough words to count.\n\nSecond bold line <kept>."),
        ("<body><nav>Menu</nav><article><p>un.</p></article></body>", "un."),
        ("<article><h1>T<p>One <b>bold<p>Two</b> three<ul><li>a<li>b</ul>", "T\n\nOne bold\n\nTwo three\n\na\n\nb"),
        ("just text", "just text"),
        ("<p>a < b</p><p title='x>y'>z</p>", "a < b\n\nz"),
        ("<script>var t = '</p>';</script><p>x</p><!-- <p>no</p> -->", "x"),
        ("<body><div class=post>Loose text, with commas, that is long enough.<p>More of it, in a paragraph, that is long.</p></div></body>",
         "Loose text, with commas, that is long enough.\n\nMore of it, in a paragraph, that is long."),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_link_lists_lose_against_prose():
    links = "".join(f"<li><a href=/{i}>A headline, with a comma, number {i}</a></li>" for i in range(40))
    page = f"<body><div><ul>{links}</ul></div><div><p>The text, as such, is here and long enough.</p><p>It goes on, and ends, here.</p></div></body>"
    assert main_text(page) == "The text, as such, is here and long enough.\n\nIt goes on, and ends, here."


@pytest.mark.parametrize("page", ['<p class="' * 20000, '<a "' * 50000, "<div>" * 30000 + "x, y, z, a long text is here", "</b>" * 50000, "<script" * 30000])
def test_hostile_pages_end_soon(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 10


def test_pages_table(spark):
    pages = spark.createDataFrame(
        [(1, "u", FURNISHED, "clash"), (2, None, None, "clash"), (2, None, None, "clash"), (3, "v", "", None)],
        "page_id bigint, url string, html string, text string",
    )
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 4
    assert {r.page_id: r.text for r in got.collect()}[2] == ""
    assert extract_main_text(pages.limit(0)).count() == 0


def test_article_blocks_of_the_tables(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
        import html

        want = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        assert main_text(r.html) == "\n\n".join(w for w in want if w)


URLS = [
    (1, "http://A.Example.net/en/x?y=1#z"), (2, "https://example.com/de/"), (3, "https://notexample.com/de/"),
    (4, "http://x.org/fr/a"), (5, "http://x.org"), (6, "http://x.net"), (7, None), (8, "no scheme"), (9, ""),
    (10, "http://x.net/?a=http://y.org/fr/"), (11, "https://casino.example.org/a"), (11, "https://casino.example.org/a"),
]


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame(URLS, "page_id bigint, url string")
    url = F.col("url")
    rule, verdict = rule_for(host_of(url), path_of(url))
    got = {r.page_id: (r.h, r.p, r.r, r.v) for r in frame.select(
        "page_id", host_of(url).alias("h"), path_of(url).alias("p"), rule.alias("r"), verdict.alias("v")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[3] == ("notexample.com", "/de/", None, None)
    assert got[4][2:] == ("org/fr/", "allow") and got[5] == ("x.org", "", None, None) and got[6] == ("x.net", "", None, None)
    assert got[7] == got[8] == got[9] == ("", "", None, None)
    assert got[10] == ("x.net", "/", "net/", "block")


def test_lexical_values():
    values = lexical_values("http://a-b.example.com/x/y?p=1&q=%20", "a-b.example.com", "/x/y")
    assert values[0] == 36 and values[3] == 2 and values[4] == 3 and values[6] == 1 and values[9] == 2
    assert lexical_values(None, "", "")[0] == 0


def test_verdicts(spark):
    frame = spark.createDataFrame(URLS, "page_id bigint, url string")
    got = judge_urls(frame).collect()
    assert len(got) == len(URLS) and {r.verdict for r in got} <= {"allow", "block"}
    assert judge_urls(frame.limit(0)).count() == 0
    one_class = judge_urls(frame, labelled=frame.select("url", F.lit(0).alias("label")))
    assert {r.verdict for r in one_class.where("rule IS NULL").collect()} == {"allow"}


def test_trees_on_held_out_urls(spark):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        host = f"{'cheap-pills-24' if bad else 'news'}{i % 23}.example.org"
        rows.append((i, f"https://{host}/{'a1b2/' * 3 if bad else 'story/'}{i}{'?x=1&y=2' if bad else ''}", int(bad)))
    frame = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    known = frame.where("page_id % 2 = 0 OR page_id % 3 = 0")
    judged = judge_urls(frame.where("page_id % 2 = 1 AND page_id % 3 > 0").unionByName(frame.where("page_id % 8 = 4")), known)
    rated = judged.join(frame.withColumnRenamed("page_id", "id"), "id").collect()
    assert sum((r.verdict == "block") == (r.label == 1) for r in rated) / len(rated) > 0.95


ARTICLE = "<p>The text, as such, is here and long enough.</p><p>It goes on, and ends, here.</p>"
ARTICLE_TEXT = "The text, as such, is here and long enough.\n\nIt goes on, and ends, here."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><div data-props='{'<p>{},</p>' * 3000}'>{ARTICLE}</div></article>", ARTICLE_TEXT),
        (f"<article><div data-props=\"{'a > b, ' * 3000}\">{ARTICLE}</div></article>", ARTICLE_TEXT),
        (f"<article><div {' '.join(f'a{i}=x' for i in range(900))}>{ARTICLE}</div></article>", ARTICLE_TEXT),
        (f"<article><script data-x='{'y>' * 5000}'>var p = '<p>no</p>';</script><!DOCTYPE {'x' * 9000}>{ARTICLE}</article>", ARTICLE_TEXT),
        (f"<article>{'<div>' * 600}{ARTICLE}<nav><div>Deep menu</div></nav><p hidden>No.</p>{'</div>' * 600}<p>Last, of all.</p></article>",
         f"{ARTICLE_TEXT}\n\nLast, of all."),
    ],
)
def test_no_length_or_depth_is_too_much(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<a " + 'x="<a " ' * 50000, "<a x='" + '<a x="' * 50000, "<b>" + "<div>" * 30000 + "</b>" * 30000, "<i" * 50000])
def test_more_hostile_pages_end_soon(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 10


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><div class="content has-sidebar">{ARTICLE}</div></body>', ARTICLE_TEXT),
        (f'<body><div id="page" class="no-comments"><article>{ARTICLE}</article></div></body>', ARTICLE_TEXT),
        (f'<body><div class="content-with-sidebar">{ARTICLE}</div><div class="sidebar"><p>Side, text.</p></div></body>', ARTICLE_TEXT),
        (f'<body><div class="sidebar-page"><article>{ARTICLE}</article></div></body>', ARTICLE_TEXT),
        (f'<article><h2 id="related-work">Related</h2>{ARTICLE}<section id="search-and-retrieval"><h3 id="social-impact">Impact</h3>'
         '<p>Of it.</p></section><section id="comments"><p>A reader, too.</p></section></article>',
         f"Related\n\n{ARTICLE_TEXT}\n\nImpact\n\nOf it."),
    ],
)
def test_names_alone_do_not_cut_the_article(page, text):
    assert main_text(page) == text
    # However deep the page lies.
    for depth in (480, 510, 700, 5000):
        assert main_text("<body>" + "<div>" * depth + page + "</div>" * depth) == text


FORM = '<form action="/find"><label>Find</label><input><fieldset><p>Choose, now.</p></fieldset></form>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><form id="aspnetForm"><div class="main">{ARTICLE}</div>{FORM}</form></body>', ARTICLE_TEXT),
        (f'<body><form role="form"><article>{ARTICLE}{FORM}</article></form></body>', ARTICLE_TEXT),
        (f"<article>{FORM}{ARTICLE}<form><p>Subscribe, please, to this.</p><button>Go</button></form></article>", ARTICLE_TEXT),
        (f"<body><form><div>{'Plain text, without paragraphs. ' * 9}</div></form></body>", ("Plain text, without paragraphs. " * 9).strip()),
        (f"<article>{ARTICLE}<p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", f"{ARTICLE_TEXT}\n\nWhere x=1 holds."),
    ],
)
def test_forms_are_judged_by_what_they_hold(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 50_000 + "<p>x</p>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<div><li>x" * 30_000,
        "<ul>" * 20_000 + "<li>x</li>" * 20_000, "<div>some text of a page, long enough to count" * 20_000,
    ],
)
def test_deep_pages_end_soon(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 10
