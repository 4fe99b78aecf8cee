from __future__ import annotations

import re
import time
from html import unescape

import pytest

from millrace.llm import html_text, queries

FOLDER = "/root/testdata/sf0.001"
PAGE = "page_id bigint, url string, html string, text string, nodes int"


def plain(html):
    return html_text.main_text(html, {}, {})


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a  b\n c</p><p>d</p>", "a b c d"),
        ("<p>one<b>two</b> <i>three</i><br>four", "onetwo three four"),
        ("<article><h1>T &amp; t&eacute;</h1><p>x &lt;b&gt; &#233;&nbsp;y</p></article>", "T & té x <b> é y"),
        ("<nav>menu</nav><div class='Main-Sidebar x'>side</div><p>body</p><footer>foot</footer>", "body"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>x</p></article>", "Title x"),
        ("<script>var a='</p>';</script><style>p{}</style><!-- c <p>no</p> --><p>x</p>", "x"),
        ("<div id=cookie-notice>we</div><form><p>name</p></form><div role=navigation>n</div><p>x</p>", "x"),
        ("<div class=comments><p>first!</p></div><div class=ad-slot>buy</div><div hidden>h</div>x", "x"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<p title='a > b'>x</p><a href=\"y>z\">w</a>", "x w"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>cut off <b>here <i", "cut off here"),
        ("<p>x</p><a href='y", "x"),
        ("<p>x <!-- open <p>no</p>", "x"),
        ("<p>x</p><!DOCTYPE y", "x"),
        ('<p class="a>x</p><p>y</p>', "x y"),
        ("<p>x</é>y<![CDATA[z]]>", "xyz"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "a b c d"),
        ("<textarea>t<p>x", "t x"),
        ("", ""),
        ("<p>" * 3000 + "deep", "deep"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article><p>shadow readers adhere</p></article>", "shadow readers adhere"),
    ],
)
def test_pages_alone(html, text):
    assert plain(html) == text


def site(n, body):
    return [(i, f"https://Site.example:8080/{i}", body(i), "t", 0) for i in range(n)]


def test_branches_alike_on_all_pages_go(spark):
    def body(i):
        stories = "".join(f"<p>story {i} part {k}</p>" for k in range(1 + i % 5))
        return f"<body><div class=top><div>Big Shop</div><div>call us</div></div><div class=story>{stories}</div><div class=base>made by us</div></body>"

    rows = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(site(40, body), PAGE)).collect()}
    assert rows == {i: " ".join(f"story {i} part {k}" for k in range(1 + i % 5)) for i in range(40)}


def test_copied_articles_stay(spark):
    pages = site(60, lambda i: "<body><nav>m</nav><article><h1>Same</h1><p>everywhere</p></article><footer>f</footer></body>")
    assert {r.text for r in html_text.extract(spark.createDataFrame(pages, PAGE)).collect()} == {"Same everywhere"}


def test_registered_query_against_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = queries.op6_html_text(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.DOTALL)[1]
        assert r.text == " ".join(unescape(re.sub(r"<[a-z/][^>]*>", " ", article)).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_input(spark):
    rows = [(1, None, None, "t", 0), (2, "http://h/", "", "t", 0), (None, "no url", "<p>x", "t", 0), (3, "", "<p>x</p>", "t", 0), (3, "", "<p>x</p>", "t", 0), (4, "//h", "<p>" + "y " * 100_000, None, None)]
    pages = spark.createDataFrame(rows, PAGE)
    got = sorted(((r.page_id or 0), len(r.text), r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (4, 199_999, 199_999)]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<html class="no-js nav-open"><body class="has-sidebar cookie-bar-on"><p>x</p>', "x"),
        ('<article class="post comments-open"><p>x</p></article>', "x"),
        ('<div class="page has-header"><p>x</p></div>', "x"),
        ('<main class="with-navigation"><p>x</p></main>', "x"),
        ('<div id="sidebar-layout">a<div class="widget"><article><p>x</p></article></div><div class="widget">w</div></div>', "a x"),
        ('<article><p>x</p></article><div class="comments"><article class="comment"><p>first!</p></article></div>', "x"),
        ('<p class="left-ad-hoc">x</p><div class="site-footer2">f</div>', "x"),
    ],
)
def test_names_of_the_layout_are_no_names_of_a_branch(html, text):
    assert plain(html) == text


def test_varied_content_overrules_a_name(spark):
    def body(i):
        stories = "".join(f"<p>story {i} part {k}</p>" for k in range(1 + i % 5))
        return f"<body><div class=top>Big Shop</div><div class=widget>{stories}</div><div class=sidebar><p>made by us</p></div></body>"

    rows = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(site(40, body), PAGE)).collect()}
    assert rows == {i: " ".join(f"story {i} part {k}" for k in range(1 + i % 5)) for i in range(40)}


def test_deep_branches_and_many_paths_have_their_own_nodes(spark):
    deep = "<div>" * 40

    def body(i):
        return f"<body>{deep}<div class=text><p>story {i}</p></div><div class=base><p>made by us</p></div>"

    rows = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(site(40, body), PAGE)).collect()}
    assert rows == {i: f"story {i}" for i in range(40)}
    many = "".join(f"<div class='{'x' * (k % 700)} {'y' * (k // 700)}'></div>" for k in range(100_000))
    assert len({node for node, _ in html_text.parse(many)[1]}) == 100_000


@pytest.mark.parametrize("tag", ["article", "main", "div role=main"])
def test_text_on_all_pages_goes_from_articles_too(spark, tag):
    def body(i):
        stories = "".join(f"<p>story {i} part {k} of a longer text</p>" for k in range(2 + i % 5))
        return f"<body><{tag}><h1>Title {i}</h1><div class=box>Join our list</div>{stories}<p>Made by us</p></{tag.split()[0]}>"

    copy = "<body><article><h1>Copy</h1><p>Everywhere the same long text</p><p>Made by us</p></article>"
    pages = site(40, body) + [(100 + i, "http://copies.example/", copy, "t", 0) for i in range(40)]
    rows = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, PAGE)).collect()}
    want = {i: " ".join([f"Title {i}", *(f"story {i} part {k} of a longer text" for k in range(2 + i % 5))]) for i in range(40)}
    assert rows == want | {100 + i: "Copy Everywhere the same long text Made by us" for i in range(40)}


MB = 1 << 20


@pytest.mark.parametrize(
    "unit",
    ["<a ", '<a b="', "<a b='", "<blockquote>", "<!", "<!--", "</x ", "<svg>", "<script ", "<textarea></textarea ", "<p>", "<div></p>", "<b>",
     "<ul><blockquote><li></li>", "<li><blockquote>", "<div class=ad>", '<div class="ad"><p>x</p>', "<div class=ad><main>x", "<article><div class=ad>x", "< ", "<=\"", "<a =  "],
)
def test_a_megabyte_of_broken_markup_takes_seconds(unit):
    start = time.time()
    plain("<p>x</p>" + unit * (MB // len(unit)))
    assert time.time() - start < 30  # seconds on a machine of its own


def test_names_of_topics_are_left_to_the_tree(spark):
    names = ("share-price", "reply-letter", "notice-of-appeal", "related-work", "social-proof-study")
    page = "<main><p>start</p>" + "".join(f"<div class={n}>about {n}</div>" for n in names) + "<div class=share-buttons>tell</div><div class=post-comments>me</div></main>"
    assert plain(page) == "start " + " ".join(f"about {n}" for n in names)

    def body(i):
        return f"<body><main><h1>Title {i}</h1><div class=share-price>price {i} of the day</div><div class=related-work>the same words</div><p>text {i} {i * 7}</p></main>"

    rows = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(site(40, body), PAGE)).collect()}
    assert rows == {i: f"Title {i} price {i} of the day text {i} {i * 7}" for i in range(40)}
