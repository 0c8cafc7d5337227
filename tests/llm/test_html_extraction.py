import pytest

from motion_tables.llm import html_extraction as H
from motion_tables.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import same

PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body><header>Top</header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="sidebar">Side</div><div class="ad">Buy {i}</div><article><h1>Head &amp; {i}</h1><p>First <b>bold</b>
text&nbsp;{i}<p>Second &lt;{i}&gt;<ul><li>item {i}</li></ul><form><input>Name</form><div class="comments"><p>Nice {i}</p></div></article><footer>&copy; site</footer></body></html>"""


def texts(spark, pages, **how):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r for r in H.extract_main_text(df, **how).collect()}


def test_same_as_sql(spark):
    for folder in ("sf0.001", "sf0.01"):
        same(spark, f"/root/testdata/{folder}", QUERIES["op10_html_extraction"], ORACLE_SQL["op10_html_extraction"])


def test_article_without_the_rest(spark):
    got = texts(spark, [(i, f"http://h.org/{i}", PAGE.format(i=i)) for i in range(8)])
    for i, r in got.items():
        assert r.text == f"Head & {i}\nFirst bold text {i}\nSecond <{i}>\nitem {i}"
        assert r.frame_tokens > 10 and r.slots >= 1


def test_template_text_goes_where_no_article_is_marked(spark):
    page = "<body><div><p>Welcome to our site</p></div><div><p>Story {i} begins</p><p>and ends {i}</p></div><div><span>All rights reserved</span></div></body>"
    got = texts(spark, [(i, "http://h.org", page.format(i=i)) for i in range(8)])
    assert got[3].text == "Story 3 begins\nand ends 3"
    alone = texts(spark, [(1, "http://h.org", page.format(i=1))])
    assert alone[1].text.startswith("Welcome to our site\nStory 1 begins")


def test_template_text_goes_inside_an_article(spark):
    bar = "<div><span>Share this story</span></div>"
    page = "<body><article><h1>Story {i}</h1>" + bar + "<p>It begins {i} here</p><div>Written by the staff of our house, who you can reach by mail</div><p>Ends {i}</p>" + bar + "</article></body>"
    got = texts(spark, [(i, "http://h.org", page.format(i=i)) for i in range(8)])
    assert got[3].text == "Story 3\nIt begins 3 here\nEnds 3" and got[3].slots == 3
    copies = texts(spark, [(i, f"http://h.org/?from={i}", page.format(i=1)) for i in range(8)])  # of one page, from which no template is known
    assert copies[3].text.startswith("Story 1\nShare this story\nIt begins 1 here")


def test_template_words_count_only_where_the_template_has_them():
    tokens, _ = H.parse("<p>a<p>b<p>c")
    a, b, c = (tokens[i] for i in (1, 3, 5))
    frame = {a: 0, b: 1}
    assert H.extract("<p>b<p>x<p>a", frame, {})[0] in ("x\na", "b\nx")  # out of order: one of them is data
    assert H.extract("<p>c<p>a<p>c<p>b<p>c", frame, {c: 2})[0] == "c\nc"  # nested in the last slot only


@pytest.mark.parametrize("wrap", ['<div class="layout no-sidebar">{}</div>', '<div id="page" class="has-sidebar">{}</div>', '<div class="banner">{}</div>', '<div class="x"><div id="search">{}</div></div>'])
def test_names_close_no_element_that_holds_the_article(wrap):
    page = wrap.format('<p>Out</p><article><div class="article-header"><h1>Head</h1></div><p>Text</p><section class="related-work">Work</section><div class="social-science">Field</div><div class="share-buttons">Post it</div></article>')
    assert H.extract(page, {}, {})[0] == "Head\nText\nWork\nField"


def test_names_still_close_what_is_beside_the_article():
    page = '<div class="sidebar ad">Buy</div><article>Text</article><div id="comments"><article class="comment">Nice</article></div>'
    assert H.extract(page, {}, {})[0] == "Text"
    assert H.extract('<div class="site-header">Top</div><p>Text</p><div class="cookie-notice-2">We use</div><div class="no-menu">More</div>', {}, {})[0] == "Text\nMore"


def test_classes_are_tokens_of_equal_occurrences(spark):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", f"<body><article>{'<p>x' * (i % 3 + 1)}</article></body>") for i in range(9)], "page_id long, url string, html string")
    tokens, _ = H.parse("<body><article><p>x</article></body>")
    from pyspark.sql import functions as F

    kind = "host long, token long, pages long, times long, sum1 long, sum2 long, place double"
    tallied = df.select(F.lit(1).cast("long").alias("host"), "page_id", "html").mapInArrow(H._tally, kind)
    t = H.templates(tallied, ["host"], 5, 0.9, 2).first()
    once = {tokens[k] for k in (0, 1, 4, 5)}
    assert {x & (2**64 - 1) for x in t.frame} == once and len(t.nested) == 2


STORY = "<h1>A story</h1><p>It was a long day in the small town, and nobody knew why.</p><p>Then it rained.</p>"
TOLD = "A story\nIt was a long day in the small town, and nobody knew why.\nThen it rained."


def test_copies_of_one_story_keep_it(spark):
    page = "<body><div>visit {i}</div><article>" + STORY + "</article><div>seen {i} times</div></body>"
    got = texts(spark, [(i, f"http://h.org/{i}", page.format(i=i)) for i in range(6)])
    assert {r.text for r in got.values()} == {TOLD}


def test_headings_that_stories_share_stay(spark):
    page = "<body><p>Our site</p><article><h1>Story {i}</h1><h2>Summary</h2><p>In short {i} of it</p><h2>Background</h2><p>At length {i} more</p></article></body>"
    got = texts(spark, [(i, f"http://h.org/{i}", page.format(i=i)) for i in range(6)])
    assert got[4].text == "Story 4\nSummary\nIn short 4 of it\nBackground\nAt length 4 more"


REMARK = '<section id="comments"><article class="comment-body"><p>I like this very much</p></article></section>'
TEASER = '<article><h3><a href="/x">Another story</a></h3></article>'


@pytest.mark.parametrize("html,text", [
    (f'<form id="aspnetForm"><div class="menu">Home</div><article>{STORY}</article></form>', TOLD), (f"<nav><ul><li>Home</ul><article>{STORY}</article>", TOLD), (f'<div class="story">{STORY}</div>{REMARK}', TOLD),
    (f'<article>{STORY}<article class="comment"><p>I like this</p></article></article>', TOLD), (f'<div class="story">{STORY}</div>{TEASER}', TOLD), (f'<form><div>{STORY}</div></form>', TOLD), (f"<article>{STORY}</article>{REMARK}", TOLD),
    (f'<article class="post comments-open">{STORY}</article><aside>More</aside>', TOLD), (f"<main><article>{STORY}</article>{REMARK}</main>", TOLD), (f'<article>{STORY}<div class="comments"><article><p>Mine</p></article></div></article>', TOLD),
    (f"<article>{STORY}<form><p>Your name</p></form></article>", TOLD), (f'<header><nav>Home</nav></header><div id="content">{STORY}</div><footer>Us</footer>', TOLD),
])
def test_layouts(html, text):
    assert H.extract(f"<body>{html}</body>", {}, {})[0] == text


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain &amp text", "plain & text"), ("<p>a<br>b</p>c", "a b\nc"), ("<p>cut <b", "cut"), ("<!-- x", ""), ("a < b", "a < b"), ("<script>x", ""), ('<p title="a>b">t</p>', "t"), ("<article>x</article>y", "x")])
def test_small_pages(spark, html, text):
    r = texts(spark, [(1, None, html)])[1]
    assert r.text == text


def test_edges(spark):
    rows = [(None, None, None), (1, "not a url", PAGE.format(i=1)), (1, "not a url", PAGE.format(i=1)), (2, "http://a", "<p>" + "word " * 200_000)]
    got = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = H.extract_main_text(got).collect()
    assert len(out) == 4 and len({r.text for r in out if r.page_id == 1}) == 1 and len(next(r.text for r in out if r.page_id == 2)) == 999_999
    assert H.extract_main_text(got.limit(0)).count() == 0
    assert H.extract_main_text(got, most_broadcast=-1).count() == 4
