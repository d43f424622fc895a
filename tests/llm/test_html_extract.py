import pytest

from loglake.llm import html_extract as H

LONG = "This is a rather long sentence, with commas, that tells a story about many things, one after the other."


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("plain text only", "plain text only"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p><b>open<br>line</b></article><footer>no</footer>", f"T & U\n{LONG}\nopen line"),
    (f"<div id=main><p>{LONG}</p><p>two</p></div><div class='sidebar'><p>{LONG}</p></div>", f"{LONG}\ntwo"),
    (f"<div class=post><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div><form>x</form>", LONG),
    (f"<article><header><h1>Head</h1></header><p>{LONG}</p><div class='ad'>buy</div><ul><li>one<li>two</ul></article>", f"Head\n{LONG}\none\ntwo"),
    (f"<article><section><p>{LONG}</p></section><section><p>short</p></section></article><aside>z</aside>", f"{LONG}\nshort"),
    (f"<header>top</header><script>var a='<p>x</p>';</script><style>p{{}}</style><!-- <p>c</p> --><p>{LONG}</p>", LONG),
    (f"<table><tr><td>{LONG}<td>cell</table>", f"{LONG}\ncell"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>&#233;&nbsp;&lt;b&gt;\n\t x</p>", "é <b> x"),
])
def test_cases(html, want):
    assert H.extract(html) == want


@pytest.mark.parametrize(("html", "want"), [
    (f"<div class=story><h1>Title</h1><p>Lead</p><div class=body>{f'<p>{LONG}</p>' * 5}</div><p>End</p></div>", ["Title", "Lead", *[LONG] * 5, "End"]),
    (f"<div><a href=x>Home</a> <a href=y>News</a></div><h1>Title</h1><div><div><pre>code</pre>{f'<p>{LONG}</p>' * 5}</div><div><p>last</p></div></div>"
     "<ul><li><a href=z>Elsewhere</a></li></ul><div class=footer>no</div>", ["Title", "code", *[LONG] * 5, "last"]),
])
def test_pages_without_article(html, want):
    assert H.extract(f"<body>{html}</body>").split("\n") == want


def test_deep_and_long_pages():
    assert H.extract("<div>" * 5000 + f"<p>{LONG}") == LONG
    text = H.extract("<article>" + "<p>word, word</p>" * 20_000 + "</article>")
    assert text.count("\n") == 19_999


def test_whole_table(spark, sf):
    pages = {x["page_id"]: x["html"] for x in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op9_html_extract(spark, sf).collect()
    assert {x["page_id"] for x in got} == set(pages) and all(x["n_chars"] == len(x["text"]) for x in got)
    import html
    import re

    for x in got:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[x["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split("<p>|</p>|</h1>", inner)]
        assert x["text"].split("\n") == [b for b in blocks if b]


def test_nulls_repeats_and_empty_table(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, f"<p>{LONG}</p>", "x"), (1, None, f"<p>{LONG}</p>", "x"), (None, "u", None, "x")]
    got = sorted(map(tuple, H.extract_pages(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, None, LONG, len(LONG)), (1, None, LONG, len(LONG)), (None, "u", "", 0)], key=str)
    assert H.extract_pages(spark.createDataFrame([], schema)).count() == 0


STORY = "A long paragraph of the story, with commas, and with enough words in it to be found at once by its length. " * 3


@pytest.mark.parametrize("html,want", [
    ('<div class="content has-sidebar"><p>{0}</p></div>', ["{0}"]),
    ('<div id=page class="no-ads layout"><h1>T</h1><p>{0}</p></div>', ["T", "{0}"]),
    ('<div class="page-with-sidebar"><p>{0}</p><div class="sidebar">more links here</div></div>', ["{0}"]),
    ('<article><header class="entry-header"><h1>Title</h1></header><p>{0}</p></article>', ["Title", "{0}"]),
    ('<div class="post-header"><h1>Title</h1></div><div><p>{0}</p><p>{0}</p></div>', ["Title", "{0}", "{0}"]),
    ('<body><h1>Title</h1><p>Lead text.</p><article><p>{0}</p></article><div class="share">Share</div></body>', ["Title", "Lead text.", "{0}"]),
    ('<body><article><p>{0}</p></article><article><p>Short one.</p></article></body>', ["{0}", "Short one."]),
    ('<body><div><p>{0}</p><p>{0}</p></div><div><a href=x><div>Card one here</div></a><a href=y><div>Card two here</div></a></div></body>', ["{0}", "{0}"]),
    ('<body><article><p>{0}</p></article><div class="cookie-notice"><p>{0}</p><p>{0}</p></div></body>', ["{0}"]),
    ('<div class="sidebar-layout"><div><p>{0}</p><p>{0}</p></div></div>', ["{0}", "{0}"]),
])
def test_probes(html, want):
    text = " ".join(STORY.split())
    assert H.extract(html.replace("{0}", STORY)).split("\n") == [w.replace("{0}", text) for w in want]


def test_deep_pages_take_linear_time():
    import time

    took = []
    for depth in (5_000, 40_000):
        html = "<div>" * depth + f"<p>{STORY}</p>" + "</div>" * depth + "</section>" * depth
        start = time.time()
        assert H.extract(html) == " ".join(STORY.split())
        took.append(time.time() - start)
    assert took[1] < 30 * took[0] + 1, took


def test_unclosed_links_end():
    assert H.extract(f"<article><p>See <a href=x>this<p>{STORY}</p><p>{STORY}</p></article>").count("A long paragraph") == 6
