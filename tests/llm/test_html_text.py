import re
from html import unescape

import duckdb
import pytest

from sparkomics.llm import html_text

CASES = {
    "": "",
    "plain words only": "plain words only",
    "<article><h1>T &amp; U</h1><p><b>First\n  line<br>second<p>Next &lt;p&gt; é&nbsp;x</article><footer>no</footer>": "T & U\nFirst line second\nNext <p> é x",
    "<nav>m</nav><main><p>" + "long text " * 20 + "</p><div class='comments'><p>reader says</p></div></main><aside>s</aside>": ("long text " * 20).strip(),
    "<header>site</header><article><header><h1>Title</h1></header><p>Body.</p><div class='ad'>buy</div><ul><li>one<li>two</ul><form>f<input></form></article>": "Title\nBody.\none\ntwo",
    "<article><p>cut off in the middle <a href='x": "cut off in the middle",
    "<script>var t='</p><article>';</script><p hidden>x</p>": "",
    "<div id='cookie-notice'>We use</div><article><p>A<script>x()</script>B</p></article><div role='navigation'>m</div>": "AB",
    "<main><article><p>kept</p></article><p>teaser outside</p></main>": "kept",
    "<article><p>if a <b is less than the rest of it": "if a <b is less than the rest of it",
    "<article><p class='social'>We share a comment on search.</p><h2 id='related'>Related</h2><div class='widget'>w</div></article>": "We share a comment on search.\nRelated\nw",
    "<article><p>text</p><div class='comments'><p>reader says</p></div><section id='newsletter'>join</section></article>": "text",
    "<div><div><p>" + "long text " * 20 + "</p><p>Yes.</p><p>No.</p><p>Why?</p><p>Then.</p><p>Ok.</p><p>Fine.</p><p>" + "long text " * 20 + "</p><p>End.</p></div><div>teaser</div></div>": "\n".join([("long text " * 20).strip(), "Yes.", "No.", "Why?", "Then.", "Ok.", "Fine.", ("long text " * 20).strip(), "End."]),
}


@pytest.mark.parametrize("html", list(CASES))
def test_pages(html):
    assert html_text.main_text(html) == CASES[html]


def test_regions_without_semantic_elements():
    body = "".join(f"<div>{'Sentence of the story, with words in it. ' * 6}</div>" for _ in range(6))
    menu = "".join(f"<div><a href='/{i}'>item {i}</a></div>" for i in range(12))
    got = html_text.main_text(f"<body>{menu}<h2>Head</h2>{body}{menu}</body>")
    assert got.count("story") == 36 and "item 3" not in got and "Head" in got


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in html_text.op4_html_text(spark, path).collect()}
    for i, url, html in duckdb.sql(f"select page_id, url, html from '{path}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1])
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        want = "\n".join(w for w in want if w)
        assert got[i].text == want and got[i].url == url and got[i].n_chars == len(want)


def test_whole_table_without_articles(spark):
    """The same pages with the article as one more div: the clusters alone lead to it."""
    path = "/root/testdata/sf0.001"
    for (html,) in duckdb.sql(f"select html from '{path}/pages.parquet'").fetchall():
        want = html_text.main_text(html)
        assert html_text.main_text(html.replace("<article>", "<div>").replace("</article>", "</div>")) == want


def test_the_clusters_choose(monkeypatch):
    story = "".join(f"<p>{'Sentence of the story, with words in it. ' * 6}</p>" for _ in range(4))
    links = "".join(f"<div><a href='/{i}'>item {i}</a></div>" for i in range(8))
    html = f"<body><div>{links}<p>short</p></div><section><div>{story}</div><p>tail of the story</p></section><div>{links}</div></body>"
    got = html_text.main_text(html)
    assert got.count("Sentence") == 24 and "item" not in got and "short" not in got
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: ratios * 0)
    assert html_text.main_text(html) == ""
    flat = f"<body>{links}{story}<p>tail of the story</p>{links}</body>"
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: ratios)
    assert "tail" not in html_text.main_text(flat)
    monkeypatch.undo()
    assert html_text.main_text(flat).endswith("tail of the story")


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (1, "u", None, "x"), (2, "v", "", "x"), (3, "w", "<article>" + "<p>word " * 20_000, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), len(r.text)) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("3", 99_999), ("None", 1)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("count,size", [(4, 4), (8, 4), (5, 20), (5, 40), (30, 10)])
def test_short_lines_inside_pages_of_divs(count, size):
    menu = "".join(f"<div><a href='/{i}'>item {i}</a></div>" for i in range(12))
    long = "".join(f"<p>{'Sentence of the story, with words in it. ' * 6}</p>" for _ in range(5))
    short = [f"{k:02d}".ljust(size, "x") for k in range(count)]
    items = "".join(f"<li>{x}</li>" for x in short)
    notice = "<div class='ad'>buy this now</div>"
    got = html_text.main_text(f"<body>{menu}<div>{long}<ul>{items}</ul>{notice}{long}</div>{menu}</body>").split("\n")
    assert [x for x in got if x in short] == short and "buy this now" not in got and "item 3" not in got and sum("story" in x for x in got) == 10
