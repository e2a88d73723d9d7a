from __future__ import annotations

import html
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.llm import html_extract as H
from tagloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
STORY = "The first sentence stands here, and it is long enough; so it says. Another one follows, with a comma."
MORE = "A second paragraph, no shorter than the first one, goes on: it has marks, words and an end."


def by_hand(page: str) -> str:
    """The article of the given tables' pages, which have one layout."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_takes_every_article_whole(spark, sf):
    folder = SF.replace("0.001", sf)
    want = {r[0]: (r[1], by_hand(r[2])) for r in duckdb.sql(f"SELECT page_id, url, html FROM '{folder}/pages.parquet'").fetchall()}
    got = Q.op12_html_extraction(spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (*want[r.page_id], len(want[r.page_id][1]))


def test_boilerplate_of_all_kinds_goes():
    page = f"""<!doctype html><html><head><title>Not this.</title><style>p {{ margin: 0 }}</style></head><body class="has-sidebar">
<div id="site-header"><h2>Site name, and a claim.</h2></div><div class="cookie-notice"><p>We use cookies, and so on. Agree, please.</p></div>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><script>if (a < b) document.write("<p>no, not this.</p>")</script>
<main><article class="post"><header><h1>A &amp; B&nbsp;&#8212; title</h1></header><p>{STORY}<p>Short.
<div class="adBox">Buy now, buy here.</div><ul><li>One  point<li>Another
 point</ul><aside>On the side, a note.</aside><p hidden>Hidden, too.</p><form><label>Name</label><p>Send it, now.</p><button>Go</button></form>
<blockquote>{MORE}</blockquote><table><tr><td>1<td>2</table><p>Last <b>bold<i> both</b> words</i>.<br>Line two<!-- a comment > --></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>{STORY}</p></article></section></main>
<footer><p>All rights, as ever, reserved.</p></footer><noscript><p>Turn on scripts.</p></noscript></body></html>"""
    want = ["A & B — title", STORY, "Short.", "One point", "Another point", MORE, "1", "2", "Last bold both words. Line two"]
    assert H.main_text(page).split("\n\n") == want


def test_pages_without_landmarks_are_told_by_their_paths():
    menu = "".join(f'<div class="x"><a href="/{i}">Entry {i}</a></div>' for i in range(12))
    page = f'<body><div id="a">{menu}</div><div id="b"><h1>Title</h1><div class="body"><p>{STORY}</p><p>One.</p><p>{MORE}</p></div></div><div id="c">{menu}<p>Imprint</p></div>'
    assert H.main_text(page).split("\n\n") == ["Title", STORY, "One.", MORE]


def test_wrappers_with_telling_names_around_the_main_element():
    page = f'<form id="aspnet"><div class="content with-sidebar"><div class="widget"><main><p>{STORY}</p></main></div></div></form>'
    assert H.main_text(page) == STORY
    teaser = f'<div class="k"><article><p>See also, here.</p></article></div><div><h1>News</h1><p>{STORY}</p><p>{MORE}</p></div>'
    assert STORY in H.main_text(teaser) and MORE in H.main_text(teaser)


def test_broken_markup():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>  </p>") == H.main_text("<script>x") == ""
    assert H.main_text("5 < 6 and &lt;b&gt; &am &amp x") == "5 < 6 and <b> &am & x"
    assert H.main_text("<p>one</div></p></span>two<p>three<!-- open <p>four") == "one\n\ntwo\n\nthree"
    assert H.main_text('<p title="a > b" data-x=\'">\'>in</p><p title="never closed>out') == "in\n\nout"
    assert H.main_text("<svg><title>t</title><text>no</text></svg><p>yes</p><noscript><p>no</noscript><p>yes") == "yes\n\nyes"
    deep = "<div>" * 20_000 + "deep" + "</b>" * 20_000 + "<p>" * 5_000 + "end"
    assert H.main_text(deep) == "deep\n\nend"
    long = "<article>" + f"<p>{STORY}</p>" * 30_000
    assert H.main_text(long) == "\n\n".join([STORY] * 30_000)


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{STORY}</p></article>")] * 2 + [(None, None, None), (2, "v", "<p>\U0001f600 a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("own"), "N_chars": F.lit(1)})
    got = sorted(tuple(r) for r in H.extract(df).collect() if r[0])
    assert got == [(1, "u", STORY, len(STORY))] * 2 + [(2, "v", "\U0001f600 a", 3)]
    assert H.extract(df.limit(0)).collect() == []
    assert H.extract(df).where("page_id is null").collect()[0][2:] == ("", 0)
