import html
import re

import pytest

from statelog.llm import site_templates
from statelog.llm.site_templates import Page, host_of


def text(source, templates=()):
    return Page(source).text(set(templates))


CASES = [
    ("", ""),
    ("plain  text\n only", "plain text only"),
    ("<p>a<b>b</b> c<br>d</p><p>e &amp; &eacute;&#8364;&nbsp;f", "ab c d e & é€ f"),
    ("<nav>menu</nav><header>top</header><article><header><h1>T</h1></header><p>x<p>y</article><footer>f</footer>", "T x y"),
    ("<div class='side-bar sidebar'>s</div><main><p>x</p><aside>n</aside></main><div>after</div>", "x"),
    ("<article><p>x</p><div class=comments><p>first!</p></div><form><input><label>q</label></form></article>", "x"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>c</p> --><p>z</p>", "z"),
    ("<div id=cookieNotice>ok?</div><div role='navigation'>m</div><p hidden>h</p><p>kept</p>", "kept"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one two a b c"),
    ("<div title='a > b'>x</div><p>1 < 2 and <3</p>", "x 1 < 2 and <3"),
    ("<p><b>bold<br><p>not closed</p></b></p> end", "bold not closed end"),
    ("<article>a</article><div>between</div><article>b</article>", "a b"),
    ("<p>unclosed <a href='x'>link", "unclosed link"),
    ("<div class=adapter>not an ad</div>", "not an ad"),
    ("<article>x<ol class=commentlist><li>first</ol><ins class=adsbygoogle>ad</ins></article>", "x ad"),
]


@pytest.mark.parametrize("source,expected", CASES)
def test_structure(source, expected):
    assert text(source) == expected


def test_hosts():
    assert host_of("https://u:p@Ex.com:80/a?b=//c") == "ex.com"
    assert host_of("//x.org#f") == "x.org"
    assert host_of("nothing") == host_of(None) == ""


def page(host, number, body):
    return (number, f"https://{host}/{number}", f"<html><body>{body}</body></html>", "extra")


def test_what_a_host_repeats_goes(spark):
    frame = "<div><p>The daily</p><ul><li>one</li></ul></div>"
    rows = [page("a.com", i, f"{frame}<div><p>story {i}</p><p>so it goes</p></div><div>All rights</div>") for i in range(12)]
    rows += [page("b.com", 100 + i, f"{frame}<p>few pages {i}</p>") for i in range(4)]
    rows += [page("c.com", 200 + i, "<div><p>the same page</p></div>") for i in range(9)]
    rows += [page("d.com", 300 + i, f"<article><p>often said</p><div>read also</div><p>n{i}</p></article>") for i in range(9)]
    rows += [(None, None, None, "extra"), (7777, None, "<p>no url</p>", None), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string").repartition(4, "page_id")
    found = site_templates.main_texts(pages).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert all(r.n_chars == len(r.text) for r in found)
    # What recurs inside a page's own part goes as well where the page names no article.
    assert all(texts[i] == f"story {i}" for i in range(12))
    assert all(texts[100 + i] == f"The daily one few pages {i}" for i in range(4))
    assert all(texts[200 + i] == "the same page" for i in range(9))
    assert all(texts[300 + i] == f"often said n{i}" for i in range(9))
    assert texts[None] == "" and texts[7777] == "no url"
    assert site_templates.main_texts(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    story = "<h1>T</h1><div><p>whole body</p></div><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table>"
    rows = [page("a.com", i, f"<div>menu {i}</div><article>{story}</article>") for i in range(20)]
    rows += [page("b.com", 100 + i, f"<h1>T</h1><div><p>plain body</p></div><p>end {i // 10}</p>") for i in range(20)]
    rows += [page("c.com", 200 + i, f"<article><p>n{i}</p><div>read also</div></article>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string").repartition(4, "page_id")
    texts = {r.page_id: r.text for r in site_templates.main_texts(pages).collect()}
    assert all(texts[i] == "T whole body one two a b" for i in range(20))
    assert all(texts[100 + i] == f"T plain body end {i // 10}" for i in range(20))
    assert all(texts[200 + i] == f"n{i}" for i in range(5))


def test_notices_in_articles_and_templates_of_sections(spark):
    story = lambda i: f"<p>the story of page {i} has some words more than a notice</p>"
    notice = "<p>Get our letter</p><ul><li>each day</li></ul><table><tr><td>free</td></tr></table>"
    rows = [page("a.com", i, f"<article>{story(i)}{notice}<p>{'often' if i % 3 else i}</p></article>") for i in range(18)]
    rows += [page("a.com", 50 + i, f"<article>{story(i)}{'<p>some say</p>' if i < 26 else ''}</article>") for i in range(18, 36)]
    rows += [page("b.com", 1000 + i, f"<p>page {i}</p>") for i in range(992)]
    rows += [(2000 + i, f"https://b.com/sport/{i}", f"<div>games</div><p>match {i}</p>", "") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string").repartition(4, "page_id")
    texts = {r.page_id: r.text for r in site_templates.main_texts(pages).collect()}
    said = lambda i: f"the story of page {i} has some words more than a notice"
    # The notice is on half of the host's pages; a line on fewer of them is content.
    assert all(texts[i] == f"{said(i)} {'often' if i % 3 else i}" for i in range(18))
    assert all(texts[50 + i] == said(i) + ' some say' * (i < 26) for i in range(18, 36))
    assert all(texts[2000 + i] == f"match {i}" for i in range(8)) and texts[1003] == "page 3"


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in site_templates.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", row.html, re.DOTALL)[1]
        body = re.sub(r"</?(?:b)>", "", body)
        assert found[row.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
