import html
import math
import re

import pytest

from khatasort.llm import htmltext as h

FURNITURE = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News and more news</a></li></ul></nav>'
PROSE = [f"Sentence number {i} has enough words to be read as prose, and a comma." for i in range(6)]


def marked(paragraphs):
    return "".join(f"<p>{x}</p>" for x in paragraphs)


TEXT = "\n".join(["Head", *PROSE])
LINKS = "".join(f"<a href='/{i}'>A link to story number {i}</a> " for i in range(12))
TEASERS = "".join(f"<article><h3><a href='/{i}'>Teaser {i}</a></h3><p>Short words.</p></article>" for i in range(4))

#: Pages of many shapes, most without <article> or <main>, whose main text is Head and PROSE.
SHAPES = {
    "article": f"<html><body>{FURNITURE}<article><h1>Head</h1>{marked(PROSE)}</article><footer>&copy; x</footer></body></html>",
    "links beside": f"<html><body><header><h2>Site</h2></header><div class='wrap'><div class='post'><h1>Head</h1>{marked(PROSE)}</div><div class='col2'><a href='x'>One link</a> <a href='y'>Other link text</a></div></div></body></html>",
    "comments and aside in main": f"<body><main><h1>Head</h1>{marked(PROSE)}<section id='comments'><p>{'I disagree. ' * 90}</p></section><aside>{'Aside text. ' * 90}</aside></main>",
    "advert and form in article": f"<body><div id='content-with-sidebar'><article><h1>Head</h1>{marked(PROSE)}<div class='advert'>{'Buy. ' * 200}</div><form><p>Name</p><input></form></article><div class='sidebar'>{'Note. ' * 99}</div></div>",
    "long cookie notice": f"<body><div class='cookie-notice'>{'We use cookies. ' * 80}</div><div id='main'><h1>Head</h1>{marked(PROSE)}</div><div class='footer'>Foot</div>",
    "capitals, unclosed paragraphs": f"<BODY><ARTICLE><H1>Head</H1>{''.join(f'<P>{x}' for x in PROSE)}<script>var a='<p>no</p>';</script></ARTICLE>",
    "plain divs": f"<body><div>{LINKS}</div><div><h1>Head</h1>{marked(PROSE)}</div><div>{LINKS}</div>",
    "classes without meaning": f"<body><div class='x1'>{LINKS}</div><div class='x2'><div class='x3'><h1>Head</h1>{marked(PROSE)}</div></div><div class='x4'><ul><li>{LINKS}</li></ul></div>",
    "menu as list": f"<body><ul><li><a href='a'>One</a><li><a href='b'>Two</a><li><a href='c'>Three</a></ul><div><h1>Head</h1>{marked(PROSE)}</div>",
    "two wrappers": f"<body><div><div><div><h1>Head</h1>{marked(PROSE)}</div></div><div><div>{LINKS}</div></div></div>",
    "role navigation": f"<body><div role='navigation'>{'Long menu words. ' * 60}</div><div><h1>Head</h1>{marked(PROSE)}</div>",
    "role main is no furniture": f"<body><div role='main'><h1>Head</h1>{marked(PROSE)}</div><div role='contentinfo'>Imprint</div>",
    "table layout": f"<body><table><tr><td>{LINKS}</td><td><h1>Head</h1>{marked(PROSE)}</td></tr></table>",
    "hidden text": f"<body><div hidden>{'Unseen. ' * 80}</div><div><h1>Head</h1>{marked(PROSE)}<p style='display:none'>no</p></div>",
    "teasers are articles": f"<body><div><h1>Head</h1>{marked(PROSE)}</div><div>{TEASERS}</div>",
    "sections": f"<body>{FURNITURE}<div><h1>Head</h1><section>{marked(PROSE[:3])}</section><section>{marked(PROSE[3:])}</section></div>",
    "related work": f"<body><article><h1>Head</h1>{marked(PROSE[:2])}<section id='related-work'>{marked(PROSE[2:])}</section></article>",
    "alert level": f"<body><article><h1>Head</h1>{marked(PROSE[:2])}{''.join(f'<p class=alert-level>{x}</p>' for x in PROSE[2:])}</article>",
    "share of the market": f"<body><main><h1>Head</h1><div class='share-of-market'>{marked(PROSE)}</div><div class='share'>Tell your friends</div></main>",
    "wrapper named like a widget": f"<body><div class='widget'><h1>Head</h1>{marked(PROSE)}</div><div class='widget'>Weather today</div>",
    "article header and footer": f"<body><article><header><h1>Head</h1></header>{marked(PROSE)}<footer>By a writer</footer></article>",
    "list of links after the text": f"<body><div><h1>Head</h1>{marked(PROSE)}<ul>{''.join(f'<li><a href=/{i}>Read on {i}</a></li>' for i in range(5))}</ul></div>",
    "link inside a sentence": f"<body><div>{LINKS}</div><div><h1>Head</h1>{marked(PROSE[:5])}<p><a href='z'>{PROSE[5][:12]}</a>{PROSE[5][12:]}</p></div>",
    "breadcrumb and pager": f"<body><div class='breadcrumb'><a href='/'>Home</a> / Head</div><div><h1>Head</h1>{marked(PROSE)}</div><div id='pagination'>1 2 3</div>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_main_text_without_furniture(shape):
    assert h.main_text(SHAPES[shape]) == TEXT


def test_density_decides_where_tags_do_not():
    first, second = marked(PROSE), marked([x.upper() for x in PROSE] * 2)
    page = f"<body><div><h1>Head</h1>{first}</div><div>{LINKS}{{}}</div>"
    assert h.main_text(page.format("")) == TEXT
    # the same page with prose among the links: now the larger part is text, and nothing of it is dropped
    assert h.main_text(page.format(second)).startswith(TEXT) and PROSE[5].upper() in h.main_text(page.format(second))
    one = f"<body><article>{LINKS}</article><div><h1>Head</h1>{first}</div>"  # an <article> of links is no answer
    assert h.main_text(one) == TEXT


def test_densities_of_a_small_tree():
    root = h.parse("<body><div><p>abcdefghij</p><p>klmno</p></div><a>xyz</a></body>")
    nodes = {(x.tag, x.chars): x for x in h.score(root)}
    body, div, link = nodes["body", 18], nodes["div", 15], nodes["a", 3]
    assert (body.tags, body.link_chars, body.link_tags) == (4, 3, 1) and (div.tags, div.link_tags) == (2, 0)
    share = 3 / 18
    by_hand = 15 / 2 * math.log(15 * 2) / max(1.0, math.log(math.log(15 / 15 * 0 + share * 15 + math.e)))
    assert div.density == pytest.approx(by_hand)
    assert div.sum == pytest.approx(nodes["p", 10].density + nodes["p", 5].density)
    assert body.sum == pytest.approx(div.density + link.density)


def test_tags_with_unpaired_quotes_end_at_their_first_bracket():
    assert h.main_text("<p title=\"it's>Broken quote <p>then text") == "Broken quote\nthen text"


def test_short_paragraphs_references_and_white_space():
    page = "<article><p>A &amp; B&nbsp;c<br>d\n  e</p><p>Of.</p><ul><li>x<li>y</ul><pre>1\n 2</pre></article><div class=ad>" + "long words " * 50
    assert h.main_text(page) == "A & B c d e\nOf.\nx\ny\n1 2"


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></div>", "<!-- open", "<script>x", "<article><p>cut <b", "&amp", "<title>t", "<a href='>x", "<body></body>"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(h.main_text(page), str)


def test_page_without_elements_and_cut_pages():
    assert h.main_text("just &lt;text&gt;\n here") == "just <text> here"
    assert h.main_text("<body><article><p>One two</p><p>Three fo") == "One two\nThree fo"


def by_cutting(page: str) -> str:
    """The article between its tags, cut at block tags: only for pages of this very shape."""
    inside = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside)]
    return "\n".join(b for b in blocks if b)


def test_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, by_cutting(r.html)) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = h.query(spark, folder).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)


def test_nulls_repeats_empty_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (2, "", "", "")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in h.extract(pages).collect())
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (0, "u", "a", 1), (2, "", "", 0)])
    assert h.extract(pages.limit(0)).collect() == []


def test_very_deep_and_very_long_pages():
    assert h.main_text("<div>" * 20000 + "deep text" + "</div>" * 20000) == "deep text"
    assert len(h.main_text("<article><p>" + "word " * 300000 + "</p></article>")) == 5 * 300000 - 1
