import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrapulse.llm.main_text import extract, main_text

LONG = "A sentence of some length, with commas, that goes on and on until it is long enough to count. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad box">Buy, buy, buy</div>
<div id="cookie-notice">We use cookies, many of them.</div><article><h1>Title &eacute;</h1><p><b>First&nbsp; line,<br>goes
 on.<br><p>{LONG}</p><ul><li>one<li>two</ul><div class="share">Share</div><form><p>mail, now</p></form>
<table><tr><td>c1<td>c2</table><section class="comments"><p>{LONG}</p></section></article>
<aside><p>{LONG}</p></aside><footer>&copy; site</footer></body></html>"""


def test_page():
    want = ["Title é", "First line, goes on.", " ".join(LONG.split()), "one", "two", "c1", "c2"]
    assert main_text(PAGE) == "\n".join(want)


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<p>cut off &am", "cut off &am"),
        ("<article><p>a &lt;b&gt; &#233;</p><p>cut <b", "a <b> é\ncut"),
        ("<body><div><p>" + LONG + "</p><p>short.</p></div><div><a href=x>link one, two, three, four</a></div></body>", " ".join(LONG.split()) + "\nshort."),
        ("<script>never closed <p>x</p>", ""),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<article><p>same</p><p>same</p><p></p></article>", "same\nsame"),
    ],
)
def test_cases(html, text):
    assert main_text(html) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<a href='x'>", "</a>", "<ul>", "<li>", "</ul>", "<td>", "<table>", "text, ", "<br>", "&am", "<!--", "-->", "<", "<script>", "</script>", "<b", "\""]), max_size=30))
def test_never_fails(parts):
    text = main_text("".join(parts))
    assert text == "\n".join(b for b in (" ".join(x.split()) for x in text.split("\n")) if b)


def test_deep_nesting():
    assert main_text("<div>" * 20_000 + "deep") == "deep"


def test_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(i, u, main_text(h or ""), len(main_text(h or ""))) for i, u, h in rows], key=str)
    assert extract(df.limit(0)).count() == 0


PROSE = " ".join(LONG.split())


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-header"])
def test_layout_wrappers(name):
    inside = f'<div class="sidebar"><p>aside, here</p></div><{{0}}><p>{LONG}</p></{{0}}><div class="comments"><article><p>{LONG} no</p></article></div>'
    for tag in ("main", "article"):
        assert main_text(f'<body><div class="{name}"><div id="{name}">{inside.format(tag)}</div></div></body>') == PROSE
    assert main_text(f'<body><div class="{name}"><div class="sidebar">aside</div><div class="post"><p>{LONG}</p><p>{LONG}</p></div></div></body>') == f"{PROSE}\n{PROSE}"


def test_comments_and_notices_stay_hidden():
    assert main_text(f'<body><div><p>{LONG}</p></div><div class="comments"><p>{LONG}</p><p>{LONG}</p></div></body>') == PROSE
    assert main_text('<body><div class="cookie-notice"><p>We use cookies, many.</p></div></body>') == ""


def test_parts_beside_the_best_element():
    html = f"""<body><div><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>one<li>two</ul><blockquote>said</blockquote>
<table><tr><td>c1<td>c2</table><section><h2>More</h2><p>short</p></section><ul><li><a href="x">link</a></ul></div></body>"""
    assert main_text(html) == "\n".join(["Title", PROSE, PROSE, "one", "two", "said", "c1", "c2", "More", "short"])


def test_a_page_within_a_form():
    page = f'<body><form action="/"><div><div><p>{LONG}</p><p>{LONG}</p></div></div><select><option>x</select></form></body>'
    assert main_text(page) == f"{PROSE}\n{PROSE}"
    assert main_text(f'<body><form id="f"><main><p>{LONG}</p><form><p>mail, now</p></form></main></form></body>') == PROSE
    assert main_text(f'<body><div><p>{LONG}</p></div><form><p>mail, now</p></form></body>') == PROSE


def test_short_parts_between_long_ones():
    page = f'<body><div><p>{LONG}</p><p>{LONG}</p></div><div>Short, but said.</div><div><p>{LONG}</p><p>{LONG}</p></div><div><a href="x">a link</a></div></body>'
    assert main_text(page) == f"{PROSE}\n{PROSE}\nShort, but said.\n{PROSE}\n{PROSE}"


def test_several_articles():
    page = f"<body><article><p>{LONG}</p></article><article><p>Short one.</p></article></body>"
    assert main_text(page) == f"{PROSE}\nShort one."


def test_names_of_paragraphs():
    page = f'<article><p>{LONG}</p><p class="related-work">Work, by others.</p><p class="related">Elsewhere</p><li id="share">Share</li></article>'
    assert main_text(page) == f"{PROSE}\nWork, by others."
