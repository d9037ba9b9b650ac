"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import query, ship, table

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside button select option input textarea iframe object svg math canvas dialog menu noscript template audio video".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An element that starts ends open ones of these names, up to a list or table around it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table".split())
#: Elements that hold what isn't the article, or all of the page.
FRAMES = frozenset("form header".split())
#: Words of a class or an id that tell what isn't the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent gdpr notice notices alert disclaimer paywall newsletter subscribe subscription popup modal overlay comment comments commentlist "
    "disqus replies respond share sharing social related recommended widget widgets login signup search pagination pager skip".split()
)
#: Those of other people's texts, which may be longer than the article.
FOREIGN = frozenset("comment comments commentlist disqus replies respond related recommended".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar".split())
WHOLE = frozenset("html body main article".split())
PARAGRAPHS = frozenset("p pre td th blockquote li dt dd h1 h2 h3 h4 h5 h6 figcaption caption summary".split())

#: What belongs to the article beside its best element, short as it may be.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure section article".split())
#: What may be a menu.
LISTS = frozenset("div ul ol section table".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|noembed)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")


def boilerplate(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in WHOLE or attributes.isspace():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def aside_words(tag: str, attributes: str) -> frozenset[str]:
    """What speaks against an element: its name, words of its class or id; of a paragraph's names only whole ones."""
    own = FRAMES.intersection((tag,))
    if not attributes or tag in WHOLE or attributes.isspace():
        return own
    values = ("".join(values).lower() for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id"))
    names = [_WORDS.findall(name) for value in values for name in value.split()]
    if tag in PARAGRAPHS:
        names = [words for words in names if ASIDE.issuperset(words)]
    return own | ASIDE.intersection(w for words in names for w in words)


@dataclass
class Page:
    """The element tree without boilerplate; a parent's number is smaller than its children's."""

    tags: list[str]
    parents: list[int]
    blocks: list[tuple[int, str, int]]  # element, text, characters within links


def read_page(html: str) -> Page:
    page, block, asides = Page(["#root"], [-1], []), [], {}
    open_elements: list[tuple[str, int]] = [("#root", 0)]
    hidden, links, linked = 0, 0, 0  # open boilerplate elements; open links; characters within links

    def flush() -> None:
        nonlocal linked
        if block:
            text = " ".join("".join(block).split())
            if text:
                page.blocks.append((next(n for t, n in reversed(open_elements) if t not in INLINE), text, linked))
            block.clear()
        linked = 0

    def close(down_to: int) -> None:
        nonlocal hidden, links
        while len(open_elements) > down_to:
            tag, number = open_elements[-1]
            if tag not in INLINE:
                flush()
            open_elements.pop()
            hidden -= number < 0
            links -= tag == "a"

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = unescape(text)
            block.append(text)
            if links:
                linked += len(text)

    at = 0
    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at, tag = m.end(), m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for depth in range(len(open_elements) - 1, 0, -1):
                if open_elements[depth][0] == tag:
                    close(depth)
                    break
                if open_elements[depth][0] in SCOPES and tag in PARAGRAPHS:
                    break
            continue
        ends = CLOSES.get(tag)
        if tag in CLOSES_PARAGRAPH or ends:
            for depth in range(len(open_elements) - 1, 0, -1):
                name = open_elements[depth][0]
                if name == "p" or ends and name in ends:
                    close(depth)
                    if not ends:
                        break
                elif name in SCOPES or name not in INLINE and not ends:
                    break
        if tag == "br":
            add(" ")
        elif tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        words = () if hidden else aside_words(tag, m["attributes"])
        if hidden or boilerplate(tag, m["attributes"]) or words and tag in INLINE:
            hidden += 1
            open_elements.append((tag, -1))
        else:
            page.tags.append(tag)
            page.parents.append(open_elements[-1][1])
            open_elements.append((tag, len(page.tags) - 1))
            if words:
                asides[len(page.tags) - 1] = words
        links += tag == "a"
    add(html[at:])
    close(1)
    flush()
    if asides:
        away = put_aside(page, asides)
        page.blocks = [b for b in page.blocks if not away[b[0]]]
    return page


def put_aside(page: Page, asides: dict[int, frozenset[str]]) -> list[bool]:
    """Which elements are hidden by words of a class or an id, their own or of one around them.

    Such a word may also name a layout around the article (has-sidebar). While no <main> or <article> with text is
    visible, an element that holds one, or most of the page's points, is none to hide.
    """
    size = len(page.tags)
    points, flagged, holds = [0.0] * size, [False] * size, [False] * size
    for element, text, in_links in page.blocks:
        points[element] += worth(text) * (1 - min(1, in_links / len(text)))
    for element in range(size - 1, 0, -1):
        parent = page.parents[element]
        points[parent] += points[element]
        holds[parent] |= holds[element] or page.tags[element] in ("main", "article") and points[element] > 0
    for element in range(1, size):
        flagged[element] = element in asides or flagged[page.parents[element]]
    shown = any(not flagged[e] and page.tags[e] in ("main", "article") and points[e] > 0 for e in range(size))
    away = [False] * size
    for element in range(1, size):
        away[element] = away[page.parents[element]]
        if element in asides and not away[element]:
            most = points[element] >= max(10, points[0] / 2) and FOREIGN.isdisjoint(asides[element])
            away[element] = shown or not (holds[element] or most)
        shown |= not away[element] and page.tags[element] in ("main", "article") and points[element] > 0
    return away


def worth(text: str) -> int:
    return 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)


def chosen(page: Page) -> list[bool]:
    """Which elements belong to the article.

    A block passes points for its length and commas to the element around it, half of them one level up and less and
    less beyond; an element's points are discounted by the share of its text within links. The best element is taken,
    or the article around it, and of its siblings those with a fair share of its points, paragraphs of prose
    and headings, lists, tables, quotes, sections and articles with few links, and what has few links between these.
    """
    size, count = len(page.tags), range(len(page.tags) - 1, 0, -1)
    points, length, linked = [0.0] * size, [0] * size, [0] * size
    for element, text, in_links in page.blocks:
        length[element] += len(text)
        linked[element] += in_links
        passed = worth(text)
        above = page.parents[element] if page.tags[element] in PARAGRAPHS and page.parents[element] >= 0 else element
        for level, share in enumerate((1, 2, 6, 9)):
            points[above] += passed / share
            if (above := page.parents[above]) < 0:
                break
    for element in count:
        length[page.parents[element]] += length[element]
        linked[page.parents[element]] += linked[element]
    score = [p * (1 - min(1, k / n)) if n else 0.0 for p, k, n in zip(points, linked, length, strict=True)]
    best = max(range(size), key=lambda e: (score[e], -e))
    around = best
    while around > 0 and page.tags[around] not in ("article", "main"):
        around = page.parents[around]
    top = around if around > 0 else best
    kept = [False] * size
    for element in range(size):
        parent = page.parents[element]
        if element == top or parent >= 0 and kept[parent]:
            # Of a container that isn't marked as the article, lists of links are no part.
            listed = parent == top and top == best and page.tags[top] not in ("article", "main") and page.tags[element] in LISTS
            kept[element] = not (listed and linked[element] >= 0.8 * max(length[element], 1))
        elif top > 0 and parent == page.parents[top] and length[element]:
            density = linked[element] / length[element]
            fair = score[element] >= max(10, 0.2 * score[best])
            prose = page.tags[element] == "p" and density < (0.25 if length[element] > 80 else 1e-9)
            part = page.tags[element] in BESIDE and density < 0.25
            kept[element] = fair or prose or part
    beside = [e for e in range(size) if top > 0 and page.parents[e] == page.parents[top]]
    inside = [n for n, e in enumerate(beside) if kept[e] and length[e]]
    for element in beside[inside[0] : inside[-1]] if inside else []:
        # What stands between parts of the article is one.
        kept[element] |= 0 < length[element] and linked[element] < 0.25 * length[element]
    for element in range(size):
        parent = page.parents[element]
        kept[element] |= parent >= 0 and kept[parent] and parent not in (top, page.parents[top])
    return kept


def main_text(html: str) -> str:
    page = read_page(html)
    kept = chosen(page)
    return "\n".join(text for element, text, _ in page.blocks if kept[element])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from the whole html.

    A null or empty html and one without text have an empty text; markup that breaks off is markup. Repeated rows and
    null ids keep their rows, an empty table gives no rows, other columns are ignored.
    """
    ship(pages.sparkSession)
    html = F.coalesce("html", F.lit("")).alias("html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h) for h in batch["html"].to_pylist()]
            columns = [batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html)
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
