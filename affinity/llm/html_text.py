"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of block elements.
Every path gathers the length, punctuation and link text of its blocks; its ratio is the
mean length of a block, raised by punctuation and lowered by links. The ratios are
smoothed over the blocks in page order, so that a short line between long ones follows
them, and paths above a share of the page's mean ratio are content. The content blocks
choose their containers: all articles (else main elements) that hold some, else their
lowest common element. Inside, the ratios choose the blocks: an article is a strong prior,
under which only paths made of links fall, headings excepted; plain short lines stay. What
elements mark as something else is left out, and so is text outside of the containers.

Defined results: null and empty html, and pages without text, give empty text of length 0;
a page cut off in the middle is read as far as it goes, an unfinished tag at its end is
dropped; a duplicate page is extracted each time; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^a-zA-Z>][^>]*+(?:>|\Z)|<![^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>|[^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# fixed values: elements by their role in the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside form script style title textarea iframe noscript template svg math button select option datalist dialog menu object canvas audio video map noembed noframes xmp search".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul".split())
# fixed values: an element of the key's kind ends an open one of the value's, up to the bound
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote dd dt td th figcaption summary caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the level that a path of an article must reach.
PRIOR = 0.05
# fixed values: words of class and id names that mark what is not the article
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscri\w+|sidebar|side|widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|topbar|"
    r"comments?|commentlist|discussion|disqus|respond|repl(?:y|ies)|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|login|signup|signin|search|skip|copyright|legal|disclaimer|alert|toast|overlay|hidden|offscreen|sr-only)(?:$|[\s_-])",
    re.I,
)
# fixed values: such names say what a page or its layout has, not what the element is
STATE = re.compile(r"(?:has|have|no|not|with|without|is|show|hide)[_-]", re.I)
# fixed values: elements whose ids are anchors of an article's sections
ANCHORED = frozenset("section h1 h2 h3 h4 h5 h6 p li dt dd td th tr figure blockquote pre details summary span a".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?、。，！？]")


@dataclass
class Block:
    text: str
    element: int  # number of the element that holds it
    links: int


@dataclass
class Element:
    tag: str
    number: int
    dropped: bool
    inside: bool  # of an article or main element


@dataclass
class Page:
    """Blocks outside of dropped elements in page order, and the elements by number, parents first.

    ``up`` is an element's parent, ``path`` the number of its path of tags from the root, and
    ``mark`` the nearest element from it upwards that class or id name as something else (-1: none).
    """

    blocks: list[Block]
    tag: list[str]
    up: list[int]
    path: list[int]
    mark: list[int]


def is_named(tag: str, attributes: str, inside: bool) -> bool:
    """Whether class or id name an element as something else than an article's text."""
    if len(attributes) < 4 or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "class" or name == "id" and not (inside and tag in ANCHORED):
            for word in (a or b or c).split():
                if not STATE.match(word) and (MARKED.search(word) or not inside and re.search(r"(?:^|[_-])(?:header)(?:$|[_-])", word, re.I)):
                    return True
    return False


def is_marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is never part of an article; ``inside`` an article its header is."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if len(attributes) < 4 or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def read_page(page: str) -> Page:
    """One linear scan: what an element needs of those around it, it takes from its parent."""
    stack = [Element("", 0, False, False)]
    out, buffer = Page([], [""], [-1], [0], [-1]), []
    paths: dict[tuple[int, str], int] = {}
    at = links = 0
    in_link = False

    def flush() -> None:
        nonlocal links
        if buffer:
            if not stack[-1].dropped and (text := " ".join("".join(buffer).split())):
                out.blocks.append(Block(text, stack[-1].number, links))
            buffer.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text and not stack[-1].dropped:
            text = html.unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                links += len(text)

    # how many elements of each kind are open: an end tag without its start is told at once
    opened: Counter = Counter()

    def close(names, bound=frozenset()) -> None:
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                flush()
                opened.subtract(e.tag for e in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in bound:
                return

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[0].endswith(">"):  # cut off within the tag
            break
        if m[1]:
            if tag == "a":
                in_link = False
            if tag not in INLINE:
                close({tag})
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = page.find(">", at) + 1 or len(page)
        elif tag == "br" or tag == "img" or tag == "wbr":
            if tag == "br":
                add(" ")
        elif tag in INLINE:
            in_link = in_link or tag == "a"
            if (is_marked(tag, m[3], True) or is_named(tag, m[3], True)) and not m[3].endswith("/>"):
                # a hidden inline element: skip to its end tag
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
        else:
            if tag in CLOSES_P:
                close({"p"}, {"table", "td", "th", "button", "article", "body"})
            if tag in ENDS:
                close(*ENDS[tag])
            flush()
            in_link = False
            if tag in VOID or m[3].endswith("/>") and tag not in CLOSES_P:
                continue
            above = stack[-1]
            number = len(out.tag)
            out.tag.append(tag)
            out.up.append(above.number)
            out.path.append(paths.setdefault((out.path[above.number], tag), len(paths) + 1))
            out.mark.append(number if is_named(tag, m[3], above.inside) else out.mark[above.number])
            opened[tag] += 1
            stack.append(Element(tag, number, above.dropped or is_marked(tag, m[3], above.inside), above.inside or tag in ("article", "main")))
    else:
        add(page[at:])
    flush()
    return out


def path_ratios(page: Page, blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """For each block the ratio of its path, smoothed over the page; and that of its path were there no links."""
    size = np.array([len(b.text) for b in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    links = np.minimum(np.array([b.links for b in blocks], float), size)
    _, path = np.unique([page.path[b.element] for b in blocks], return_inverse=True)
    nodes, chars, points, linked = (np.bincount(path, x) for x in (np.ones_like(size), size, marks, links))
    plain = chars / nodes * (1 + np.log1p(points / nodes))
    ratio = plain * (1 - linked / chars) ** 2
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    near = np.convolve(ratio[path], kernel, "full")[2:-2] / np.convolve(np.ones(len(blocks)), kernel, "full")[2:-2]
    # smoothing lifts a path's short blocks; it never lowers a path below itself
    return np.maximum(near * (1 - links / size), ratio[path]), plain[path]


def added_up(page: Page, blocks: list[Block], values) -> np.ndarray:
    """By element: the values of the blocks in it, at any depth."""
    out = np.zeros(len(page.tag))
    for b, x in zip(blocks, values):
        out[b.element] += x
    for p in range(len(out) - 1, 0, -1):
        out[page.up[p]] += out[p]
    return out


def nearest(page: Page, chosen: set[int]) -> list[int]:
    """By element: the nearest of the chosen ones from it upwards, -1 for none."""
    out = []
    for p, up in enumerate(page.up):
        out.append(p if p in chosen else out[up] if up >= 0 else -1)
    return out


def without_marked(page: Page, share: float = 0.5) -> list[Block]:
    """The blocks outside of elements that class or id name as something else.

    Such a name is not believed where the element holds the page's articles (none lies outside),
    or, on a page without, where it holds most of the text on paths without links.
    """
    blocks = page.blocks
    if all(page.mark[b.element] < 0 for b in blocks):
        return blocks
    some = added_up(page, blocks, [1] * len(blocks))
    boxes = {p for p, t in enumerate(page.tag) if t == "article" and some[p]} or {p for p, t in enumerate(page.tag) if t == "main" and some[p]}
    spared: set[int] = set()
    if boxes:
        # marks around the articles, unless one has none around it
        if all(page.mark[page.up[p]] >= 0 for p in boxes):
            for p in boxes:
                mark = page.mark[page.up[p]]
                while mark >= 0 and mark not in spared:
                    spared.add(mark)
                    mark = page.mark[page.up[mark]]
    else:
        ratio, _ = path_ratios(page, blocks)
        held = added_up(page, blocks, [len(b.text) * (r > 0) for b, r in zip(blocks, ratio)])
        spared = {p for p, own in enumerate(page.mark) if p == own and held[p] > share * held[0]}
    # the nearest mark that is believed
    real: list[int] = []
    for p, up in enumerate(page.up):
        real.append(p if page.mark[p] == p and p not in spared else real[up] if up >= 0 else -1)
    kept = [b for b in blocks if real[b.element] < 0]
    # an article whose whole text is marked keeps it
    return kept or (blocks if boxes else [])


def main_text(html_: str | None, share: float = 0.25) -> str:
    """The articles of one page; ``share`` of the mean ratio (by length) makes a path content."""
    if not html_:
        return ""
    page = read_page(html_)
    blocks = without_marked(page) if page.blocks else []
    if not blocks:
        return ""
    ratio, plain = path_ratios(page, blocks)
    size = np.array([len(b.text) for b in blocks], float)
    tag = [page.tag[b.element] for b in blocks]
    level = share * (ratio * size).sum() / size.sum()
    content = ratio >= level
    # where the page says what is text, a path is held against itself without links: short plain lines are not lost
    likely = (ratio >= PRIOR * np.minimum(level, plain)) | np.array([t in HEADINGS for t in tag])
    weight = added_up(page, blocks, size * content)
    named = {p for p, t in enumerate(page.tag) if t == "article" and weight[p]} or {p for p, t in enumerate(page.tag) if t == "main" and weight[p]}
    if named:
        box = nearest(page, named)
        take = [box[b.element] >= 0 and x for b, x in zip(blocks, likely)]
    else:
        box = nearest(page, {max(p for p, w in enumerate(weight) if w >= 0.98 * weight[0])})
        take = [box[b.element] >= 0 and (c or x and t in TEXTUAL and b.links < 0.5 * len(b.text)) for b, t, c, x in zip(blocks, tag, content, likely)]
    return "\n".join(b.text for b, t in zip(blocks, take) if t)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(picked, run, "page_id long, url string, text string, n_chars long")
