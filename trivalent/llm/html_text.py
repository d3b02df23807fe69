"""Main text of web pages by tag-path ratios.

A page is read as a row of text nodes, each with the path of tags from the root to it. For
every path the text length and the punctuation a node are summed up; both ratios are smoothed
over the nodes in page order and fused to the node's score. What an element calls itself (nav,
footer, class="sidebar", form) is a prior that weighs the score; menus, notices, adverts, forms and
comments are never content, however long they are.

Nodes whose score reaches a part of the scores' deviation are content. The gaps between them
are filled: short nodes of the same article belong to it (in pages without article or main,
those of the deepest element that holds nearly all content), unless the prior is against them or
their path's text is mostly links. A heading belongs to what follows it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

#: Weights of the smoothing over neighbours, the part of the deviation that makes content, and the share of content that a page's article holds.
SMOOTHING, PART, SHARE = (0.25, 0.5, 0.25), 0.5, 0.9
#: Priors that weigh a node's score: in an element that calls itself something else than content, and in an article.
AGAINST, FOR = 0.05, 4.0
#: Paragraphs, beside a first heading, of an element that is a page's layout, whatever its class; and the part of a path's text in links from
#: which its nodes must reach the threshold themselves.
PARAGRAPHS, LINKED = 2, 0.5

#: Elements nested deeper stand beside each other, as in browsers.
DEEPEST = 512

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_TEXT = frozenset("head script style noscript template iframe object svg math button select textarea menu title".split())
_APART = frozenset("nav footer aside dialog header".split())
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: A class or id is against content if it is one of these words, alone or with affixes that say where or what kind of box it is.
_NAMES = "ads?|advert\\w*|adsense|sponsor\\w*|promo\\w*|banner|sidebar|comments?|commentary|disqus|respond|replies|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|subscription|menu|navbar|nav|navigation|breadcrumbs?|pagination|pager|share|sharing|social|related|recommended|recommendations|widgets?|toolbar|masthead|header|footer|copyright|login|signup|search"
_BEFORE = "site|page|main|global|left|right|top|bottom|post|entry|article|user|reader|skip|sticky|google|js|wp"
_AFTER = "list|section|box|block|area|container|wrapper|wrap|widget|links|link|bar|notice|banner|form|buttons?|icons?|panel|inner|outer|top|bottom|left|right|posts|articles|stories|items?|unit|slot|thread|body|nav|menu|overlay|[0-9]+"
_MARK = re.compile(rf"(?:(?:{_BEFORE})[_-])*(?:{_NAMES})(?:[_-](?:{_NAMES}|{_AFTER}))*", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An opening tag of the first closes open ones of the second, up to one of the third.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = _BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption", "html", "body", "head", "title"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe|svg|template)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S | re.I)
#: A quote opens a value only after the equals sign; elsewhere it is a character like any other.
_ATTRIBUTE = re.compile(r"([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE = frozenset("p span b i a em strong li h1 h2 h3 h4 h5 h6 td th dt dd blockquote pre".split())
_PUNCTUATION = re.compile(r"[.,;:!?。，、؟।]")


class _Element:
    __slots__ = ("tag", "path", "parent", "skipped", "against", "depth", "linked")

    def __init__(self, tag, parent, skipped=False, against=""):
        self.tag, self.parent, self.skipped, self.against = tag, parent, skipped, against
        self.path = f"{parent.path}/{tag}" if parent else tag
        self.depth = parent.depth + 1 if parent else 0
        self.linked = tag == "a" or parent is not None and parent.linked


def _element(tag: str, rest: str, parent: _Element) -> _Element:
    """An element in its parent: skipped if nothing in it is shown, against if its tag ("tag") or attributes ("name") speak against content."""
    against = ""
    if tag in _APART and not (tag == "header" and ("/article" in parent.path or "/main" in parent.path)):  # an article's own header has its title
        against = "tag"
    elif tag == "form":
        against = "name"
    skipped = parent.skipped or tag in _NO_TEXT
    if not skipped and ("=" in rest or "hidden" in rest) and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                skipped = True
            elif name == "role" and value.lower() in _ROLES or name in ("class", "id") and any(_MARK.fullmatch(x) for x in value.split()):
                against = against or "name"
    return _Element(tag, parent, skipped, against)


def text_blocks(html: str) -> list[tuple[_Element, str, int]]:
    """Blocks in page order with the element that holds each and its characters in links: text between the borders of block elements, white
    space made one space."""
    root = _Element("", None)
    top, blocks, held, linked, at = root, [], [], [], 0
    owner = root

    def flush():
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                blocks.append((owner, text, min(len(text), sum(map(len, linked)))))
            held.clear()
            linked.clear()

    def close(to):
        nonlocal top
        top = to.parent

    for m in _TOKEN.finditer(html):
        if m.start() > at and not top.skipped:
            if not held:
                owner = top
            held.append(html[at : m.start()])
            if top.linked:
                linked.append(held[-1])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCKS:
            flush()
        if tag in _VOID:
            continue
        if m["end"]:
            e = top
            while e.parent and e.tag != tag:
                e = e.parent
            if e.parent:
                close(e)
            continue
        if tag in _CLOSES_P or tag in _IMPLIED:
            closed, border = _IMPLIED.get(tag, ({"p"}, {"button", "table", "td", "th"}))
            e = top
            while e.parent and e.tag not in border and (e.tag not in _CLOSES_P or e.tag in closed):
                if e.tag in closed:
                    close(e)
                    break
                e = e.parent
        if not m["rest"].rstrip().endswith("/") or tag in _BLOCKS:
            parent = top if top.depth < DEEPEST else top.parent
            top = _element(tag, m["rest"], parent)
    if at < len(html) and not top.skipped:
        if not held:
            owner = top
        held.append(html[at:])
    flush()
    return blocks


def _above(e: _Element):
    while e:
        yield e
        e = e.parent


def priors(elements: list[_Element]) -> np.ndarray:
    """Each node's prior by the elements around it: AGAINST, FOR in an article or main, or 1.

    An element that holds an article isn't believed against it, nor is a class or a form that holds a first heading and PARAGRAPHS paragraphs:
    that is a page's layout."""
    held, first, paragraphs = set(), set(), defaultdict(set)
    for e in elements:
        for x in _above(e):
            if x.tag in ("article", "main") and not x.against and x.parent not in held:
                held.update(y for y in _above(x.parent) if y.tag not in ("nav", "footer", "aside", "dialog"))
            elif x.tag == "h1":
                first.update(_above(x))
            elif x.tag == "p":
                for y in _above(x):
                    if y.against:
                        paragraphs[y].add(x)
    out = np.ones(len(elements))
    for i, e in enumerate(elements):
        if any(x.against and x not in held and (x.against == "tag" or x not in first or len(paragraphs[x]) < PARAGRAPHS) for x in _above(e)):
            out[i] = AGAINST
        elif any(x.tag in ("article", "main") for x in _above(e)):
            out[i] = FOR
    return out


def content_scores(elements: list[_Element], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each node's score and prior. The score fuses its path's ratios, smoothed in page order: the text a node times one more
    than the punctuation a node, weighed by the prior."""
    length, marks, n = defaultdict(int), defaultdict(int), defaultdict(int)
    for e, t in zip(elements, texts):
        length[e.path] += len(t)
        marks[e.path] += len(_PUNCTUATION.findall(t))
        n[e.path] += 1
    ratios = np.array([[length[e.path] / n[e.path], marks[e.path] / n[e.path]] for e in elements])
    padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
    smooth = sum(w * padded[i : i + len(ratios)] for i, w in enumerate(SMOOTHING))
    fused = smooth[:, 0] * (1 + smooth[:, 1])
    prior = priors(elements)
    return fused * prior, prior


def content_nodes(score: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Nodes at or above a part of the scores' deviation, and that the prior isn't against."""
    return (score >= min(PART * score.std(), score[~against].max(initial=0))) & ~against


def linked_paths(elements: list[_Element], texts: list[str], links: list[int]) -> np.ndarray:
    """Whether each node's path has most of its text in links."""
    length, inside = defaultdict(int), defaultdict(int)
    for e, t, n in zip(elements, texts, links):
        length[e.path] += len(t)
        inside[e.path] += n
    return np.array([inside[e.path] > LINKED * length[e.path] for e in elements])


def main_text(html: str) -> str:
    """The content nodes and the gaps between them, in page order, joined by line feeds; empty if the page has none."""
    blocks = text_blocks(html)
    if not blocks:
        return ""
    elements, texts, links = (list(x) for x in zip(*blocks))
    score, prior = content_scores(elements, texts)
    content = content_nodes(score, prior < 1)
    if not content.any():
        return ""
    inside: dict[_Element, int] = defaultdict(int)
    for e, t, is_content in zip(elements, texts, content):
        if is_content:
            for x in _above(e):
                inside[x] += len(t)
    articles = {x for x in inside if x.tag in ("article", "main")}
    if not articles:
        most = max(inside.values())
        articles = {max((x for x in inside if inside[x] >= SHARE * most and x.tag not in _INLINE), key=lambda x: x.depth)}
    linked = linked_paths(elements, texts, links)
    kept = [c or p >= 1 and not n and any(x in articles for x in _above(e)) for e, c, p, n in zip(elements, content, prior, linked)]
    for i in range(len(kept) - 2, -1, -1):  # a heading belongs to what follows it
        if not kept[i] and kept[i + 1] and prior[i] >= 1 and any(x.tag in _HEADINGS for x in _above(elements[i])):
            kept[i] = True
    return "\n".join(t for t, keep in zip(texts, kept) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' page_id and url with text and n_chars (code points).

    Null and empty pages have empty text; pages of any length are read whole and may be cut off anywhere; repeated rows are each extracted;
    an empty table gives an empty one; other columns, whatever their names, are left out."""

    def make():
        def each(page_id, url, html):
            texts = [main_text(h) for h in html]
            return page_id, url, texts, [len(t) for t in texts]

        return each

    return map_columns(pages.select("page_id", "url", F.coalesce(html, F.lit("")).alias("html")), make, "page_id long, url string, text string, n_chars long", rows=500)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
