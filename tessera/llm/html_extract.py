"""Main text of HTML pages by tag-path ratios.

A page is cut into text nodes.  For each root-to-leaf path of block tags the
length of its text, its punctuation and its link text are aggregated; length and
punctuation per node are smoothed along the page and fused to one score per node, which
what tags and class words say of the elements around it damps or raises
(``UNWANTED``, ``DOUBTFUL``, ``IN_CONTENT``).  Nodes under the threshold of the page
that are damped or mostly links count against every element that holds them, all others by their
score; nodes are damped if less is said for them than for the best one; the element with the largest sum, the lowest of equals, is the content.
Its blocks but for those that count against it are the text, in page order.

Scripts, styles, forms, menus, headers and footers of the page and sidebars told by tag or role, and
elements that are not shown, take no part.

Edge cases: null or empty html gives an empty text, as does a page whose article has
none; unclosed and stray tags, pages that end anywhere and unquoted attributes are read as
far as they go; of elements with equal sums the lowest, then the last is taken; very
long or deep pages are read whole in time and memory linear in their length; repeated rows each get
their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>|[^>]*(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "iframe", "noembed", "noframes", "xmp", "title"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br"}
EMBEDDED = {"noscript", "template", "svg", "math", "select", "object", "canvas", "audio", "video"}  # skipped up to their end, if that is within the block
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
DROP = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "head", "fieldset", "search", *EMBEDDED}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay"
    " sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar topbar comment comments disqus reply replies respond discussion"
    " share sharing social related recommended recommendations newsletter subscribe subscription signup login signin widget widgets copyright pager pagination paywall hidden".split()
)
# words that name a layout or a kind of text as well
LAYOUT = frozenset("discussion respond recommended sidebar sidebars menu menus nav navbar navigation header footer masthead toolbar topbar banner overlay modal notice notices social related widget widgets share sharing".split())
UNWANTED, DOUBTFUL, IN_CONTENT = 0.02, 0.6, 5.0
IN_ARTICLE = {"header"}  # words and tags that only count outside an article
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_raw_end = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW | EMBEDDED}


def _words(value: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))


def _prior(tag: str, attributes: str, in_article: bool) -> float:
    """What the element's own tag, role and class words say of its text: 0 is hidden, 1 tells nothing."""
    if tag in DROP or (tag == "header" and not in_article):
        return 0.0
    out = IN_CONTENT if tag in ("article", "main") and not in_article else 1.0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return out
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            found = _words(value) & WORDS
            if found and not (in_article and found <= IN_ARTICLE):
                out *= DOUBTFUL if found <= LAYOUT else UNWANTED
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return 0.0
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0.0
    return out


class _Node:
    """A block element: its root-to-leaf path as a number, what is said of its text so far, whether an article or main is open, its parent."""

    __slots__ = ("tag", "path", "prior", "article", "up", "at")

    def __init__(self, tag, path, prior, article, up, at):
        self.tag, self.path, self.prior, self.article, self.up, self.at = tag, path, prior, article, up, at


def visible_blocks(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All block elements, parents first, and (node, text, characters of links in it) of each block that is not hidden, in page order."""
    out: list[tuple[_Node, str, int]] = []
    node = root = _Node("", 0, 1.0, False, None, 0)
    nodes, paths, open_ = [root], {}, {}  # open_: how many elements of each tag are open
    pieces: list[str] = []
    links = in_link = at = 0
    ends: dict[str, re.Match | None] = {}  # the next end of each embedded element

    def flush() -> None:
        nonlocal pieces, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and node.prior:
                out.append((node, text, links))
        pieces, links = [], 0

    def close(upto: _Node) -> None:
        nonlocal node
        while node is not upto:
            open_[node.tag] -= 1
            node = node.up

    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and node.prior:
            text = _html.unescape(text) if "&" in text else text
            pieces.append(text)
            links += len(text) * (in_link > 0)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1]:
                end = _raw_end[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in ("svg", "math") and not m[1] and m[3].endswith("/>"):
            continue
        if tag in EMBEDDED and not m[1]:
            if tag not in ends or ends[tag] and ends[tag].start() < at:
                ends[tag] = _raw_end[tag].search(page, at)
            if (end := ends[tag]) and not re.compile(f"</{re.escape(node.tag or 'body')}[\\s/>]", re.I).search(page, at, end.start()):
                at = end.end()
                continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = 0 if m[1] else 1
        if tag in VOID and tag != "hr" or tag in INLINE:
            continue
        flush()
        if tag == "hr":
            continue
        if m[1]:
            if open_.get(tag):
                up = node
                while up.tag != tag:
                    up = up.up
                close(up.up)
                in_link = 0
            continue
        inner, outer = CLOSES.get(tag, (set(), set()))
        up = node
        while up.up and up.tag not in outer and (up.tag in inner or up.tag == "p" and up is node):
            up = up.up
        if up is node and any(open_.get(x) for x in inner):  # an item may be open below other blocks
            x = node
            while x.up and x.tag not in outer and x.tag not in inner:
                x = x.up
            if x.up and x.tag in inner:
                up = x.up
        close(up)
        prior = node.prior and node.prior * _prior(tag, m[3], node.article)
        path = paths.setdefault((node.path, tag), len(paths) + 1)
        node = _Node(tag, path, prior, node.article or bool(prior) and tag in ("article", "main"), node, len(nodes))
        nodes.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return nodes, out


def path_scores(blocks: list[tuple[_Node, str, int]]) -> tuple[list[float], float]:
    """The fused score of each block and the threshold of the page.

    Length and punctuation are means of the block's path, smoothed along the page; their product is taken less the path's
    share of links and weighed by what tags and class words around the block say.
    """
    paths: dict[int, list[float]] = {}
    for node, text, links in blocks:
        s = paths.setdefault(node.path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += min(links, len(text))
        s[3] += 1
    length = [paths[n.path][0] / paths[n.path][3] for n, _, _ in blocks]
    marks = [paths[n.path][1] / paths[n.path][3] for n, _, _ in blocks]
    linked = [paths[n.path][2] / max(paths[n.path][0], 1) for n, _, _ in blocks]
    prior = [n.prior for n, _, _ in blocks]

    def smooth(v: list[float]) -> list[float]:
        """Along the page, among blocks of the same prior."""
        near = lambda i, j: v[j] if 0 <= j < len(v) and prior[j] == prior[i] else v[i]
        return [0.25 * near(i, i - 1) + 0.5 * v[i] + 0.25 * near(i, i + 1) for i in range(len(v))]

    fused = [a * (1 + b) * (1 - c) * p for a, b, c, p in zip(smooth(length), smooth(marks), linked, prior)]
    # half of the mean score of a character's block: many small blocks don't lower it
    return fused, 0.5 * sum(x * x for x in fused) / (sum(fused) or 1)


def main_text(page: str | None) -> str:
    """The page's content blocks, one a line."""
    nodes, blocks = visible_blocks(page or "")
    if not blocks:
        return ""
    scores, least = path_scores(blocks)
    # what counts against a node that holds it: less than the threshold, and mostly links or less told for it than for the best block
    best = blocks[max(range(len(scores)), key=scores.__getitem__)][0].prior
    bad = [s < least and (n.prior < best or 2 * links > len(text)) for s, (n, text, links) in zip(scores, blocks)]
    if any(n.article for n in nodes) and not any(n.article for n, _, _ in blocks):
        return ""  # an article without text
    gain = [0.0] * len(nodes)
    for (n, _, _), s, b in zip(blocks, scores, bad):
        gain[n.at] += s - least if b else s
    leaf = [False] * len(nodes)
    for n, _, _ in blocks:
        leaf[n.at] = n.up is not None and n.tag not in ("article", "main")
    for n in reversed(nodes[1:]):
        gain[n.up.at] += gain[n.at]
        leaf[n.up.at] = False
    top = max((n for n in nodes if not leaf[n.at]), key=lambda n: (gain[n.at], n.at), default=nodes[0])
    inside = [False] * len(nodes)
    for n in nodes:
        inside[n.at] = n is top or n.up is not None and inside[n.up.at]
    return "\n".join(text for (n, text, _), b in zip(blocks, bad) if inside[n.at] and not b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_query(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
