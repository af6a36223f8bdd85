"""Main text of web pages by tag-path ratios.

The page is read once into blocks of text, each under its root-to-leaf path of block elements (a step is the tag with
its class). Text length, punctuation and text in links are aggregated per path. A path's ratio fuses mean length, mean
punctuation and the share outside links; ratios are smoothed over the order of the blocks (a block between strong ones
is lifted to a part of the weaker side, so that nothing spreads over the edges), averaged per path and thresholded at a
part of the text's mean: that selects the content paths, and their blocks are the output, within the region that holds
the content (the page's article, or the deepest element with nearly all of it). Left out blocks come back where structure
ties them to selected ones: headings, paragraphs, items and cells in the same container, and short gaps.

Menus, headers, footers, asides, notices, adverts, comments and the like by tag, role, class or id are not content. Tags
hold always; a word in a class or id, and a form, does not if the element holds most of the page's text and its
heading or article, or nearly all text.

Defined results: null or empty html, or html without content, gives ''; malformed markup (unclosed or stray tags or
quotes, cut-off pages) is read as browsers do in outline: new blocks close open paragraphs, stray end tags are skipped;
any depth and length is read in linear time; equal rows give equal results; only page_id, url and html are read, and
columns of other names change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("nav header footer aside form script style noscript template iframe button select textarea dialog menu svg head title object applet canvas audio video input option fieldset noembed noframes xmp math".split()) - {"form"}
SCOPES = frozenset("html body table td th tr div article section main ul ol dl blockquote figure aside nav header footer form details fieldset".split())
# Words in class, id or role that mark what is not content.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar colophon copyright sidebar sidebars aside rail complementary "
    "contentinfo banner ad ads adv advert adverts advertisement advertising advertorial adbox adsbygoogle sponsor sponsored sponsors promo promos promotion cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay dialog subscribe subscription newsletter signup login form search searchbox share sharing social "
    "related recommended recommendations comment comments disqus reply replies respond discussion pagination pager widget widgets toolbar skip hidden tags toc".split()
)
#: Words before which a class tells of a state and not of what the element is (has-sidebar, with-banner).
STATES = frozenset("has with no not without is show hide js".split())
#: Elements of running text: what they hold belongs to the container around them.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure figcaption address center".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s]+))?""")
_NAMED = re.compile(r"class|id|role|hidden|style", re.I)
_PUNCT = re.compile(r"[.,;:!?。，！？…]")
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Which open elements a start tag closes, by the group that is searched, and what ends the search.
_GROUP = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3, "option": 4}
_LISTS = frozenset("ul ol dl table select".split())
_WORD = re.compile(r"[a-z]+")

CONTENT, HARD, MARK = 0, 1, 2
#: Part of the text's mean score that a path needs, part of the weaker side that a block between is lifted to, and blocks of a gap.
PART, LIFT, GAP = 0.25, 0.5, 3


def _kind(tag: str, attrs: str) -> tuple[int, str]:
    """What an element is by tag and attributes, and its class."""
    if tag in SKIPPED:
        return HARD, ""
    kind, named = (MARK if tag == "form" else CONTENT), ""
    if not attrs or not _NAMED.search(attrs):
        return kind, named
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class":
            named = " ".join(value.split())
        if tag in ("body", "html"):
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return HARD, named
        if name in ("class", "id", "role") and tag not in ("article", "main") and not (tag[:1] == "h" and tag[1:].isdigit()):
            for part in value.split():
                words = _WORD.findall(part)
                if words and words[0] not in STATES and not MARKS.isdisjoint(words):
                    kind = MARK
    return kind, named


class Page:
    """Elements in order (parents first) and text nodes (text, element); a text of None ends a block."""

    def __init__(self, html: str):
        self.tag, self.parent, self.kind, self.path, self.link = ["#"], [-1], [CONTENT], [0], [False]
        #: Innermost block element of an element, itself counted.
        self.block = [0]
        self.nodes: list[tuple[str | None, int]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(html)

    def _element(self, tag: str, parent: int, kind: int, named: str) -> int:
        at = len(self.tag)
        inline = tag in INLINE
        self.tag.append(tag)
        self.parent.append(parent)
        self.kind.append(kind)
        self.link.append(tag == "a" or self.link[parent])
        self.block.append(self.block[parent] if inline else at)
        step = (self.path[parent], f"{tag}.{named}" if named else tag)
        self.path.append(self.path[parent] if inline else self._paths.setdefault(step, len(self._paths) + 1))
        return at

    def _read(self, html: str) -> None:
        nodes = self.nodes
        # open elements, and for each: innermost open block, paragraph in scope, cell, and siblings by group, as places in the stack
        stack, blocks, paragraphs, cells, groups = [0], [0], [0], [0], [(0,) * 5]
        places: dict[str, list[int]] = {}
        endless: set[str] = set()
        at = 0

        def pop_to(i: int) -> None:
            if blocks[-1] >= i:
                nodes.append((None, stack[i - 1]))
            for e in stack[i:]:
                places[self.tag[e]].pop()
            for held in (stack, blocks, paragraphs, cells, groups):
                del held[i:]

        while True:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else len(html)
            if stop > at:
                nodes.append((unescape(html[at:stop]), stack[-1]))
            if not m:
                return
            at = m.end()
            if m["cdata"] is not None:
                nodes.append((m["cdata"], stack[-1]))
            if m["tag"] is None:
                continue
            tag, attrs = m["tag"].lower(), m["attrs"]
            if m["end"]:
                if tag == "br":
                    nodes.append((" ", stack[-1]))
                i = places[tag][-1] if places.get(tag) else 0
                if i and not (tag in INLINE and i < blocks[-1]) and not (tag not in SCOPES and i < cells[-1]):
                    pop_to(i)
                continue
            if tag in VOID:
                nodes.append((None, stack[-1]) if tag == "hr" else ("" if tag == "wbr" else " ", stack[-1]))
                continue
            if tag in _P_CLOSERS and paragraphs[-1]:
                pop_to(paragraphs[-1])
            if tag in _GROUP:
                g = _GROUP[tag]
                if tag == "tr" and groups[-1][3]:  # a row ends an open cell and its row
                    pop_to(groups[-1][3])
                if groups[-1][g]:
                    pop_to(groups[-1][g])
            if tag == "body" and places.get("head"):
                pop_to(places["head"][-1])
            if tag not in INLINE:
                nodes.append((None, stack[-1]))
            if attrs.endswith("/") and tag in ("svg", "path", "script"):
                continue
            if tag in RAW:
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                if end:
                    at = html.find(">", end.end() - 1) + 1 or len(html)
                elif tag in ("script", "style", "textarea", "xmp"):
                    at = len(html)
                else:
                    endless.add(tag)
                continue
            e = self._element(tag, stack[-1], *_kind(tag, attrs))
            i = len(stack)
            stack.append(e)
            blocks.append(blocks[-1] if tag in INLINE else i)
            paragraphs.append(i if tag == "p" else 0 if tag in SCOPES else paragraphs[-1])
            cells.append(i if tag in ("td", "th") else cells[-1])
            near = groups[-1]
            if tag in _LISTS:
                near = (0,) * 5
            elif tag in _GROUP:
                near = (*near[: _GROUP[tag]], i, *near[_GROUP[tag] + 1 :])
            groups.append(near)
            places.setdefault(tag, []).append(i)

    def under(self, own: list[float]) -> list[float]:
        """Sums over elements and all that they hold."""
        held = list(own)
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        return held

    def dropped(self) -> list[bool]:
        """Elements that are not content, with all that they hold."""
        own, main = [0.0] * len(self.tag), [float(t in ("h1", "article", "main")) for t in self.tag]
        for text, e in self.nodes:
            if text and not self.link[e]:
                own[e] += len(text.strip())
        hard = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            hard[e] = hard[self.parent[e]] or self.kind[e] == HARD
            if hard[e]:
                own[e] = main[e] = 0.0
        own, main = self.under(own), self.under(main)
        out = hard
        for e in range(1, len(self.tag)):
            if self.kind[e] == MARK and not hard[e]:
                holds = own[e] >= 0.9 * own[0] or main[e] and own[e] >= 0.5 * own[0]
                out[e] = not (own[0] and holds)
            out[e] = out[e] or out[self.parent[e]]
        return out


class Blocks:
    """Kept blocks of a page: text, element, path, and lengths of text, punctuation and text in links."""

    def __init__(self, page: Page):
        self.text: list[str] = []
        self.element: list[int] = []
        length, punct, linked = [], [], []
        drop = page.dropped()
        now: list[str] = []
        first, links = 0, 0

        def close() -> None:
            if now and (text := " ".join("".join(now).split())):
                self.text.append(text)
                self.element.append(page.block[first])
                length.append(len(text))
                punct.append(len(_PUNCT.findall(text)))
                linked.append(min(links, len(text)))

        for text, e in page.nodes:
            if text is None:
                close()
                now, links = [], 0
            elif not drop[e]:
                if not now:
                    first = e
                now.append(text)
                links += len(text.strip()) if page.link[e] else 0
        close()
        self.length, self.punct, self.linked = (np.array(c, float) for c in (length, punct, linked))
        self.path = np.array([page.path[e] for e in self.element], np.int64)


def path_scores(b: Blocks) -> tuple[np.ndarray, float]:
    """Every block's path score (fused, smoothed, averaged per path), and the threshold."""
    _, of = np.unique(b.path, return_inverse=True)
    count, length, punct, linked = (np.bincount(of, weights=w) for w in (np.ones(len(of)), b.length, b.punct, b.linked))
    free = 1 - linked / length
    ratio = ((length / count) * (1 + punct / count) * free)[of]
    far = np.pad(ratio, 2)
    n = len(ratio)
    left, right = 0.6 * far[1 : n + 1] + 0.4 * far[:n], 0.6 * far[3 : n + 3] + 0.4 * far[4 : n + 4]
    smooth = np.maximum(ratio, LIFT * np.minimum(left, right))
    score = (np.bincount(of, weights=smooth) / count * free)[of]
    return score, PART * float((score * b.length).sum() / b.length.sum())


def region(page: Page, b: Blocks, weight: np.ndarray) -> int:
    """The element that holds the content: the only article, or one with over half of the selected text, or such a main;
    else the deepest element with nearly all of it."""
    own, shown = [0.0] * len(page.tag), [0.0] * len(page.tag)
    for e, w, n in zip(b.element, weight.tolist(), b.length.tolist(), strict=True):
        own[e] += w
        shown[e] += n
    own, shown = page.under(own), page.under(shown)
    for tag in ("article", "main"):
        named = [e for e in range(len(page.tag)) if page.tag[e] == tag and shown[e]]
        best = max(named, key=lambda e: own[e], default=0)
        if best and (len(named) == 1 or own[best] > 0.5 * own[0]):
            return best
    best = at = 0
    for e in range(1, len(page.tag)):
        # parents come first, and at most one child can hold this much
        if page.parent[e] == at and own[0] and own[e] >= 0.9 * own[0]:
            at = e
            if page.tag[e] == "td" or page.tag[e] not in FLOW and page.tag[e] not in INLINE:
                best = e
    return best


def _chosen(page: Page, b: Blocks) -> np.ndarray:
    """Which blocks are the main text."""
    score, least = path_scores(b)
    selected = (score > 0) & (score >= least)
    top = region(page, b, np.where(selected, b.length - b.linked, 0))
    inside, home = [e == top for e in range(len(page.tag))], list(range(len(page.tag)))
    for e in range(1, len(page.tag)):
        inside[e] = inside[e] or inside[page.parent[e]]
        if e != top and (page.tag[e] in FLOW or page.tag[e] in INLINE):
            home[e] = home[page.parent[e]]
    within = np.array([inside[e] for e in b.element])
    homes = np.array([home[e] for e in b.element])
    keep = selected & within
    # what stands in one container with selected blocks, unless it is a list of links
    keep |= within & np.isin(homes, homes[keep]) & (b.linked < 0.8 * b.length)
    at = np.flatnonzero(keep)
    for x, y in zip(at, at[1:], strict=False):
        if 1 < y - x <= GAP + 1:
            keep[x + 1 : y] |= within[x + 1 : y] & (b.linked[x + 1 : y] < 0.5 * b.length[x + 1 : y])
    if len(at) and not any(page.tag[b.element[i]] == "h1" for i in at):
        for i in range(at[0] - 1, max(at[0] - 1 - GAP, -1), -1):
            if page.tag[b.element[i]] == "h1":
                keep[i] = True
                break
    return keep


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    b = Blocks(page)
    return " ".join(b.text[i] for i in np.flatnonzero(_chosen(page, b))) if b.text else ""


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; no shuffle, one page in memory at a time beside its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [main_text(h) for h in column(part, "html").to_pylist()]
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
