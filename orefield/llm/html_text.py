"""Main text of web pages by tag-path ratios.

Each text of a page belongs to the path of tags (with classes) from the root to it. Per path, text
length and punctuation are summed and divided by the number of its texts; the two ratios are fused
(their product), spread to the single texts, smoothed over neighbours in page order, and texts at or above the
threshold (a share of the page's mean, weighted by length), as their path's own ratio must be, are content. Elements that are no text by
their tag (navigation, headers, footers, forms and the like) never count. Names of such parts in class, id or role only weigh: they lower the ratios
of what is below them: a little for headers, footers, banners and the like, under which prose that is long beside the rest of the page stays, and by
a thousand for adverts, comments and others that the text is to be without. A name counts if all its words name parts or are
neutral (site-header, comment-list), not if it says something else too (comment-on-budget, related-work, has-sidebar), and not on an element around
nearly all text. All content is kept. So is, although its own ratio is low, a short paragraph or heading beside content in its sectioning element, or in the
deepest one below body that holds nine tenths of the content; below a counted name, only beside content under that same name.

Null and empty pages give empty text. Broken markup is read leniently: missing end tags, stray end
tags and text after the last tag. Repeated pages give a row each; extra columns stay, but for one
with the name of the output, which replaces it.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import with_text_columns

THRESHOLD = 0.25
_SMOOTH = (0.25, 0.5, 0.25)
#: Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_NOT_CONTENT = frozenset("head title script style textarea noscript template iframe nav header footer aside form button select option svg canvas object menu dialog label input".split())
_SECTION = frozenset("article main section div td body html".split())
#: Words in class, id or role that name other parts of a page than its text, and how much of a ratio they leave.
_PARTS = dict.fromkeys("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent modal nav navbar navigation newsletter notice notices popup promo promotion reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split(), 0.001)
_PARTS |= dict.fromkeys("banner disclaimer footer header menu related".split(), 0.4)
#: Words that leave such a name what it is.
_NEUTRAL = frozenset("a area author bar block body bottom box button buttons card col column container content entry form global group head icon icons inner item items large left level link links list main mobile module outer page panel post primary right row secondary section site slot small sticky text thread title top unit wrap wrapper".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>?|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"[^a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_SPACES = re.compile(r"\s+")


class _Element:
    __slots__ = ("bad", "chain", "depth", "mark", "named", "other", "parent", "path", "section", "size", "tag", "weight")

    def __init__(self, tag: str, path: int, parent: _Element | None, bad: bool, named: float = 1.0) -> None:
        self.tag, self.path, self.parent, self.bad, self.named = tag, path, parent, bad, named
        self.depth = parent.depth + 1 if parent else 0
        self.section = self if tag in _SECTION or not parent else parent.section
        self.size = self.chain = 0
        self.other, self.weight = False, 1.0
        self.mark: _Element | None = None  # the innermost element around whose name counts


def _name_weight(named: str) -> float:
    """What the names leave of a ratio: 1 if none of them names a part."""
    least = 1.0
    for name in named.split():
        words = [w for w in _CLASS.split(name) if w]
        known = [_PARTS[w] for w in words if w in _PARTS]
        if known and all(w in _PARTS or w in _NEUTRAL or w.isdigit() for w in words):
            least = min(least, *known)
    return least


def _settle(elements: list[_Element], rows: list[tuple[_Element, int, str]]) -> None:
    """Elements below a name take its weight. From the outside in, a name on an element with over half of the text is ignored while under a quarter of the text is free of names."""
    texts = [(e, len(t.strip())) for e, _, t in rows if not e.bad]
    for e, n in texts:
        e.size += n
    for e in reversed(elements[1:]):  # parents come before their children
        e.parent.size += e.size
    total = elements[0].size
    for e in elements:
        up, large, counts = e.parent, 2 * e.size > total, e.named < 1
        e.chain = (up.chain if up else 0) + (counts and large)
        e.other = bool(up and up.other) or (counts and not large)
    free: dict[int, int] = defaultdict(int)
    for e, n in texts:
        if not e.other:
            free[e.chain] += n
    ignored, found, most = 0, free[0], max(e.chain for e in elements)
    while ignored < most and 4 * found < total:
        ignored += 1
        found += free[ignored]
    for e in elements:
        up = e.parent
        counts = e.named < 1 and (2 * e.size <= total or e.chain > ignored)
        e.weight = (up.weight if up else 1.0) * (e.named if counts else 1.0)
        e.mark = e if counts else up.mark if up else None


def _texts(page: str) -> list[tuple[_Element, int, str]]:
    """(element, block number, raw text) in page order."""
    root = _Element("html", 0, None, False)
    paths: dict[tuple[int, str, str], int] = {}  # a number for each path, so that deep pages stay small
    at, block, out = root, 0, []
    elements = [root]
    skipped = 0
    for m in _TOKEN.finditer(page):
        if m.start() < skipped:
            continue
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if not text.startswith(("<!", "<?")):
                out.append((at, block, text))
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            block += 1
        if m.group(1):
            e = at
            while e is not None and e.tag != tag:
                e = e.parent
            if e is not None and e.parent is not None:
                at = e.parent
            continue
        if tag in _VOID:
            if tag == "br":
                out.append((at, block, " "))
            continue
        if tag == "html":
            continue
        if tag in _BLOCK:  # an open paragraph ends before a block; so does an open item before its like
            e = at
            while e.parent is not None and e.tag not in _SECTION and e.tag not in ("ul", "ol", "table", "tr", "nav", "form", "aside"):
                if e.tag == "p" or (e.tag == tag and tag in ("li", "dt", "dd", "tr", "option")):
                    at = e.parent
                    break
                e = e.parent
        names = ""
        bad, weight = at.bad or tag in _NOT_CONTENT, 1.0
        if m.group(3):
            named = " ".join(a or b or c for a, b, c in _NAMES.findall(m.group(3))).lower()
            names = ".".join(sorted(set(named.split())))
            weight = _name_weight(named)
        at = _Element(tag, paths.setdefault((at.path, tag, names), len(paths) + 1), at, bad, weight)
        elements.append(at)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, m.end())
            skipped = end.start() if end else len(page)
    _settle(elements, out)
    return out


def main_text(page: str) -> str:
    rows = _texts(page)
    usable = [(e, b, html.unescape(t) if "&" in t else t) for e, b, t in rows if not e.bad]
    size, marks, times = defaultdict(int), defaultdict(int), defaultdict(int)
    nodes = []
    for e, b, t in usable:
        short = t.strip()
        if short:
            nodes.append((e, b, short))
            size[e.path] += len(short)
            marks[e.path] += len(_PUNCTUATION.findall(short))
            times[e.path] += 1
    if not nodes:
        return ""
    fused = {p: (size[p] / times[p]) * (1 + marks[p] / times[p]) for p in size}
    values = [fused[e.path] * e.weight for e, _, _ in nodes]
    spread = [sum(w * values[min(max(i + d, 0), len(values) - 1)] for d, w in zip((-1, 0, 1), _SMOOTH)) for i in range(len(values))]
    lengths = [len(t) for _, _, t in nodes]
    threshold = THRESHOLD * math.fsum(s * n for s, n in zip(spread, lengths)) / sum(lengths)
    inside: dict[_Element, int] = defaultdict(int)
    for (e, _, t), s, v in zip(nodes, spread, values):
        if s >= threshold and v >= threshold:  # a menu item does not become content by its neighbour
            inside[e] += len(t)
    content = set(inside)
    beside = {e.section for e in inside}  # sectioning elements with content of their own
    total = sum(inside.values())
    levels: dict[int, list[_Element]] = defaultdict(list)
    for e in inside:
        levels[e.depth].append(e)
    for depth in range(max(levels, default=0), 0, -1):  # children add to their parents, deepest first
        for e in levels.pop(depth, ()):
            if e.parent not in inside:
                levels[depth - 1].append(e.parent)
            inside[e.parent] += inside[e]
    section = None  # the deepest sectioning element with nine tenths of the content; an article or main element first
    for e, n in inside.items():
        if 10 * n >= 9 * total and e.tag in _SECTION and e.tag not in ("body", "html"):
            rank = (e.tag in ("article", "main"), e.depth)
            if section is None or rank > section[0]:
                section = (rank, e)
    chosen = section[1] if section else None
    blocks: dict[int, list[str]] = {}
    held: dict[_Element, bool] = {}

    def within(e: _Element) -> bool:
        seen, up = [], e
        while up not in held and up is not chosen and up.parent is not None:
            seen.append(up)
            up = up.parent
        answer = up is chosen or held.get(up, False)
        held.update(dict.fromkeys([*seen, up], answer))
        return answer

    def stays(e: _Element) -> bool:
        if e.mark is None:
            return e.section in beside or within(e)
        return e in content or (e.section in beside and e.section.mark is e.mark)

    for e, b, t in usable:
        if stays(e):
            blocks.setdefault(b, []).append(t)
    lines = (_SPACES.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text in out_col."""

    def run(raw: list[bytes]) -> list[pa.Array]:
        return [pa.array([main_text(p.decode()) for p in raw], pa.string())]

    return with_text_columns(pages, html_col, f"`{out_col}` string", run)
