"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of tags and classes from the root. For every path
the text outside of links and the punctuation of its blocks are added up and divided by their number;
both ratios are smoothed over neighbouring blocks in page order and fused, with a weight for blocks
inside an article or main element. Paths that reach a share of the fused values' spread are content.
Content nodes name the region: the article or main elements that hold them, else the least element
around them, with the page's heading. The text is all of the region but for menus, page headers, footers,
sidebars, notices, adverts, forms, hidden parts and reader comments, which tags, roles and the words of
class and id names give away.

A page is worked on alone, in Arrow batches cut by bytes, so there is no shuffle, and memory follows the
longest page.

Defined cases: null and empty html, and pages without text, give an empty text of 0 characters. Tags that
are never closed end with what holds them, a comment, script or style without an end goes on to the end of
the page. A line break is white space; a table's cell and a list's item are blocks. Rows that repeat are
pages of their own, columns of other names aren't read, and an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log1p, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .frames import narrow

SLICE_BYTES = 8_000_000


@dataclass(frozen=True)
class ExtractRules:
    #: Shares of a block's neighbours in its smoothed ratios, from two before to two after.
    kernel: tuple[float, ...] = (0.06, 0.24, 0.4, 0.24, 0.06)
    #: What text without any punctuation keeps of its ratio.
    bare: float = 0.2
    #: Weight of blocks inside an article or main element.
    landmark: float = 4.0
    #: Share of the standard deviation of fused values that a path must reach.
    spread: float = 0.8


# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
MUTE = frozenset("audio button canvas datalist label map math noscript object select svg template video".split())
WALLS = frozenset("caption math noscript object svg table td template th".split())
TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag on the left ends an open element on the right.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr", "caption"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("td", "th", "tr", "tbody", "thead", "caption"), "tfoot": ("td", "th", "tr", "tbody", "thead", "caption"), "thead": ("caption",),
}
INSIDE_P = frozenset("body caption head html tbody td tfoot th thead tr legend".split())
LIST_WALLS = frozenset("ul ol menu dir dl table".split())

# What gives boilerplate away.
HARD_TAGS = frozenset("nav aside footer form dialog menu search head".split())
HARD_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc footer colophon copyright sidebar sidebars aside widget widgets related recommended "
    "recommendations trending notice notices cookie cookies consent gdpr alert popup modal overlay toast newsletter subscribe signup ad ads advert adverts advertisement "
    "advertisements advertising advertorial adsense adsbygoogle sponsor sponsored sponsors promo promos promotion promoted banner banners login search searchbox comment comments "
    "commentlist disqus respond replies reply share sharing social".split()
)
TOP_WORDS = frozenset("header masthead topbar".split())
BESIDE_TOP = frozenset("site main page top global web app wrapper wrap container bar inner the".split())
STATES = frozenset("has with no without is not open closed free enabled disabled".split())
FLAGS = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
NONE, SOFT, HARD = 0, 1, 2


@lru_cache(4096)
def _about(tag: str, attributes: str) -> tuple[int, bool, bool, str]:
    """How surely an element is boilerplate, whether only outside an article, whether it is a landmark, and its name in a path."""
    got = {k.lower(): v1 or v2 or v3 for k, v1, v2, v3 in reversed(ATTRIBUTE.findall(attributes))}
    role = got.get("role", "").lower().strip()
    landmark = tag in ("article", "main") or role in ("main", "article") or "articlebody" in got.get("itemprop", "").lower()
    label = f"{tag} {got.get('class', '')}"
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or INVISIBLE.search(got.get("style", ""))
    if tag in HARD_TAGS or hidden or role in HARD_ROLES:
        return HARD, False, landmark, label
    if tag == "header" or role == "banner":
        return HARD, True, landmark, label
    if tag in ("html", "body", "main"):
        return NONE, False, landmark, label
    top = False
    for name in f"{got.get('class', '')} {got.get('id', '')}".split():
        words = [w.lower() for w in NAME_WORDS.findall(name)]
        if STATES.intersection(words):
            continue
        if WORDS.intersection(words):
            return SOFT, False, landmark, label
        top |= bool(TOP_WORDS.intersection(words)) and not set(words) - TOP_WORDS - BESIDE_TOP
    return (SOFT if top else NONE), top, landmark, label


@dataclass
class Page:
    """Elements in page order, and the blocks of text with the elements that hold them."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    cue: list[int] = field(default_factory=lambda: [NONE])
    landmark: list[int] = field(default_factory=lambda: [0])  # the nearest one around, 0: none
    path: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links


def parse(source: str) -> Page:
    """Blocks and elements of a page, as browsers would nest them but for formatting tags, which don't count."""
    page, paths = Page(), {}
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element (-1: formatting), whether it mutes text
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    links = linked = mute = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces and (text := " ".join("".join(pieces).split())):
            page.blocks.append((here(), text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def here() -> int:
        return next(e for _, e, _ in reversed(stack) if e >= 0)

    def said(text: str) -> None:
        nonlocal linked
        if text and not mute:
            pieces.append(entities.unescape(text) if "&" in text else text)
            linked += len(text) * (links > 0)

    def drop(i: int) -> None:
        """Takes entry `i` off the stack."""
        nonlocal links, mute
        tag, _, muted = stack.pop(i)
        open_tags[tag] -= 1
        links -= tag == "a"
        mute -= muted

    def close(i: int) -> None:
        """Ends entry `i` of the stack and all above it."""
        flush()
        while len(stack) > i:
            drop(-1)

    def found(tags: tuple[str, ...], walls: frozenset[str]) -> int:
        """The place of the last open element of these tags before a wall; 0: none."""
        if any(open_tags.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in walls:
                    break
        return 0

    def start(tag: str, attributes: str) -> None:
        nonlocal links, mute
        sort = NONE, False, tag in ("article", "main"), f"{tag} "
        if attributes and FLAGS.search(attributes) or tag in HARD_TAGS or tag == "header":
            sort = _about(tag, attributes)
        if tag not in BLOCK:
            if tag == "br":
                said(" ")
            if tag in VOID:
                return
            muted = tag in MUTE or sort[0] != NONE and not sort[1]
            stack.append((tag, -1, muted))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            links += tag == "a"
            mute += muted
            return
        flush()
        if tag == "hr":
            return
        if tag not in INSIDE_P and (i := found(("p",), WALLS)):
            close(i)
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        if open_tags.get("head") and tag not in ("head", "html") and (i := found(("head",), WALLS)):
            close(i)
        if tag in ENDS:
            walls = frozenset(("table",)) if tag in TABLE_PARTS else LIST_WALLS
            while i := found(ENDS[tag], walls):
                close(i)
        above = here()
        outside = not page.landmark[above]
        me = len(page.tag)
        page.tag.append(tag)
        page.parent.append(above)
        page.cue.append(NONE if sort[1] and not outside else sort[0])
        page.landmark.append(me if sort[2] else page.landmark[above])
        page.path.append(paths.setdefault((page.path[above], sort[3]), len(paths) + 1))
        stack.append((tag, me, False))
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def end(tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            if tag == "br":
                said(" ")
            return
        if tag in BLOCK:
            flush()
            if i := found((tag,), frozenset(("table",)) if tag in TABLE_PARTS - {"table"} else frozenset() if tag in WALLS else WALLS):
                close(i)
        elif open_tags.get(tag):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i) if tag in WALLS else drop(i)
                    return
                if stack[i][0] in WALLS and tag not in WALLS:
                    return

    while m := TOKEN.search(source, at):
        said(source[at : m.start()])
        at = m.end()
        if tag := m[2]:
            tag = tag.lower()
            if m[1]:
                end(tag)
            elif tag in RAW:
                over = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = over.end() if over else len(source)
            else:
                start(tag, m[3])
                if m[3].endswith("/") and tag in MUTE and stack[-1][0] == tag:
                    drop(-1)
    said(source[at:])
    flush()
    return page


def _left_out(page: Page) -> list[bool]:
    """For each element, whether it belongs to boilerplate. A form or a telling name around the main element says nothing."""
    cue = page.cue[:]
    for e, tag in enumerate(page.tag):
        if page.landmark[e] == e != 0:
            up = page.parent[e]
            while up:
                if page.tag[up] == "form" or tag != "article" and cue[up] == SOFT:
                    cue[up] = NONE
                up = page.parent[up]
    out = [False] * len(cue)
    for e in range(1, len(cue)):
        out[e] = cue[e] != NONE or out[page.parent[e]]
    return out


def content_paths(page: Page, left: list[int], rules: ExtractRules) -> set[int]:
    """Paths whose fused ratios reach the threshold; `left` are the blocks that may be content."""
    number, chars, marks = {}, {}, {}
    for i in left:
        e, text, linked = page.blocks[i]
        p = page.path[e]
        number[p] = number.get(p, 0) + 1
        chars[p] = chars.get(p, 0) + len(text) - linked
        marks[p] = marks.get(p, 0) + len(PUNCTUATION.findall(text))
    ratios = {p: (log1p(chars[p] / n), log1p(marks[p] / n)) for p, n in number.items()}
    of = [page.path[page.blocks[i][0]] for i in left]
    middle = len(rules.kernel) // 2
    fused: dict[int, float] = {}
    values = []
    for k, i in enumerate(left):
        near = [(w, ratios[of[k + d - middle]]) for d, w in enumerate(rules.kernel) if 0 <= k + d - middle < len(of)]
        every = sum(w for w, _ in near)
        text, punctuation = sum(w * r[0] for w, r in near) / every, sum(w * r[1] for w, r in near) / every
        value = text * (rules.bare + punctuation) * (rules.landmark if page.landmark[page.blocks[i][0]] else 1.0)
        fused[of[k]] = fused.get(of[k], 0.0) + value / number[of[k]]
        values.append(value)
    mean = sum(values) / len(values)
    least = min(rules.spread * sqrt(sum((v - mean) ** 2 for v in values) / len(values)), max(fused.values()))
    return {p for p, v in fused.items() if v >= least}


def _around(page: Page, elements: list[int]) -> int:
    """The least element that holds all of these."""
    found = elements[0]
    for e in elements[1:]:
        while found != e:  # elements are numbered in page order, so the later one goes up
            if found > e:
                found = page.parent[found]
            else:
                e = page.parent[e]
    return found


def main_text(source: str | None, rules: ExtractRules = ExtractRules()) -> str:
    page = parse(source or "")
    out = _left_out(page)
    left = [i for i, (e, _, _) in enumerate(page.blocks) if not out[e]]
    if not left:
        return ""
    paths = content_paths(page, left, rules)
    content = sorted({page.blocks[i][0] for i in left if page.path[page.blocks[i][0]] in paths})
    heads = [e for e in sorted({page.blocks[i][0] for i in left}) if page.tag[e] == "h1"]
    inside = [e for e in content if page.landmark[e]]
    size = lambda es: sum(len(t) for e, t, _ in page.blocks if e in es)
    if inside and heads and not any(page.landmark[e] for e in heads) and 5 * size(set(inside)) < size(set(content) - set(inside)):
        inside = []  # an article element beside the story, which has the page's heading
    if inside:
        regions = {page.landmark[e] for e in inside}
    else:
        region = _around(page, content)
        if len(heads) == 1 and heads[0] < content[0]:
            region = _around(page, [region, heads[0]])
        regions = {region}
    within = [False] * len(page.tag)
    within[0] = 0 in regions
    for e in range(1, len(within)):
        within[e] = e in regions or within[page.parent[e]]
    return "\n\n".join(page.blocks[i][1] for i in left if within[page.blocks[i][0]])


def _extracted(rules: ExtractRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")), at + 1)
                part = batch.slice(at, upto - at)
                texts = [main_text(x.as_py(), rules) for x in part.column("html")]
                made = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["page_id", "url", "text", "n_chars"])
                at = upto

    return run


def extract(pages: DataFrame, rules: ExtractRules = ExtractRules()) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page."""
    p = narrow(pages, "page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    return p.mapInArrow(_extracted(rules), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
