"""Main text of raw HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line weighs what it can add to
an article: nothing inside menus, forms and the like, otherwise its characters outside
links. The weights of a sliding window of lines are summed; the text surges where a window
becomes heavy and dives where it becomes empty, and the lines between the two points are
kept, links too. Lines of menus, forms and the like stand in no window. Where a page marks
its article, all of that is kept; where no window is heavy, the heaviest run of lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
"""Lines of a sliding window."""

SURGE = 80
"""Weight of a window at which text begins."""

# Elements of HTML by their role.
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search
    section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes svg math object xmp".split())
# Of these only an end tag ends the text, and it may hold what looks like a start tag.
LITERAL = frozenset("script style title textarea".split())
ASIDE = frozenset("head nav footer aside form menu dialog button select search fieldset label".split())
MARKED = frozenset(["article", "main"])
CLOSES_P = BLOCKS - frozenset(["br", "body", "html", "option", "optgroup", "legend", "caption"])

# Names and roles of parts that are not the article.
BOILERPLATE = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion
    nav navbar navigation navigator menu submenu breadcrumb breadcrumbs masthead topbar header footer sidebar sidebars rail
    widget widgets aside cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall
    newsletter subscribe subscription signup login register search share sharing social related recommended
    recommendations trending comment comments commentlist disqus respond replies reply discussion pagination pager toolbar
    copyright disclaimer skip""".split()
)
# Words before such a name that say whether a page has the part: no names of the part itself.
ABOUT = frozenset("has with without no layout".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar status".split())

OUTSIDE = ("", False, False, False)

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)",
    re.DOTALL,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def is_boilerplate(tag: str, attributes: str, in_article: bool, by_name: bool = True) -> bool:
    """Whether an element is no part of an article, from its tag, role and, if asked, names."""
    if tag in ASIDE:
        return True
    if tag == "header":
        return not in_article
    if not attributes or tag in MARKED or tag in ("html", "body"):
        return False
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if by_name and name in ("class", "id"):
            for word in value.split():
                parts = {p.lower() for p in PARTS.findall(word)}
                if in_article:
                    parts -= {"header"}
                if parts & BOILERPLATE and not parts & ABOUT:
                    return True
    return False


def element_ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of that name ends, by where its start tag begins; unclosed ones are missing."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    found = re.compile(
        rf"<!--(?:.*?-->|.*)|<(?:script|style)(?=[\s/>]).*?(?:</(?:script|style)\s*>|\Z)|<{tag}(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/){tag}\s*>|<{tag}(?=[\s/>])[^>]*(?:>|\Z)",
        re.DOTALL | re.IGNORECASE,
    )
    for m in found.finditer(page):
        if m[1] is not None:
            if not SELF_CLOSED.search(m[1]):
                opened.append(m.start())
        elif m[2] and opened:
            ends[opened.pop()] = m.end()
    return ends


def page_lines(page: str, by_name: bool = True) -> list[tuple[str, int, bool, bool]]:
    """(text, weight, in a marked article, boilerplate) of each block, white space made one space."""
    lines: list[tuple[str, int, bool, bool]] = []
    pieces: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # element, boilerplate, in an article, left out of its line
    links = 0

    def end_line() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, aside, marked, _ = stack[-1] if stack else OUTSIDE
                lines.append((text, 0 if aside else max(len(text) - linked, 0), marked, aside))
            pieces.clear()
        linked = 0

    ends: dict[str, dict[int, int]] = {}
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at and not (stack and stack[-1][3]):
            piece = html.unescape(page[at:upto])
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # end tag
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                end_line()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[0] in BLOCKS for s in stack[i:]):
                        end_line()
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            empty = SELF_CLOSED.search((m[3] if m[2] else m[6]) or "")
            if tag in LITERAL:
                close = re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>" if empty else rf"<(/){tag}\s*>", re.IGNORECASE).search(page, at)
                if not empty:
                    at = close.end() if close else end
                elif close and close[1]:  # closed once more, so what looked like its end was none
                    at = close.end()
            elif not empty:
                if tag not in ends:
                    ends[tag] = element_ends(page, tag)
                at = ends[tag].get(m.start(), at)
            continue
        if tag in BLOCKS:
            end_line()
        if tag in CLOSES_P or tag == "li":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (tag == "li" and stack[i][0] == "li"):
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in VOID:
            continue
        attributes = m[3] if m[2] else m[6]
        if attributes and attributes.rstrip().endswith("/") and tag in ("a", "span", "i", "b"):
            continue
        if tag == "a":
            links += 1
        _, aside, marked, silent = stack[-1] if stack else OUTSIDE
        apart = not aside and is_boilerplate(tag, attributes, marked, by_name)
        silent = (silent or apart) and tag not in BLOCKS
        stack.append((tag, aside or apart, marked or (tag in MARKED and not aside and not apart), silent))
    end_line()
    return lines


def runs_of_lines(weight: np.ndarray, surge: int) -> list[tuple[int, int]]:
    """The lines from each surge to the dive after it (end exclusive)."""
    n = len(weight)
    sums = np.concatenate([[0], np.cumsum(weight)])
    ahead = sums[np.minimum(np.arange(n) + WINDOW, n)] - sums[:-1]
    runs, start = [], None
    for i in range(n):
        if start is None and weight[i] and ahead[i] >= surge:
            start = i
        elif start is not None and not ahead[i]:
            runs.append((start, i))
            start = None
    return runs if start is None else [*runs, (start, n)]


def kept_lines(lines: list[tuple[str, int, bool, bool]], also: frozenset[str] = frozenset()) -> list[str]:
    """All of a marked article, else the lines between surge and dive; with these, lines that are in ``also``."""
    lines = [line for line in lines if not line[3]]
    if any(marked for _, _, marked, _ in lines):
        return [text for text, _, marked, _ in lines if marked]
    weight = np.array([w for _, w, _, _ in lines], np.int64)
    inside = np.zeros(len(lines), bool)
    for a, b in runs_of_lines(weight, SURGE):
        inside[a:b] = True
    return [line[0] for line, k in zip(lines, inside, strict=True) if k or line[0] in also] if inside.any() else []


def heaviest_run(lines: list[tuple[str, int, bool, bool]]) -> list[str]:
    """The run of lines, boilerplate lines aside, with most text outside links, however little."""
    lines = [line for line in lines if not line[3]]
    weight = np.array([w for _, w, _, _ in lines], np.int64)
    a, b = max(runs_of_lines(weight, 1), key=lambda r: weight[r[0] : r[1]].sum(), default=(0, 0))
    return [text for text, _, _, _ in lines[a:b]]


def main_text(page: str | None) -> str:
    """The article of one page, its blocks joined by line feeds; null and empty give ''."""
    if not page:
        return ""
    lines = page_lines(page)
    kept = kept_lines(lines)
    if not kept:
        # Names are hints: a page that they would leave without a long text is read without them.
        short, plain = heaviest_run(lines), page_lines(page, by_name=False)
        kept = kept_lines(plain, frozenset(short)) or short or heaviest_run(plain)
        # A short text without any element is no page.
        if len("".join(kept)) < SURGE and not any(m[2] or m[5] for m in TOKEN.finditer(page)):
            return ""
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page, and one without an article, has an empty text; repeated rows get
    equal results; an empty table gives no rows; other columns are not read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
