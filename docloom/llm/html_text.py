"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines of text, one for each block of the page; what stands in containers that are never article
(menus, headers, footers, asides, forms, notices, adverts, comments, by tag, role, class or id) weighs nothing, and
neither do lines that are mostly links. The lengths are summed over sliding windows of three lines. The main text begins
where the sums surge over a bar, ends where they dive to zero again, and all lines between are kept, short ones and links
too. A container that holds no article ends a range, unless it lies between lines of the same parent, as an advert between
paragraphs does. Without a surge, the range of largest sum is taken.

Surge and dive decide on every page. An <article> is weight only: in one with text enough, lines of links count as one
character, so that they end no range, and neither does a container in it that holds no article. One with less, as the
cards of related pages are, is summed apart from what stands around it.
"""

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the characters in one from which text surges.
WINDOW, SURGE = 3, 120

# Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg math iframe object textarea xmp noembed noframes canvas audio video title".split()
#: Containers that hold no article.
OUTSIDE = frozenset("nav header footer aside form head dialog menu button select fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Class and id names of such containers: these whole names; these before further words that are no state of a page
#: (`sidebar-left`, not `sidebar-open`); and these after a word of place (`main-menu`, not `has-sidebar`).
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment "
    "comments cookie cookies consent gdpr disclaimer discussion disqus footer header masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup related recommended replies respond share sharing shares sidebar "
    "sidebars signup social subscribe subscription tags toolbar widget widgets".split()
)
PLACES = frozenset("article bottom entry footer global header inline left main mobile page post primary right secondary site social top".split())
STATES = frozenset(
    "active closed collapsed content disabled enabled expanded fixed free has hidden layout no none off on open page present show shown visible "
    "with without".split()
)
#: Blocks that are parts of the text around them.
WITHIN = frozenset("ul ol dl li dt dd blockquote section table tbody thead tfoot tr td th figure center hgroup".split())
#: A tag that opens closes an open one of these before it.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

GONE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(" + "|".join(RAW) + r")\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)",
    re.S | re.I,
)
# Possessive: a tag that never ends is given up where the next one begins.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACES = re.compile(r"\s+")


def _outside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether a tag opens a container that holds no article."""
    if tag in OUTSIDE and not (tag == "header" and in_article):
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for name, a, b, c in NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in OUTSIDE_ROLES:
            return True
        if name in ("class", "id") and any(map(_names_outside, value.split())):
            return True
    return False


def _names_outside(name: str) -> bool:
    """Whether a name of a class or an id is one of a container that holds no article."""
    words = [w.lower() for w in WORDS.findall(name)]
    at = next((k for k, w in enumerate(words) if w not in PLACES or k == len(words) - 1 or w in OUTSIDE_NAMES and words[k + 1] not in OUTSIDE_NAMES), None)
    if at is None or words[at] not in OUTSIDE_NAMES or not STATES.isdisjoint(words[at + 1 :]):
        return False
    # The header of an article or a page holds its title.
    return not (words[at] == "header" and at and words[at - 1] in ("article", "entry", "page", "post"))


class Line(NamedTuple):
    """A block of a page; `weight` counts the characters outside links, and none of an outside container.

    `block` is the number of the container its text stands in and `parent` that of the one around; for a line in an
    outside container, `parent` is the one around that.
    """

    text: str
    weight: int
    article: int
    outside: bool
    block: int
    parent: int


def lines(page: str) -> tuple[list[Line], list[int]]:
    """The blocks in page order, and for each <article>, numbered from 1, the one it stands in (0: none)."""
    page = GONE.sub(lambda m: " " if m.group(1) is None else "", page)
    out: list[Line] = []
    above = [0]
    # (tag, in article or main, outside, link, article, block, parent)
    stack: list[tuple[str, bool, bool, bool, int, int, int]] = []
    text: list[str] = []
    linked = article = at = block = parent = blocks = 0
    outside = False

    def end_line():
        nonlocal linked
        if text:
            line = SPACES.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append(Line(line, 0 if outside else max(0, len(line) - 2 * linked), article, outside, block, parent))
            text.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        if piece:
            text.append(piece)
            if stack and stack[-1][3]:
                linked += len(piece.strip())

    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            end_line()
        if closing:
            # An end tag without a beginning, or beyond the container it stands in, closes nothing.
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None and (tag in BLOCKS or not any(s[0] in BLOCKS for s in stack[k + 1 :])):
                del stack[k:]
        elif tag not in VOID and not attributes.endswith("/"):
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in BLOCKS:
                k -= 1
            if k >= 0 and tag in CLOSES.get(stack[k][0], ()):
                del stack[k:]
            around, was_article, was_outside, was_link, number, block, parent = stack[-1] if stack else ("", False, False, False, 0, 0, 0)
            if tag == "article":
                above.append(number)
                number = len(above) - 1
            is_article = was_article or tag in ("article", "main")
            is_outside = was_outside or _outside(tag, attributes, is_article)
            if tag in BLOCKS and not was_outside:
                # What stands in a part of a text has the parent that the part has.
                parent = parent if around in WITHIN and stack[-1][5] else block
                blocks += 1
                block = blocks
            stack.append((tag, is_article, is_outside, tag == "a" or tag not in BLOCKS and was_link, number, block, parent))
        outside, article, block, parent = (stack[-1][2], *stack[-1][4:]) if stack else (False, 0, 0, 0)
    add(page[at:])
    end_line()
    return out, above


def _full(found: list[Line], above: list[int]) -> list[bool]:
    """Which articles hold text enough to surge, or on a page of little text as much as stands anywhere else."""
    held = [0] * len(above)
    for line in found:
        held[line.article] += line.weight
    beside = held[0]
    for k in range(len(above) - 1, 0, -1):
        if above[k]:
            held[above[k]] += held[k]
    bar = max(1, min(SURGE, max([beside, *held[1:]])))
    return [False, *(n >= bar for n in held[1:])]


def _segments(found: list[Line], full: list[bool]) -> list[list[int]]:
    """The lines that are summed together."""
    out: list[list[int]] = []
    # The last line of each container's own.
    latest = {home: k for k, line in enumerate(found) if not line.outside for home in (line.block, line.parent)}
    seen: dict[int, int] = {}
    last, first = None, 0
    between: set[int] = set()
    for k, line in enumerate(found):
        if line.outside:
            between.add(line.parent)
            continue
        same = last is not None and line.article == found[last].article and full[line.article]
        # Lines of the same parent on both sides.
        same = same or all(seen.get(p, -1) >= first and latest[p] >= k for p in between)
        card, was_card = (bool(a) and not full[a] for a in (line.article, found[last or 0].article))
        if last is None or card != was_card or not same:
            out.append([])
            first = k
        out[-1].append(k)
        seen[line.block] = seen[line.parent] = last = k
        between.clear()
    return out


def _ranges(weights: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, highest window) from each first line that counts to the next dive."""
    out: list[tuple[int, int, int]] = []
    begin, peak = None, 0
    for k in range(len(weights) + 1):
        window = sum(weights[k : k + WINDOW])
        if begin is None and window and weights[k]:
            begin, peak = k, 0
        peak = max(peak, window)
        if begin is not None and not window:
            out.append((begin, k, peak))
            begin = None
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines; empty if there is none."""
    if not page:
        return ""
    found, above = lines(page)
    full = _full(found, above)
    weights = [max(line.weight, int(full[line.article])) for line in found]
    ranges = [(s[b:e], peak) for s in _segments(found, full) for b, e, peak in _ranges([weights[k] for k in s])]
    if not ranges:
        return ""
    bar = min(SURGE, max(peak for _, peak in ranges))
    return "\n".join(found[k].text for kept, peak in ranges if peak >= bar for k in kept)


def extract(df: DataFrame, html_column: str, out: str = "text") -> DataFrame:
    """Add the main text of a column of pages. `out` replaces a column of that name.

    Null and empty pages, and pages without text, give the empty string. Pages of any length are read whole, one by one.
    Character references are decoded; white space within a block, line breaks by br included, becomes one space.
    """
    kept_columns = [c for c in df.columns if c != out]
    at = kept_columns.index(html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept_columns, out])

    rows = df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept_columns])
    return rows.mapInArrow(run, rows.withColumn(out, F.lit("")).schema)
