"""Operator 7: main text of web pages by the distribution of their lines.

Markup is stripped to lines, one a block element.  Scripts, styles, comments and
containers that by name hold no article are taken out; each other line weighs the
characters that stand outside links, and nothing where those are no letters or
digits.  Weights are summed over sliding windows of lines.  Where a window's sum
jumps over the surge level the text begins, where it falls to nothing the text
ends, and all lines between are kept that have weight, short ones too, headings, and
paragraphs of the stretch's own container, be they a link or a row of stars.  Every
such stretch stays, with the lines beside it that share its container.  Where a page
marks its article, the mark bounds the search: windows run over the lines in it alone.
A label of class, id or role is read as a whole, and not at all where its container
holds most of the page's text.  In a marked article a label that may as well tell what a
section is about counts only where the windows find no text in that section.

Each page is worked on alone, in Arrow batches.

Defined results.  Null or empty html, and a page without text, give the empty
text.  Unclosed elements end with their container or the page, an unclosed head
where the body or a block begins.  Nothing is capped.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from plebis.llm.common import table

#: Elements whose content is no text.
_HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "title")
#: Containers that hold menus, page heads and feet, side matter and controls.
_OUTSIDE = {"nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "textarea", "fieldset"}
#: The same said by a class, id or role of any container.
_NAMES = (
    "nav|navbar|navigation|menu|menubar|header|masthead|footer|foot|sidebar|aside|breadcrumbs?|ads?|adverts?|advertisement|advertising|"
    "sponsor(?:s|ed)?|promos?|promotion|banners?|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    "sign-?up|share|sharing|shares|social|related|recommended|recommendations|comments?|commentlist|respond|disqus|reply|replies|pager|"
    "pagination|widgets?|tags|toolbar|search|searchform|login|legal|copyright|complementary|contentinfo"
)
#: A whole label: a name, alone or with words that only say which or what shape.
_NAMED = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|sub|mobile|user|post|entry|article|cookie|social|search|share|sharing)[_-])*"
    r"(?:" + _NAMES + r")"
    r"(?:[_-](?:nav|menu|bar|box|list|items?|links?|buttons?|icons?|block|container|wrap|wrapper|area|section|inner|content|posts?|articles?|"
    r"form|thread|banner|notice|consent|widget|left|right|top|bottom|media|\d+))*",
    re.I,
)
#: Labels that also tell what a section of an article is about.
_TOPICS = re.compile(r"search|legal|copyright|login|social|alert|sharing", re.I)
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PROSE = {"p", "blockquote", "pre"}
_CLOSED_BY_NEXT = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
_HOLDERS = {"article", "body", "div", "main", "section", "td"}
_STRIP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(_HIDDEN) + r")\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)", re.S | re.I
)
#: A page's head ends with its tag, else where the body or a first block begins.
_HEAD = re.compile(r"<head\b(?![\w:-])[^>]*>.*?(?:</head\s*>|(?=<(?:" + "|".join(sorted(_BLOCKS - {"html"})) + r")\b(?![\w:-]))|\Z)", re.S | re.I)
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)|[!?][^>]*)>")
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WHITE = re.compile(r"\s+")
#: Lines a window spans, and the weight at which the text begins.
WINDOW, SURGE = 3, 80


class _Open(NamedTuple):
    """An open element, and what it and all around it say about the text in it."""

    name: str
    outside: bool
    marked: int  # number of the outermost marked article, or 0
    number: int
    holder: int
    heading: bool
    linked: bool
    label: int  # the innermost container that is outside by its label alone, or 0


class _Label(NamedTuple):
    """A container that is outside by its label alone, and the one around it."""

    around: int
    topic: bool


class Line(NamedTuple):
    text: str
    weight: int
    marked: int  # marked article or 0
    holder: int
    heading: bool
    prose: bool


def lines(page: str) -> list[Line]:
    """Every line that no tag and no label puts outside."""
    page = _HEAD.sub(" ", _STRIP.sub(" ", page))
    out: list[tuple[Line, int]] = []
    labels: dict[int, _Label] = {}
    stack: list[_Open] = [_Open("", False, 0, 0, 0, False, False, 0)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    free = False  # letters or digits outside links
    at = 0

    def flush() -> None:
        nonlocal parts, linked, free
        if parts:
            text = _WHITE.sub(" ", references.unescape("".join(parts))).strip()
            top = stack[-1]
            if text and not top.outside:
                block = next(o.name for o in reversed(stack) if o.name != "a")
                out.append((Line(text, max(1, len(text) - linked) if free else 0, top.marked, top.holder, top.heading, block in _PROSE), top.label))
        parts, linked, free = [], 0, False

    def take(text: str) -> None:
        nonlocal linked, free
        parts.append(text)
        if stack[-1].linked:
            linked += len(text)
        elif not free:
            free = any(map(str.isalnum, references.unescape(text)))

    for tag in _TAG.finditer(page):
        text = page[at : tag.start()]
        at = tag.end()
        if text:
            take(text)
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCKS:
            flush()
        if tag.group(1):
            # An inline end tag does not close the blocks it stands in.
            back = len(stack) - 1 if opened[name] else 0
            while back and stack[back].name != name and (name in _BLOCKS or stack[back].name not in _BLOCKS):
                back -= 1
            if back and stack[back].name == name:
                opened.subtract(o.name for o in stack[back:])
                del stack[back:]
        elif name not in _VOID and not tag.group(3).endswith("/"):
            if name in _CLOSED_BY_NEXT and stack[-1].name == name:
                opened[stack.pop().name] -= 1
            top = stack[-1]
            label = " ".join(filter(None, (g for m in _LABEL.finditer(tag.group(3)) for g in m.groups())))
            outside = name in _OUTSIDE
            told = [] if outside or name in _MAIN or name in ("body", "html") else list(filter(_NAMED.fullmatch, label.split()))
            by_label = bool(told) or name == "form"  # may wrap a whole page
            if name == "header" and top.marked:
                outside = False  # the article's own heading
            if name == "article" and label and re.search(r"(?:^|[\s_-])comment", label, re.I):
                outside = True
            if name in _BLOCKS or name == "a" or outside or by_label:
                number = tag.start() + 1
                opened[name] += 1
                if by_label:
                    labels[number] = _Label(top.label, name != "form" and bool(top.marked) and all(map(_TOPICS.fullmatch, told)))
                stack.append(
                    _Open(
                        name,
                        top.outside or outside,
                        top.marked or (number if name in _MAIN and not outside else 0),
                        number,
                        number if name in _HOLDERS else top.holder,
                        top.heading or name in _HEADINGS,
                        top.linked or name == "a",
                        number if by_label else top.label,
                    )
                )
    take(page[at:])
    flush()
    return within(out, labels)


def _surges(weights: list[int]) -> bool:
    return any(sum(weights[i : i + WINDOW]) >= SURGE for i in range(len(weights)))


def within(found: list[tuple[Line, int]], labels: dict[int, _Label]) -> list[Line]:
    """The lines that no label puts outside.  A label does not count, outer ones
    first, where its container holds more than half of the weight and the page's
    only marked article, or the lines left without it nowhere reach the surge level; nor
    does a topic's where its own lines reach it.  What is left changes only with a label
    that does not count, and each of the first kind doubles its weight, so that page-wide
    looks are few."""
    own: dict[int, list[Line]] = {}
    for line, label in found:
        own.setdefault(label, []).append(line)
    lifted = {0}
    rest = sum(line.weight for line in own.get(0, ()))
    rest_marked = any(line.marked for line in own.get(0, ()))
    surges: bool | None = None  # of the rest, once asked
    for number, label in sorted(labels.items()):
        if label.around not in lifted:
            continue
        inside = own.get(number, [])
        weight = sum(line.weight for line in inside)
        lift = label.topic and _surges([line.weight for line in inside if line.prose])
        if not lift and weight > rest:
            lift = not rest_marked and len({line.marked for line in inside if line.marked}) == 1
            if not lift:
                if surges is None:
                    surges = _surges([line.weight for line, outer in found if outer in lifted])
                lift = not surges
        if lift:
            lifted.add(number)
            rest += weight
            rest_marked = rest_marked or any(line.marked for line in inside)
            surges = None
    return [line for line, outer in found if outer in lifted]


def extract(page: str | None) -> str:
    found = lines(page or "")
    if any(line.marked and line.weight for line in found):
        found = [line for line in found if line.marked]
    weights = [line.weight for line in found]
    n = len(found)
    if not any(weights):
        return ""
    level = min(SURGE, max(weights))
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    stretches, i = [], 0
    while i < n:
        if weights[i] and sums[i] >= level:
            end = i
            while end < n and (weights[end] or (sums[end] >= level and any(weights[end : end + WINDOW]))):
                end += 1
            stretches.append((i, end))
            i = end
        i += 1
    kept: set[int] = set()
    for start, end in stretches:
        by_holder: dict[int, int] = {}
        for k in range(start, end):
            by_holder[found[k].holder] = by_holder.get(found[k].holder, 0) + weights[k]
        own = max(by_holder, key=by_holder.__getitem__)
        first, last = {own, found[start].holder}, {own, found[end - 1].holder}
        while start and found[start - 1].holder in first:  # a heading above the surge
            start -= 1
        while end < n and found[end].holder in last:
            end += 1
        kept.update(k for k in range(start, end) if weights[k] or found[k].heading or (found[k].prose and found[k].holder == own))
    return "\n\n".join(found[k].text for k in sorted(kept))


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The named columns with text and n_chars (code points) of every page."""
    keep = list(keep)
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return pages.select(*[pages[c] for c in keep], pages[html].alias("__html")).mapInArrow(run, schema)


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
