"""Main-text extraction by line-block distribution.

A page is stripped to lines: one per block element, with markup, scripts, styles, forms and what names itself as a menu,
header, footer, sidebar, notice, advert or comment section leaving empty lines. Text lengths are summed over a
sliding window of lines. Where the sum surges above the threshold a stretch of text lies, from where the sum rises from nothing to
where it dives to nothing: one or two empty lines do not end it. The stretch with the most text tells the main block, the element
that holds it: all stretches above the threshold in that element are main text, and so are short lines between them. The main block
of a stretch in a part of a text (a section, a list, one of several like elements that hold stretches) is the whole they are
parts of. ``article`` and ``main`` elements can be a main block, as ``div`` can. Where most of the text that surges is in such elements, their
edges end a stretch as a dive does; on a page where no sum surges, what they hold is the text, or everything if there are none.

An element named as something else is kept after all if it holds most of the page's text, no sum surges without it, and it does not
name itself as comments.

Defined results: a null or empty html, and one without text, give an empty text; an unclosed element ends where its
parent ends; a tag that is never closed is text; repeated rows each get their own result; further columns are ignored. The time
taken is in proportion to the page, however it is nested or broken.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import table, text_of

WINDOW = 3
SURGE = 80  # characters in a window of lines
MAX_LINK_SHARE = 0.5  # lines with more of their text inside links do not count as text in the distribution

# Element names of HTML, and words by which pages name what is not their text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
NOT_TEXT = frozenset(
    "head nav header footer aside form button select template svg math canvas object audio video dialog menu map".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul aside menu dialog".split()
)
CELLS = frozenset(["td", "th", "br"])
CONTAINERS = frozenset(["article", "main"])
HOLDERS = CONTAINERS | frozenset("body center div html td".split())  # what can be a main block; others are parts of one
NOT_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie"
    " cookies disqus footer header menu modal nav navbar navigation newsletter notice popup promo related respond share sharing"
    " sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ABOUT_OTHERS = frozenset("with without has no is".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus".split())
NOT_TEXT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>", re.S)
# A tag up to its end, or as far as it goes: quoted values may hold any character.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)")
# The same where quotes are unbalanced.
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)")
LONG_TAG = 256  # characters that an attempt at a tag may run over before quotes are taken for unbalanced
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[a-z0-9]+")


def attributes_of(text: str) -> dict[str, str]:
    """The attributes by name, the first of each; empty values where there are none."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def is_named_not_text(attributes: dict[str, str], names: frozenset[str] = NOT_TEXT_NAMES) -> bool:
    """Whether a class, id or role says so; a name like ``body-with-sidebar`` tells of a neighbour, not of the element."""
    for attribute, told in (("class", names), ("id", names), ("role", NOT_TEXT_ROLES)):
        for name in attributes.get(attribute, "").lower().split():
            parts = NAME_PART.findall(name)
            if any(part in told and (not k or parts[k - 1] not in ABOUT_OTHERS) for k, part in enumerate(parts)):
                return True
    return "hidden" in attributes


def is_named_comments(attributes: dict[str, str]) -> bool:
    return is_named_not_text({k: v for k, v in attributes.items() if k != "hidden"}, COMMENT_NAMES)


@dataclass
class Line:
    text: str
    n_link: int
    container: int  # number of the outermost article or main element, 0 outside of them
    element: int  # number of the innermost element


@dataclass
class Element:
    """Elements are numbered as they open, so an element holds the numbers from its own to ``last``."""

    parent: int
    kind: tuple[str, str]  # name and classes
    last: int = -1


@dataclass
class Open:
    name: str
    is_stripped: bool
    by_name: bool  # stripped for its class, id or role, and not a comment section
    container: int
    element: int
    n_before: int  # characters of text before it, stripped ones included


def next_tag(page: str, at: int, bare: bool) -> tuple[re.Match | None, int, bool]:
    """(tag, where the text before it ends, whether quotes are taken as they stand from here on)."""
    while (begin := page.find("<", at)) >= 0:
        m = (BARE_TAG if bare else TAG).match(page, begin)
        if m:
            if page.startswith(">", m.end()):
                return m, begin, bare
            bare = bare or m.end() - begin > LONG_TAG or page.startswith(('"', "'"), m.end())
            m = BARE_TAG.match(page, begin)
            if page.startswith(">", m.end()):
                return m, begin, bare
        elif m := COMMENT.match(page, begin):
            return m, begin, bare
        at = begin + 1
    return None, len(page), bare


def lines_of(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[Line], list[Element], frozenset[int]]:
    """The page's blocks in order, and its elements, first the page itself; an empty line stands where something was stripped.

    The last of the three are the elements named as something else that hold most of the page's text; ``spared`` are elements that
    are not stripped for their names.
    """
    lines: list[Line] = []
    elements = [Element(-1, ("html", ""))]
    parts: list[str] = []
    links: list[str] = []
    opened: list[Open] = []
    names: Counter[str] = Counter()
    blocks: list[int] = []  # the places in ``opened`` of block elements
    stripped = in_link = at = n_text = 0
    bare = False
    weights: dict[int, int] = {}

    def close_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            here = opened[-1] if opened else None
            lines.append(Line(text, len(" ".join("".join(links).split())), here.container if here else 0, here.element if here else 0))
        parts.clear()
        links.clear()

    def close_to(depth: int) -> None:
        nonlocal stripped, in_link
        while len(opened) > depth:
            last = opened[-1]
            if last.name in BLOCKS or last.is_stripped:
                close_block()
            opened.pop()
            names[last.name] -= 1
            if blocks and blocks[-1] == len(opened):
                blocks.pop()
            elements[last.element].last = len(elements) - 1
            if last.by_name:
                weights[last.element] = n_text - last.n_before
            if last.is_stripped:
                stripped -= 1
                if not stripped:
                    lines.append(Line("", 0, 0, 0))
            in_link -= last.name == "a"

    def add(text: str) -> None:
        nonlocal n_text
        if not text:
            return
        n_text += len(text) if text.strip() else 0
        if not stripped:
            parts.append(html.unescape(text))
            if in_link > 0:
                links.append(parts[-1])

    while True:
        m, end_of_text, bare = next_tag(page, at, bare)
        add(page[at:end_of_text])
        if not m:
            break
        if m.re is COMMENT:
            at = m.end()
            continue
        at = m.end() + 1
        name = m[2].lower()
        if m[1]:
            if names[name]:
                close_to(next(k for k in range(len(opened) - 1, -1, -1) if opened[k].name == name))
            elif name == "p":
                close_block()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            close_block()
            continue
        if name in BLOCKS:
            # A block ends an open paragraph, and a list item the one before it.
            if blocks:
                other = opened[blocks[-1]].name
                if other == "p" or other == name == "li" or other in ("dd", "dt") and name in ("dd", "dt"):
                    close_to(blocks[-1])
            close_block()
        elif name in CELLS:
            add(" ")
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        attributes = attributes_of(m[3]) if m[3] else {}
        number = len(elements)
        # An article's classes name its topics, too: of containers only comments are told by name.
        named = name not in ("html", "body") and bool(attributes) and is_named_not_text(attributes, COMMENT_NAMES if name in CONTAINERS else NOT_TEXT_NAMES)
        by_name = named and name not in NOT_TEXT and "hidden" not in attributes and not is_named_comments(attributes)
        skip = name in NOT_TEXT or named and number not in spared
        if skip:
            close_block()
            stripped += 1
        here = opened[-1] if opened else None
        container, parent = (here.container, here.element) if here else (0, 0)
        classes = " ".join(attributes.get("class", "").split())
        elements.append(Element(parent, (name, "" if name in CONTAINERS else classes)))
        if name in CONTAINERS and not stripped and not container:
            container = number
        in_link += name == "a"
        if name in BLOCKS:
            blocks.append(len(opened))
        names[name] += 1
        opened.append(Open(name, skip, by_name, container, number, n_text))
    close_to(0)
    close_block()
    elements[0].last = len(elements) - 1
    return lines, elements, frozenset(k for k, n in weights.items() if 2 * n > n_text)


@dataclass
class Stretch:
    begin: int
    surge: int | None  # the first line above the threshold
    end: int  # exclusive


def stretches(lengths: list[int], parts: list[int] | None = None) -> list[Stretch]:
    """Lines from a text line to where the sum over the window dives to nothing, or to where another of the ``parts`` begins."""
    if parts is not None:
        cuts = [k for k in range(1, len(parts)) if parts[k] != parts[k - 1] and lengths[k]]
        found = []
        for begin, end in zip([0, *cuts], [*cuts, len(lengths)]):
            for s in stretches(lengths[begin:end]):
                found.append(Stretch(s.begin + begin, None if s.surge is None else s.surge + begin, s.end + begin))
        return found
    sums = [sum(lengths[k : k + WINDOW]) for k in range(len(lengths))]
    found, k = [], 0
    while k < len(lengths):
        if not lengths[k]:
            k += 1
            continue
        begin, surge = k, None
        while k < len(lengths) and sums[k] > 0:
            if surge is None and lengths[k] and sums[k] >= SURGE:
                surge = k
            k += 1
        found.append(Stretch(begin, surge, k))
    return found


def main_block(best: list[int], others: list[int], elements: list[Element]) -> int:
    """The element of the main text, given the elements of the best stretch's lines and of one line of every other stretch."""

    def holds(a: int, x: int) -> bool:
        return a <= x <= elements[a].last

    at, last = min(best), max(best)
    while not holds(at, last):
        at = elements[at].parent
    # An element holds a range of numbers, which grows on both sides on the way up: each other line is met once.
    others = sorted(others)
    below, above = bisect_left(others, at), bisect_right(others, elements[at].last)
    seen: set[int] = set()
    while at:
        parent = elements[at].parent
        like = False
        outer = bisect_left(others, parent), bisect_right(others, elements[parent].last)
        for x in (*others[outer[0] : below], *others[above : outer[1]]):
            # Paths that meet an earlier one end in a part that has been looked at.
            while x != parent and elements[x].parent != parent and x not in seen:
                seen.add(x)
                x = elements[x].parent
            like = like or x != parent and elements[x].parent == parent and elements[x].kind == elements[at].kind
        if elements[at].kind[0] in HOLDERS and not like:
            break
        at, (below, above) = parent, outer
    return at


def main_lines(lines: list[Line], lengths: list[int], elements: list[Element], found: list[Stretch]) -> list[int]:
    """The lines of the stretches above the threshold in the main block, and what text stands between them."""
    high = [s for s in found if s.surge is not None]
    if not high:
        held = [k for k, x in enumerate(lines) if x.text and x.container]
        return held or [k for k, x in enumerate(lines) if x.text]
    best = max(high, key=lambda s: (sum(lengths[s.surge : s.end]), -s.begin))
    surged = [lines[k].element for k in range(best.surge, best.end) if lines[k].text]
    block = main_block(surged, [lines[s.surge].element for s in high if s is not best], elements)
    inside = [k for k, x in enumerate(lines) if x.text and block <= x.element <= elements[block].last]
    in_high = {k for s in high for k in range(s.begin, s.end)}
    ends = [k for k in inside if k in in_high]
    in_found = {k for s in found for k in range(s.begin, s.end)}
    return [k for k in inside if ends[0] <= k <= ends[-1] and k in in_found]


def main_text(page: str, spared: frozenset[int] = frozenset()) -> str:
    lines, elements, heavy = lines_of(page, spared)
    lengths = [len(x.text) if x.n_link <= MAX_LINK_SHARE * len(x.text) else 0 for x in lines]
    found = stretches(lengths)
    high = [k for s in found if s.surge is not None for k in range(s.begin, s.end)]
    if 2 * sum(lengths[k] for k in high if lines[k].container) >= sum(lengths[k] for k in high) > 0:
        # Stripped lines between two lines of a container are in it, too.
        parts, last = [], 0
        for x in lines:
            last = x.container if x.text else last
            parts.append(last)
        found = stretches(lengths, parts)
    if heavy and not spared and all(s.surge is None for s in found):
        return main_text(page, heavy)
    return "\n\n".join(lines[k].text for k in main_lines(lines, lengths, elements, found))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of(F.col("html")).alias("html"))
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long")


# --- query ---------------------------------------------------------------------------------------------


def op8_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
