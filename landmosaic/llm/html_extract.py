"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; inline tags and single line
breaks stay inside a block.  Markup without text of its own (scripts, styles,
form controls, hidden parts) is left out first.  The first pass judges each
block by itself: link density makes it bad, stop-word density and length make it
good, bad or near (in between), and what is shorter is short, too little to tell.
Menus, teasers and link lists are bad for their links alone, whatever element or
class they stand in.  The second pass lets short and near blocks inherit the label
of their nearest decided neighbours, looking no further than the container
(article or page body) they stand in.

Stop words are listed for four languages.  Where a page uses hardly any of them in
its longer blocks, and in blocks of another script than Latin, sentences tell
running text instead: their ends, not too far apart, in any script.

Where density can't tell, as readers' comments, notices and adverts are running
text like the article, and where the page itself names its header, footer, sidebar
or form, a block is left out too.  A name is a whole class or id, or one put
together from such names and words of layout.  An element that holds every good
block of the page and its heading, or is a form around several, is the page and
not apart, whatever it is called.

Null and empty html give the empty string, and so does a page without text.
Every page gives one row, repeated rows too, an empty table none; pages of any
length are read whole, in time proportional to it.  Only ``page_id``, ``url`` and
``html`` are read, whatever else there is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block with less text than this is short.
SHORT_CHARS = 70
#: Share of stop words from which a block reads as running text.
STOP_DENSITY = 0.2
#: A page with a smaller share of stop words in its longer blocks is in a language that is not listed.
KNOWN_DENSITY = 0.05
#: Characters for each end of a sentence, at most, in running text of such a page.
SENTENCE_CHARS = 400
#: Share of characters inside links from which a block is a list of links.
LINK_DENSITY = 0.4

# Function words of the languages served.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by at from this are or an not have has had but they you we "
    "he she his her its their which will would can there been were if who what when all more no so up out about into "
    "der die das und in zu den von mit ist des im dem nicht ein eine als auch es an auf für so dass sich wie bei oder "
    "aus nach wird sind noch einer um am einen war nur aber vor zur bis mehr durch man kann wenn über "
    "de la le les et des en un une du que qui dans est pour pas au sur plus par ne se ce il elle sont avec son mais "
    "comme ou où leur ont été cette nous vous "
    "el los las y del que se por con una no para es al lo como más su sus pero este esta ha sin sobre también me ya "
    "entre cuando muy era son fue hay".split()
)

# Tags of HTML by how they are treated.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset(
    "head script style noscript template iframe object svg math canvas audio video button select textarea dialog".split()
)
APART_TAGS = frozenset("footer aside form".split())
APART_ROLES = frozenset("banner contentinfo complementary search form dialog alert alertdialog".split())
# Names of what is running text like the article, but not of it.
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promoted "
    "promotion cookie cookies consent gdpr notice notices newsletter sidebar comment comments commentlist respond "
    "replies disqus discussion".split()
)
# Words of layout that stand beside such a name.
LAYOUT_NAMES = frozenset(
    "area aside bar block body bottom box center col column container content footer form header inner item left list "
    "main message outer overlay panel popup right row section side slot text title top unit widget widgets wrap wrapper "
    "policy signup law".split()
)
CLOSES = {  # an opening tag ends these open ones
    "p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[a-z0-9]+")
SPACES = re.compile(r"\s+")
EDGES = re.compile(r"^\W+|\W+$")
SENTENCE_END = re.compile(r"[.!?\u2026](?=[\s\"'\u00bb\u201d\u2019)\]]|$)|[\u3002\uff01\uff1f\u061f\u06d4\u0964\u1362\u104b]")

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"


def silent(tag: str, attributes: str) -> bool:
    """Whether this element shows no text of its own to a reader."""
    if tag in SILENT_TAGS:
        return True
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def apart(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the page names this element as no part of the article."""
    if tag in APART_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value.strip() in APART_ROLES:
            return True
        if key in ("class", "id"):
            for name in value.split():
                parts = NAME_PART.findall(name)
                named = [p in APART_NAMES for p in parts]
                if any(named) and all(n or p in LAYOUT_NAMES or p.isdigit() for n, p in zip(named, parts, strict=True)):
                    return True
    return False


@dataclass
class Named:
    """An element that is named apart, and the blocks ``[start, end)`` inside."""

    tag: str
    start: int
    end: int = 0


class Open:
    """The open elements, innermost last, with the places of each tag's."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, silent, innermost named element, container
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block elements
        self.walls: list[int] = []  # and of those but paragraphs

    def top(self) -> tuple[str, bool, int, int]:
        return self.stack[-1] if self.stack else ("", False, -1, 0)

    def push(self, tag: str, hidden: bool, aside: int, inside: int) -> None:
        place = len(self.stack)
        self.stack.append((tag, hidden, aside, inside))
        self.at.setdefault(tag, []).append(place)
        if tag in BLOCK_TAGS:
            self.blocks.append(place)
            if tag != "p":
                self.walls.append(place)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element with one of these tags, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, place: int, named: list[Named], block: int) -> None:
        """Close all from ``place`` on, before the block of that number."""
        while len(self.stack) > place:
            tag, _, aside, _ = self.stack.pop()
            if aside != self.top()[2]:
                named[aside].end = block
            self.at[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
                if tag != "p":
                    self.walls.pop()


def blocks(html: str) -> tuple[list[tuple[str, int, int]], list[Named], list[int]]:
    """``text, characters in links, container`` of each block with text, in page order, elements named apart, and at which blocks headings or articles begin."""
    out: list[tuple[str, int, int]] = []
    named: list[Named] = []
    heads: list[int] = []
    elements = Open()
    pieces: list[str] = []
    linked, links, containers, at, size = 0, 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACES.sub(" ", unescape("".join(pieces))).strip()
            _, hidden, _, inside = elements.top()
            if text and not hidden:
                out.append((text, linked, inside))
            pieces.clear()
        linked = 0

    while at < size:
        low = html.find("<", at)
        if low < 0:
            low = size
        if low > at:
            pieces.append(html[at:low])
            if links:
                linked += len(html[at:low].strip())
        if low == size:
            break
        m = TOKEN.match(html, low)
        if not m:
            pieces.append("<")
            at = low + 1
            continue
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, closing = m[2].lower(), m[1]
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            place = elements.last(tag)
            inline = tag not in BLOCK_TAGS and elements.blocks and elements.blocks[-1] > place
            if place >= 0 and not inline:  # an inline end tag closes no block
                if elements.top()[1:3] != (elements.stack[place - 1][1:3] if place else (False, -1)):
                    flush()
                elements.close(place, named, len(out))
            continue
        shut = CLOSES.get(tag)
        if shut:
            place = elements.last(*shut)
            if place >= 0 and place >= (elements.walls[-1] if elements.walls else -1):
                elements.close(place, named, len(out))
        elif tag in BLOCK_TAGS and elements.top()[0] == "p":
            elements.close(len(elements.stack) - 1, named, len(out))
        if tag in VOID_TAGS:
            continue
        _, was_hidden, was_aside, inside = elements.top()
        hidden = was_hidden or silent(tag, m[3])
        aside = len(named) if apart(tag, m[3], inside > 0) and tag not in RAW_TAGS else was_aside
        if (hidden, aside) != (was_hidden, was_aside):
            flush()
        if aside != was_aside:
            named.append(Named(tag, len(out)))
        if tag in ("article", "main", "h1"):
            heads.append(len(out))
        if tag in ("article", "main") and not hidden:
            containers += 1
            inside = containers
        if tag == "a":
            links += 1
        if m[3].endswith("/") and tag not in BLOCK_TAGS:
            if aside != was_aside:
                named[aside].end = len(out)
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        elements.push(tag, hidden, aside, inside)
    flush()
    elements.close(0, named, len(out))
    return out, named, heads


@dataclass
class Measures:
    """What the first pass goes by: characters, those in links, words and stop words among them."""

    chars: int
    linked: int
    words: int = 0
    stops: int = 0

    @property
    def links(self) -> bool:
        return self.linked > LINK_DENSITY * self.chars


def measured(text: str, linked: int) -> Measures:
    m = Measures(len(text), linked)
    if m.chars >= SHORT_CHARS and not m.links:
        words = text.lower().split()
        m.words, m.stops = len(words), sum(w in STOP_WORDS if w.isalpha() else EDGES.sub("", w) in STOP_WORDS for w in words)
    return m


def sentences(text: str) -> bool:
    return len(SENTENCE_END.findall(text)) * SENTENCE_CHARS >= len(text)


def first_pass(text: str, m: Measures, inside: int, listed: bool = True) -> str:
    """The label of a block by itself: its text and measures, whether it stands in an article, and in a language that is listed."""
    if m.links:
        return SHORT if inside and m.chars < SHORT_CHARS else BAD
    if m.chars < SHORT_CHARS:
        return SHORT
    # other scripts than Latin take half a byte more for a character, and more
    if not (listed and (text.isascii() or len(text.encode("utf-8", "replace")) < 1.5 * m.chars)) and sentences(text):
        return GOOD
    if m.stops >= STOP_DENSITY * m.words:
        return GOOD
    return NEAR if inside or m.stops >= 0.5 * STOP_DENSITY * m.words else BAD


def labelled(found: list[tuple[str, int, int]]) -> list[str]:
    """The first pass over the blocks of a page. Its language is listed if the longer blocks use the stop words."""
    measures = [measured(text, linked) for text, linked, _ in found]
    listed = sum(m.stops for m in measures) >= KNOWN_DENSITY * sum(m.words for m in measures)
    return [first_pass(text, m, inside, listed) for (text, _, inside), m in zip(found, measures, strict=True)]


def second_pass(labels: list[str], containers: list[int], lengths: list[int]) -> list[bool]:
    """Whether each block is kept: undecided ones inherit from the nearest decided ones.

    Neighbours count only inside the block's own container.  Where both sides
    differ the closer one in characters wins, a tie is kept; an undecided block
    without decided neighbours is kept.
    """
    n = len(labels)
    before: list[tuple[str, int] | None] = [None] * n
    after: list[tuple[str, int] | None] = [None] * n
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        seen: dict[int, tuple[str, int]] = {}
        passed = 0
        for i in order:
            at = seen.get(containers[i])
            out[i] = (at[0], passed - at[1]) if at else None
            passed += lengths[i]
            if labels[i] in (GOOD, BAD):
                seen[containers[i]] = (labels[i], passed)
    keep = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            keep.append(label == GOOD)
            continue
        a, b = before[i], after[i]
        if a and b:
            keep.append(a[0] == GOOD if a[0] == b[0] or a[1] < b[1] else b[0] == GOOD if b[1] < a[1] else True)
        elif a or b:
            keep.append((a or b)[0] == GOOD)
        else:
            keep.append(True)
    return keep


def left_out(labels: list[str], named: list[Named], heads: list[int]) -> list[bool]:
    """Which blocks stand in an element named apart, unless that is the page all the same: every good block stands inside it."""
    good = [i for i, label in enumerate(labels) if label == GOOD]
    change = [0] * (len(labels) + 1)
    for e in named:
        if good and e.start <= good[0] and good[-1] < e.end:
            head = bisect_left(heads, e.start)
            if (head < len(heads) and heads[head] < e.end) or (e.tag == "form" and len(good) > 1):
                continue
        change[e.start] += 1
        change[e.end] -= 1
    return [depth > 0 for depth in accumulate(change[:-1])]


def main_text(html: str) -> str:
    found, named, heads = blocks(html)
    labels = labelled(found)
    out = left_out(labels, named, heads)
    found, labels = ([x for x, gone in zip(of, out, strict=True) if not gone] for of in (found, labels))
    keep = second_pass(labels, [b[2] for b in found], [len(b[0]) for b in found])
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
