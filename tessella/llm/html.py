"""Main text of web pages by minimum-cut labelling.

A page becomes blocks: stretches of text between tags that are no inline tags.
A classifier gives each block the costs of calling it content and of calling
it boilerplate; these are the capacities of its edges to the two terminals.
It weighs length, links, sentence ends, kind of element, the place of the
block (in or out of the densest part of the tree), and, as weak evidence among
the rest, what the elements around it are called.  Short blocks alone say
little: a word in a paragraph of its own looks like a menu entry.

Smoothness edges join neighbours in the page, the more strongly the nearer
their containers are in the tree, and neighbours among the blocks of one
container, so that parting them costs too.  The minimum cut, found by maximum
flow, labels all blocks of a page at once; those on the content side are its
main text.

Scripts, styles, hidden and other unreadable elements are no blocks.  Character
references are decoded, white space inside a block becomes one space, blocks
are trimmed, and empty ones dropped.  Broken markup is read as far as it goes:
unclosed tags close with their container; an unreadable element that is never
closed hides nothing, but for scripts and styles, whose text is code.  Null and
empty pages, and pages without content, give the empty text.  Every page is
handled whole, in time linear in its length but for the cut.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.llm.common import extend, slices, without

#: Fixed values of the HTML standard: elements by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNREAD = frozenset("script style noscript template svg math iframe object audio video canvas map select option textarea button input datalist title head".split())
#: Elements whose content is text up to their end tag; that of CODE is so even without one.
RAW = frozenset("script style iframe textarea title".split())
CODE = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the named ones closes when still open.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
CLOSES = {tag: [name for name, closers in CLOSED_BY.items() if tag in closers] for tag in frozenset().union(*CLOSED_BY.values())}

#: Evidence, in units of log odds for content.  What an element is by the standard:
TAG_HINTS = {"article": 0.8, "main": 0.6, "nav": -4.0, "aside": -4.0, "footer": -4.0, "form": -4.0, "header": -3.0, "dialog": -4.0, "menu": -4.0, "fieldset": -3.0, "address": -1.0}
ROLE_HINTS = {"main": 0.6, "article": 0.8, "navigation": -4.0, "complementary": -4.0, "contentinfo": -4.0, "banner": -3.0, "search": -4.0, "alert": -3.0, "dialog": -4.0, "alertdialog": -4.0, "menu": -4.0, "menubar": -4.0, "status": -3.0, "form": -3.0, "toolbar": -3.0}
#: What it is called: one name, each further one, and a good name.
BAD_NAME, MORE_BAD, GOOD_NAME = -2.0, -1.0, 0.5
LEAST_HINT = -8.0
_BAD_NAMES = regex.compile(
    r"^(?:ads?|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|outbrain|taboola|nav\w*|menu\w*|breadcrumbs?|crumbs?|footer|foot|header|masthead|topbar|toolbar|sidebar|side|aside|widget\w*|rail"
    r"|comments?|commentlist|disqus|respond|replies|reply|discussion|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended"
    r"|recirc|copyright|legal|disclaimer|pagination|pager|search|skip|tags|form|dialog|toast)$"
)
_GOOD_NAMES = regex.compile(r"^(?:article|content|entry|post|story|body|main|text|articlebody|postcontent|maincontent|prose)$")
_NAME_PARTS = regex.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Elements that hold the content by their role: names on them describe layout or state, not what they are.
_HOLDERS = frozenset("body html main article".split())
#: First parts of names that say what an element has or lacks.
_STATES = frozenset("has no with without is".split())
_ATTRIBUTE = regex.compile(r"""([a-zA-Z][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG = regex.compile(r"""(?|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", regex.S)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_OWN_LINE = frozenset(["p", "li", *_HEADING])
_SENTENCE_END = regex.compile(r"[.!?\u2026\u3002](?:\s|\Z)")
_IMPRINT = regex.compile(r"[\u00a9\u00ae]|all rights reserved|copyright|cookies?\b|subscribe|sign up|log ?in\b", regex.I)

#: What the text and the place of a block say.
WORD_SLOPE, EVEN_WORDS, MOST_WORDS = 1.3, 8.0, 54.0  # words that say nothing either way, and beyond which more say no more
LINKED = -4.0
SENTENCE = 0.3
BY_TAG = {"p": 0.3, "blockquote": 0.3, "pre": 0.3, "li": -0.3, "td": -0.3, "th": -0.3} | dict.fromkeys(_HEADING, 0.6)
IMPRINT = -1.5
INSIDE, OUTSIDE = 0.6, -0.6  # the densest part of the tree
CORE_SHARE = 0.6  # of the page's unlinked words that this part holds

#: Smoothness capacities: of page neighbours whose containers are one (less with the square of the distance), and between neighbours of one container.
NEAR = 1.6
SAME_CONTAINER = 1.0
_UNIT = 1000  # capacities are whole numbers


@dataclass(slots=True)
class Element:
    tag: str
    hint: float
    up: int  # number of the element around it, inline ones aside
    number: int
    depth: int
    link: bool = False
    unread: bool = False


@dataclass(slots=True)
class Block:
    text: str
    hint: float
    container: int
    tag: str
    linked: float  # share of the text inside links
    words: int


@dataclass(slots=True)
class Page:
    """Blocks in order; elements by number: parent, depth."""

    blocks: list[Block]
    up: list[int]
    depth: list[int]


def _described(value: str) -> set[str]:
    """The names of a class or id, and their first and last parts, less those that describe a state or layout."""
    out = set()
    for part in value.split():
        for pieces in (_NAME_PARTS.split(part), _NAME_PARTS.split(part.lower())):
            pieces = [w.lower() for w in pieces if w]
            if pieces and pieces[0] not in _STATES:
                out |= {part.lower(), pieces[0], pieces[-1]} if not {"with", "without"} & set(pieces) else {pieces[0]}
    return out


def _hint(tag: str, attributes: str, outer: float) -> float | None:
    """The evidence of an element and those around it; None if it is not shown.  What is bad inside good is bad; what is good inside bad stays bad."""
    own, bad, good = TAG_HINTS.get(tag, 0.0), set(), False
    if tag == "header" and outer > 0:
        own = 0.0  # a heading of the article, not of the page
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names = _described(value)
                good = good or any(_GOOD_NAMES.match(w) for w in names)
                if tag not in _HOLDERS:
                    bad |= {w for w in names if _BAD_NAMES.match(w)}
            elif name == "role":
                own = ROLE_HINTS.get(value.lower(), own)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                return None
    if bad and not (good and bad == {"header"}):  # the header of an article is its heading
        own = min(own, 0.0) + BAD_NAME + MORE_BAD * (len({w.rstrip("s") for w in bad}) - 1)
    elif good and own >= 0:
        own = max(own, GOOD_NAME)
    if own < 0:
        return max(LEAST_HINT, min(outer, 0.0) + own)
    return outer if outer < 0 else max(outer, own)


class _Open:
    """The open elements, with the places that questions about them need, so that each is answered at once."""

    def __init__(self):
        self.stack = [Element("", 0.0, -1, 0, 0)]
        self.at: dict[str, list[int]] = {}  # places by tag
        self.outer = [0]  # places of elements that are not inline
        self.barriers = [0]  # places of elements that an opening tag never closes
        self.links = self.unread = 0

    def push(self, e: Element) -> None:
        place = len(self.stack)
        self.stack.append(e)
        self.at.setdefault(e.tag, []).append(place)
        if e.tag not in INLINE:
            self.outer.append(place)
            if e.tag not in CLOSED_BY:
                self.barriers.append(place)
        self.links += e.link
        self.unread += e.unread

    def cut(self, place: int) -> None:
        """Close everything from a place on."""
        while len(self.stack) > place:
            e = self.stack.pop()
            self.at[e.tag].pop()
            self.links -= e.link
            self.unread -= e.unread
        for places in (self.outer, self.barriers):
            while places[-1] >= place:
                places.pop()

    def place(self, tag: str) -> int:
        """The place of the innermost open element of a tag; 0 if there is none."""
        found = self.at.get(tag)
        return found[-1] if found else 0

    @property
    def block(self) -> Element:
        return self.stack[self.outer[-1]]


def parse(page: str) -> Page:
    """The blocks of a page, in order, and the tree around them."""
    out: list[Block] = []
    up, deep = [0], [0]
    opened = _Open()
    text: list[str] = []
    n_linked = n_text = 0
    lowered = ""
    last_end: dict[str, int] = {}

    def closes_later(tag: str, at: int) -> bool:
        nonlocal lowered
        if tag not in last_end:
            lowered = lowered or page.lower()
            last_end[tag] = lowered.rfind(f"</{tag}")
        return last_end[tag] >= at

    def flush() -> None:
        nonlocal n_linked, n_text
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                top = opened.block
                inner = min(e.hint for e in opened.stack[max(opened.outer[-1], len(opened.stack) - 3) :])
                out.append(Block(joined, min(top.hint, inner), top.up if top.tag in _OWN_LINE else top.number, top.tag, n_linked / max(1, n_text), joined.count(" ") + 1))
            text.clear()
        n_linked = n_text = 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not opened.unread:
            piece = page[at : m.start()]
            text.append(piece)
            size = len(piece) - piece.count(" ")
            n_text += size
            n_linked += size * bool(opened.links)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            place = opened.place(tag)
            if not place:
                if tag == "p" and not opened.unread:
                    flush()
                continue
            if tag in INLINE:
                if opened.outer[-1] > place:
                    continue  # an inline end tag does not close the blocks that are open inside it
            elif not opened.unread:
                flush()
            opened.cut(place)
            continue
        if tag not in INLINE and tag not in UNREAD:  # what is not read does not part the text around it
            if not opened.unread:
                flush()
            for name in CLOSES.get(tag, ()):
                place = opened.place(name)
                if place and opened.barriers[-1] < place:
                    opened.cut(place)
            if (tag == "body" or tag not in VOID) and opened.stack[-1].tag == "head":
                opened.cut(len(opened.stack) - 1)
        if tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = regex.compile(rf"</{tag}\b[^>]*(?:>|\Z)", regex.I).search(page, at) if closes_later(tag, at) else None
            if end:
                at = end.end()
            elif tag in CODE and not m[3].rstrip().endswith("/"):
                at = len(page)
            continue
        if m[3].rstrip().endswith("/") or (tag in UNREAD and tag != "head" and not closes_later(tag, at)):
            continue
        block = opened.block
        up.append(block.number)
        deep.append(deep[block.number] + (tag not in INLINE))
        hint = _hint(tag, m[3], opened.stack[-1].hint)
        opened.push(Element(tag, LEAST_HINT if hint is None else hint, block.number, len(up) - 1, deep[-1], tag == "a", tag in UNREAD or hint is None))
    if at < len(page) and not opened.unread:
        text.append(page[at:])
    flush()
    return Page(out, up, deep)


def core(page: Page) -> tuple[int, int]:
    """First and last number of the elements in the densest part of the tree: the smallest part with most of the unlinked words."""
    n = len(page.up)
    weight, last, blocks = [0.0] * n, list(range(n)), [0] * n
    for b in page.blocks:
        weight[b.container] += b.words * (1 - b.linked) * (1.0 if b.hint >= 0 else 0.2)
        blocks[b.container] += 1
    for i in range(n - 1, 0, -1):  # elements are numbered before those inside them
        weight[page.up[i]] += weight[i]
        blocks[page.up[i]] += blocks[i]
        last[page.up[i]] = max(last[page.up[i]], last[i])
    here = 0
    for i in range(1, n):
        if page.up[i] == here and weight[i] >= CORE_SHARE * weight[0] and blocks[i] > 1:
            here = i
    return here, last[here]


def evidence(block: Block, inside: bool) -> float:
    """The log odds of a block for content, by itself."""
    z = block.hint + WORD_SLOPE * (math.log(1 + min(block.words, MOST_WORDS)) - math.log(1 + EVEN_WORDS))
    z += LINKED * block.linked + BY_TAG.get(block.tag, 0.0)
    if _SENTENCE_END.search(block.text):
        z += SENTENCE
    if block.words < MOST_WORDS and _IMPRINT.search(block.text):
        z += IMPRINT
    if block.hint >= 0 or not inside:
        z += INSIDE if inside else OUTSIDE
    return z


def costs(z: float) -> tuple[float, float]:
    """Costs of calling a block boilerplate and of calling it content: minus the logarithms of its probabilities."""
    z = max(-12.0, min(12.0, z))
    return (math.log1p(math.exp(z)), math.log1p(math.exp(-z)))


def distances(page: Page) -> list[int]:
    """Steps in the tree between the containers of each block and the next."""
    out = []
    for x, y in zip(page.blocks, page.blocks[1:], strict=False):
        a, b, steps = x.container, y.container, 0
        while a != b:
            if page.depth[a] >= page.depth[b]:
                a = page.up[a]
            else:
                b = page.up[b]
            steps += 1
        out.append(steps)
    return out


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source side of the minimum cut.

    ``source``/``sink``: capacities from and to the terminals; ``edges``:
    (node, node, capacity) in both directions.  Maximum flow by blocking flows
    in layered networks; flow through a single node is sent at once.  Of
    several minimum cuts it is the one with the fewest source nodes.
    """
    n = len(source)
    s, t = n, n + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + 2)]  # [to, capacity, index of reverse]

    def add(a: int, b: int, ab: int, ba: int) -> None:
        graph[a].append([b, ab, len(graph[b])])
        graph[b].append([a, ba, len(graph[a]) - 1])

    for a, b, c in edges:
        add(a, b, c, c)
    for i in range(n):
        direct = min(source[i], sink[i])
        if source[i] > direct:
            add(s, i, source[i] - direct, 0)
        elif sink[i] > direct:
            add(i, t, sink[i] - direct, 0)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, c, _ in graph[a]:
                if c and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[list[int]] = []
        here = s
        while True:
            if here == t:
                flow = min(e[1] for e in path)
                cut_at = 0
                for k in range(len(path) - 1, -1, -1):
                    e = path[k]
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                    if not e[1]:
                        cut_at = k
                here = graph[path[cut_at][0]][path[cut_at][2]][0]
                del path[cut_at:]
                continue
            row = graph[here]
            while at[here] < len(row):
                e = row[at[here]]
                if e[1] and level[e[0]] == level[here] + 1:
                    break
                at[here] += 1
            if at[here] < len(row):
                path.append(row[at[here]])
                here = row[at[here]][0]
            elif here == s:
                break
            else:
                level[here] = -1
                e = path.pop()
                here = graph[e[0]][e[2]][0]


def label(page: Page, smooth: float = 1.0) -> list[bool]:
    """Whether each block is content; ``smooth`` scales the smoothness edges."""
    first, last = core(page)
    both = [costs(evidence(b, first <= b.container <= last)) for b in page.blocks]
    edges = [(i, i + 1, round(smooth * NEAR / (1 + d) ** 2 * _UNIT)) for i, d in enumerate(distances(page))]
    before: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        if b.container in before:
            edges.append((before[b.container], i, round(smooth * SAME_CONTAINER * _UNIT)))
        before[b.container] = i
    return minimum_cut([round(a * _UNIT) for a, _ in both], [round(b * _UNIT) for _, b in both], edges)


def main_text(page: str | None) -> str:
    """The main text of a page, one line per block."""
    if not page:
        return ""
    found = parse(page)
    return "\n".join(b.text for b, content in zip(found.blocks, label(found), strict=True) if content)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of ``pages``, text, and n_chars (its code points), which replace columns of their names."""
    keep = without(keep, ["text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p) for p in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = extend(pages.select(*keep).schema, "text string, n_chars long")
    return pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, schema)
