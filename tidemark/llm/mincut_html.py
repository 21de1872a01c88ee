"""Main text of HTML pages by minimum cut.

A page becomes a list of text blocks.  A fixed logistic classifier gives each block log
odds of being content, which become its capacity to the source (content) or to the sink
(boilerplate); neighbouring blocks and blocks under one parent are tied by smoothness
edges.  The minimum cut, found by maximum flow, is the labelling with the least cost: it
keeps a short paragraph between long ones and drops a wordy line inside a menu.

What an element's name, role and classes say is weighed against the prose inside it: an
element that holds most of the page's prose is a wrapper, whatever it is called.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds of elements.
SCRIPTS = ("script", "style")  # without an end tag they take the rest of the page
RAW = frozenset(
    "script style noscript template textarea svg iframe object select title annotation annotation-xml".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta link"
    " nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math semantics mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mfenced msub msup msubsup"
    " munder mover munderover".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_ITSELF = frozenset("li dt dd tr td th option p thead tbody tfoot".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BOILERPLATE_TAGS = frozenset("nav footer aside button dialog menu head fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie"
    " cookies consent gdpr notice notices notification alert popup modal overlay sidebar sidebars aside widget"
    " widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer foot copyright"
    " share sharing social related recommended"
    " newsletter subscribe subscription signup signin login search pagination pager toolbar hidden".split()
)
COMMENT_WORDS = frozenset(
    "comment comments commentlist commentarea commentbody commenttext usercomment usercomments respond responses"
    " reply replies disqus discussion discussions".split()
)
CONTENT_WORDS = frozenset("article content story post entry main body text".split())
COMMENT_HEADING = re.compile(
    r"(?:\d+ )?(?:reader |user |your )?comments?(?: ?\(\d+\)|:? \d+|:)?|\d+ (?:replies|responses)"
    r"|(?:leave|post|add|write) a (?:comment|reply)|join the (?:conversation|discussion)",
    re.IGNORECASE,
)

# Log odds of the classifier and weights of the smoothness edges.
BIAS, PER_WORD, MOST_WORDS, SENTENCE, HEADING = -1.0, 0.15, 20, 1.0, 1.5
IN_ARTICLE, IN_BOILERPLATE, NAMED_BOILERPLATE, LINKED = 6.0, -16.0, -10.0, -6.0
BESIDE, SAME_PARENT, SAME_GRANDPARENT = 1.0, 1.0, 0.5
# Words of a block of prose and of an element that may be a wrapper by its
# prose alone; its share of the page's prose where its name begins and ceases to count for nothing.
PROSE_WORDS, WRAPPED_WORDS, LEAST_SHARE, WHOLE_SHARE = 10, 60, 0.4, 0.6

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# A quote opens a value only after "="; every alternative moves forward and none is tried again.
TO_END = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BESIDES = re.compile(r"\b(?:with|has|no)[-_][\w-]+|\bcomments?(?:-status)?[-_](?:open|closed|enabled|off|on)\b")
PART = re.compile(r"[a-z0-9]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)[^>]*+(?:>|$)", re.IGNORECASE) for name in RAW}
NOTHING, ARTICLE, UNSHOWN, NAMED, COMMENTS = range(5)


class Element:
    __slots__ = ("number", "name", "parent", "cue", "holds_article", "barred", "prose", "log_odds", "last")

    def __init__(self, number: int, name: str, parent: Element | None, cue: int):
        self.number, self.name, self.parent, self.cue = number, name, parent, cue
        self.holds_article = cue == ARTICLE and name in ("article", "main") or name == "h1"
        self.barred = False  # inside something that is never content
        self.prose = 0  # words of prose inside, its own and those of the elements in it
        self.log_odds = 0.0  # of this element and those around it
        self.last = number  # number of the last element inside


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words inside links
    element: Element


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of the page's tags.

    Comments, scripts and the like are one nameless tag.  The scan only moves forward: its
    time is proportional to the page, whatever is left open in it.
    """
    at, quoted, endless = 0, True, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        opened = NAME.match(page, start + 1)
        if not opened:
            if page[start + 1 : start + 2] not in ("!", "?", "/"):
                at = start + 1  # a less-than sign in a text
                yield start, start, "", False, ""
                continue
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        close = TO_END.match(page, opened.end()) if quoted else None
        if close:
            at = close.end()
        else:  # no end outside quotes from here on: quotes no longer count
            quoted = False
            end = page.find(">", opened.end())
            at = end + 1 if end >= 0 else len(page)
            if end < 0:  # a tag that breaks off ends the page
                yield start, at, "", False, ""
                continue
        name, rest = opened[2].lower(), page[opened.end() : at - 1]
        if name in RAW and not opened[1]:
            if name not in endless and not rest.endswith("/"):
                closed = RAW_END[name].search(page, at)
                if closed:
                    at = closed.end()
                elif name in SCRIPTS:
                    at = len(page)
                else:
                    endless.add(name)
            yield start, at, "", False, ""
            continue
        yield start, at, name, bool(opened[1]), rest


def cue_of(name: str, rest: str, inside_article: bool) -> int:
    """What an element's name and attributes say about the text inside it."""
    cue = NOTHING
    if name in ("article", "main"):
        cue = ARTICLE
    elif name in BOILERPLATE_TAGS:
        cue = UNSHOWN
    elif name == "form" or name == "header" and not inside_article:
        cue = NAMED
    if not rest or name in ("html", "body"):
        return cue
    words: set[str] = set()
    for match in ATTRIBUTE.finditer(rest):
        key, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if key == "role":
            if value in BOILERPLATE_ROLES:
                cue = UNSHOWN
            elif value == "main" and not cue:
                cue = ARTICLE
        elif key == "style":
            cue = UNSHOWN if HIDDEN.search(value) else cue
        elif key in ("hidden", "aria-hidden"):
            cue = UNSHOWN if value != "false" else cue
        elif key in ("class", "id", "itemprop", "itemtype", "aria-label"):
            # "with-sidebar" describes an element beside a sidebar, not the sidebar.
            words.update(PART.findall(BESIDES.sub("", value)))
    if cue == UNSHOWN:
        return cue
    if words & COMMENT_WORDS:
        return COMMENTS
    if words & BOILERPLATE_WORDS and name not in ("article", "main"):
        return NAMED
    return ARTICLE if not cue and words & CONTENT_WORDS else cue


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in page order, white space folded, character references decoded."""
    blocks: list[Block] = []
    root = Element(0, "", None, NOTHING)
    elements, stack, links = [root], [root], 0
    opened: Counter[str] = Counter()  # open elements by name, so a stray end tag costs nothing
    articles = 0
    pieces: list[str] = []
    linked_pieces: list[str] = []

    def flush() -> None:
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                linked = len("".join(linked_pieces).split()) if linked_pieces else 0
                blocks.append(Block(" ".join(words), len(words), linked, stack[-1]))
            pieces.clear()
            linked_pieces.clear()

    def close(depth: int) -> None:
        nonlocal articles
        for element in stack[depth:]:
            opened[element.name] -= 1
            articles -= element.cue == ARTICLE
        del stack[depth:]

    at = 0
    for start, end, name, ends, rest in tags(page):
        if start > at:
            piece = page[at:start]
            pieces.append(piece)
            if links:
                linked_pieces.append(piece)
        at = end
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if ends else 1
            elif name == "br":
                pieces.append(" ")
            continue
        flush()
        if ends:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                close(depth)
            continue
        links = 0
        if name in VOID or rest.endswith("/"):
            continue
        if name in CLOSED_BY_ITSELF or stack[-1].name == "p":
            for depth in range(len(stack) - 1, max(0, len(stack) - 4), -1):
                if stack[depth].name == name or stack[depth].name == "p":
                    close(depth)
                    break
                if stack[depth].name in ("ul", "ol", "table", "div", "dl"):
                    break
        element = Element(len(elements), name, stack[-1], cue_of(name, rest, articles > 0))
        elements.append(element)
        stack.append(element)
        opened[name] += 1
        articles += element.cue == ARTICLE
    if at < len(page):
        pieces.append(page[at:])
    flush()
    weigh(elements, blocks)
    return blocks


def weigh(elements: list[Element], blocks: list[Block]) -> None:
    """Set each element's log odds: cues above it, weakened where it holds the page's prose."""
    for element in reversed(elements[1:]):
        above = element.parent
        above.holds_article |= element.holds_article
        above.last = max(above.last, element.last)
    for element in elements[1:]:
        if element.cue == COMMENTS and element.holds_article:
            element.cue = NOTHING  # an article about comments, or one that may be commented on
        element.barred = element.parent.barred or element.cue in (UNSHOWN, COMMENTS)
    for block in blocks:
        if block.words >= PROSE_WORDS and 2 * block.linked < block.words and not block.element.barred:
            block.element.prose += block.words - block.linked
    for element in reversed(elements[1:]):
        element.parent.prose += element.prose
    for element in elements[1:]:
        above, own = element.parent.log_odds, 0.0
        if element.cue == ARTICLE:
            own = IN_ARTICLE
        elif element.cue in (UNSHOWN, COMMENTS):
            own = IN_BOILERPLATE
        elif element.cue == NAMED:
            share = 0.0
            if element.prose and (element.holds_article or element.prose >= WRAPPED_WORDS):
                share = element.prose / elements[0].prose
            faith = (WHOLE_SHARE - share) / (WHOLE_SHARE - LEAST_SHARE)
            own = NAMED_BOILERPLATE * min(1.0, max(0.0, faith))
        if above < 0:
            # An article in a sidebar is a teaser, unless the sidebar was hardly one.
            element.log_odds = min(above, own) if own <= 0 else above + (own if above > -own else 0.0)
        else:
            element.log_odds = own if own < 0 else max(own, above)


def log_odds(block: Block) -> float:
    """The classifier: content has words and sentences, lies in an article, is not made of links."""
    return (
        BIAS
        + PER_WORD * min(block.words, MOST_WORDS)
        + (SENTENCE if block.text[-1] in ".!?…。:»\"”" else 0.0)
        + (HEADING if block.element.name in HEADINGS else 0.0)
        + LINKED * block.linked / block.words
        + block.element.log_odds
    )


def costs(blocks: list[Block]) -> list[float]:
    """Log odds of every block; a heading such as "3 comments" also tells those after it in its
    parent, up to the next heading of its level."""
    odds, upto, level = [], -1, 0
    for block in blocks:
        rank = HEADINGS.index(block.element.name) + 1 if block.element.name in HEADINGS else 0
        if block.element.number > upto or rank and rank <= level:
            upto = -1
        if rank and upto < 0 and len(block.text) < 60 and COMMENT_HEADING.fullmatch(block.text):
            upto, level = block.element.parent.last, rank
        odds.append(log_odds(block) + (IN_BOILERPLATE - IN_ARTICLE if upto >= 0 else 0.0))
    return odds


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of each block to the next one, and to the next under the same parent and grandparent."""
    edges = [(i, i + 1, BESIDE) for i in range(len(blocks) - 1)]
    for steps, weight in ((1, SAME_PARENT), (2, SAME_GRANDPARENT)):
        last: dict[int, int] = {}
        for i, block in enumerate(blocks):
            element: Element | None = block.element
            for _ in range(steps):
                element = element.parent if element else None
            if element is None:
                continue
            if element.number in last:
                edges.append((last[element.number], i, weight))
            last[element.number] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut, by Dinic's maximum flow.

    A node has capacity ``odds`` from the source, or ``-odds`` to the sink; edges have
    their weight in both directions.
    """
    n = len(odds)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def tie(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for node, value in enumerate(odds):
        if value > 0:
            tie(source, node, value, 0.0)
        elif value < 0:
            tie(node, sink, -value, 0.0)
    for a, b, weight in edges:
        tie(a, b, weight, weight)

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque((source,))
        while queue:
            node = queue.popleft()
            for edge in graph[node]:
                if room[edge] > 1e-9 and level[to[edge]] < 0:
                    level[to[edge]] = level[node] + 1
                    queue.append(to[edge])
        if level[sink] < 0:  # what the source still reaches is its side
            return [level[node] >= 0 for node in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                most = min(room[edge] for edge in path)
                for edge in path:
                    room[edge] -= most
                    room[edge ^ 1] += most
                full = next(i for i, edge in enumerate(path) if room[edge] <= 1e-9)
                del path[full:]
                node = to[path[-1]] if path else source
                continue
            while turn[node] < len(graph[node]):
                edge = graph[node][turn[node]]
                if room[edge] > 1e-9 and level[to[edge]] == level[node] + 1:
                    break
                turn[node] += 1
            if turn[node] < len(graph[node]):
                path.append(edge)
                node = to[edge]
            elif path:
                node = to[path.pop() ^ 1]
                turn[node] += 1
            else:
                break


def main_text(page: str) -> str:
    """The blocks on the content side of the cut, one a line."""
    blocks = blocks_of(page)
    kept = minimum_cut(costs(blocks), smoothness(blocks))
    return "\n".join(block.text for block, content in zip(blocks, kept) if content)


def extract(pages: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text in ``text`` instead of the html, one row per row.

    The whole html is read.  Null or empty html and pages without content give an empty
    text; other columns pass through, one named like ``text`` is replaced; equal pages
    give equal texts; an empty table gives an empty result.  Markup errors are taken as
    they come: unclosed and stray tags, a page that breaks off (a tag without its end is
    markup, not text).  Time to read a page is proportional to its length.
    """
    keep = [c for c in pages.columns if c not in (html_column, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page) if page else "" for page in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, text]
                )

    return pages.select(*keep, html_column).mapInArrow(run, pages.select(keep).schema.add(text, "string"))
