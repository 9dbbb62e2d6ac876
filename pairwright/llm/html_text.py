"""Main text of web pages: blocks labelled as content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds and the words of class, id and role that tell what an element holds.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup and runs to their own end tag.
RAW_TAGS = frozenset("script style title textarea".split())
#: Nothing in them is shown, if they are closed.
UNSHOWN_TAGS = frozenset("noscript template svg math iframe object canvas select button".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset label search".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert newsletter subscribe subscription signup share sharing social sidebar widget related "
    "recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus "
    "reply replies respond login search popup modal overlay toolbar pagination pager copyright legal disclaimer "
    "contentinfo complementary dialog skip".split()
)
CONTENT_WORDS = frozenset("article content main post entry story articlebody".split())
#: Words that only say which part or arrangement of the named thing an element is.
NEUTRAL_WORDS = frozenset(
    "site page top bottom left right upper lower box bar list item items block area section wrapper wrap container inner "
    "outer panel card link links text body button icon slot unit row col column grid group header head title form posts "
    "articles stories thread author meta tree count primary secondary global mobile desktop fixed sticky inline the".split()
)
#: In front of a word these tell of a state of the element, not of what it holds.
STATE_WORDS = frozenset("has have no not non with without is hide show".split())

#: Weights of the block classifier (log odds of content) and of the smoothness edges.
CONTEXT, LINKS, LENGTH, SENTENCE, BIAS, ADJACENT, SIBLING = 8.0, 3.0, 0.5, 0.8, -1.5, 0.6, 0.3
#: What a name such as ``related-work``, of a telling and another word, takes from the context.
HINT = 0.2

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW_TAGS}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that an opening tag ends when they are still open.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@lru_cache(maxsize=4096)
def element_kind(tag: str, rest: str) -> tuple[str, bool]:
    """What an element holds, and whether only its names say so.

    ``boilerplate``, ``content``, ``header``, ``hidden``, ``unshown`` (if closed), ``hint`` (perhaps boilerplate)
    or nothing. A name is boilerplate if a word of it is and the others are neutral; with other words it
    is a hint. Names of the whole page (``html``, ``body``) and names of a state (``no-comment``) tell nothing.
    """
    if tag in UNSHOWN_TAGS:
        return "unshown", False
    attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(
        r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I
    ):
        return "hidden", False
    if tag in BOILERPLATE_TAGS:
        return "boilerplate", False
    if tag in ("html", "body"):
        return "", False
    found = set()
    for name in " ".join(attributes.get(a, "") for a in ("class", "id", "role", "itemprop")).split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in STATE_WORDS:
            continue
        if BOILERPLATE_WORDS.intersection(words):
            known = all(w in BOILERPLATE_WORDS or w in CONTENT_WORDS or w in NEUTRAL_WORDS for w in words)
            found.add("boilerplate" if known else "hint")
        elif "header" in words or "masthead" in words:
            found.add("header")
        elif CONTENT_WORDS.intersection(words):
            found.add("content")
    if "boilerplate" in found:
        return "boilerplate", True
    if tag == "header" or "header" in found:
        return "header", tag != "header"
    if tag in CONTENT_TAGS or "content" in found:
        return "content", tag not in CONTENT_TAGS
    return ("hint", True) if found else ("", False)


class Element:
    """An open element; what its ancestors tell is carried along, so nobody walks up a deep page."""

    __slots__ = ("parent", "depth", "tag", "kind", "named", "start", "context", "inside", "hidden", "unshown", "tagged")

    def __init__(self, parent: Element | None, tag: str, kind: str, named: bool, start: int) -> None:
        self.parent, self.tag, self.kind, self.named, self.start = parent, tag, kind, named, start
        if parent is None:
            self.depth, self.context, self.inside, self.hidden, self.unshown, self.tagged = 0, 0.0, False, 0, 0, False
            return
        self.depth = parent.depth + 1
        self.context, self.inside, self.tagged = parent.context, parent.inside, parent.tagged
        self.hidden = parent.hidden + (kind in ("hidden", "unshown"))
        self.unshown = parent.unshown + (kind == "unshown")
        if kind == "content":
            self.context, self.inside = 1.0, True
        elif kind == "boilerplate" or kind == "header" and not self.inside:
            self.context, self.tagged = -1.0, self.tagged or not named
        elif kind == "hint":
            self.context = max(-1.0, self.context - HINT)


class Block:
    """Text between two block boundaries, its context and the innermost open element around it."""

    __slots__ = ("context", "element", "text", "linked", "title")

    def __init__(self, text: str, linked: int, element: Element, title: bool = False) -> None:
        self.text, self.linked, self.element, self.title = text, linked, element, title
        self.context = element.context


def page_blocks(page: str) -> list[Block]:
    """Shown blocks of a page in order; white space inside one is a single space, references are decoded.

    Elements of ``UNSHOWN_TAGS`` hide their content only if an end tag of their own closes
    them: the page is read again for those that turn out to be unclosed, and so it is where
    names would make all of its text boilerplate.
    """
    unclosed: set[int] = set()
    unnamed: set[int] = set()
    while True:
        blocks, more, content = _blocks(page, unclosed, unnamed)
        if not more <= unclosed:
            unclosed |= more
            continue
        wrappers = set() if content else _wrappers(blocks)
        if not wrappers:
            return blocks
        unnamed |= wrappers


def _wrappers(blocks: list[Block]) -> set[int]:
    """Starts of elements that their names make boilerplate and that hold all blocks but those of ``BOILERPLATE_TAGS``.

    Where nothing is marked as content, such a name tells nothing apart.
    """
    rest = [b.element for b in blocks if not b.element.tagged]
    # blocks lie in the order of a walk through the tree: what holds the first and the last holds all
    shared = _common(rest[0], rest[-1]) if rest else None
    found = set()
    while shared:
        if shared.named and shared.kind in ("boilerplate", "header"):
            found.add(shared.start)
        shared = shared.parent
    return found


def _common(a: Element, b: Element) -> Element:
    """The innermost element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def _blocks(page: str, unclosed: set[int], unnamed: set[int]) -> tuple[list[Block], set[int], bool]:
    """Blocks, the starts of unclosed elements of ``UNSHOWN_TAGS``, and whether an element is marked as content.

    Elements that start in ``unclosed`` hide nothing, names of those in ``unnamed`` tell nothing.
    """
    blocks: list[Block] = []
    stack = [Element(None, "", "", False, -1)]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements in the stack, by tag
    outer: list[int] = []  # of the open block elements
    parts: list[str] = []
    more: set[int] = set()
    head = None  # whether it is open
    content = False
    linked = 0

    def end(first: int, closed: bool = False) -> None:
        """End the open elements from ``first`` on; only an end tag of its own closes the first of them."""
        for place in range(len(stack) - 1, first - 1, -1):
            element = stack.pop()
            places[element.tag].pop()
            if outer and outer[-1] == place:
                outer.pop()
            if element.kind == "unshown" and not (closed and place == first):
                more.add(element.start)

    def end_head() -> None:
        """What cannot stand in a head ends it, unless an element in the head hides it."""
        nonlocal head
        if places["head"]:
            # the head itself hides, too
            if stack[-1].hidden > stack[places["head"][-1]].hidden:
                return
            end(places["head"][-1])
        head = False

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, min(linked, len(text)), stack[-1], bool(places["h1"])))
            parts.clear()
        linked = 0

    def shown(text: str) -> None:
        nonlocal linked
        if head and text and not text.isspace():
            end_head()
        if text and not stack[-1].hidden:
            parts.append(text)
            if places["a"]:
                linked += len(text)

    at = 0
    while token := _TOKEN.search(page, at):
        shown(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if head:
                end_head()
            parts.append("\n")
        elif token["end"]:
            opened = places[tag][-1] if places[tag] else 0
            if tag in BLOCK_TAGS and not stack[opened - 1].unshown:
                close_block()
            if opened:
                end(opened, closed=True)
        else:
            empty = tag in VOID_TAGS or token["rest"].endswith("/")
            if head and tag not in HEAD_TAGS:
                end_head()
            if tag in RAW_TAGS:
                # only in drawings and formulas can these be empty
                if not (empty and (places["svg"] or places["math"])):
                    raw_end = _RAW_END[tag].search(page, at)
                    at = raw_end.end() if raw_end else len(page)
                continue
            if tag in BLOCK_TAGS and not stack[-1].unshown:
                close_block()
                # an open paragraph ends here, with the inline elements in it
                ended = _ENDS.get(tag, ())
                while outer and ((t := stack[outer[-1]].tag) == "p" or t in ended):
                    end(outer[-1])
            if tag == "head":
                if head is None and not empty:
                    head = True
                    places[tag].append(len(stack))
                    stack.append(Element(stack[-1], tag, "hidden", False, token.start()))
            elif not empty:
                kind, named = element_kind(tag, token["rest"])
                if named and token.start() in unnamed or kind == "unshown" and token.start() in unclosed:
                    kind = ""
                content = content or kind == "content"
                places[tag].append(len(stack))
                if tag in BLOCK_TAGS:
                    outer.append(len(stack))
                stack.append(Element(stack[-1], tag, kind, named, token.start()))
    shown(page[at:])
    close_block()
    end(1)
    return blocks, more, content


def log_odds(block: Block, marked: bool = True) -> float:
    """Of a block being content: nearest telling ancestor, share of linked text, length and sentence marks.

    A block without a telling ancestor is held to be boilerplate only beside content that is
    ``marked`` as such in its page, and if it is no title.
    """
    size = len(block.text)
    bias = BIAS if abs(block.context) > 0.5 or marked and not block.title else 0.0
    return (
        bias + CONTEXT * block.context - LINKS * block.linked / size + LENGTH * math.log2(1 + size / 40)
        + SENTENCE * (block.text[-1] in ".!?…\"”»)")
    )


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker with every element boundary between them, and between next siblings."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            # as far to walk as elements open and close between the two
            a, b = blocks[i - 1].element, block.element
            between = a.depth + b.depth - 2 * _common(a, b).depth
            edges.append((i - 1, i, ADJACENT / (1 + max(0, between - 2))))
        parent = block.element.parent
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def source_side(capacity: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut.

    ``capacity`` is the source capacity minus the sink capacity of each node: what both
    have in common is cut anyway. Dinic's algorithm sends flow from nodes with a surplus
    to nodes with a demand over the undirected smoothness edges.
    """
    n = len(capacity)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(capacity):
        if c > 0:
            connect(source, i, c, 0.0)
        elif c < 0:
            connect(i, sink, -c, 0.0)
    for a, b, weight in edges:
        connect(a, b, weight, weight)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= least)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > least and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def main_text(page: str) -> str:
    """The content blocks of a page, one per line; empty if there are none."""
    blocks = page_blocks(page)
    # softplus(z) - softplus(-z) = z: the classifier's two costs differ by its log odds
    marked = any(b.element.inside for b in blocks)
    odds = [log_odds(b, marked) for b in blocks]
    kept = source_side(odds, smoothness(blocks)) if any(z > 0 for z in odds) else [False] * len(blocks)
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract_main_text(
    pages: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)
) -> DataFrame:
    """``id_column, *keep, text`` of every row of ``pages``, from the whole html; null html and no content are empty.

    A page is parsed into blocks. The block classifier's costs are the terminal
    capacities of a graph, neighbourhood in the page and in the element tree its
    smoothness edges; the maximum flow separates content from boilerplate. Text of
    scripts, styles, comments and hidden elements is never part of a block. The work on a
    page grows with its length, however deep its elements nest. Rows are treated one by one
    with no shuffle; repeated rows give repeated results, further columns are not read.
    """
    names = [id_column, *keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(p.as_py() or "") for p in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + [pa.array(texts, pa.string())], names=names)

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_column, *keep))
    return pages.select(id_column, *keep, F.col(html_column).cast("string")).mapInArrow(run, f"{kinds}, text string")
