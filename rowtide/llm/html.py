"""Main text of web pages by minimum-cut labelling.

A page becomes its text blocks in order, each with its place in the element tree. A linear classifier over signs of content and of
boilerplate (elements, class and id words, link density, length) gives each block the cost of either label; these are the
capacities to the two terminals. Blocks that follow each other, and blocks of one parent, are tied by smoothness
edges whose capacity falls with their distance in the tree. The minimum cut is the cheapest labelling; its content
side is the text.

One pass over the pages, no shuffle; a task holds one block of pages and the graph of one page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from rowtide.llm import texts as X

#: A comment ends at --> or --!>; in a tag a quote opens a value only straight after =, elsewhere it is part of a name.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"""|</?[a-zA-Z](?:=\s*(?:"[^"]*(?:"|$)|'[^']*(?:'|$))?|[^>=])*(?:>|$)""",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe".split())  # hold text up to their end tag, whatever it looks like
#: Elements of boilerplate inside running text: what they hold is left out, and they part no block.
_EMBEDDED = frozenset("noscript template svg object select canvas audio video annotation annotation-xml".split())
_MATH = frozenset("math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | _MATH
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end one of the same kind, up to the element that holds such a list.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_BAD_TAGS = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "button": 6.0, "menu": 5.0, "dialog": 6.0, "header": 3.0, "label": 2.0, "address": 1.0}
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar "
    "toolbar comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations widget widgets pagination pager "
    "copyright legal disclaimer skip tags tagcloud trending popular search form hidden".split()
)
#: Of these the ones that name nothing but boilerplate; the others are also words for parts of an article.
_SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted cookie cookies consent gdpr popup modal newsletter subscribe subscription "
    "signup login sidebar nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus share sharing pagination pager".split()
)
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_GOOD_WORDS = frozenset("article post entry story content main body text prose".split())
ADJACENT, SIBLING = 1.2, 0.6
UNSURE = 1.5  # the cost of an unsure word inside an article, less than a sentence there is worth


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    bad: float = 0.0  # worst sign of boilerplate on the path
    good: float = 0.0
    out: bool = False  # an embedded element, or inside one
    loose: bool = False  # the next block starts outside of it


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""


def _signs(tag: str, source: str, parent: Node) -> Node:
    bad, good = parent.bad, parent.good
    inside = good >= 3.0
    own = _BAD_TAGS.get(tag, 0.0)
    if tag == "header" and inside:
        own = 0.0  # the head of the article itself
    attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(source, len(tag) + 1)} if "=" in source or "hidden" in source else {}
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower()))
    if words & _BAD_WORDS and tag not in ("body", "html", "article", "main"):
        own = max(own, 5.0 if not inside or words & _SURE_WORDS else UNSURE)
    if attributes.get("role") in _BAD_ROLES:
        own = max(own, 6.0)
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        own = max(own, 6.0)
    if tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articlebody":
        good = max(good, 3.0)
    elif words & _GOOD_WORDS:
        good = max(good, 1.0)
    return Node(tag, parent, parent.depth + 1, max(bad, own), good)


def closed(page: str, tag: str) -> set[int]:
    """Places of the start tags `tag` that have an end tag of their own."""
    out, open_ = set(), []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*", page, re.I):
        if not m[1] and not m[0].endswith("/"):
            open_.append(m.start())
        elif m[1] and open_:
            out.add(open_.pop())
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order; elements that hold no running text are left out."""
    root = Node("", None, 0)
    stack, out, links = [root], [], 0
    block = Block(root)
    ended: dict[str, set[int]] = {}
    open_: Counter[str] = Counter()  # of the elements on the stack

    def push(node: Node) -> None:
        stack.append(node)
        open_[node.tag] += 1

    def flush() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                out.append(block)
            block = Block(stack[-1])

    def add(text: str) -> None:
        if stack[-1].out:
            return
        if not block.parts and text.strip():
            block.node = next((n for n in reversed(stack) if n.tag not in _INLINE), root)
            block.heading = any(n.tag in _HEADINGS for n in stack[-4:])
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    def pop(to: int) -> None:
        nonlocal links
        for n in stack[to:]:
            links -= n.tag == "a"
            open_[n.tag] -= 1
        if any(n.tag not in _INLINE and not n.out for n in stack[to:]):
            flush()
        del stack[to:]
        if not block.parts:
            block.node = stack[-1]

    at, n = 0, len(page)
    while at < n:
        begin = at
        while (begin := page.find("<", begin)) >= 0 and not (m := _TOKEN.match(page, begin)):
            begin += 1
        if text := page[at : begin if begin >= 0 else n]:
            add(html.unescape(text))
        if begin < 0:
            break
        source, at = m[0], m.end()
        if source[1] in "!?":
            if source.startswith("<![CDATA["):
                add(source[9:].removesuffix("]]>"))
            continue
        tag = _NAME.match(source)[1].lower()
        if source[1] == "/":
            if not open_[tag]:
                if tag == "p":
                    flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break  # an inline end tag closes no block
            continue
        if tag in _CLOSES_P and stack[-1].out and not any(x.tag == "foreignobject" for x in stack):
            for i, x in enumerate(stack):
                if x.loose or x.out and tag in ("article", "main"):
                    pop(i)
                    break
        inside = stack[-1].out
        if inside and source.endswith("/>"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            add(" ")
            continue
        if tag in _EMBEDDED or inside:
            if tag in _VOID or source.endswith("/>"):
                continue
            if tag in _EMBEDDED and tag not in ended:
                ended[tag] = closed(page, tag)
            add(" " if not tag.startswith("annotation") else "")
            loose = tag in _EMBEDDED and (begin not in ended[tag] or tag in ("svg", "select"))  # these two hold no blocks
            push(Node(tag, stack[-1], stack[-1].depth + 1, stack[-1].bad, stack[-1].good, True, loose))
            links += tag == "a"
            continue
        if tag == "head":
            continue
        if tag == "body" or tag == "html":
            flush()
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
        if tag in _ENDS:
            ends, within = _ENDS[tag]
            lowest = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in ends:
                    lowest = i
            if lowest:
                pop(lowest)
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            add(" ")
        if tag in _VOID or source.endswith("/>") and (tag in _MATH or tag not in _INLINE and tag not in _CLOSES_P):
            continue
        push(_signs(tag, source, stack[-1]))
        links += tag == "a"
        if tag not in _INLINE:
            block.node = stack[-1]
    flush()
    return out


def content_cost(block: Block, text: str) -> float:
    """Log-odds of content: positive costs to drop the block, negative costs to keep it."""
    words = len(text.split())
    dense = block.linked / max(1, len(text))
    score = 0.6 * math.log1p(words) - 1.4 + 0.8 * block.node.good - block.node.bad
    score += 0.5 * (block.node.tag in ("p", "blockquote", "pre", "li", "td", "figcaption")) + 0.3 * (text[-1] in ".!?…:;\"'”»")
    linked = 1.0 if block.node.good >= 3.0 else 3.0  # articles hold lists of links too
    score -= linked * (dense > 0.5) + linked / 3 * (0.2 < dense <= 0.5)
    score += 0.7 * (block.heading and block.node.good >= 3.0)
    score -= 3.0 * text.startswith("©")
    return score


def apart(a: Node, b: Node) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The cheapest labelling: dropping i costs costs[i] if positive, keeping it -costs[i] if negative, parting an edge its weight."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    rest = list(costs)  # what a block can still send (positive) or take in (negative)
    while True:
        # distance to the nearest block that takes in, as far as the first ones that send: the rest of the page is not looked at
        layer = [i for i in range(n) if rest[i] < -1e-9]
        level, senders = dict.fromkeys(layer, 0), []
        while layer and not senders:
            further = []
            for x in layer:
                for y in near[x]:
                    if y not in level and near[y][x] > 1e-9:
                        level[y] = level[x] + 1
                        (senders if rest[y] > 1e-9 else further).append(y)
            layer = further
        if not senders:
            break
        for s in senders:  # all shortest ways at once; one that leads no further is closed
            path = [s]
            while path and rest[s] > 1e-9:
                x = path[-1]
                if not level[x] and rest[x] < -1e-9:
                    flow = min([rest[s], -rest[x], *(near[a][b] for a, b in zip(path, path[1:]))])
                    for a, b in zip(path, path[1:]):
                        near[a][b] -= flow
                        near[b][a] += flow
                    rest[s] -= flow
                    rest[x] += flow
                    path = [s]
                    continue
                on = next((y for y, w in near[x].items() if w > 1e-9 and level.get(y, -1) == level[x] - 1 and level[x]), None)
                if on is None:
                    level[x] = -1
                    path.pop()
                else:
                    path.append(on)
    keep, queue = [r > 1e-9 for r in rest], deque(i for i in range(n) if rest[i] > 1e-9)
    while queue:  # the source's side: all that it can still reach
        x = queue.popleft()
        for y, w in near[x].items():
            if w > 1e-9 and not keep[y]:
                keep[y] = True
                queue.append(y)
    return keep


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by two line ends; empty for a null page or one without content."""
    blocks = blocks_of(page or "")
    texts = [b.text for b in blocks]
    costs = [content_cost(b, t) for b, t in zip(blocks, texts)]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT / (1 + apart(blocks[i - 1].node, b.node))))
        if (j := last.get(id(b.node.parent))) is not None:
            edges.append((j, i, SIBLING))
        last[id(b.node.parent)] = i
    keep = minimum_cut(costs, edges)
    return "\n\n".join(t for t, k in zip(texts, keep) if k)


def extract(pages: DataFrame, id: str = "page_id", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """Per row of `pages`: id, kept columns, text and n_chars (its code points).

    A null or empty page, and one without content, has the empty text. Markup may be cut off or badly nested. Repeated rows each come
    back; kept columns must not be called text or n_chars; others are not looked at.
    """
    base, back = X.kept(pages, id, html, keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, html):
            out = [main_text(x) for x in block.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in back), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*back, "text", "n_chars"])

    return base.mapInArrow(scan, X.struct(base, back, [("text", "string"), ("n_chars", "bigint")]))
