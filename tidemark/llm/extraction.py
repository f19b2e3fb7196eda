"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks of text. A linear classifier over what encloses a block, its length and its links gives the
cost of calling it boilerplate or content, which become the capacities of its edges from the source and to the sink.
Edges between neighbouring blocks, weaker the further apart they are in the tree of elements, and between neighbours with
the same parent, cost their capacity when the labels differ. The minimum cut is the cheapest labelling of the whole page;
blocks on the source's side are its main text. Where nothing around a block tells, what is beside it decides.

All costs are finite. Names of elements are evidence by their head noun (``post-sidebar`` is a sidebar, ``has-sidebar``
and ``page-with-sidebar`` are not, ``search-results`` hardly a search box), ``article`` and ``main`` outweigh names and
forms around them, and a name or form around most of the page's prose is taken for a wrapper.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML, and words in class, id and role that name parts of a page.
RAW = "script style template textarea select svg iframe object canvas audio video title annotation annotation-xml"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
PARTS_OUT = frozenset("nav footer aside menu dialog head".split())
PARTS_IN = frozenset("article main".split())
FORMS = frozenset("form fieldset".split())
NAMES_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner billboard breadcrumb breadcrumbs complementary contentinfo consent cookie cookies copyright dialog disclaimer "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion recommended related search share sharing "
    "sidebar signup skip skiplink social sponsor sponsored subscribe subscription tags toolbar trending widget".split()
)
NAMES_COMMENTS = frozenset("comment comments commentlist commenter discussion disqus reader readers reactions replies reply respond responses".split())
NAMES_IN = frozenset("article body content entry main post story text".split())
#: Words that follow the noun that a name is about.
GENERIC = frozenset(
    "area bar block body bottom box card col column container content group holder inner item items left link links list main note notes outer panel right row section slot text title top unit wrap wrapper".split()
)
#: Words after which a name says what an element has, not what it is.
HAVING = frozenset("has no with without not is hide show under before after".split())

#: Weights of the classifier, for content. What encloses a block outweighs what it looks like: a long paragraph with a
#: full stop has 1.6 by itself, a block of links -6; a name alone (WEAK) does not outweigh a paragraph.
BIAS, PARAGRAPH, HEADING, LIST, WORD, MOST_WORDS, LINKS, SENTENCE, PLAIN = -1.5, 1.0, 0.5, -0.5, 0.04, 40, -4.5, 0.5, 1.5
INSIDE, NAMED, WEAK, FORM, OUT, PART, OUTSIDE = 4.0, 2.0, -1.5, -3.0, -6.0, -9.0, -3.0
#: Share of a page's prose within an element from which its name is taken for a wrapper's, what is then left of its
#: weight, share within article or main from which the rest is OUTSIDE, and words of prose.
WRAPS, LEFT, MAIN, PROSE = 0.6, 0.1, 0.3, 8
#: Weight of links in a paragraph or heading that is placed as content.
LINKED = 0.45
#: Edge between neighbouring blocks two steps apart in the tree, as neighbouring paragraphs are, and what each further step
#: leaves of it; edge between neighbours of one parent; share of a block's text in buttons from which it is a button.
NEXT, STEP, SIBLING, BUTTON = 0.7, 0.8, 0.7, 0.99

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})(?=[\s/>])((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*+)>?(?:(?<=/>)|.*?(?:</\1(?=[\s/>])[^>]*>|\Z))"
    r"|<[!?][^>]*>?|<(/?)([a-z][a-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*+)>?",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Cues:
    """Evidence that an element gives on what it encloses, and the nearest element around it that gives some."""

    __slots__ = ("apart", "around", "inside", "kinds", "main", "number", "out", "prose", "state")

    def __init__(self, around: Cues | None, kinds: list[str], number: int):
        self.around, self.kinds, self.number = around, kinds, number
        self.prose = self.main = 0  # words of prose within it, and of those that are within article or main
        self.inside = (around is not None and around.inside) or "in" in kinds
        parts = 2 * any(k in ("part", "comments", "out", "form") for k in kinds) or "header" in kinds
        self.out = max(around.out if around else 0, int(parts))  # 2 if out of the content, 1 if so unless inside
        self.apart = (around is not None and around.apart) or "part" in kinds or "comments" in kinds
        self.state = (0.0, False)


class Block:
    """A run of text between block elements: text, shares inside links and buttons, words, what encloses it, and the steps in the tree from the block before."""

    __slots__ = ("button", "cues", "element", "link", "parent", "steps", "text", "words")

    @property
    def inside(self) -> bool:
        """Whether an article or main encloses it."""
        return self.cues is not None and self.cues.inside

    @property
    def out(self) -> bool:
        """Whether a part of the page that isn't content, or one named so, encloses it."""
        return self.cues is not None and (self.cues.out == 2 or (self.cues.out == 1 and not self.inside))


@functools.lru_cache(maxsize=4096)
def name_cue(name: str) -> str:
    """What one word of class, id or role says: out, comments, header, weak, named or nothing."""
    words = []
    for w in map(str.lower, _WORDS.findall(name)):
        if w in HAVING:
            break
        words.append(w)
    head = next((w for w in reversed(words) if w not in GENERIC), None)
    if head in NAMES_COMMENTS:
        return "comments"
    if head in NAMES_OUT:
        return "out"
    if head == "header":
        return "header"
    if any(w in NAMES_OUT or w in NAMES_COMMENTS for w in words):
        return "weak"
    return "named" if any(w in NAMES_IN for w in words) else ""


def _cues(tag: str, rest: str) -> list[str]:
    """Kinds of evidence that an element gives on what it encloses."""
    if tag in ("html", "body"):
        return []
    found = []
    names = [x for m in _NAMES.finditer(rest) for x in (m[1] or m[2] or m[3] or "").split()] if "=" in rest else []
    kinds = {name_cue(x) for x in names}
    if tag in PARTS_OUT:
        return ["part"]
    if tag == "noscript":
        return ["weak"]
    if tag in PARTS_IN or names and ("main" in names or "article" in names) and "role" in rest.lower():
        found.append("in")
    for kind in ("comments", "out", "header"):
        if kind in kinds:
            return [*found, kind]
    if tag in FORMS:
        found.append("form")
    if tag == "header":
        found.append("header")
    return found + [k for k in ("named", "weak") if k in kinds]


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Elements left open end with the page, or where an outer one ends."""
    found: list[Block] = []
    stack: list[tuple] = [("", None, 0)]  # tag, the nearest cues, number
    opened: Counter[str] = Counter()
    text, link, button, links, number, at = [], 0, 0, 0, 0, 0
    depth, low = 0, 0  # of the block before, and the least since

    def flush() -> None:
        nonlocal text, link, button, depth, low
        if text:
            joined = " ".join(html_lib.unescape("".join(text)).split())
            if joined:
                block, i = Block(), len(stack) - 1
                while i and stack[i][0] in INLINE:
                    i -= 1
                block.text, block.link, block.button, block.element, block.words = joined, min(1.0, link / len(joined)), min(1.0, button / len(joined)), stack[i][0], joined.count(" ") + 1
                block.cues, block.parent = stack[i][1], stack[max(0, i - 1)][2]
                block.steps, depth = max(2, depth + i - 2 * min(low, i)), i
                low = depth
                found.append(block)
        text, link, button = [], 0, 0

    def close() -> str:
        nonlocal links, low
        tag = stack.pop()[0]
        low = min(low, len(stack) - 1)
        opened[tag] -= 1
        links -= tag == "a"
        return tag

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            link += (m.start() - at) * bool(links)
            button += (m.start() - at) * (opened["button"] > 0)
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[3]:
            if opened[tag] > 0:
                while close() != tag:
                    pass
        elif tag not in VOID:
            if tag not in INLINE:  # these end an open paragraph, and an item the one before
                while stack[-1][0] in INLINE or stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
                    close()
            number += 1
            if not m[5].rstrip().endswith("/"):
                cues = _cues(tag, m[5])
                stack.append((tag, Cues(stack[-1][1], cues, number) if cues else stack[-1][1], number))
                opened[tag] += 1
                links += tag == "a"
    if at < len(page):
        text.append(page[at:])
    flush()
    return found


def _placed(nodes: list[Cues], total: int, has_main: bool) -> None:
    """The weight that each element with cues gives to what it encloses, from that of those around it; nodes from the outside in."""
    for node in nodes:
        cue, own = node.around.state if node.around else (0.0, False)
        wraps = total and node.prose > WRAPS * total and (node.main or not has_main)
        for kind in node.kinds:
            if kind == "part":
                cue = PART
            elif kind == "comments":
                cue = min(cue, PART)
            elif kind == "in":
                own = True
                cue = INSIDE if cue > PART else cue
            elif kind == "weak":
                cue += WEAK
            elif kind == "named":
                cue = max(cue, NAMED) if cue >= 0 else cue
            elif kind != "header" or not own:
                weight = FORM if kind == "form" else OUT
                cue = cue + LEFT * weight if wraps else min(cue, weight)
        node.state = (cue, own)


def costs(found: list[Block]) -> list[float]:
    """How much likelier each block is content than boilerplate, as a log odds."""
    nodes: dict[int, Cues] = {}
    total = main = 0
    for b in found:
        node = b.cues
        while node is not None and node.number not in nodes:
            nodes[node.number] = node
            node = node.around
        if b.words >= PROSE and b.link < 0.5:
            own = b.words if b.inside and not b.cues.apart else 0
            total, main = total + b.words, main + own
            if b.cues is not None:
                b.cues.prose += b.words
                b.cues.main += own
    order = [nodes[n] for n in sorted(nodes)]  # an element begins after those around it
    for node in reversed(order):
        if node.around is not None:
            node.around.prose += node.prose
            node.around.main += node.main
    has_main = main > 0 and main >= MAIN * total
    _placed(order, total, has_main)
    plain = all(b.element in ("", "html", "body") for b in found)
    out = []
    for b in found:
        cue, own = b.cues.state if b.cues is not None else (0.0, False)
        if b.button >= BUTTON:
            cue = PART
        upright = b.element in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")
        z = BIAS + cue + OUTSIDE * (has_main and not own) + PLAIN * plain + WORD * min(b.words, MOST_WORDS) + SENTENCE * (b.text[-1] in ".!?…\"'»”")
        z += LINKS * b.link * (LINKED if upright and cue > 0 else 1)
        z += PARAGRAPH * (b.element in ("p", "blockquote", "pre")) + HEADING * (b.element[:1] == "h" and b.element[1:].isdigit()) + LIST * (b.element in ("li", "td", "th", "dt", "dd"))
        out.append(z)
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut, by Dinic's maximum flow.

    A positive cost is the capacity from the source, a negative one that to the sink. A node whose cost outweighs all
    its edges is on its own side in every minimum cut, so it is fixed first and only adds to its neighbours' costs.
    """
    near: list[dict[int, float]] = [{} for _ in costs]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    z, side = list(costs), [None] * len(costs)
    queue = deque(range(len(costs)))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(z[i]) > sum(c for j, c in near[i].items() if side[j] is None):
            side[i] = z[i] > 0
            for j, c in near[i].items():
                if side[j] is None:
                    z[j] += c if side[i] else -c
                    queue.append(j)
    free = [i for i, s in enumerate(side) if s is None]
    if not free:
        return side
    number = {i: k for k, i in enumerate(free)}
    source, sink = len(free), len(free) + 1
    graph: list[list[list]] = [[] for _ in range(len(free) + 2)]  # edges: to, capacity left, index of the reverse

    def connect(a: int, b: int, there: float, back: float) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i in free:
        if z[i] > 0:
            connect(source, number[i], z[i], 0.0)
        elif z[i] < 0:
            connect(number[i], sink, -z[i], 0.0)
        for j, c in near[i].items():
            if j > i and side[j] is None:
                connect(number[i], number[j], c, c)
    while True:
        level = [-1] * len(graph)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for b, left, _ in graph[a]:
                if left > 1e-12 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            break
        arc, path = [0] * len(graph), [source]
        while path:
            a = path[-1]
            if a == sink:
                steps = [graph[x][arc[x]] for x in path[:-1]]
                flow = min(e[1] for e in steps)
                for e in steps:
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                path = path[: next(k for k, e in enumerate(steps) if e[1] <= 1e-12) + 1]
            elif arc[a] == len(graph[a]):
                path.pop()
                if path:
                    arc[path[-1]] += 1
            elif (e := graph[a][arc[a]])[1] > 1e-12 and level[e[0]] == level[a] + 1:
                path.append(e[0])
            else:
                arc[a] += 1
    for i in free:
        side[i] = level[number[i]] >= 0
    return side


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks: to the one before, by the steps between them, and to the last one with the same parent."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT * STEP ** (b.steps - 2)))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return edges


def labelled(page: str | None) -> list[tuple[Block, float, bool]]:
    """The blocks of a page with their own cost and whether the cut calls them content."""
    found = blocks(page or "")
    own = costs(found)
    return list(zip(found, own, minimum_cut(own, smoothness(found)), strict=True))


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks in page order, one a line."""
    return "\n".join(b.text for b, _, content in labelled(page) if content)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main texts: page_id, url, text, n_chars (code points).

    pages: page_id, url, html. A row for each row of pages, from the whole html. Null or empty html, or a page without
    content, gives an empty text; page_id and url may be null and may repeat; other columns are ignored; no rows give
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
