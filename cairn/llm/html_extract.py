"""Main-text extraction from web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text, one for each stretch between block-level tags. A
classifier turns a block's features (the elements around it, link density, length,
wording) into a probability of being content; its two log costs become the capacities
of the block's edges to source and sink. Neighbouring blocks, and near blocks under one
parent element, are joined by smoothness edges. The minimum cut, found by max-flow,
separates content from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import tidy

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_RAW = frozenset("script style noscript iframe template textarea title xmp noembed noframes".split())
#: Elements whose text is never shown as text of the page.
_UNSEEN = frozenset("script style noscript iframe template textarea title xmp noembed noframes head svg object math select option button".split())
#: A start tag of the first kind ends open elements of the second, up to a container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SMALL = frozenset("p li h1 h2 h3 h4 h5 h6".split())
_BARRIER = frozenset("ul ol dl table td th article section div main aside nav header footer form blockquote body".split())
_TAG_WEIGHT = {"article": 5.0, "main": 4.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0}
_NEGATIVE = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|sidebar|footer|header|masthead|topbar|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|replies|widget|pagination|pager|copyright|toolbar|skip)(?![a-z])", re.I)
_POSITIVE = re.compile(r"(?:^|[^a-z])(?:article|content|main|post|entry|story|maincontent|articlebody|bodytext)(?![a-z])", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_WORDING = re.compile(r"©|\bcopyright\b|all rights reserved|privacy policy|terms of (?:use|service)", re.I)
_MARK = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: The rest of a tag after its name: quotes count where a value begins, and one that is never closed is a character like others.
_TAG_REST = re.compile(r"(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+>")
SCALE = 1000
#: What the element right around a block adds to its log odds.
_KIND = {"p": 0.6, "blockquote": 0.6, "pre": 0.6, "li": -0.2} | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 0.8)


class Block:
    """A block of text with what the classifier reads."""

    __slots__ = ("parent", "weight", "text", "link_chars", "kind")

    def __init__(self, text: str, parent: int, weight: float, link_chars: int, kind: float) -> None:
        self.text, self.parent, self.weight, self.link_chars, self.kind = text, parent, weight, link_chars, kind


def _element_weight(tag: str, attributes: str, inside: float) -> float:
    """What an element adds to the evidence for its text."""
    weight = _TAG_WEIGHT.get(tag, 0.0)
    if tag == "header" and inside <= 0:
        weight = -9.0
    if attributes:
        if tag not in ("body", "html") and ("class" in attributes or "id" in attributes or "role" in attributes):
            names = " ".join(filter(None, (x for m in _NAMES.finditer(attributes) for x in m.groups())))
            if names:
                weight += -9.0 * bool(_NEGATIVE.search(names)) or 2.0 * bool(_POSITIVE.search(names))
        if _HIDDEN.search(_QUOTED.sub("", attributes)) or ("style" in attributes or "aria-hidden" in attributes) and _HIDDEN.search(attributes):
            weight -= 12.0
    return weight


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order, with white space joined; one pass over the page."""
    out: list[Block] = []
    # tag, weight of all around, unseen; of the block-level element around: tag, weight; number of the nearest grouping one
    stack: list[tuple[str, float, bool, str, float, int]] = [("", 0.0, False, "", 0.0, 0)]
    depths: dict[str, list[int]] = {}  # where in the stack elements of a name are, so that no step walks through it
    parts: list[str] = []
    linked: list[str] = []
    number = links = 0
    where: tuple[int, float, float] = (0, 0.0, 0.0)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, where[0], where[1], len(" ".join("".join(linked).split())), where[2]))
        parts.clear()
        linked.clear()

    def text(raw: str) -> None:
        nonlocal where
        if not raw or stack[-1][2]:
            return
        said = html.unescape(raw) if "&" in raw else raw
        if not parts:
            _, weight, _, home, home_weight, up = stack[-1]
            where = (up, min(home_weight, weight), _KIND.get(home, 0.0))
        parts.append(said)
        if links:
            linked.append(said)

    def leave(depth: int) -> None:
        nonlocal links
        for e in stack[depth:]:
            links -= e[0] == "a"
            depths[e[0]].pop()
        del stack[depth:]

    at, end = 0, len(page)
    lower: str | None = None
    while True:
        m = _MARK.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        if page.startswith("<!--", m.start()):
            close = page.find("-->", m.end())
            at = end if close < 0 else close + 3
            continue
        close = page.find(">", m.end())
        if close < 0:  # an unfinished tag ends the page
            break
        tag = m[2]
        if tag is None:  # <!DOCTYPE>, <?xml>, </>
            at = close + 1
            continue
        rest = _TAG_REST.match(page, m.end())
        if rest is None:  # no end outside of quotes: an unfinished tag
            break
        close = rest.end() - 1
        attributes = page[m.end() : close]
        if "<" in attributes:  # markup within a value says nothing about the element
            attributes = _QUOTED.sub(lambda q: '""' if "<" in q[0] else q[0], attributes)
        at, tag = close + 1, tag.lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            if depths.get(tag):
                leave(depths[tag][-1])
            continue
        if tag in _BLOCK:
            flush()
            ends = _ENDS.get(tag, set()) | {"p"}
            if opened := [d for e in ends if (d := depths.get(e))]:
                barrier = max((d[-1] for e in _BARRIER - ends if (d := depths.get(e))), default=0)
                leave(min((d[i] for d in opened if (i := bisect_right(d, barrier)) < len(d)), default=len(stack)))
        if tag in _VOID:
            if tag == "br":
                text(" ")
            continue
        if attributes.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in _RAW:
            lower = page.lower() if lower is None or len(lower) != end else lower
            close = lower.find(f"</{tag}", at) if len(lower) == end else page.find(f"</{tag}", at)
            stop = page.find(">", close) if close >= 0 else -1
            at = end if stop < 0 else stop + 1
            continue
        number += 1
        _, around, unseen, home, home_weight, up = stack[-1]
        weight = around + _element_weight(tag, attributes, around)
        if tag in _BLOCK:
            home, home_weight = tag, weight
            up = up if tag in _SMALL else number
        depths.setdefault(tag, []).append(len(stack))
        stack.append((tag, weight, unseen or tag in _UNSEEN, home, home_weight, up))
        links += tag == "a"
    flush()
    return out


def content_score(b: Block) -> float:
    """Log odds that a block is content."""
    n = len(b.text)
    density = min(1.0, b.link_chars / n)
    z = -0.2 + b.weight + 0.7 * math.log1p(n / 30) - 4.0 * density
    z += b.kind + 0.5 * (b.text[-1] in ".!?…\"'”»。") - 2.5 * bool(n < 400 and _WORDING.search(b.text))
    return max(-12.0, min(12.0, z))


def costs(score: float) -> tuple[int, int]:
    """Capacities (from the source, to the sink): the cost of calling a block boilerplate, and of calling it content."""
    softplus = lambda x: x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))
    return round(SCALE * softplus(score)), round(SCALE * softplus(-score))


def neighbours(blocks: list[Block]) -> Iterator[tuple[int, int, int]]:
    """Smoothness edges (block, block, capacity): adjacent ones, stronger within a parent, and the next but one under a parent."""
    for i in range(1, len(blocks)):
        yield i - 1, i, 400 if blocks[i].parent == blocks[i - 1].parent else 80
        if i > 1 and blocks[i].parent == blocks[i - 2].parent:
            yield i - 2, i, 150


def min_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For every node whether it is on the source's side of a minimum cut (the smallest such side).

    Max-flow in phases: a breadth-first search from all nodes with excess gives every node its distance, then flow is
    pushed along edges that lead one step further until no such path is left. Distances grow from phase to phase, and a capacity along a page of
    blocks is used up within a few of them, so time grows about in proportion to the page, not with paths times nodes.
    """
    n = len(terminals)
    rest = [a - b for a, b in terminals]  # min(a, b) flows straight through
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j, c in edges:
        out[i].append(len(to))
        out[j].append(len(to) + 1)
        to += [j, i]
        room += [c, c]
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if rest[i] > 0]
        for i in queue:
            level[i] = 0
        short = False
        for i in queue:  # grows while it is read
            short = short or rest[i] < 0
            for e in out[i]:
                j = to[e]
                if room[e] > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not short:
            return [v >= 0 for v in level]
        tried = [0] * n  # edges of a node before this one lead nowhere in this phase
        for source in queue:
            if rest[source] <= 0 or level[source]:
                continue
            path: list[int] = []
            i = source
            while rest[source] > 0:
                if rest[i] < 0:
                    flow = min(rest[source], -rest[i], *(room[e] for e in path))
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    rest[source] -= flow
                    rest[i] += flow
                    full = next((k for k, e in enumerate(path) if not room[e]), len(path))
                    if full < len(path):  # go on from before the first edge that is used up
                        i = to[path[full] ^ 1]
                        del path[full:]
                        continue
                    if rest[i] < 0:  # the source is empty
                        break
                while tried[i] < len(out[i]):
                    e = out[i][tried[i]]
                    if room[e] > 0 and level[to[e]] == level[i] + 1:
                        path.append(e)
                        i = to[e]
                        break
                    tried[i] += 1
                else:
                    if not path:
                        break
                    i = to[path.pop() ^ 1]
                    tried[i] += 1


def extract(page: str | None) -> str:
    """The main text of a page: content blocks joined by empty lines; empty for null or a page without content."""
    if not page:
        return ""
    blocks = blocks_of(page)
    kept = min_cut([costs(content_score(b)) for b in blocks], list(neighbours(blocks)))
    return "\n\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Add `text`, the main text of each page, and `n_chars`, its length in code points.

    A narrow transformation: rows keep their other columns, except ones named `text` or
    `n_chars`, which are replaced. Null or empty html, or a page without main text, gives
    an empty text. Whole pages are read, however long or deeply nested. Repeated rows give repeated results.
    """
    others = [c for c in df.columns if c.lower() not in ("text", "n_chars", html_col.lower())]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*others, "text", "n_chars"])

    return df.select(*others, html_col).mapInArrow(tidy(run), f"{fields}text string, n_chars long")
