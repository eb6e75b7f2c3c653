"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of block elements; inline elements belong to their block. Each node is content or not. Node
potentials are log-odds of its features (tag, words of class, id and role, how much text it and all below it have and the share of that in links, whether it
stands beside an ``article`` or ``main`` that the page has); a potential for each kind of parent couples the labels of parent and child. Both are counted on
labelled pages (see ``html_pages``), among them pages without names and with names that mean nothing; at a name that training hasn't seen the rest decides. Sum-product messages go up from the leaves and down from the root, which gives exact
marginals; the text of nodes that are more likely content than not is the result.

Scripts, styles, comments, the head, form controls and elements that their attributes hide never have text. Character references are decoded after the tags are split off;
white space (line breaks ``<br>`` too) becomes one space; blocks without text are left out. Null or empty pages give an empty text, an empty table no rows; pages of any length are read whole.
Tags are read by the attribute states of the HTML standard, so that stray quotes don't turn markup into text; of a value whose quote is never closed, the tag ends at its first ``>``.
Unclosed, misnested or deeply nested elements are no error. Repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.spread import spread
from . import html_pages

TRAINING_PAGES = 1500
#: Fixed values of the HTML standard: elements by their role in parsing.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template noscript iframe object svg math canvas audio video select textarea button datalist head title".split())
RAW = set("script style textarea title noscript iframe".split())
BLOCKS = set("html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption form fieldset legend address details summary dialog center hgroup menu search".split())
#: A start tag of the key closes an open element of the values that isn't beyond one of the scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
LABELS = "data-y"
#: What stands in the names of an element that its attributes hide.
UNSHOWN = "-hidden-"
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?=[^a-zA-Z>])[^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>\x00]*)", re.S)
#: Attributes of a tag as they are mostly written, up to its end; the rest goes through ``_attribute_end``.
_PLAIN = re.compile(r"(?:[\s/]++[^\s/>=\"'<]++(?:=(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+[\s/]*+>")
_NAME = re.compile(r"[\s/]*+(=?[^\s/>=]*+)\s*+(=?)\s*+")
_UNQUOTED = re.compile(r"[^\s>]*")
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\s(hidden)(?=[\s/>]|\Z)", re.I)
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attribute_end(source: str, at: int) -> int:
    """Where a tag ends whose attributes begin at ``at``, after the closing ``>``."""
    if m := _PLAIN.match(source, at):
        return m.end()
    n = len(source)
    while at < n:
        m = _NAME.match(source, at)
        at = m.end()
        if at >= n or source[at] == ">" and not m[2]:
            return min(n, at + 1)
        if m[2]:
            quote = source[at]
            if quote in "\"'":
                end = source.find(quote, at + 1)
                if end < 0:
                    end = source.find(">", at)
                    return n if end < 0 else end + 1
                at = end + 1
            else:
                at = _UNQUOTED.match(source, at).end()
        elif m.end() == m.start():
            at += 1
    return n


@dataclass(slots=True)
class Node:
    tag: str
    names: tuple[str, ...]
    parent: int
    label: str | None
    text: int = 0
    linked: int = 0


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: Runs of text in page order: node and text.
    blocks: list[tuple[int, str]] = field(default_factory=list)
    _sums: tuple[list[int], list[int], list[int], list[bool]] | None = None

    def sums(self) -> tuple[list[int], list[int], list[int], list[bool]]:
        """Of each node the text and the linked text in it and below, how many of its children are paragraphs, and whether it stands beside the page's articles."""
        if self._sums is None:
            nodes = self.nodes
            text, linked = [n.text for n in nodes], [n.linked for n in nodes]
            holds = [n.tag in ("article", "main") for n in nodes]  # an article, or some below
            within = list(holds)
            paragraphs = [0] * len(nodes)
            for k in range(len(nodes) - 1, 0, -1):
                p = nodes[k].parent
                text[p] += text[k]
                linked[p] += linked[k]
                paragraphs[p] += nodes[k].tag in PARAGRAPHS and nodes[k].text > nodes[k].linked
                holds[p] = holds[p] or holds[k]
            for k in range(1, len(nodes)):
                within[k] = within[k] or within[nodes[k].parent]
            self._sums = text, linked, paragraphs, [holds[0] and not (h or w) for h, w in zip(holds, within, strict=True)]
        return self._sums


@lru_cache(1 << 12)
def _names(attrs: str) -> tuple[tuple[str, ...], str | None]:
    """Words of class, id and role; the training label."""
    found: set[str] = set()
    label = None
    for m in _ATTR.finditer(attrs):
        key, value = (m[5] or m[1]).lower(), next((g for g in m.groups()[1:4] if g is not None), "")
        if key in ("class", "id", "role"):
            whole = value.lower().split()
            found.update(w for x in whole for w in (x, *re.split(r"[^a-z]+", x)) if w)
        elif key == LABELS:
            label = value
        elif key in ("hidden", "aria-hidden") and value.lower() != "false" or key == "style" and _UNSHOWN.search(value):
            found.add(UNSHOWN)
    return tuple(sorted(found)), label


def _telling(attrs: str) -> str:
    """What of a tag's attributes can matter, so that links with an address each are one key of the cache."""
    return attrs if any(k in attrs for k in _KEYS) else ""


_KEYS = ("class", "id", "role", "hidden", "style", "CLASS", "ID", "ROLE", "Class", "Id", LABELS)


def parse(source: str) -> Page:
    page = Page([Node("html", (), -1, None)])
    nodes = page.nodes
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # open elements, the block each belongs to, and whether it isn't shown
    counts: Counter[str] = Counter()
    hidden = links = 0
    run: list[str] = []
    at, n = 0, len(source)

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                page.blocks.append((stack[-1][1], text))
                nodes[stack[-1][1]].text += len(text)

    def say(text: str) -> None:
        if text and not hidden:
            run.append(text)
            if links:
                nodes[stack[-1][1]].linked += len(text)

    def close(k: int) -> None:
        nonlocal hidden, links
        flush()
        for tag, _, unshown in stack[k:]:
            counts[tag] -= 1
            hidden -= unshown
            links -= tag == "a"
        del stack[k:]

    while at < n:
        m = _TOKEN.search(source, at)
        say(source[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:-3]))
            continue
        end = _attribute_end(source, at)
        attrs, at = source[at : end - 1], end
        tag = tag.lower()
        block = tag in BLOCKS
        if m[1]:
            if tag == "br":
                say(" ")
            elif counts[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if block or tag in HIDDEN or not any(t in BLOCKS for t, *_ in stack[k + 1 :]):
                    if block or any(t in BLOCKS for t, *_ in stack[k + 1 :]):
                        close(k)
                    else:  # an inline element ends within its block
                        for t, _, unshown in stack[k:]:
                            counts[t] -= 1
                            hidden -= unshown
                            links -= t == "a"
                        del stack[k:]
            continue
        if tag == "br" or tag == "hr":
            say(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in ("html", "body") and counts[tag]:
            continue
        if block:
            flush()
            if counts["p"] and tag not in ("html", "body"):
                k = len(stack) - 1
                while k and stack[k][0] != "p" and stack[k][0] not in ("td", "th", "li", "div", "section", "article", "table", "button"):
                    k -= 1
                if stack[k][0] == "p":
                    close(k)
            elif tag == "body" and counts["head"]:
                k = next(i for i, x in enumerate(stack) if x[0] == "head")
                close(k)
            if tag in CLOSES and any(counts[t] for t in CLOSES[tag]):
                scope, k = SCOPES.get(tag, {"table"}), len(stack) - 1
                last = None
                while k and stack[k][0] not in scope:
                    if stack[k][0] in CLOSES[tag]:
                        last = k
                    k -= 1
                if last is not None:
                    close(last)
        names, label = _names(_telling(attrs)) if attrs else ((), None)
        if tag == "html":
            continue
        own = stack[-1][1]
        if block and not hidden and UNSHOWN not in names:
            nodes.append(Node(tag, names, own, label if label is not None else nodes[own].label))
            own = len(nodes) - 1
        if not attrs.endswith("/") or tag not in ("svg", "path"):
            stack.append((tag, own, unshown := tag in HIDDEN or UNSHOWN in names))
            counts[tag] += 1
            hidden += unshown
            links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            close(len(stack) - 1) if block else None
            if not block:
                counts[tag] -= 1
                hidden -= 1
                stack.pop()
    flush()
    return page


@lru_cache(1 << 14)
def _features(tag: str, names: tuple[str, ...], own: str, below: str, paragraphs: int, beside: bool, top: bool) -> tuple[str, ...]:
    return (f"{tag}/{own}", *((f"below/{below}", f"paragraphs/{paragraphs}") if below else ()), *(f"name={w}" for w in names), *((f"unnamed/{tag}",) if not names and tag in ("div", "section") else ()), *((f"beside/{tag}",) if beside else ()), *((f"top/{tag}",) if top else ()))


def _amount(text: int, linked: int) -> str:
    """How much text, and the share of it in links by quarters."""
    return f"{bisect(AMOUNTS, text)}-{4 * min(linked, text) // text if text else 0}"


def features(page: Page, k: int) -> tuple[str, ...]:
    """Of a node: its tag with the amount of its own text; the amount of all text in it and the number of its paragraphs, if some lies below; its names; its tag if it stands beside the page's articles, and if it is a child of the body."""
    n = page.nodes[k]
    text, linked, paragraphs, beside = page.sums()
    return _features(n.tag, n.names, _amount(n.text, n.linked), _amount(text[k], linked[k]) if text[k] > n.text else "", min(3, paragraphs[k]), beside[k], page.nodes[n.parent].tag in ("body", "html"))


PARAGRAPHS = frozenset("p h1 h2 h3 h4 pre blockquote".split())
#: Bounds of amounts of text, in characters.
AMOUNTS = (1, 60, 400)
#: Kinds of parents that couple with their children alike.
KINDS = {"html": "page", "body": "page", "main": "main", "article": "article", "section": "section", "div": "section", "ul": "list", "ol": "list", "table": "list", "tbody": "list", "tr": "list", "dl": "list"}


def kind(node: Node) -> str:
    """Kind of a parent."""
    return KINDS.get(node.tag, "leaf")


@dataclass
class Model:
    """Log-odds by feature, and P(child's label | parent's label) by the parent's kind, as ((00, 01), (10, 11))."""

    odds: dict[str, float]
    couple: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    prior: float


def train(pages: list[Page], smooth: float = 1.0) -> Model:
    """Counts over labelled pages; nodes without a label are not content."""
    seen = [defaultdict(float), defaultdict(float)]
    total = [0.0, 0.0]
    pairs: dict[str, list[list[float]]] = defaultdict(lambda: [[smooth, smooth], [smooth, smooth]])
    for page in pages:
        y = [int(n.label == "1") for n in page.nodes]
        y[0] = 1
        for k, (n, label) in enumerate(zip(page.nodes[1:], y[1:], strict=True), 1):
            parent = page.nodes[n.parent]
            pairs[kind(parent)][y[n.parent]][label] += 1
            total[label] += 1
            for f in features(page, k):
                seen[label][f] += 1
    odds = {}
    for f in set(seen[0]) | set(seen[1]):
        odds[f] = math.log((seen[1][f] + smooth) / (total[1] + 2 * smooth)) - math.log((seen[0][f] + smooth) / (total[0] + 2 * smooth))
    couple = {k: tuple((a / (a + b), b / (a + b)) for a, b in m) for k, m in pairs.items()}
    return Model(odds, couple, math.log((total[1] + smooth) / (total[0] + smooth)))


@cache
def trained(pages: int = TRAINING_PAGES) -> Model:
    return train([parse(html_pages.page(k)) for k in range(pages)])


def marginals(page: Page, model: Model) -> list[float]:
    """P(content) of each node by sum-product: messages up, then down."""
    nodes, n = page.nodes, len(page.nodes)
    get = model.odds.get
    local = [(0.0, 1.0)] * n
    for i in range(1, n):
        x = sum([get(f, 0.0) for f in features(page, i)])
        x = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
        local[i] = (1 - x, x)
    loose = ((0.5, 0.5), (0.5, 0.5))
    couples = [model.couple.get(kind(x), loose) for x in nodes]
    below = list(local)  # evidence of the node and all below
    up = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        c, (b0, b1) = couples[p], below[i]
        u0, u1 = c[0][0] * b0 + c[0][1] * b1, c[1][0] * b0 + c[1][1] * b1
        s = u0 + u1
        up[i] = u0 / s, u1 / s
        q0, q1 = below[p][0] * up[i][0], below[p][1] * up[i][1]
        s = q0 + q1
        below[p] = (q0 / s, q1 / s) if s > 0 else below[p]
    full = list(below)
    for i in range(1, n):
        p = nodes[i].parent
        # the parent's belief without what this node told it
        r0, r1 = full[p][0] / max(up[i][0], 1e-300), full[p][1] / max(up[i][1], 1e-300)
        c = couples[p]
        d0, d1 = r0 * c[0][0] + r1 * c[1][0], r0 * c[0][1] + r1 * c[1][1]
        q0, q1 = d0 * below[i][0], d1 * below[i][1]
        s = q0 + q1
        full[i] = (q0 / s, q1 / s) if s > 0 else below[i]
    return [f[1] for f in full]


def extract(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parse(source)
    p = marginals(page, model)
    return "\n\n".join(text for node, text in page.blocks if p[node] > 0.5)


def _extract(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        texts = [extract(h.as_py(), model) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """Per page: id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())  # some hundred features
    rows = spread(pages).select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    id_type = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lambda it: _extract(it, sent), f"page_id {id_type}, url string, text string, n_chars long").withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
