"""Main text of web pages by tag-path ratios.

A page is read once by a tag scanner into blocks of text, each under its root-to-leaf path of tags.
Text length and punctuation (without link texts) are summed bottom-up over each path and all its
ends, and divided by the path's number of blocks; both ratios are smoothed towards the path's container,
fused with the path's share of the page's text, its share of links and what its marks say (MARKED, OUTSIDE), and the
blocks of paths that reach THRESHOLD of the largest fused ratio are the main text.

A paragraph, item or cell is judged by the path of the element that holds it and its like, a heading by
that of the element that also holds what it heads, any other block by its own.  Within an article or main a path has
KIN of its ratio at least.  Elements that HTML itself marks as something else (nav, aside, footer, form, header
outside an article, hidden ones, and their roles) aren't read at all; a class or id that names such a part
only lowers its path's ratio.

Time is linear in the page: a tag's end, an element's scope and its container are found without
walking the open elements.

Defined results: a null or empty html, or one without text, gives ''; an empty table gives no rows.  Pages of any
length and depth are read whole.  Unclosed, stray and wrongly nested tags follow the open elements; a
tag that never ends is text up to its '>' or the end; an embedded element (video, svg, ...) that is never closed holds
nothing, an unclosed script or style holds the rest.  Rows are taken one by one, so repeated rows give
repeated results.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Share of the largest fused ratio from which a path is content.
THRESHOLD = 0.15
#: A path's ratio is multiplied by these if it is named as something else, or lies outside a page's articles.
MARKED, OUTSIDE = 0.05, 0.05
#: Share of an article's ratio that each path within it has at least.
KIN = 0.2
_STOP = re.compile(r">|=\s*[\"']")
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PUNCTUATION = frozenset(".,;:!?…。、，；：！？¿¡")
# Elements by their part in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
_EMBEDDED = frozenset("template noscript iframe svg math object audio video canvas select".split())
_BLOCK = frozenset(
    "address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HOLD = frozenset("article aside body div footer form header html main nav section table td th".split())
_TEXT = frozenset("address blockquote caption dd details dl dt figcaption figure hgroup li menu ol p pre summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl menu table".split())
_OUT = frozenset("nav footer aside form menu dialog button label fieldset input option datalist head search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
# Names that pages give to parts that aren't their article, as the last part of a name or beside others of these lists.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices"
    " announcement announcements notification notifications alert alerts disclaimer adbox adslot adsense cookiebar cookiebanner"
    " sidebar sidenav topbar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead"
    " comment comments commentlist respond replies disqus reactions feedback"
    " recommended popup modal newsletter subscribe subscription login signup pagination pager".split()
)
_BESIDE = frozenset(
    "share sharing social related overlay search widget toolbar skip discussion"
    " area bar block body box card col column container content global group head inner item items left link links list main outer page panel"
    " primary right row secondary section site slot text title top bottom unit wrap wrapper".split()
)
_ALONE = frozenset("share sharing social related overlay search widget toolbar skip discussion".split())
_HEADS = frozenset("header site-header page-header top-header global-header".split())


class Node:
    """An element; what later steps ask of its open ancestors is known from its parent's answers."""

    __slots__ = ("tag", "parent", "out", "named", "inside", "link", "block", "hold", "group", "p", "item", "cell", "odd", "full", "path", "sums")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, named: bool = False, mark: str = ""):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        #: The article or main around it, whether it lies in a link, and its block element.
        self.inside = self if tag in ("article", "main") else parent.inside if parent else None
        self.link = tag == "a" or bool(parent and parent.link)
        self.block = self if tag in _BLOCK or not parent else parent.block
        #: The element that holds a text element and its like, and the list or table, or else that element, whose links count.
        self.hold = self if tag in _BLOCK - _TEXT - _HEADINGS or not parent else parent.hold
        self.group = self if tag in _LISTS or self.hold is self else parent.group
        #: The open paragraph, item or row, and cell that an element's start closes.
        above = None if not parent or tag in _HOLD else parent
        self.p = self if tag == "p" else above and above.p
        self.item = self if tag in ("li", "dt", "dd", "tr") else None if tag in ("ul", "ol", "dl", "menu") else above and above.item
        self.cell = self if tag in ("td", "th") else None if tag in ("tr", "table") or not parent else parent.cell
        #: The outermost element around it that isn't content or is named so.
        self.odd = parent.odd if parent and parent.odd and (out or named) else self if out or named else None
        #: Stands for the tags, with their classes, from the root to here.
        self.path = hash((parent.path if parent else 0, tag, mark))
        #: Length and punctuation outside links, blocks, length, blocks that aren't headings, of all below.
        self.sums = [0, 0, 0, 0, 0]
        self.full = self


def telling(name: str) -> bool:
    """Whether a class or id names a part that isn't the article."""
    parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
    if not parts:
        return False
    return parts[-1] in _NAMES or all(x in _NAMES or x in _BESIDE for x in parts) and any(x in _NAMES or x in _ALONE for x in parts)


def opening(tag: str, attributes: str, parent: Node) -> Node:
    """The element that a start tag opens in parent."""
    root = tag in ("html", "body")
    out, named, mark = not root and (parent.out or tag in _OUT), not root and parent.named, ""
    if tag == "header":
        out = out or not parent.inside
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name == "class":
            mark = value
        if root:
            continue
        if name in ("class", "id"):
            named = named or any(telling(x) or x in _HEADS and not parent.inside for x in value.split())
        elif name == "role":
            out = out or value in _ROLES
        elif name == "hidden":
            out = True
        elif name == "aria-hidden":
            out = out or value == "true"
        elif name == "style":
            out = out or "display:none" in value.replace(" ", "")
    return Node(tag, parent, out, named, mark)


class Scanner:
    """One pass over a page's tags; nodes come in document order, blocks as (block element, text, its text outside links)."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.broken = False
        self.ends: dict[str, tuple[re.Pattern, int]] = {}
        self.node = Node("", None)
        self.nodes = [self.node]
        #: How many are open of a block element, or of an inline one in a block.
        self.open: dict[tuple[str, int], int] = {}
        self.found: list[tuple[Node, str, str]] = []
        self.text: list[str] = []
        self.links: list[bool] = []
        self.of = self.node

    def flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            if text:
                plain = text
                if any(self.links):
                    plain = " ".join(entities.unescape("".join(t for t, a in zip(self.text, self.links) if not a)).split())
                self.found.append((self.of, text, plain))
            self.text.clear()
            self.links.clear()

    def put(self, text: str) -> None:
        if not self.node.out:
            self.text.append(text)
            self.links.append(self.node.link)
            self.of = self.node.block

    def end(self, at: int) -> int:
        """Where the tag whose name ends here ends; -1 if it never does."""
        k = at
        while not self.broken:
            m = _STOP.search(self.page, k)
            if m and m[0] == ">":
                return m.start()
            close = self.page.find(m[0][-1], m.end()) if m else -1
            if close < 0:
                self.broken = True  # quotes say nothing from here on
            k = close + 1
        return self.page.find(">", at)

    def closing(self, tag: str, at: int) -> re.Match | None:
        """The next end tag of that name."""
        if tag not in self.ends:
            one = re.compile(rf"</{re.escape(tag)}\s*>", re.I)
            self.ends[tag] = one, max((m.start() for m in one.finditer(self.page)), default=-1)
        one, last = self.ends[tag]
        return one.search(self.page, at) if at <= last else None

    def closes(self, tag: str, at: int) -> bool:
        """Whether an end tag of that name follows."""
        self.closing(tag, len(self.page))
        return at <= self.ends[tag][1]

    def key(self, tag: str, node: Node) -> tuple[str, int]:
        return tag, 0 if tag in _BLOCK else id(node.block)

    def enter(self, node: Node) -> None:
        self.node = node
        self.nodes.append(node)
        key = self.key(node.tag, node)
        self.open[key] = self.open.get(key, 0) + 1

    def leave(self, to: Node) -> None:
        while self.node is not to:
            self.open[self.key(self.node.tag, self.node)] -= 1
            self.node = self.node.parent

    def run(self) -> None:
        page, at = self.page, 0
        while at < len(page):
            m = _TAG.search(page, at) if at <= self.last else None
            if m and m[2] and (stop := self.end(m.end())) < 0:
                m = None
            piece = page[at : m.start() if m else len(page)]
            if piece:
                self.put(piece)
            if not m:
                break
            if m[2]:
                at = stop + 1
                if m[1]:
                    self.close(m[2].lower())
                else:
                    at = self.start(m[2].lower(), page[m.end() : stop], at)
            else:
                mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                stop = page.find(mark, m.end())
                if m[0] == "<![CDATA[":
                    self.put(page[m.end() : stop if stop >= 0 else len(page)].replace("&", "&amp;"))
                at = stop + len(mark) if stop >= 0 else len(page)
        self.flush()

    def close(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.node.p:
            self.put(" ")
            return
        if not self.open.get(self.key(tag, self.node)):
            return  # none is open, or, of an inline element, only around the block
        end = self.node
        while end.tag != tag:
            end = end.parent
        if tag in _BLOCK:
            self.flush()
        self.leave(end.parent)

    def start(self, tag: str, attributes: str, at: int) -> int:
        """Opens an element; where to go on."""
        if tag in _VOID:
            if tag == "br":
                self.put(" ")
            elif tag == "hr":
                self.flush()
            return at
        if tag in _RAW:
            stop = self.closing(tag, at)
            return stop.end() if stop else len(self.page)
        if tag in _EMBEDDED:
            stop = None if attributes.endswith("/") else self.closing(tag, at)
            return stop.end() if stop else at
        if tag in _BLOCK:
            self.flush()
            self.leave(self.implied(tag, at))
            self.enter(opening(tag, attributes, self.node))
        else:
            node = opening(tag, attributes, self.node)
            if node.out and not self.node.out:
                self.put(" ")
            self.enter(node)
        return at

    def implied(self, tag: str, at: int) -> Node:
        """Where a block element opens: it closes an open paragraph, and items, cells and rows close their like."""
        node = self.node.p.parent if self.node.p else self.node
        if tag in ("li", "dt", "dd", "tr") and (n := node.item) and (n.tag == tag or {n.tag, tag} == {"dt", "dd"}):
            return n.parent
        if tag in ("td", "th") and node.cell:
            return node.cell.parent
        if tag in ("article", "main") and node.odd and (node.odd.tag == "form" or not self.closes(node.odd.tag, at)):
            return node.odd.parent  # an element that is never closed, or a form around the whole page, doesn't hold it
        return node


def ratios(nodes: list[Node], found: list[tuple[Node, str, str]]) -> list[float]:
    """Per block the fused ratio of its path."""
    for node, text, plain in found:
        sums = node.sums
        sums[0] += len(plain)
        sums[1] += sum(map(plain.count, _PUNCTUATION))
        sums[2] += 1
        sums[3] += len(text)
        sums[4] += node.tag not in _HEADINGS
    paths: dict[int, list[int]] = {}
    for node in reversed(nodes):
        if node.sums[2]:
            if node.parent:
                node.parent.sums = [a + b for a, b in zip(node.parent.sums, node.sums)]
            known = paths.get(node.path)
            paths[node.path] = [a + b for a, b in zip(known, node.sums)] if known else node.sums
    whole = nodes[0].sums
    for node in nodes[1:]:
        node.full = node if node.hold is node and node.sums[4] else node.parent.full
    # a block is judged by the path of its element, or of what holds that and its like
    holders = [node.hold.full if node.tag in _HEADINGS else node.hold for node, _, _ in found]
    smooth = {h.path: smoothed(h, paths) for h in holders}
    articles = {node.inside.path: node.inside for node, _, _ in found if node.inside and not node.named}
    smooth |= {p: smoothed(a, paths) for p, a in articles.items()}
    most = [max(x[k] for x in smooth.values()) + 0.1 for k in range(2)]
    fused = {p: math.sqrt((a + 0.1) / most[0] * (b + 0.1) / most[1] * (paths[p][3] / whole[3])) for p, (a, b) in smooth.items()}
    out = []
    for (node, _, _), h in zip(found, holders):
        ratio = fused[h.path]
        inside = node.inside
        if inside and inside.path in articles:
            ratio = max(ratio, KIN * fused[inside.path])
        # a heading's links are its own
        group = paths[(node if node.tag in _HEADINGS else node.group).path]
        ratio *= 1 - 0.95 * (1 - group[0] / group[3])
        if node.named:
            ratio *= MARKED
        if articles and not inside:
            ratio *= OUTSIDE
        out.append(ratio)
    return out


def smoothed(node: Node, paths: dict[int, list[int]]) -> tuple[float, float]:
    """Length and punctuation per block of a path, with half the weight of those of the container around it."""
    own = paths[node.path]
    found = own[0] / own[2], own[1] / own[2]
    around = node.parent.hold if node.parent else None
    if around is None or around.tag in ("", "html", "body"):
        return found
    more = paths[around.path]
    return (found[0] * 2 + more[0] / more[2]) / 3, (found[1] * 2 + more[1] / more[2]) / 3


def extract(page: str | None) -> str:
    """The page's main text: the blocks of its content paths, one to a line."""
    scanner = Scanner(page or "")
    scanner.run()
    if not scanner.found:
        return ""
    fused = ratios(scanner.nodes, scanner.found)
    least = THRESHOLD * max(fused)
    return "\n".join(text for (_, text, _), f in zip(scanner.found, fused) if f >= least)


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(make, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
