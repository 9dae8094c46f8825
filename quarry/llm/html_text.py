"""Main text of web pages by tag-path ratios.

A page becomes a sequence of blocks, each with the path of tags from the root to it.
Text length, link text and punctuation are summed per path and divided by the nodes on
it; both ratios are smoothed over neighbouring blocks (a short heading or a one-word
paragraph between long ones belongs to them), fused by their geometric mean, and weighed
down by class names of furniture. Paths over a threshold hold the content, and the
deepest element that holds most of their score is the content root. Under it the content
stays in page order, with the headings over it, the short blocks between, and the short
list items, cells and the like that stand in the same container as chosen blocks; what
else is under the threshold goes. Tags and roles of furniture are never content.

Pages are independent rows: no shuffle. A page takes time and memory in proportion to
its length, however deep its tags nest: paths are numbers, what a node inherits is set
when it is opened, and sums over subtrees are single passes over the nodes.

Defined cases: null or empty html gives an empty text; broken markup never fails (an
unclosed comment or raw element hides the rest; unclosed drawings, formulas, menus of
choices and objects end at the next block; unclosed blocks close with their parents);
rows with null ids and repeated rows are extracted each; an empty table gives no rows;
other columns pass, but a column named ``text`` in any case is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._native import finished, inner_names

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])([\w-]++)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
WORDS = re.compile(r"[a-z0-9]+")
STOPS = re.compile(r"[.,;:!?…。，、；：！？]")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = set("script style title textarea noscript iframe xmp noembed noframes".split())
#: Elements that show no text of the page; a block that begins inside ends the first of them.
SHUT = set("svg math select object".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre search section summary table tbody td template tfoot th thead tr ul".split()
)
#: What an opening tag closes if it is open in the same container.
CLOSES = {t: {"p", *SHUT} for t in BLOCK - {"body", "html", "head"}}
CLOSES |= {t: CLOSES["p"] | more for t, more in {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}}.items()}
CLOSES["option"] = {"option"}
SCOPES = set("article aside blockquote body div dl fieldset figure footer foreignobject form header html main nav ol section table template ul".split())
FURNITURE = set("nav footer aside form button menu dialog head input label search template".split()) | SHUT
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related reply replies respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ROOTS = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Parts of a text that may be short, and what only holds such parts together.
PARTS = set("blockquote dd dt figcaption li p pre td th".split())
HOLDERS = set("blockquote dl figure li ol table tbody tfoot thead tr ul".split())
#: Share of the mean score that a path must reach, weight of a path with a furniture name, and share of linked text from which a block or path is one of links.
LINE, NAMED, LINKED = 0.5, 0.1, 0.7


class Node:
    __slots__ = ("tag", "parent", "at", "depth", "path", "marked", "soft", "rooted", "link", "holder", "flow")

    def __init__(self, tag: str, parent: Node | None, at: int):
        self.tag, self.parent, self.at = tag, parent, at
        self.depth, self.path, self.marked, self.soft, self.rooted, self.link = 0, 0, False, False, False, tag == "a"
        self.holder, self.flow = self, self
        if parent:
            self.depth = parent.depth + 1
            self.rooted = parent.rooted or parent.tag in ROOTS
            self.link |= parent.link
            self.holder = self if tag in BLOCK else parent.holder
            self.flow = parent.flow if parent.tag in HOLDERS else parent


class Block:
    __slots__ = ("node", "parts", "linked", "text", "nodes")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.text, self.nodes = node, [], 0, "", 0


class Page:
    """Nodes, parents before children, and blocks with text, in page order. Text of
    furniture is left out."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.paths: dict[tuple, int] = {}
        self.block: Block | None = None
        self.blocks: list[Block] = []
        self.open: list[Node] = []
        #: Open tags in all, and since each open container began.
        self.count: Counter = Counter()
        self.scopes: list[Counter] = [Counter()]
        self.push("", "")
        self.read(source)
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
        self.blocks = [b for b in self.blocks if b.text]

    def push(self, tag: str, attributes: str) -> None:
        parent = self.open[-1] if self.open else None
        node = Node(tag, parent, len(self.nodes))
        given = {m[1].lower() if m[1] else "hidden": (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
        names = set(WORDS.findall(f"{given.get('class', '')} {given.get('id', '')}"))
        node.path = self.paths.setdefault((parent.path if parent else 0, tag, *sorted(names)), len(self.paths) + 1)
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        hard = tag in FURNITURE or (tag == "header" and not node.rooted) or given.get("role") in ROLES or hidden
        node.marked = hard or bool(parent and parent.marked)
        #: Marked by its name alone, which a wrapper of the whole page may have too.
        node.soft = not hard and tag not in (*ROOTS, *HEADINGS, "body", "html") and bool(names & NAMES or "header" in names and not node.rooted)
        self.nodes.append(node)
        self.open.append(node)
        self.count[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())

    def pop(self) -> str:
        tag = self.open.pop().tag
        if tag in SCOPES:
            self.scopes.pop()
        self.count[tag] -= 1
        self.scopes[-1][tag] -= 1
        return tag

    def start(self, tag: str, attributes: str) -> None:
        closes = CLOSES.get(tag, ())
        while any(self.scopes[-1][t] for t in closes):
            while self.pop() not in closes:
                pass
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if self.count[tag] if tag in SCOPES else self.scopes[-1][tag]:
            while self.pop() != tag:
                pass

    def add(self, piece: str) -> None:
        top = self.open[-1]
        if top.marked:
            return
        bare = len(piece.strip())
        if self.block is None or self.block.node is not top.holder:
            if not bare:
                return
            self.block = Block(top.holder)
            self.blocks.append(self.block)
        self.block.parts.append(piece)
        self.block.nodes += bare > 0
        self.block.linked += bare * top.link

    def read(self, page: str) -> None:
        at, last, never = 0, page.rfind(">") + 1, set()
        while at < len(page):
            # No tag ends behind the last '>'; an unclosed comment hides the rest.
            m = TOKEN.search(page, at, last) if at < last else None
            if not m:
                tail = page.find("<!--", max(at, last))
                self.add(html.unescape(page[at:] if tail < 0 else page[at:tail]))
                return
            if m.start() > at:
                self.add(html.unescape(page[at : m.start()]))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    return
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if name == "br":
                self.add(" ")
            elif closing:
                self.end(name)
            elif name in RAW:
                if not attributes.endswith("/"):
                    end = None if name in never else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                    if not end:
                        never.add(name)
                    at = end.end() if end else len(page)
            elif name not in VOID and not (name in SHUT and attributes.endswith("/")):
                self.start(name, attributes)
            if name in BLOCK:
                self.block = None


def path_scores(page: Page, odd: list[bool]) -> tuple[list[float], list[bool], list[bool]]:
    """Per block its fused and smoothed path score, whether it passes the threshold, and whether it is a link on a path of links."""
    length: dict[int, float] = defaultdict(float)
    links: dict[int, float] = defaultdict(float)
    stops: dict[int, float] = defaultdict(float)
    nodes: dict[int, int] = defaultdict(int)
    blocks = page.blocks
    for b in blocks:
        path = b.node.path
        length[path] += len(b.text)
        links[path] += min(b.linked, len(b.text))
        stops[path] += len(STOPS.findall(b.text)) * (1 - min(1, b.linked / len(b.text)))
        nodes[path] += max(1, b.nodes)
    of = [b.node.path for b in blocks]
    linked = [links[p] >= LINKED * length[p] and b.linked >= LINKED * len(b.text) for b, p in zip(blocks, of, strict=True)]

    def smooth(values: list[float]) -> list[float]:
        return [(values[max(0, i - 1)] + 2 * v + values[min(len(values) - 1, i + 1)]) / 4 for i, v in enumerate(values)]

    texts, marks = smooth([(length[p] - links[p]) / nodes[p] for p in of]), smooth([stops[p] / nodes[p] for p in of])
    fused = [((x + 1) * (y + 0.1)) ** 0.5 for x, y in zip(texts, marks, strict=True)]
    # What its name speaks against doesn't lower the line.
    plain = [f for f, o in zip(fused, odd, strict=True) if not o] or fused
    line = LINE * sum(plain) / len(plain)
    fused = [f * (NAMED if o else 1) for f, o in zip(fused, odd, strict=True)]
    return fused, [f >= line and not k for f, k in zip(fused, linked, strict=True)], linked


def content(page: Page) -> list[Block]:
    """The blocks of the main text."""
    blocks, nodes = page.blocks, page.nodes
    if not blocks:
        return []
    total = sum(len(b.text) for b in blocks)
    under, wraps, odd = [0] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    for b in blocks:
        under[b.node.at] += len(b.text)
    # Only what encloses a title or the main element wraps the page; what is inside doesn't.
    for n in reversed(nodes[1:]):
        under[n.parent.at] += under[n.at]
        wraps[n.parent.at] |= wraps[n.at] or (n.tag in ("h1", "main") and under[n.at] > 0)
    for n in nodes[1:]:
        odd[n.at] = odd[n.parent.at] or (n.soft and not wraps[n.at] and under[n.at] < 0.8 * total)
    off = [odd[b.node.at] for b in blocks]
    fused, passes, linked = path_scores(page, off)
    score = [0.0] * len(nodes)
    for b, f, p in zip(blocks, fused, passes, strict=True):
        score[b.node.at] += f * len(b.text) * p
    for n in reversed(nodes[1:]):
        score[n.parent.at] += score[n.at]
    # The deepest element that still holds nearly all of the content's score.
    best = max((n for n in nodes if score[n.at] >= 0.8 * score[0] and n.tag not in ("p", "h1", "h2", "li", "td")), key=lambda n: n.depth)
    inside = [False] * len(nodes)
    for n in nodes:
        inside[n.at] = n is best or bool(n.parent and inside[n.parent.at])
    within = [inside[b.node.at] for b in blocks]
    chosen = [p and i for p, i in zip(passes, within, strict=True)]
    at = [k for k, c in enumerate(chosen) if c]
    if not at:
        return []
    beside = {id(blocks[k].node.flow) for k in at}

    def belongs(k: int) -> bool:
        if not within[k] or off[k] or linked[k]:
            return False
        node = blocks[k].node
        return at[0] < k < at[-1] or (node.tag in PARTS and id(node.flow) in beside)

    kept = [c or belongs(k) for k, c in enumerate(chosen)]
    for k in range(len(blocks) - 2, -1, -1):
        kept[k] = kept[k] or (blocks[k].node.tag in HEADINGS and within[k] and not off[k] and kept[k + 1])
    return [b for b, k in zip(blocks, kept, strict=True) if k]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in content(Page(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``."""
    names = inner_names(pages.columns, "html")
    inner = pages.toDF(*names)
    schema = T.StructType([*inner.schema.fields, T.StructField("text", T.StringType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index("html"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return finished(inner.mapInArrow(extracted, schema), pages.columns, names, {"text": F.col("text")})


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
