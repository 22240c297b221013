"""Main text of web pages by wrapper induction over the pages of a host.

A page becomes a tree in which neighbouring siblings of one label (tag and
first class) are folded into one node, so its size follows the page's make-up
and not its length.  Each distinct tree of a host is aligned with the host's
reference tree (that of its smallest page_id) by simple tree matching.  Two
things make an aligned node template: a text that most of the host's different
pages have there, and, on a host of ``FEW_PAGES`` or more, texts of which most
are also there on other pages (a menu's entries, an advert's slot, a footer),
outside articles and but for the node that holds most of the host's text.
What varies is a content slot.

Only then, for what a template cannot show (hosts of one page, reader comments,
parts that differ on each page), parts known by tag, class or role are left
out, and where a page marks its article only that is kept.  A class that may
also name an article's own subject does not count on a part that holds most of
the page's text.

Pages that are copies of each other count once, so a group of copies does not
turn its own article into template; and a host of one page has no template.
On a host of few pages, those of one longest text are versions of one page and
count once too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, steady_memory

#: A text is template if this share of a host's different pages have it at one node, and these many at least.
TEMPLATE_SHARE = 0.8
TEMPLATE_PAGES = 2
#: A host of fewer different pages has few.
FEW_PAGES = 10
#: A node is template if this share of its texts are at that node on other pages too.
SLOT_SHARE = 0.5
#: Parts of a host's pages that are joined with its size apart.
SHARES = 32
#: Bounds of a page's tree: what lies deeper, or beside so many siblings, belongs to a node that is there; no text is lost.
MAX_CHILDREN = 64
MAX_DEPTH = 150

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body caption head html legend option tbody td tfoot th thead tr".split())
#: An opening tag ends an open one of its set, unless one of the others stands between.
SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CHROME_TAGS = set(
    "nav footer aside form script style noscript template button select input head svg canvas object menu dialog"
    " iframe audio video map".split()
) | RAW
CHROME_WORDS = set(
    "nav navbar navigation menu menubar sidebar footer ad ads adv advert adverts advertisement advertising sponsor"
    " sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination"
    " pager comment comments respond replies disqus widget toolbar masthead copyright legal disclaimer skip"
    " complementary contentinfo search dialog".split()
)
HEADER_WORDS = {"header", "masthead", "banner"}
#: Of those, what a part of the article may be called as well.
SUBJECT_WORDS = HEADER_WORDS | set(
    "promo promotion notice notices alert popup modal overlay signup login share sharing social related recommended"
    " widget toolbar copyright legal disclaimer skip search dialog complementary sponsor sponsored subscription".split()
)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
READ = {"class", "id", "role", "hidden", "aria-hidden"}
PARTS = re.compile(r"[a-z]+")

#: Entries up to which the templates go to all tasks; above, pages are dealt by host.
BROADCAST_ENTRIES = 200_000

BLOCK_KIND = "array<struct<node:int,article:boolean,listed:boolean,text:string>>"
BLOCKS = f"page_id bigint, url string, host string, shape string, blocks {BLOCK_KIND}"


class _Node:
    __slots__ = ("ident", "label", "children")

    def __init__(self, ident: int, label: str):
        self.ident, self.label, self.children = ident, label, []


def _describe(tag: str, attrs: str, in_article: bool) -> tuple[str, int]:
    """Label of an element, and whether it is known as no content: 0 no, 1 by a word that may be a subject, 2 whatever it holds."""
    chrome = 2 if tag in CHROME_TAGS or (tag == "header" and not in_article) else 0
    first = ""
    if attrs:
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name not in READ:
                continue
            if name == "class":
                first = (value.split() or [""])[0]
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                chrome = 2
            elif tag not in ("html", "body", "article", "main"):
                words = set(PARTS.findall(value))
                if in_article:
                    words -= HEADER_WORDS - CHROME_WORDS
                words &= CHROME_WORDS | HEADER_WORDS
                if words:
                    chrome = max(chrome, 1 if words <= SUBJECT_WORDS else 2)
    return f"{tag}.{first}" if first else tag, chrome


class _Scanner:
    """Tags of a page in order, in time linear in its length."""

    def __init__(self, source: str):
        self.source, self.end = source, len(source)
        self.gone: set[str] = set()  # signs that do not occur again

    def find(self, sign: str, at: int) -> int:
        """Place of the next ``sign``, or -1; a sign that is not found is not looked for again."""
        if sign in self.gone:
            return -1
        i = self.source.find(sign, at)
        if i < 0:
            self.gone.add(sign)
        return i

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at ``at``; quoted ones do not, unless a quote stays open."""
        i = at
        while True:
            m = TAG_STOP.search(self.source, i)
            if m is None:
                return -1
            if m[0] == ">":
                return m.start()
            i = self.find(m[0], m.end()) + 1
            if not i:
                return self.find(">", at)

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next tag, comment or declaration (name None); None at the end.

        A tag that the page's end cuts off goes up to there.
        """
        source = self.source
        while True:
            start = self.find("<", at)
            if start < 0 or start + 1 >= self.end:
                return None
            sign = source[start + 1]
            if sign in "!?":
                stop = self.find("-->", start + 4) + 3 if source.startswith("<!--", start) else self.find(">", start) + 1
                return start, (self.end if stop < 3 else stop), False, None, ""
            closing = sign == "/"
            m = TAG_NAME.match(source, start + 1 + closing)
            if m is None:
                at = start + 1
                continue
            stop = self.tag_end(m.end())
            if stop < 0:
                return start, self.end, False, None, ""
            return start, stop + 1, closing, m[0].lower(), source[m.end() : stop]


def parse(source: str) -> tuple[str, list[tuple[int, bool, bool, str]]]:
    """The folded tree, as ``label(child,child)`` text, and the page's blocks (node, in an article, listed, text).

    A block is listed if it lies in a part known as no content by tag, class or role.
    """
    root = _Node(0, "")
    n_nodes, n_parts = 1, 0
    # tag, node, parts known as no content (outermost first; 0: whatever they hold), in an article
    stack: list[tuple[str, _Node, tuple[int, ...], bool]] = [("", root, (), False)]
    open_at: dict[str, list[int]] = {}  # places of a tag's open elements
    block_at: list[int] = []
    found: list[tuple[int, bool, tuple[int, ...], str]] = []
    buf: dict[tuple[int, ...], list] = {}

    def flush() -> None:
        for parts, (node, article, said) in buf.items():
            text = " ".join("".join(said).split())
            if text:
                found.append((node, article, parts, text))
        buf.clear()

    def say(text: str) -> None:
        _, node, parts, article = stack[-1]
        if text:
            if parts not in buf:
                buf[parts] = (node.ident, article, [])
            buf[parts][2].append(html.unescape(text) if "&" in text else text)

    def top(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(i: int) -> None:
        """Ends the elements from the i-th on."""
        if block_at and block_at[-1] >= i:
            flush()
        for k in range(len(stack) - 1, i - 1, -1):
            open_at[stack[k][0]].pop()
        while block_at and block_at[-1] >= i:
            block_at.pop()
        del stack[i:]

    scan, at, end, lower = _Scanner(source), 0, len(source), None
    while at < end:
        hit = scan.next(at)
        if hit is None:
            say(source[at:])
            break
        start, stop, closing, tag, attrs = hit
        if start > at:
            say(source[at:start])
        at = stop
        if tag is None:
            continue
        if closing:
            if tag == "br":
                flush()
            elif open_at.get(tag):
                close(open_at[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        if tag in CLOSES_P and block_at and stack[block_at[-1]][0] == "p":
            close(block_at[-1])
        if tag in SIBLING:
            ends, stops = SIBLING[tag]
            if top(ends) > top(stops):
                close(top(ends))
        if tag in BLOCK or tag == "br":
            flush()
        if tag in VOID:
            continue
        _, parent, parts, article = stack[-1]
        label, known = _describe(tag, attrs, article)
        if tag in RAW:
            lower = source.lower() if lower is None else lower
            if len(lower) != end:  # a letter that changes its length in lower case
                m = re.compile(f"</{tag}", re.I).search(source, at)
                stop = m.start() if m else -1
            else:
                stop = lower.find(f"</{tag}", at)
            at = end if stop < 0 else (source.find(">", stop) + 1 or end)
            continue
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        kids = parent.children
        node = None
        if len(stack) > MAX_DEPTH:
            node = parent
        elif kids and kids[-1].label == label:
            node = kids[-1]
        elif len(kids) >= MAX_CHILDREN:
            node = next((k for k in kids if k.label == label), None)
        if node is None:
            node = _Node(n_nodes, label)
            n_nodes += 1
            kids.append(node)
        if known and 0 not in parts:  # a part of a part that is no content whatever it holds needs no mark
            n_parts += 1
            parts = (*parts[-MAX_DEPTH:], n_parts) if known == 1 else (0,)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_at.append(len(stack))
        stack.append((tag, node, parts, article or tag in ("article", "main")))
    flush()
    # a part known by a word that may be a subject, with most of the text, is content
    held, total = {}, 0
    for _, _, parts, text in found:
        if 0 not in parts:
            total += len(text)
            for p in parts:
                held[p] = held.get(p, 0) + len(text)
    subject = {p for p, n in held.items() if 2 * n > total}
    return render(root), [(node, article, any(p not in subject for p in parts), text) for node, article, parts, text in found]


def render(node: _Node) -> str:
    """Nodes in the order they were made, each as ``number:label(children)``."""
    inner = ",".join(render(k) for k in node.children)
    label = re.sub(r"[(),:]", "_", node.label)
    return f"{node.ident}:{label}({inner})" if inner else f"{node.ident}:{label}"


def read_tree(shape: str) -> _Node:
    root, stack, at = _Node(-1, ""), [], 0
    stack.append(root)
    for m in re.finditer(r"(\d+):([^(),]*)|([(),])", shape):
        if m[3] == "(":
            stack.append(stack[-1].children[-1])
        elif m[3] == ")":
            stack.pop()
        elif m[1]:
            stack[-1].children.append(_Node(int(m[1]), m[2]))
    return root.children[0]


def match_trees(a: _Node, b: _Node, memo: dict) -> int:
    """Simple tree matching: the most nodes that an order-keeping, level-keeping alignment pairs."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        prev = [0] * (len(b.children) + 1)
        table = [prev]
        for x in a.children:
            row = [0]
            for j, y in enumerate(b.children):
                row.append(max(row[j], prev[j + 1], prev[j] + match_trees(x, y, memo)))
            table.append(row)
            prev = row
        memo[key] = (1 + prev[-1], table)
    return memo[key][0]


def align(a: _Node, b: _Node) -> dict[int, int]:
    """Node of ``a`` -> node of ``b`` for the pairs of the best alignment."""
    memo: dict = {}
    out: dict[int, int] = {}
    if not match_trees(a, b, memo):
        return out
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        out[x.ident] = y.ident
        table = memo[(id(x), id(y))][1]
        i, j = len(x.children), len(y.children)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x.children[i], y.children[j]))
    return out


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host, tree and text blocks of every page; parsed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        kind = pa.list_(pa.struct({"node": pa.int32(), "article": pa.bool_(), "listed": pa.bool_(), "text": pa.string()}))
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                shapes, found = [], []
                for source in part.column(3):
                    shape, blocks = parse(source.as_py() or "")
                    shapes.append(shape)
                    found.append([{"node": n, "article": a, "listed": x, "text": t} for n, a, x, t in blocks])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(shapes, pa.string()), pa.array(found, kind)],
                    names=["page_id", "url", "host", "shape", "blocks"],
                )

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, BLOCKS)


def induce(
    parsed: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES, slot_share: float = SLOT_SHARE
) -> tuple[DataFrame, DataFrame]:
    """The alignment (host, shape, slots: node -> reference node) and the template (host, texts, whole nodes) of each host."""
    shapes = parsed.groupBy("host", "shape").agg(F.min("page_id").alias("first_id"))
    by_host = shapes.groupBy("host").agg(
        F.min(F.struct(F.coalesce("first_id", F.lit(1 << 62)).alias("i"), F.col("shape").alias("s")))["s"].alias("ref")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = []
            for shape, ref in zip(batch["shape"], batch["ref"]):
                pairs = align(read_tree(shape), read_tree(ref))
                size = shape.count(":")
                slots.append([pairs.get(i, -1) for i in range(size)])
            yield pd.DataFrame({"host": batch["host"], "shape": batch["shape"], "slots": slots})

    aligned = shapes.join(by_host, "host").select("host", "shape", "ref")
    aligned = aligned.mapInPandas(run, "host string, shape string, slots array<int>")
    # one page of each group of copies
    own = F.filter("blocks", lambda b: ~b["listed"])
    hashed = F.transform(own, lambda b: F.struct(F.length(b["text"]).alias("n"), F.xxhash64(b["text"]).alias("h")))
    marks = F.transform(
        "blocks",
        lambda b: F.struct(
            b["node"].alias("node"), F.xxhash64(b["text"]).alias("h"), F.length(b["text"]).alias("n"), b["article"].alias("article")
        ),
    )
    seen = parsed.select(
        "host", "shape", F.xxhash64(F.transform(own, lambda b: b["text"])).alias("body"), F.array_max(hashed)["h"].alias("main"),
        F.array_distinct(marks).alias("marks"),
    )
    different = seen.groupBy("host", "body").agg(F.min(F.struct("shape", "marks", "main")).alias("p"))
    sizes = seen.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    kind = F.when(F.col("size") < FEW_PAGES, F.col("p.main")).otherwise(F.col("body"))
    # a large host is dealt into shares, each with the host's size
    sizes = sizes.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    different = different.withColumn("share", F.pmod("body", F.lit(SHARES).cast("long"))).join(sizes, ["host", "share"])
    different = different.groupBy("host", kind.alias("kind")).agg(F.min(F.struct("p.shape", "p.marks")).alias("p"))
    different = different.select("host", "p.shape", "p.marks")
    totals = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least)
    placed = different.select("host", "shape", F.explode("marks").alias("m")).join(aligned, ["host", "shape"])
    placed = placed.select(
        "host", F.get("slots", F.col("m.node")).alias("slot"), F.col("m.h").alias("h"), F.col("m.n").alias("n"),
        F.col("m.article").alias("article"),
    ).filter("slot >= 0")
    counts = placed.groupBy("host", "slot", "h").agg(
        F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.max("article").alias("article")
    )
    # how much of a node's texts is also there on other pages
    often = F.when(F.col("times") >= 2, F.col("times")).otherwise(F.lit(0))
    nodes = counts.groupBy("host", "slot").agg(
        F.sum("times").alias("all"), F.sum(often).alias("often"), F.sum(F.col("times") * F.col("n")).alias("chars"),
        F.max("article").alias("article"),
    )
    most = nodes.groupBy("host").agg(F.max_by("slot", F.struct(F.col("chars"), -F.col("slot"))).alias("most"))
    whole = nodes.filter(~F.col("article") & (F.col("often") >= F.col("all") * slot_share)).join(
        totals.filter(F.col("pages") >= FEW_PAGES).select("host"), "host"
    )
    whole = whole.join(most, "host").filter("slot <> most").select("host", "slot", F.lit(None).cast("long").alias("h"))
    fixed = counts.filter(F.col("times") >= least).join(totals, "host").filter(F.col("times") >= F.col("pages") * share)
    fixed = fixed.join(whole.select("host", "slot"), ["host", "slot"], "left_anti").select("host", "slot", "h").unionByName(whole)
    template = fixed.groupBy("host").agg(
        F.collect_set(F.when(F.col("h").isNotNull(), F.struct("slot", "h"))).alias("fixed"),
        F.collect_set(F.when(F.col("h").isNull(), F.col("slot"))).alias("whole"),
    )
    return aligned, template


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, and n_template, n_listed: characters that template and lists left out.

    Null or empty html gives an empty text; a page without a url belongs to
    the host of all such pages; rows that repeat are extracted each; extra
    columns are ignored.
    """
    parsed = materialize(page_blocks(pages), "html-blocks")
    aligned, template = induce(parsed)
    template = materialize(template, "html-template")
    # only hosts that have a template need their pages' alignment
    aligned = aligned.join(template, "host").select("host", "shape", "slots", "fixed", "whole")
    size = template.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("fixed") + F.size("whole")).alias("m")).first()
    if size.n * 200 + (size.m or 0) <= BROADCAST_ENTRIES:
        aligned = F.broadcast(aligned)  # checked: few hosts with a template, few texts each
    out = parsed.join(aligned, ["host", "shape"], "left")

    def constant(b):
        slot = F.get("slots", b["node"])
        return F.coalesce(
            F.array_contains("whole", slot) | F.array_contains("fixed", F.struct(slot.alias("slot"), F.xxhash64(b["text"]).alias("h"))),
            F.lit(False),
        )

    def length(blocks):
        return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))

    varying = F.when(F.col("fixed").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~constant(b)))
    out = out.withColumn("varying", varying).withColumn("own", F.filter("varying", lambda b: ~b["listed"]))
    marked = F.exists("blocks", lambda b: b["article"] & ~b["listed"])
    chosen = F.when(marked, F.filter("own", lambda b: b["article"])).otherwise(F.col("own"))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), " ")
    return out.select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"),
        (length("blocks") - length("varying")).alias("n_template"), (length("varying") - length("own")).alias("n_listed"),
    )
