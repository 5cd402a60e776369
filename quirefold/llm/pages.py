"""Main text of web pages by wrapper induction.

A few pages of each host (bounded, the distinct ones with the smallest hashes) are parsed into trees;
neighbouring siblings of one kind are folded into one node, and the folded trees are aligned by
simple tree matching. Aligned nodes whose text is the same on all of these pages are template;
aligned nodes whose text varies are slots. The content root is found by going down along the bulk of
the varying text, as long as no varying heading is left behind; named elements (article, main and the
like) only choose among the regions on that way. Blocks inside the root that not every page has and that hold
little are notices, adverts or comments, and go. So do elements that are named as such.

The wrapper is the aligned tree with these marks. Every page of the host is aligned with it in one map,
first to count on how many of the host's pages each template text stands (text that only the few
have in common is no template), then to cut the text out. A page on which the root is not found,
and pages of hosts with fewer than LEAST_FOR_TEMPLATE distinct pages, go by names alone.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, saved

#: Pages of a host that are aligned; the template needs three of them.
PAGES_PER_HOST = 5
LEAST_FOR_TEMPLATE = 3
#: Parts of a host among which its first pages are chosen before they are chosen among all.
PARTS = 64
#: Wrappers are broadcast up to this size in bytes, and joined beyond it.
MAX_BROADCAST = 32 << 20
#: A template text stands on at least this share of its host's pages.
TEMPLATE_SHARE = 0.5
#: The alignment looks at this many levels and folded nodes of a page, in page order from the top. What lies
#: beyond belongs to the node above it: its text counts there, and is kept or left out with it.
MAX_DEPTH = 60
MAX_NODES = 3000

# Elements of HTML by role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select".split())
NOT_CONTENT = frozenset("nav footer aside form button dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted recommended "
    "related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
CONTENT_NAMES = frozenset("article articlebody content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3".split())
CONTAINERS = frozenset("div section aside details".split())
CLOSES = {  # an opening tag ends an open element of these
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tr"}, "tfoot": {"tbody", "tr"},
}
KEEPS_P = INLINE | VOID - {"hr"} | RAW

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s>/]*)[^>]*>|<([a-zA-Z][^\s>/]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*)>|<([a-zA-Z][^\s>/]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("kind", "name", "out", "parts", "tag", "up")

    def __init__(self, tag: str, kind: str, up: Node | None, out: bool, name: bool):
        self.tag, self.kind, self.up, self.out, self.name, self.parts = tag, kind, up, out, name, []

    def own(self) -> str:
        return " ".join("".join(p if isinstance(p, str) else " " for p in self.parts).split())


def _element(tag: str, attributes: str, up: Node) -> Node:
    """kind: tag and class words; out: it holds no content; name: it is named as content."""
    if not attributes.strip(" /"):
        within = tag == "header" and not any(True for _ in _holders(up, ("article", "main")))
        return Node(tag, tag, up, tag in NOT_CONTENT or within, tag in ("article", "main"))
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes = " ".join(found.get("class", "").lower().split())
    words = set(SPLIT.split(f"{classes} {found.get('id', '').lower()}"))
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    in_article = any(True for _ in _holders(up, ("article", "main")))
    out = (
        tag in NOT_CONTENT or (tag == "header" and not in_article) or role in ROLES or "hidden" in found
        or found.get("aria-hidden", "") == "true" or "display:none" in style
        or (tag not in ("html", "body", "main") and (bool(words & NAMES) or ("header" in words and not in_article)) and not (tag == "article" and not words & {"comment", "comments", "related", "promo", "ad", "sponsored"}))
    )
    named = tag in ("article", "main") or role == "main" or found.get("itemprop", "").lower() == "articlebody" or bool(words & CONTENT_NAMES)
    kind = tag if not classes else f"{tag}.{re.sub(r'[0-9]+', '#', classes)}"
    return Node(tag, kind, up, out, named)


def _holders(node: Node | None, tags):
    while node is not None:
        if node.tag in tags:
            yield node
        node = node.up


def parse(page: str) -> Node:
    """The element tree of a page, however malformed; texts are decoded."""
    root = top = Node("", "", None, False, False)
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            top.parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        closing, opening = m[1], m[2] or m[4]
        if closing:
            tag = closing.lower()
            if tag == "br":
                top.parts.append("\n")
                continue
            node = top
            while node.up is not None and node.tag != tag and not (tag in INLINE and node.tag not in INLINE):
                node = node.up
            if node.up is not None and node.tag == tag:
                top = node.up
        elif opening:
            tag, attributes = opening.lower(), m[3] or m[5] or ""
            if tag in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else n
                top.parts.append(" ")
                continue
            if tag in VOID:
                if tag not in INLINE:
                    top.parts.append("\n")
                continue
            if tag not in KEEPS_P:
                node = top
                while node.up is not None and node.tag in INLINE:
                    node = node.up
                if node.tag == "p":
                    top = node.up
            ends = CLOSES.get(tag)
            if ends:
                node = top
                while node.up is not None and (node.tag in INLINE or node.tag == "p") and node.tag not in ends:
                    node = node.up
                while node.up is not None and node.tag in ends:
                    top = node = node.up
            node = _element(tag, attributes, top)
            top.parts.append(node)
            if not attributes.endswith("/") or tag not in INLINE:
                top = node
    return root


class Folded:
    """A tree of kinds: neighbouring siblings of one kind, with or without blocks inside, are one node."""

    __slots__ = ("children", "count", "deep", "drop", "kind", "name", "nodes", "out", "pages", "root", "tag", "template")

    def __init__(self, kind: str, tag: str, out: bool, name: bool):
        self.kind, self.tag, self.out, self.name = kind, tag, out, name
        self.children: list[Folded] = []
        self.nodes: list[Node] = []
        self.pages: dict[int, list[str]] = {}  # own texts by page
        self.count: dict[int, int] = {}  # nodes by page
        self.deep = 0  # characters of what lies beyond the limits
        self.root = self.drop = False
        self.template: list[str] | None = None


def _inside(node: Node) -> int:
    n, work = 0, [node]
    while work:
        for p in work.pop().parts:
            if isinstance(p, str):
                n += len(p)
            else:
                work.append(p)
    return n


def fold(root: Node, page: int) -> Folded:
    top, room = Folded(root.kind, root.tag, root.out, root.name), MAX_NODES
    top.nodes = [root]
    work = deque([(top, 0)])
    while work:
        into, depth = work.popleft()
        into.pages[page] = [t for x in into.nodes if (t := x.own())]
        into.count[page] = len(into.nodes)
        inline: dict[tuple, Folded] = {}
        for x in into.nodes:
            last, last_leaf = None, None
            for child in (p for p in x.parts if isinstance(p, Node)):
                leaf = not any(isinstance(p, Node) and p.tag not in INLINE for p in child.parts)
                flows = child.tag not in CONTAINERS and leaf
                if flows:
                    same = inline.get((child.kind, child.out))
                elif last is not None and (last.kind, last.out, last_leaf) == (child.kind, child.out, leaf):
                    same = last
                else:
                    same = None
                if same is None:
                    if not room or depth >= MAX_DEPTH:
                        into.deep += _inside(child)
                        continue
                    room -= 1
                    same = Folded(child.kind, child.tag, child.out, child.name)
                    into.children.append(same)
                    work.append((same, depth + 1))
                    if flows:
                        inline[child.kind, child.out] = same
                same.nodes.append(child)
                same.name |= child.name
                if not flows:
                    last, last_leaf = same, leaf
    return top


def match(a: Folded, b: Folded, memo: dict) -> int:
    """Simple tree matching: the size of the largest order-keeping alignment from the roots down; 0 for different kinds."""
    if a.kind != b.kind or a.out != b.out:
        return 0
    if (id(a), id(b)) not in memo:
        m, n = len(a.children), len(b.children)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(a.children[i], b.children[j], memo))
        memo[id(a), id(b)] = (best[m][n] + 1, best)
    return memo[id(a), id(b)][0]


def _aligned(a: Folded, b: Folded, memo: dict) -> tuple[list[tuple[Folded, Folded]], list[Folded]]:
    """The aligned pairs of children, and the children of both in order, b's unaligned ones among a's."""
    best = memo[id(a), id(b)][1]
    i, j, out, pairs = len(a.children), len(b.children), [], []
    while i or j:
        if i and best[i][j] == best[i - 1][j]:
            i -= 1
            out.append(a.children[i])
        elif j and best[i][j] == best[i][j - 1]:
            j -= 1
            out.append(b.children[j])
        else:
            i, j = i - 1, j - 1
            pairs.append((a.children[i], b.children[j]))
            out.append(a.children[i])
    return pairs, out[::-1]


def merge(a: Folded, b: Folded, memo: dict) -> None:
    """b's texts go into the nodes of a that it is aligned with; its other nodes are added."""
    if match(a, b, memo) == 0:
        a.children += b.children
        return
    a.pages.update(b.pages)
    a.count.update(b.count)
    a.name |= b.name
    a.deep += b.deep
    pairs, a.children = _aligned(a, b, memo)
    for x, y in pairs:
        merge(x, y, memo)


def induce(pages: list[str]) -> Folded:
    """The wrapper of one host from some of its pages: the aligned tree with root, template and what to leave out marked."""
    tree = fold(parse(pages[0]), 0)
    for i, page in enumerate(pages[1:], 1):
        merge(tree, fold(parse(page), i), {})
    several = len(pages) >= LEAST_FOR_TEMPLATE
    flat: list[Folded] = [tree]
    up, out = [-1], [tree.out]
    for at, node in enumerate(flat):  # grows while it is walked
        for c in node.children:
            flat.append(c)
            up.append(at)
            out.append(out[at] or c.out)
    total: list[float] = []
    for at, node in enumerate(flat):
        texts = list(node.pages.values())
        if several and len(texts) == len(pages) and bool(texts[0]) and all(t == texts[0] for t in texts):
            node.template = sorted(set(texts[0]))
        total.append(0 if out[at] or node.template or node.tag == "a" else node.deep + sum(len(x) for t in texts for x in t))
    for at in range(len(flat) - 1, 0, -1):
        total[up[at]] += total[at]
    number = {id(x): at for at, x in enumerate(flat)}
    most = lambda x: total[number[id(x)]]
    way = [tree]
    while most(way[-1]) > 0:
        here = way[-1]
        share = 0.5 if several else 0.8
        inner = [c for c in here.children if c.tag not in INLINE and c.tag != "p" and most(c) >= share * most(here) and max(c.count.values()) == 1]
        heads = [c for c in here.children if c.tag in HEADINGS and not c.template and any(c.pages.values())]
        if not inner or heads:
            break
        way.append(inner[0])
    # names choose on the way; on a page alone, among all regions with a fair share
    named = way if several else [x for at, x in enumerate(flat) if not out[at] and most(x) >= 0.3 * total[0] and most(x) > 0]
    root = max((x for x in named if x.name), key=lambda x: (x.tag == "article", x.tag == "main", most(x)), default=way[-1])
    root.root = True
    inside = [root]
    for x in inside:
        inside += x.children
    for x in inside[1:]:
        x.drop = several and x.tag in CONTAINERS and not x.name and len(x.count) < len(pages) and most(x) < 0.25 * most(root)
    # pages that repeat each other's content say nothing about what is template within it
    held = [{t for x in inside for t in x.pages.get(i, ())} for i in range(len(pages))]
    pairs = [(a, b) for k, a in enumerate(held) for b in held[:k]]
    size = lambda some: sum(map(len, some))
    alike = sum(size(a & b) / max(1, size(a | b)) for a, b in pairs) / max(1, len(pairs))
    for x in flat if alike >= 0.3 else []:
        x.template = None
    return tree


def packed(tree: Folded) -> list:
    """The wrapper as lists: kind, tag, marks, template, children."""
    marks = tree.out + 2 * tree.name + 4 * tree.root + 8 * tree.drop
    return [tree.kind, tree.tag, marks, tree.template, [packed(c) for c in tree.children]]


def unpacked(held: list) -> Folded:
    kind, tag, marks, template, children = held
    tree = Folded(kind, tag, bool(marks & 1), bool(marks & 2))
    tree.root, tree.drop, tree.template = bool(marks & 4), bool(marks & 8), template
    tree.children = [unpacked(c) for c in children]
    return tree


def marked(tree: Node, wrapper: Folded) -> dict[int, Folded]:
    """The wrapper's node of each of a page's nodes that is aligned with one, by id."""
    page, memo, out = fold(tree, 0), {}, {}
    work = [(wrapper, page)] if match(wrapper, page, memo) else []
    while work:
        a, b = work.pop()
        out.update((id(x), a) for x in b.nodes)
        work += [(x, y) for x, y in _aligned(a, b, memo)[0] if match(x, y, memo)]
    return out


def template_hits(page: str, wrapper: Folded) -> list[str]:
    """The template texts of the wrapper that stand on the page where they belong."""
    tree = parse(page)
    held = marked(tree, wrapper)
    found, work = set(), [tree]
    while work:
        x = work.pop()
        m = held.get(id(x))
        if m is not None and m.template and (own := x.own()) in m.template:
            found.add(own)
        work += [p for p in x.parts if isinstance(p, Node)]
    return sorted(found)


def apply(page: str, wrapper: Folded | None) -> str:
    """The text of one page by its host's wrapper, or by its own names if there is none or its root isn't found."""
    tree = parse(page)
    text = _text(tree, marked(tree, wrapper)) if wrapper is not None else None
    if text is None:
        text = _text(tree, marked(tree, induce([page])))
    return text or ""


def _text(tree: Node, held: dict[int, Folded]) -> str | None:
    out: list[str] = []
    seen = False
    work: list = [(tree, False)]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        node, kept = x
        mark = held.get(id(node))
        if node.out or (mark is not None and mark.drop):
            out.append(" ")
            continue
        kept = kept or (mark is not None and mark.root)
        seen |= kept
        mute = not kept or (mark is not None and mark.template is not None and node.own() in mark.template)
        if node.tag not in INLINE:
            out.append(" ")
            work.append(" ")
        work += [(p, kept) if isinstance(p, Node) else ("" if mute else p) for p in reversed(node.parts)]
    return " ".join("".join(out).split()) if seen else None


def host(url: Column) -> Column:
    """The host of a URL, lower-cased; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def induce_wrappers(pages: DataFrame, per_host: int = PAGES_PER_HOST) -> DataFrame:
    """pages(page_id, url, html) -> (host, wrapper json), a row per host with LEAST_FOR_TEMPLATE distinct pages."""
    rows = pages.where("html is not null").select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("h"), "page_id")
    distinct = rows.groupBy("host", "h").agg(F.min("page_id").alias("page_id"))
    # the smallest hashes of each part of a host, then of all its parts
    part = Window.partitionBy("host", F.pmod("h", F.lit(PARTS))).orderBy("h")
    first = distinct.withColumn("n", F.row_number().over(part)).where(F.col("n") <= per_host)
    every = Window.partitionBy("host").orderBy("h")
    first = first.withColumn("n", F.row_number().over(every)).where(F.col("n") <= per_host)
    first = saved(first.select(F.col("host").alias("host_"), F.col("h").alias("h_"), F.col("page_id").alias("page_id_")))
    some = pages.where("html is not null").select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("h"), "page_id", "html")
    on = (F.col("host") == F.col("host_")) & (F.col("h") == F.col("h_")) & F.col("page_id").eqNullSafe(F.col("page_id_"))
    some = some.join(hinted(first, 64, MAX_BROADCAST), on).dropDuplicates(["host", "h"]).select("host", "h", "html")

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        picked = list(group.sort_values("h")["html"])
        made = [json.dumps(packed(induce(picked)))] if len(picked) >= LEAST_FOR_TEMPLATE else []
        return pd.DataFrame({"host": [key[0]] * len(made), "wrapper": made}, dtype=object)

    return some.groupBy("host").applyInPandas(one, "host string, wrapper string")


class Wrappers:
    """Wrappers of some hosts, for use in tasks: either a broadcast dict by host or given row by row."""

    def __init__(self, held=None):
        self.held, self.loaded = held, {}

    def __getstate__(self):
        return {"held": self.held, "loaded": {}}

    def get(self, key: str | None) -> Folded | None:
        """key: a host if wrappers are broadcast, else the wrapper itself."""
        if key not in self.loaded:
            text = self.held.value.get(key) if self.held is not None else key
            if len(self.loaded) > 10_000:
                self.loaded.clear()
            self.loaded[key] = unpacked(json.loads(text)) if text else None
        return self.loaded[key]


def _with_wrappers(pages: DataFrame, wrappers: DataFrame, max_broadcast: int) -> tuple[DataFrame, Wrappers, str]:
    """pages with host_, the wrappers, and the column by which a row names its own."""
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host_"))
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]
    if size <= max_broadcast:
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        return rows, Wrappers(held), "host_"
    return rows.join(wrappers.select(F.col("host").alias("host_"), "wrapper"), "host_", "left"), Wrappers(), "wrapper"


def checked_wrappers(pages: DataFrame, wrappers: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(host, wrapper) -> the same, without template texts that fewer than TEMPLATE_SHARE of all pages of the host have."""
    rows, tool, by = _with_wrappers(pages.where("html is not null"), wrappers, max_broadcast)

    def count(batches):
        for b in batches:
            pages_of, hits = Counter(), Counter()
            for page, name, key in zip(*(b.column(c).to_pylist() for c in ("html", "host_", by)), strict=True):
                wrapper = tool.get(key)
                if wrapper is not None and page:
                    pages_of[name] += 1
                    hits.update((name, t) for t in template_hits(page, wrapper))
            found = [(h, None, n) for h, n in pages_of.items()] + [(h, t, n) for (h, t), n in hits.items()]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "t", "n"])

    counts = rows.select("html", *dict.fromkeys(("host_", by))).mapInArrow(count, "host string, t string, n long").groupBy("host", "t").agg(F.sum("n").alias("n"))
    of = F.max(F.when(F.col("t").isNull(), F.col("n"))).over(Window.partitionBy("host"))
    rare = counts.withColumn("pages", of).where(F.col("t").isNotNull() & (F.col("n") < TEMPLATE_SHARE * F.col("pages"))).groupBy("host").agg(F.collect_set("t").alias("rare"))

    @F.pandas_udf("string")
    def without(given: pd.Series, rare: pd.Series) -> pd.Series:
        out = []
        for w, gone in zip(given, rare, strict=True):
            if gone is None or not len(gone):
                out.append(w)
                continue
            tree, gone = unpacked(json.loads(w)), set(gone)
            work = [tree]
            while work:
                x = work.pop()
                if x.template:
                    x.template = [t for t in x.template if t not in gone]
                work += x.children
            out.append(json.dumps(packed(tree)))
        return pd.Series(out, dtype=object)

    return wrappers.join(rare, "host", "left").select("host", without("wrapper", "rare").alias("wrapper"))


def extract_pages(pages: DataFrame, per_host: int = PAGES_PER_HOST, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, one row per row.

    Null or empty html: empty text, 0. A null or host-less URL belongs to the host without a name.
    Repeated rows get equal texts, and count as one page when a host's pages are chosen. Broken markup is read
    as far as it goes. Very long and very deep pages are read whole. Empty table: no rows. Other columns are ignored.
    """
    wrappers = saved(checked_wrappers(pages, saved(induce_wrappers(pages, per_host)), max_broadcast))
    rows, tool, by = _with_wrappers(pages, wrappers, max_broadcast)

    @F.pandas_udf("string")
    def text(htmls: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([apply(page, tool.get(key)) if page else "" for page, key in zip(htmls, keys, strict=True)], dtype=object)

    rows = rows.withColumn("text", text("html", by))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op1_extract(spark, sf_dir):
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Every page of the table has its main text in one article element, whose references are these four.
OP1_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as x from pages),
t as (select page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) as text from a)
select page_id, url, text, length(text)::bigint as n_chars from t
"""
