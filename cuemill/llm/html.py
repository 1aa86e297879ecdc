"""HTML extraction by wrapper induction.

A host's pages fall into layouts: the path of the container that holds most of a page's text.  Up to
``REFERENCES`` pages of each layout are aligned by simple tree matching; nodes with equal text are constant, all
others are varying slots, and the wrapper's root is the deepest container that holds the slots.  What is
template is decided over all pages: a block (path and text) that a share of the layout's distinct pages
has, outside article and main elements, goes.  Menus, notices, adverts and the like vary as well, so
elements of such roles never count.

Every page is parsed once, into its blocks; these are staged, counted by map-side sums, and filtered in
the JVM by the wrapper of their layout.  No host is a group anywhere, and a layout with a large share of
all pages meets its wrapper by a broadcast of proven size.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._core import join_split, staged
from ._text import let

REFERENCES = 4
SPREAD = 64
#: Share of a layout's distinct pages that makes a block template; two pages at least.
TEMPLATE_SHARE = 0.3
BROADCAST_ROWS = 50_000
# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body main article section div td center".split())
LANDMARKS = frozenset(("article", "main"))
DROPPED = frozenset("head script style noscript template svg math iframe object nav footer aside form button select option textarea dialog menu".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu menubar".split())
_ROLE = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notice|alert|popup|modal|comments?|disqus|respond|replies|share|sharing|social|related|newsletter|subscribe|footer|copyright|masthead|site-header|header|widget|skip-link|pagination|pager"
# A whole class token: a role word, or one with a listed word before or after it ("no-sidebar" is neither).
ROLE_WORDS = re.compile(rf"(?:^|\s)(?:(?:site|main|global|primary|secondary|top|bottom|cookie|ad|social|google)[_-])?(?:{_ROLE})(?:[_-](?:area|banner|bar|block|bottom|box|buttons?|container|default|form|icons|inner|items?|links?|list|main|menu|notice|popup|posts?|primary|secondary|section|signup|slot|top|unit|widgets?|wrap|wrapper))?(?=$|\s)", re.I)
CLOSES_P = BLOCKS - {"body", "html"}
DIGITS = re.compile("[0-9]+")


class Node:
    __slots__ = ("tag", "label", "dropped", "kids", "by_class")

    def __init__(self, tag: str, label: str, dropped: bool, by_class: bool = False):
        self.tag, self.label, self.dropped, self.kids, self.by_class = tag, label, dropped or by_class, [], by_class


def _dropped(tag: str, attrs: dict[str, str]) -> bool:
    return tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES


def _dropped_by_class(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Headers and elements named for a role; one that turns out to hold an article or main element stays."""
    if tag in LANDMARKS or tag in ("html", "body"):
        return False
    if tag == "header":
        return not in_article
    return bool(ROLE_WORDS.search(attrs.get("class", "")) or ROLE_WORDS.search(attrs.get("id", "")))


class _Builder(HTMLParser):
    """A tree of any depth; the open elements are a list, with their number by tag beside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False)
        self.open = [self.root]
        self.count: dict[str, int] = {}
        self.named: list[int] = []  # places of open elements that are dropped for their class

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]
        while self.named and self.named[-1] >= i:
            self.named.pop()

    def _close(self, tags, stop=frozenset()):
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in CLOSES_P:
            self._close({"p"}, CONTAINERS | {"table", "li", "ul", "ol"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, {"dl"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        dropped = _dropped(tag, attrs)
        by_class = not dropped and _dropped_by_class(tag, attrs, bool(self.count.get("article")))
        name = DIGITS.sub("9", attrs.get("class", ""))
        node = Node(tag, f"{tag}.{name}" if name else tag, dropped, by_class)
        if tag in LANDMARKS:
            for i in self.named:
                self.open[i].dropped = False
            self.named.clear()
        self.open[-1].kids.append(node)
        if tag not in VOID:
            if by_class:
                self.named.append(len(self.open))
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag}, frozenset() if tag in BLOCKS else BLOCKS)

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(re.sub(r"<[A-Za-z/!][^<>]*\Z", "", html))
    b.close()
    return b.root


_paths: dict[tuple[int, str], int] = {}


def path_of(parent: int, label: str) -> int:
    """Number of the path that label makes below a path; the same on every machine."""
    key = (parent, label)
    if key not in _paths:
        if len(_paths) > 1_000_000:
            _paths.clear()
        digest = hashlib.blake2b(f"{parent}/{label}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
        _paths[key] = int.from_bytes(digest, "little", signed=True)
    return _paths[key]


def outline(tree: Node) -> tuple[list[tuple[int, bool, str]], list[tuple[int, int, int]]]:
    """Blocks of a tree in page order as (path, inside a landmark, text), and its containers with text as
    (path, first block, end block)."""
    blocks: list[tuple[int, bool, str]] = []
    spans: list[tuple[int, int, int]] = []
    line: list[str] = []
    at, marks = 0, 0

    def end():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append((at, marks > 0, text))

    walk = [(tree, iter(tree.kids), 0, 0)]
    while walk:
        node, kids, path, first = walk[-1]
        k = next(kids, None)
        if k is None:
            walk.pop()
            if not walk or node.tag in BLOCKS:
                end()
            marks -= node.tag in LANDMARKS
            if node.tag in CONTAINERS and len(blocks) > first:
                spans.append((path, first, len(blocks)))
        elif isinstance(k, str):
            if not line:
                at = path
            line.append(k)
        elif k.dropped:
            if k.tag in BLOCKS:
                end()
        else:
            if k.tag in BLOCKS or k.tag == "br":
                end()
            marks += k.tag in LANDMARKS
            walk.append((k, iter(k.kids), path_of(path, k.label), len(blocks)))
    return blocks, spans


def layout_of(blocks, spans) -> int:
    """Path of the smallest container with more than half of a page's text; 0 if none has."""
    sums = [0]
    for _, _, text in blocks:
        sums.append(sums[-1] + len(text))
    return next((p for p, a, b in spans if 2 * (sums[b] - sums[a]) > sums[-1]), 0)


class Slim:
    """A tree for alignment: like siblings are one node, in the place of the first; text is what stands directly in it."""

    __slots__ = ("tag", "path", "depth", "text", "kids")

    def __init__(self, tag: str, path: int, depth: int, members: list[Node]):
        self.tag, self.path, self.depth, self.kids = tag, path, depth, {}
        self.text = " ".join(" ".join(k for m in members for k in m.kids if isinstance(k, str)).split())


def slim_tree(tree: Node) -> Slim:
    top = Slim("", 0, 0, [tree])
    todo = [(top, [tree])]
    while todo:
        slim, members = todo.pop()
        groups: dict[str, list[Node]] = {}
        for m in members:
            for k in m.kids:
                if isinstance(k, Node) and not k.dropped:
                    groups.setdefault(k.label, []).append(k)
        for label, some in groups.items():
            slim.kids[label] = Slim(some[0].tag, path_of(slim.path, label), slim.depth + 1, some)
            todo.append((slim.kids[label], some))
    return top


def _heaviest_order(pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of the increasing subsequence of (place, weight) pairs with the largest sum of weights."""
    places = sorted(p for p, _ in pairs)
    tree: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)  # prefix maxima of (sum, index), a Fenwick tree
    before = []
    best = (0, -1)
    for i, (place, weight) in enumerate(pairs):
        at = bisect_left(places, place)
        found, j = (0, -1), at
        while j > 0:
            found = max(found, tree[j])
            j &= j - 1
        before.append(found[1])
        now = (found[0] + weight, i)
        best = max(best, now)
        j = at + 1
        while j <= len(places):
            tree[j] = max(tree[j], now)
            j += j & -j
    out, i = [], best[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def tree_match(a: Slim, b: Slim) -> tuple[int, list[tuple[Slim, Slim]]]:
    """Simple tree matching: the largest order-preserving top-down matching and its node pairs.

    Siblings differ in their labels, so a node can match one node only, and the best matching of two lists of
    children is a heaviest increasing subsequence."""
    pairs, below = [(a, b)], []
    for x, y in pairs:  # grows as it goes
        place = {label: i for i, label in enumerate(y.kids)}
        made = []
        for label, kid in x.kids.items():
            if label in place:
                made.append((len(pairs), place[label]))
                pairs.append((kid, y.kids[label]))
        below.append(made)
    score, chosen = [1] * len(pairs), [[]] * len(pairs)
    for i in range(len(pairs) - 1, -1, -1):
        some = [(place, score[k]) for k, place in below[i]]
        chosen[i] = [below[i][j][0] for j in _heaviest_order(some)]
        score[i] += sum(score[k] for k in chosen[i])
    found, todo = [], [0]
    while todo:
        i = todo.pop()
        found.append(pairs[i])
        todo += chosen[i]
    return score[0], found


def _varying(top: Slim, same: set[int], share: dict[int, int], known: dict[int, Slim]) -> int:
    """Add the varying text below each container of a tree to share; returns that of the tree."""
    order = [top]
    for node in order:
        order += node.kids.values()
    total: dict[int, int] = {}
    for node in reversed(order):
        n = (0 if id(node) in same else len(node.text)) + sum(total[id(k)] for k in node.kids.values())
        total[id(node)] = n
        if node.tag in CONTAINERS:
            share[node.path] = share.get(node.path, 0) + n
            known[node.path] = node
    return total[id(top)]


def induce(pages: list[str], most: float = 0.8) -> int | None:
    """Path of the container that holds the slots of pages of one layout; None if fewer than two, or if nothing varies."""
    if len(pages) < 2:
        return None
    slim = [slim_tree(parse(p)) for p in pages]
    share: dict[int, int] = {}
    known: dict[int, Slim] = {}
    total = 0
    for k, a in enumerate(slim):
        same = {id(x) for x, y in tree_match(a, slim[(k + 1) % len(slim)])[1] if x.text == y.text}
        total += _varying(a, same, share, known)
    if not total:
        return None
    marked = [p for p in share if known[p].tag in LANDMARKS and 2 * share[p] >= total]
    good = marked or [p for p in share if share[p] >= most * total]
    return max(good, key=lambda p: (known[p].depth, share[p]), default=None)


def extract(html: str | None, wrapper: tuple[int | None, set[int]] | None = None) -> str:
    """Main text of one page by a wrapper (root, hashes of template blocks), as extract_pages gives it."""
    blocks, spans = outline(parse(html)) if html else ([], [])
    root, template = wrapper or (None, set())
    below = [(a, b) for p, a, b in spans if p == root]
    found = [t for i, (p, mark, t) in enumerate(blocks) if any(a <= i < b for a, b in below) and (mark or path_of(p, t) not in template)]
    return "\n".join(found or [t for _, mark, t in blocks if mark] or [t for _, _, t in blocks])


_BLOCK = pa.struct([("h", pa.int64()), ("l", pa.bool_()), ("t", pa.string())])
_SPAN = pa.struct([("p", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _outline_all(batches):
    """Rows of (page_id, url, host, x, html) to their layout, blocks and containers."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            page = b.slice(lo, 256)
            layouts, blocks, spans = [], [], []
            for html in page.column(4).to_pylist():
                some, around = outline(parse(html)) if html else ([], [])
                layouts.append(layout_of(some, around))
                blocks.append([{"h": path_of(p, t), "l": mark, "t": t.encode("utf-8", "replace").decode()} for p, mark, t in some])
                spans.append([{"p": p, "a": a, "b": z} for p, a, z in around])
            made = (pa.array(layouts, pa.int64()), pa.array(blocks, pa.list_(_BLOCK)), pa.array(spans, pa.list_(_SPAN)))
            yield pa.RecordBatch.from_arrays([*(page.column(k) for k in range(4)), *made], ["page_id", "url", "host", "x", "layout", "blocks", "spans"])


def _induce_all(batches):
    """Rows of (layout key, pages) to (layout key, root)."""
    for b in batches:
        keys, pages = b.column(0), b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([keys, pa.array([induce([p for p in x if p]) for x in pages], pa.int64())], ["g", "root"])


def host_of(url):
    """Host of a URL in lower case without user or port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def wrappers(rows: DataFrame, outlined: DataFrame, references: int = REFERENCES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """(g, root, template) of every layout with two distinct pages or more; g is its key, template the hashes of its blocks."""
    outer = F.transform(F.filter("blocks", lambda k: ~k["l"]), lambda k: k["h"])
    known = outlined.where("g is not null").select("g", "host", "x", F.array_distinct(outer).alias("h"))
    pages = staged(known.groupBy("g", "host", "x").agg(F.first("h").alias("h")), "html-layouts")
    number = staged(pages.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "html-sizes")
    counts = pages.select("g", F.explode("h").alias("h")).groupBy("g", "h").agg(F.count("*").alias("c")).where("c > 1")
    often = join_split(counts, number, "g").where(F.col("c") >= F.col("n") * share)
    template = often.groupBy("g").agg(F.collect_list("h").alias("template"))
    # references: the smallest of the least hashes of SPREAD parts, so that no layout is sorted whole
    low = pages.groupBy("g", "host", F.pmod("x", F.lit(SPREAD)).alias("part")).agg(F.min("x").alias("x"))
    rank = F.row_number().over(W.partitionBy("g").orderBy("x"))
    wanted = staged(low.withColumn("r", rank).where(F.col("r") <= references).join(number.select("g"), "g").select("g", F.col("host").alias("w_host"), F.col("x").alias("w_x")), "html-wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = rows.join(chosen, (F.col("host") == F.col("w_host")) & (F.col("x") == F.col("w_x")))
    one = texts.groupBy("g", "w_x").agg(F.first("html").alias("html"))
    refs = one.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("w_x", "html"))).alias("refs"))
    roots = refs.select("g", F.transform("refs", lambda r: r["html"]).alias("pages")).mapInArrow(_induce_all, "g string, root bigint")
    return staged(roots.join(template, "g", "left"), "html-wrappers")


def main_text() -> Column:
    """The text of a page from its blocks and containers and the root and template of its layout."""
    every = F.transform("blocks", lambda k, i: F.struct(i.alias("i"), k["h"].alias("h"), k["l"].alias("l"), k["t"].alias("t")))
    none = F.array().cast("array<bigint>")

    def inside(places):
        kept = lambda k: k["l"] | ~F.array_contains(F.coalesce("template", none), k["h"])
        return F.filter(every, lambda k: F.exists(places, lambda s: (s["a"] <= k["i"]) & (k["i"] < s["b"])) & kept(k))

    below = let(F.filter("spans", lambda s: s["p"] == F.col("root")), inside)
    marked = F.filter(every, lambda k: k["l"])
    pick = lambda found: F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).when(F.size(marked) > 0, marked).otherwise(every)
    return F.array_join(F.transform(let(below, pick), lambda k: k["t"]), "\n")


def extract_pages(pages: DataFrame, references: int = REFERENCES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole html; returns page_id, url, text and n_chars.

    Null or empty html gives the empty text.  A page without host, or alone in its layout, falls back
    on its article or main element, else on all blocks outside the dropped roles.  Elements may nest to any
    depth, and a page may have any number of them.  Repeated rows and null ids stay, an empty table gives
    an empty table; other columns are ignored, whatever their names.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), F.xxhash64(pages[html_col]).alias("x"), pages[html_col].alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, x bigint, layout bigint, blocks array<struct<h:bigint,l:boolean,t:string>>, spans array<struct<p:bigint,a:int,b:int>>"
    outlined = rows.mapInArrow(_outline_all, schema).withColumn("g", F.when(F.size("blocks") > 0, F.concat_ws("|", F.when(F.col("host").isNotNull(), F.col("layout").cast("string")), "host")))
    outlined = outlined.withColumn("g", F.when(F.col("host").isNotNull(), F.col("g")))
    outlined = staged(outlined, "html-blocks")
    made = wrappers(rows, outlined, references)
    joined = join_split(outlined.select("page_id", "url", "g", "blocks", "spans"), made, "g")
    return joined.select("page_id", "url", main_text().alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
