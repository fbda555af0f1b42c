"""Main text of web pages by wrapper induction.

All pages of each host are parsed into trees, and the longest page is aligned with
each other one by simple tree matching: pages stay where they are, and what is counted
is how each node of the longest one fares in them.  Text that is the same
wherever its node is matched belongs to the host's template; text that varies
marks the slots.  The wrapper of a host is the path of the element that holds the
varying text (menus, adverts and the like, which vary too, left out by their tags
and classes) and the constant texts inside it.  Pages are then read through the
wrapper of their host; a host with too few different pages uses its ``article`` or
``main`` element, else the body.

Trees are walked with explicit stacks and places are hashes of paths, so depth costs
no more than size.  A NULL or empty html has an empty text; repeated and equal pages
are read one by one and count once in a wrapper; of equally good alignments that of
equal texts counts; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded, store, table

ALIKE = 4  # pages besides the first that a template needs
LARGE = 20_000  # child pairs from which on two child lists are matched by whole rows of scores
CELLS = 1 << 21  # scores held of two such lists
BROADCAST_BYTES = 8 << 20  # wrappers, and the longest pages of the hosts, up to this size are broadcast, more are joined by host
KEPT_NODES = 200_000  # nodes of longest pages that a task keeps parsed

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SKIPPED = set("head script style noscript template nav footer aside form button select textarea input iframe object svg math canvas audio video dialog menu title".split())
#: An open element of these ends where one of the others starts.
ENDED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "th", "li", "div", "article", "section", "blockquote", "main", "body"}}
SIDE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|notices|alert|sidebar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|share|sharing|social|related|recommended|comment|comments|reply|replies|disqus|subscribe|newsletter|popup|modal|login|signup|search|widget|pagination|pager|toolbar|skip|copyright)(?=$|[\s_-])", re.I)
TOP = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?=$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
HOLDERS = {"body", "main", "article", "section", "div", "td"}


HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
WALLS = ("table", "article", "body")  # end tags and implied ends do not reach beyond these


class Node:
    """An element or a text.  ``side``: not part of the main text; ``soft``: so by its class alone."""

    __slots__ = ("tag", "kind", "side", "soft", "children", "text", "holds")

    def __init__(self, tag: str, kind: str = "", side: bool = False, text: str = "", soft: bool = False):
        self.tag, self.kind, self.side, self.soft, self.text = tag, kind, side, soft, text
        self.children: list[Node] = []
        self.holds = False


def element(tag: str, attributes: str) -> Node:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return Node(tag, "", tag in SKIPPED)
    a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attributes)}
    kind = " ".join(filter(None, (a.get("class"), a.get("id"))))
    gone = re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", '""', attributes)) or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("aria-hidden") == "true"
    hard = tag in SKIPPED or bool(gone) or a.get("role", "").lower() in ROLES
    soft = not hard and tag not in ("html", "body", "article", "main") and tag not in HEADINGS and bool(SIDE.search(kind))
    node = Node(tag, a.get("class", ""), hard or soft, soft=soft)
    node.text = "top" if TOP.search(kind) else ""
    return node


class Open:
    """The open elements of a page, with where each tag was opened last."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def close(self, place: int) -> None:
        for node in self.stack[place:]:
            self.at[node.tag].pop()
        del self.stack[place:]

    def holds(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)


#: For each tag the open elements that end where it starts.
ENDS: dict[str, list[str]] = {}
for _open, _tags in ENDED_BY.items():
    for _tag in _tags:
        ENDS.setdefault(_tag, []).append(_open)


def parse(html: str) -> Node:
    """The tree of a page.  Missing end tags are supplied, stray ones ignored."""
    root = Node("#root")
    opened = Open(root)
    at, n = 0, len(html)
    buried: list[list[Node]] = []  # what hides each article that stands in side elements only
    plain = False

    def add_text(a: int, b: int) -> None:
        if b > a:
            opened.stack[-1].children.append(Node("#text", text=entities.unescape(html[a:b])))

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            add_text(at, n)
            break
        add_text(at, m.start())
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            place = opened.last((tag,))
            if place and (tag in ("body", "html") or place >= opened.last(WALLS)):
                opened.close(place)
            continue
        ended = opened.last(ENDS.get(tag, ()))
        if ended and ended > opened.last((*SCOPE.get(tag, ()), *WALLS)):
            opened.close(ended)
        node = element(tag, m.group(3))
        if (tag == "header" or node.text) and not opened.holds("article", "main"):
            node.side, node.soft = True, False  # a site's header; an article's own holds its title
        opened.stack[-1].children.append(node)
        if tag in ("article", "main") and not plain:
            hidden = [x for x in opened.stack if x.side]
            plain = not hidden and not node.side
            if hidden and all(x.soft for x in hidden):
                buried.append(hidden)
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
            if tag in ("textarea", "title"):
                node.children.append(Node("#text", text=entities.unescape(html[at:end.start() if end else n])))
            at = end.end() if end else n
        elif tag not in VOID and not m.group(3).rstrip().endswith("/"):
            opened.push(node)
    if not plain:  # the only article stands in an element that its class alone calls a side one
        for node in (x for hidden in buried for x in hidden):
            node.side = False
    return root


def step(node: Node) -> str:
    return f"{node.tag}.{node.kind}" if node.kind else node.tag


def place(parent: int, label: str) -> int:
    """The hash of a path one step longer."""
    return int.from_bytes(hashlib.blake2b(parent.to_bytes(8, "little") + label.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def blocks(node: Node, path: int, out: list[tuple[int, str]], skip: bool = True) -> list[tuple[int, str]]:
    """(place, text) of the blocks under ``node`` in page order, white space folded."""
    run: list[str] = []
    first = [path]

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append((first[0], text))
        run.clear()

    stack: list[tuple[Iterator[Node], int, str]] = [(iter(node.children), path, "")]
    while stack:
        children, at, end = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            if end == "block":
                flush()
            elif end:
                run.append(end)
        elif c.tag == "#text":
            if not run:
                first[0] = at
            run.append(c.text)
        elif c.side and skip:
            continue
        elif c.tag in BLOCK:
            flush()
            stack.append((iter(c.children), place(at, step(c)), "block"))
        elif c.tag in ("br", "td", "th"):
            run.append(" ")
            stack.append((iter(c.children), place(at, step(c)), " "))
        else:
            stack.append((iter(c.children), at, ""))
    flush()
    return out


def inside(node: Node) -> list[Node]:
    """Its elements that are part of the main text."""
    return [c for c in node.children if c.tag != "#text" and not c.side]


def mark_blocks(root: Node) -> None:
    """Sets ``holds`` of every element: whether it is a block or holds one."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += inside(node)
    for node in reversed(order):
        node.holds = node.tag in BLOCK or any(c.holds for c in inside(node))


class Tree:
    """Element tree of a page for alignment: only what a reader sees, blocks as leaves with their texts."""

    __slots__ = ("label", "path", "parent", "children", "text", "size")

    def __init__(self, root: Node):
        mark_blocks(root)
        order, stack = [], [(self, root, None)]
        while stack:
            tree, node, parent = stack.pop()
            order.append(tree)
            tree.label, tree.parent, tree.children = step(node), parent, []
            tree.path = place(parent.path if parent else 0, tree.label)
            inner = inside(node)
            if any(c.holds for c in inner):
                tree.text = " ".join("".join(c.text for c in node.children if c.tag == "#text").split())
                tree.children = [Tree.__new__(Tree) for _ in inner]
                stack += [(t, c, tree) for t, c in zip(reversed(tree.children), reversed(inner))]
            else:
                tree.text = "\n".join(t for _, t in blocks(node, 0, []))
        for tree in reversed(order):
            tree.size = 1 + sum(c.size for c in tree.children)

    def all(self) -> list[Tree]:
        """Its nodes, parents before children, in page order."""
        out, stack = [], [self]
        while stack:
            out.append(stack.pop())
            stack += reversed(out[-1].children)
        return out

    def steps(self) -> list[str]:
        out, at = [], self
        while at is not None:
            out.append(at.label)
            at = at.parent
        return out[::-1]


def match(a: Tree, b: Tree, out: list[tuple[Tree, Tree]]) -> int:
    """Simple tree matching: the largest number of node pairs that keeps labels, order
    and parents; the pairs go to ``out``."""
    return run(_match(a, b, out))


def run(steps):
    """The result of a generator that yields the generators it waits for."""
    stack, result = [steps], None
    while stack:
        try:
            asked = stack[-1].send(result)
        except StopIteration as done:
            stack.pop()
            result = done.value
        else:
            result = None
            stack.append(asked)
    return result


def weights(xs: list[Tree], ys: list[Tree]):
    """[x, y] -> the size of the largest match of two nodes (generator)."""
    labels: dict[str, int] = {}
    texts: dict[str, int] = {}
    lx, ly = (np.array([labels.setdefault(t.label, len(labels)) for t in ts], np.int32) for ts in (xs, ys))
    tx, ty = (np.array([inner if t.children else texts.setdefault(t.text, len(texts)) for t in ts], np.int32) for ts, inner in ((xs, -1), (ys, -2)))
    same = lx[:, None] == ly
    out = same.astype(np.int32)
    out += same & (tx[:, None] == ty)  # of equal alignments the one of equal texts
    kinds: list[dict[tuple[str, int], list[int]]] = [{}, {}]
    for ts, found in zip((xs, ys), kinds):
        for i, t in enumerate(ts):
            if t.children:
                found.setdefault((t.label, len(t.children)), []).append(i)
    for (label, m), rows in kinds[0].items():
        for (its, n), cols in kinds[1].items():
            if label != its:
                continue
            if len(rows) * len(cols) < m * n:
                for i in rows:
                    for j in cols:
                        out[i, j] = 1 + (yield total(xs[i].children, ys[j].children))
                continue
            below, most = [ys[j] for j in cols], max(1, CELLS // (len(cols) * (n + 1)))
            for a in range(0, len(rows), most):  # all pairs at once, child by child
                some = [xs[i] for i in rows[a:a + most]]
                above = [np.zeros((len(some), len(below)), np.int32)] * (n + 1)
                for i in range(m):
                    row = above[:1]
                    for j in range(n):
                        w = yield weights([x.children[i] for x in some], [y.children[j] for y in below])
                        row.append(np.maximum(np.maximum(above[j + 1], row[j]), above[j] + w))
                    above = row
                out[np.ix_(rows[a:a + most], cols)] = 1 + above[n]
    return out


def rows_of(above: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The rows of scores that follow ``above``, which comes first."""
    out = np.zeros((len(w) + 1, len(above)), np.int32)
    out[0] = above
    for i, each in enumerate(w):
        np.maximum.accumulate(np.maximum(out[i, 1:], out[i, :-1] + each), out=out[i + 1, 1:])
    return out


def rows_at_once(m: int, n: int) -> int:
    return min(m, max(CELLS // n, int(m ** 0.5) + 1))


def total(xs: list[Tree], ys: list[Tree]):
    """The size of the best alignment of two child lists (generator)."""
    above, step = np.zeros(len(ys) + 1, np.int32), rows_at_once(len(xs), len(ys))
    for i in range(0, len(xs), step):
        above = rows_of(above, (yield weights(xs[i:i + step], ys)))[-1]
    return int(above[-1])


def aligned(xs: list[Tree], ys: list[Tree]):
    """(size, pairs from the last to the first) of the best alignment of two child lists
    (generator).  Some rows of scores are held, the others computed again on the way back."""
    step, held = rows_at_once(len(xs), len(ys)), [np.zeros(len(ys) + 1, np.int32)]
    score = np.zeros((1, len(ys) + 1), np.int32)
    for i in range(0, len(xs), step):
        score = rows_of(held[-1], (yield weights(xs[i:i + step], ys)))
        held.append(score[-1].copy())
    size, j, pairs = int(held.pop()[-1]), len(ys), []
    for i in reversed(range(0, len(xs), step)):
        if i + step < len(xs):
            score = rows_of(held[-1], (yield weights(xs[i:i + step], ys)))
        held.pop()
        k = len(score) - 1
        while k and j:
            if score[k, j] == score[k - 1, j]:
                k -= 1
            elif score[k, j] == score[k, j - 1]:
                j -= 1
            else:
                k, j = k - 1, j - 1
                pairs.append((i + k, j))
    return size, pairs


def _match(a: Tree, b: Tree, out: list[tuple[Tree, Tree]]):
    """``match`` (generator)."""
    if a.label != b.label:
        return 0
    out.append((a, b))
    m, n = len(a.children), len(b.children)
    if not m or not n:
        return 1
    if m == n == 1 and (a.children[0].children or b.children[0].children):  # a chain: no copies of its pairs
        return 1 + (yield _match(a.children[0], b.children[0], out))
    if m * n > LARGE:
        size, chosen = yield aligned(a.children, b.children)
        for i, j in chosen:
            yield _match(a.children[i], b.children[j], out)
        return 1 + size
    score, above = [[0] * (n + 1)], [0] * (n + 1)
    pairs: dict[tuple[int, int], list] = {}
    below = [(y, y.label, y.children, y.text) for y in b.children]
    for i, x in enumerate(a.children, 1):
        label, inner, text, left, row, j = x.label, x.children, x.text, 0, [0], 0
        for y, its, under, other in below:
            best = above[j + 1]
            if left > best:
                best = left
            if label == its:
                if inner or under:
                    w = yield _match(x, y, pairs.setdefault((i, j + 1), []))
                else:
                    w = 2 if text == other else 1  # of equal alignments the one of equal texts
                if above[j] + w > best:
                    best = above[j] + w
            left = best
            row.append(best)
            j += 1
        score.append(row)
        above = row
    i, j = m, n
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            out += pairs.get((i, j)) or [(a.children[i - 1], b.children[j - 1])]
            i, j = i - 1, j - 1
    return 1 + score[m][n]


def alignment(first: Tree, nodes: dict[int, int], other: Tree) -> bytearray:
    """For each node of ``first`` (numbered by ``nodes``): 0 if it has no partner in ``other``,
    1 if it has one, 2 if that one's text is the same."""
    pairs: list[tuple[Tree, Tree]] = []
    match(first, other, pairs)
    out = bytearray(len(nodes))
    for x, y in pairs:
        out[nodes[id(x)]] = 2 if x.text == y.text else 1
    return out


def numbered(tree: Tree) -> dict[int, int]:
    return {id(t): i for i, t in enumerate(tree.all())}


def induce(pages: list[str]) -> tuple[list[str], list[str]]:
    """``decide`` of pages at hand."""
    pages = sorted(dict.fromkeys(pages), key=lambda p: -len(p))
    if len(pages) <= ALIKE:
        return [], []
    first = Tree(parse(pages[0]))
    nodes = numbered(first)
    found = [alignment(first, nodes, Tree(parse(p))) for p in pages[1:]]
    return decide(first, [sum(f[i] > 0 for f in found) for i in range(len(nodes))], [sum(f[i] == 2 for f in found) for i in range(len(nodes))], len(found))


def decide(first: Tree, met_by: list[int], same_by: list[int], others: int) -> tuple[list[str], list[str]]:
    """(steps to the content element or none, constant texts in it as place, tab, text) of a
    host by its longest page and, for each node of it in page order, the numbers of
    ``others`` that hold a partner, and one of the same text."""
    if others < ALIKE:
        return [], []
    nodes = first.all()
    met = {id(t): n for t, n in zip(nodes, met_by)}
    same = {id(t): n for t, n in zip(nodes, same_by)}

    def constant(t: Tree) -> bool:
        return bool(t.text) and met[id(t)] >= max(ALIKE, 0.8 * others) and same[id(t)] == met[id(t)]

    varies: dict[int, int] = {}
    for t in reversed(first.all()):
        varies[id(t)] = (0 if constant(t) else len(t.text)) + sum(varies[id(c)] for c in t.children)
    total = varies[id(first)]
    if not total:
        return [], []
    at, chosen, article = first, first, None
    while True:
        inner = max(at.children, key=lambda c: varies[id(c)], default=None)
        if inner is None or varies[id(inner)] < 0.9 * total:
            break
        at = inner
        tag = at.label.split(".")[0]
        if tag in ("article", "main"):
            article = article or at
        if tag in HOLDERS:
            chosen = at
    chosen = article or chosen
    fixed = [t for t in chosen.all() if constant(t)]
    size = sum(len(t.text) for t in fixed)
    # Pages that are mostly the same text are copies of each other; then nothing tells text from template.
    keep = fixed if size <= varies[id(chosen)] else []
    return chosen.steps(), [f"{t.path}\t{line}" for t in keep if t.label.split(".")[0] not in ("h1", "h2") for line in t.text.split("\n")]


def find(node: Node, steps: list[str]) -> list[Node]:
    found = [node]
    for label in steps:
        found = [c for x in found for c in inside(x) if step(c) == label]
    return found


def named(node: Node, tags: tuple[str, ...]) -> list[Node]:
    """Outermost elements of these tags that are not in a menu or the like."""
    out, stack = [], inside(node)[::-1]
    while stack:
        c = stack.pop()
        if c.tag in tags:
            out.append(c)
        else:
            stack += inside(c)[::-1]
    return out


def content(html: str, steps: list[str], fixed: set[str]) -> str:
    """The main text of a page through a wrapper."""
    root = parse(html)
    at = 0
    for label in steps:
        at = place(at, label)
    holders = find(root, steps[1:]) if steps else []
    found = [(h, at) for h in holders] or [(h, 0) for h in named(root, ("article",)) or named(root, ("main",)) or named(root, ("body",)) or [root]]
    out: list[tuple[int, str]] = []
    for holder, at in found:
        blocks(holder, at, out)
    return "\n".join(t for p, t in out if f"{p}\t{t}" not in fixed)


class Parsed:
    """Trees of longest pages with their nodes' numbers, so many that they hold ``KEPT_NODES``."""

    def __init__(self):
        self.kept: dict[str, tuple[Tree, dict[int, int]]] = {}
        self.size = 0

    def __call__(self, html: str) -> tuple[Tree, dict[int, int]]:
        found = self.kept.get(html)
        if found is None:
            tree = Tree(parse(html))
            found = tree, numbered(tree)
            if self.size + len(found[1]) > KEPT_NODES:
                self.kept, self.size = {}, 0
            self.kept[html], self.size = found, self.size + len(found[1])
        return found


def if_short(df: DataFrame, size: Column) -> DataFrame:
    """``df``, to be broadcast if the ``size`` of its rows adds up to ``BROADCAST_BYTES`` at most."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path, fixed) of every host of ``pages`` (key, host, html), from all its
    different pages.  Each is aligned with the host's longest page in the task that reads it."""
    own = pages.where("host IS NOT NULL AND html IS NOT NULL").select("host", "html", F.xxhash64("html").alias("h"))
    longest = store(own.groupBy("host").agg(F.max_by("html", F.struct(F.length("html"), "h")).alias("first")), "longest-pages")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = Parsed()
        for batch in batches:
            for part in bounded(batch):
                how = []
                for html, first in zip(part.column(1), part.column(3)):
                    html, first = html.as_py(), first.as_py()
                    how.append(None if html == first else list(alignment(*parsed(first), Tree(parse(html)))))
                yield pa.record_batch([part.column(0), part.column(2), pa.array(how, pa.list_(pa.int8()))], names=["host", "h", "how"])

    read = own.join(if_short(longest, F.octet_length("first")), "host").select("host", "html", "h", "first")
    aligned = store(read.mapInArrow(align, "host string, h long, how array<tinyint>").where("how IS NOT NULL").dropDuplicates(["host", "h"]), "alignments")
    others = aligned.groupBy("host").agg(F.count(F.lit(1)).alias("others"))
    fares = aligned.select("host", F.posexplode("how").alias("node", "how")).groupBy("host", "node").agg(F.count_if(F.col("how") > 0).alias("met"), F.count_if(F.col("how") == 2).alias("same"))
    # as many as the longest page has nodes
    fares = fares.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "met", "same"))).alias("fares"))
    found = longest.join(others, "host").join(fares, "host").select("host", "first", "others", F.col("fares.met").alias("met"), F.col("fares.same").alias("same"))

    def learn(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [decide(Tree(parse(r["first"])), r["met"], r["same"], r["others"]) for r in batch.to_pylist()]
        texts = pa.list_(pa.string())
        return pa.record_batch([batch.column(0), pa.array([p for p, _ in got], texts), pa.array([f for _, f in got], texts)], names=["host", "path", "fixed"])

    return arrow_map(found, learn, "host string, path array<string>, fixed array<string>")


def extract(pages: DataFrame) -> DataFrame:
    """(key, text) of every row of ``pages`` (key, url, html).  A NULL or empty html has
    an empty text; a NULL url or one without a host uses no wrapper; repeated rows
    are read one by one."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    pages = pages.withColumn("host", F.when(host != "", host))
    learned = store(wrappers(pages), "wrappers")
    learned = if_short(learned, F.length(F.array_join("path", "/")) + F.coalesce(F.length(F.array_join("fixed", "")), F.lit(0)) + F.length("host") + 64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [content(h.as_py() or "", p.as_py() or [], set(f.as_py() or ())) for h, p, f in zip(batch.column(2), batch.column(3), batch.column(4))]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    read = pages.select("key", "url", "html", "host").join(learned, "host", "left").select("key", "url", "html", "path", "fixed")
    return arrow_map(read, run, "key long, url string, text string")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 7 over the whole ``pages`` table."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return extract(pages).select(F.col("key").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
