"""HTML main text by wrapper induction.

Every leaf block of a page is counted over all pages of its host, by its path, the tags and names from the root down, and
its text. What nearly all pages carry is template, of any length. Pages that are mostly made of such nodes are copies of
each other, not fillings of one template, and count as one page. The host's wrapper is the tree of the template nodes on
the page that has most of them. Pages that lack some of them under their usual path are aligned with it by simple tree
matching, which finds those that stand in their place under other names. The varying slots are content, unless their role
(menu, advert, footer ...) shows in their mark-up.

Each node is matched with one partner at most, whose children are then matched. Equal children at both ends and those that
are found once in both lists are fixed first; what lies between is matched in order, by tag, place in the page and text.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups, slices

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",)}
NOT_CONTENT = frozenset("script style noscript template nav footer aside form button select input textarea iframe svg canvas object embed dialog menu title head noembed noframes datalist audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id names that mark page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars rail widget widgets "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies "
    "respond discussion footer foot header masthead topbar copyright pagination pager toolbar search form hidden disclaimer alert skip paywall".split()
)
#: Words that say of what sort a marked element is, not what it holds.
SORTS = frozenset("area bar block box buttons container form inner item items link links list module panel post posts section slot title top unit wrap wrapper".split())
MAIN_NAMES = frozenset("article content main post entry story articlebody postbody entrycontent maincontent".split())
#: A node is template if at least this share of a host's pages, and this many pages, carry it with the same text.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.9, 5
#: Share of a page's text in constant nodes above which it is a copy of others, and cells of a matching that are held at a time.
COPY_SHARE, CELLS = 0.8, 1_000_000
#: Votes that a task holds before it hands them on.
VOTES = 100_000
#: Beyond so many nodes of templates, they are joined to the pages by host in place of being sent to all executors.
BROADCAST_NODES = 100_000


class Node:
    __slots__ = ("attrs", "blocks", "key", "parts", "size", "tag", "text", "words")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.parts, self.blocks, self.key, self.text, self.size, self.words = tag, attrs, [], [], None, -1, 0, None

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]


def parse(page: str) -> Node:
    """A tree of elements and text; unclosed and misnested tags are put right as browsers commonly do."""
    root = Node("#root", "")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",), ("td", "th", "div", "article", "section", "li", "button", "body"))
        if tag in SIBLING:
            _close(stack, SIBLING[tag], SCOPE[tag])
        node = Node(tag, m[3] or "")
        stack[-1].parts.append(node)
        if tag not in INLINE and tag not in RAW:
            stack[-1].blocks.append(node)
        if tag in RAW and not node.attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            stop = end.start() if end else size
            node.parts.append(page[at:stop])
            at = end.end() if end else size
        elif tag not in VOID and not node.attrs.rstrip().endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
    cut_at = 0
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            cut_at = i
        elif stack[i].tag in scope:
            break
    if cut_at:
        del stack[cut_at:]


@lru_cache(16384)
def _attributes(attrs: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}


def attributes(node: Node) -> dict[str, str]:
    return _attributes(node.attrs) if node.attrs else {}


@lru_cache(16384)
def _names(attrs: str) -> frozenset[str]:
    a = _attributes(attrs)
    return frozenset(x for x in _SPLIT.split(f"{a.get('class', '')} {a.get('id', '')}".lower()) if x)


def names(node: Node) -> frozenset[str]:
    return _names(node.attrs)


def furniture(node: Node, inside: bool) -> bool:
    """Whether an element's tag, role or names mark it as page furniture. inside: within the article."""
    return _furniture(node.tag, node.attrs, inside)


@lru_cache(16384)
def _furniture(tag: str, attrs: str, inside: bool) -> bool:
    if tag in NOT_CONTENT:
        return True
    if tag == "header":
        return not inside
    if not attrs.strip():
        return False
    a = _attributes(attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if not inside:
        return bool(_names(attrs) & FURNITURE)
    # within an article a name must speak of nothing else: "entry-header" and "form-of-words" are content
    own = [{x for x in _SPLIT.split(c.lower()) if x} for c in re.split(r"\s+", f"{a.get('class', '')} {a.get('id', '')}") if c]
    return any(w & FURNITURE and w <= FURNITURE | SORTS for w in own)


def plain(text: str) -> str:
    """Text with its character references decoded and white space turned into one space."""
    return " ".join(entities.unescape(text).split())


def own_text(node: Node) -> str:
    """The text of a subtree of any depth."""
    out: list[str] = []
    todo: list = list(reversed(node.parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.parts)
        elif x.tag not in RAW:
            out.append(" ")
            todo.append(" ")
            todo += reversed(x.parts)
    return plain("".join(out))


def _hash(text: str) -> int:
    """64 bits, never -1, the mark of no text."""
    h = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return h if h != -1 else 0


@lru_cache(16384)
def _path(above: int, tag: str, attrs: str) -> int:
    return _hash(f"{above}/{tag}" + "".join(f".{x}" for x in sorted(_names(attrs))))


def skeleton(node: Node) -> Node:
    """Gives every block node a name of its path, the tags and names from the root down to it, and the hash of its text."""
    node.key, order = _path(0, node.tag, node.attrs), [node]
    for n in order:
        for c in n.blocks:
            c.key = _path(n.key, c.tag, c.attrs)
        order += n.blocks
    for n in reversed(order):  # children before their parents, so that every text is read once
        if not n.blocks:
            t = own_text(n)
            n.text, n.size = (_hash(t), len(t)) if t else (-1, 0)
            if all(isinstance(x, str) for x in n.parts):
                n.words = t
            continue
        hashes, size = [], 0
        for x in n.parts:
            if isinstance(x, str) or x.tag in INLINE:
                t = plain(x) if isinstance(x, str) else own_text(x)
                hashes += [_hash(t)] if t else []
                size += len(t)
            elif x.tag not in RAW:
                hashes += [x.text] if x.text != -1 else []
                size += x.size
        n.text, n.size = hash(tuple(hashes)) if hashes else -1, size
    return node


def blocks_of(node: Node) -> list[Node]:
    return node.blocks


def with_text(node: Node) -> list[Node]:
    """The block nodes that hold text, parents before their children, in page order."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.text != -1:
            out.append(n)
            todo += reversed(n.blocks)
    return out


def align(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> int:
    """Simple tree matching, roots first: a matching of two trees that keeps roots, order and ancestry; fills ``pairs``."""
    todo = [(a, b)] if a.tag == b.tag else []
    while todo:
        p, q = todo.pop()
        pairs.append((p, q))
        todo += matched(blocks_of(p), blocks_of(q))
    return len(pairs)


def _alike(p: Node, q: Node) -> int:
    """How well two children match: 0 for other tags, more for the same place in the page, the same text."""
    return 0 if p.tag != q.tag else 1 + 2 * (p.key == q.key) + 4 * (p.text == q.text)


def matched(x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
    """Partners among two lists of children, in order."""
    u, v = [(n.key, n.text) for n in x], [(n.key, n.text) for n in y]
    lo, most = 0, min(len(u), len(v))
    while lo < most and u[lo] == v[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and u[-1 - hi] == v[-1 - hi]:
        hi += 1
    out = list(zip(x[:lo], y[:lo], strict=True)) + [(x[len(x) - 1 - k], y[len(y) - 1 - k]) for k in range(hi)]
    i, j = lo, lo
    for m, n in [*once_in_both(u, v, lo, hi), (len(u) - hi, len(v) - hi)]:
        out += between(x[i:m], y[j:n])
        if m < len(u) - hi:
            out.append((x[m], y[n]))
        i, j = m + 1, n + 1
    return out


def once_in_both(u: list, v: list, lo: int, hi: int) -> list[tuple[int, int]]:
    """Places of the elements that both lists hold once, of these the most that are in the same order."""
    n, m = Counter(u[lo : len(u) - hi]), Counter(v[lo : len(v) - hi])
    at = {w: j for j, w in enumerate(v[lo : len(v) - hi], lo) if m[w] == 1}
    both = [(i, at[w]) for i, w in enumerate(u[lo : len(u) - hi], lo) if n[w] == 1 and w in at]
    tails: list[int] = []  # the longest ascending run of second places
    heads: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(both):
        where = bisect.bisect_left(tails, j)
        tails[where : where + 1] = [j]
        heads[where : where + 1] = [k]
        before.append(heads[where - 1] if where else -1)
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def between(x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
    """A matching in order of the largest sum of :func:`_alike`; halves of long lists are matched one by one, so that memory
    grows with their length alone."""
    if not x or not y:
        return []
    codes: dict = {}
    u, v = (np.array([[codes.setdefault(w, len(codes)) for w in (n.tag, (0, n.key), (1, n.text))] for n in z]).T for z in (x, y))

    def scores(rows, lo: int, hi: int, step: int):
        """The sums of rows of x with every start (step 1) or end (step -1) of y[lo:hi], after each row."""
        row = np.zeros(hi - lo + 1, np.int64)
        t, k, w = (c[lo:hi][::step] for c in v)
        for i in rows:
            alike = np.where(t == u[0, i], 1 + 2 * (k == u[1, i]) + 4 * (w == u[2, i]), 0)
            row = np.maximum.accumulate(np.concatenate(([0], np.maximum(row[1:], row[:-1] + alike))))
            yield row

    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, lo, hi = todo.pop()
        if a == b or lo == hi:
            continue
        if b - a > 1 and (b - a) * (hi - lo) > CELLS:
            mid = (a + b) // 2
            *_, first = scores(range(a, mid), lo, hi, 1)
            *_, second = scores(range(b - 1, mid - 1, -1), lo, hi, -1)
            at = lo + int(np.argmax(first + second[::-1]))
            todo += [(a, mid, lo, at), (mid, b, at, hi)]
            continue
        best = [np.zeros(hi - lo + 1, np.int64), *scores(range(a, b), lo, hi, 1)]
        i, j = b - a, hi - lo
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x[a + i], y[lo + j]))
    return out


TREE = "struct<parent: array<int>, tag: array<string>, key: array<long>, text: array<long>>"
_TREE = pa.struct([("parent", pa.list_(pa.int32())), ("tag", pa.list_(pa.string())), ("key", pa.list_(pa.int64())), ("text", pa.list_(pa.int64()))])


def pruned(tree: dict, keep: set[tuple[int, int]]) -> dict:
    """The leaves of a written tree that are in ``keep``, and what is above them."""
    wanted = [t != -1 and (k, t) in keep for k, t in zip(tree["key"], tree["text"], strict=True)]
    for i in range(len(wanted) - 1, 0, -1):
        if wanted[i]:
            wanted[tree["parent"][i]] = True
    at: dict[int, int] = {-1: -1}
    for i, w in enumerate(wanted):
        if w:
            at[i] = len(at) - 1
    return {"parent": [at[tree["parent"][i]] for i in at if i >= 0], **{c: [tree[c][i] for i in at if i >= 0] for c in ("tag", "key", "text")}}


def grown(tree: dict) -> Node | None:
    """The nodes of a written tree."""
    nodes: list[Node] = []
    for parent, tag, key, text in zip(tree["parent"], tree["tag"], tree["key"], tree["text"], strict=True):
        n = Node(tag, "")
        n.key, n.text = key, text
        nodes.append(n)
        if parent >= 0:
            nodes[parent].parts.append(n)
            nodes[parent].blocks.append(n)
    for n in reversed(nodes):
        if n.blocks:
            n.text = hash(tuple(c.text for c in n.blocks))
    return nodes[0] if nodes else None


def trees(pages: DataFrame) -> DataFrame:
    """(page_id, host, tree, sizes, size) for every page that has html: its block nodes that hold text, -1 as the text of those with
    blocks in them, the code points of each leaf and of the whole page."""

    def rows(batches):
        for batch in batches:
            for b in slices(batch):
                ids, hosts, out, sizes, size = [], [], [], [], []
                for page_id, host, page in zip(*(b.column(c).to_pylist() for c in ("page_id", "host", "html")), strict=True):
                    if not page:
                        continue
                    tree = skeleton(parse(page))
                    nodes = with_text(tree)
                    at = {id(n): i for i, n in enumerate(nodes)}
                    parent = [-1] * len(nodes)
                    for i, n in enumerate(nodes):
                        for c in n.blocks:
                            if c.text != -1:
                                parent[at[id(c)]] = i
                    ids.append(page_id)
                    hosts.append(host)
                    out.append({"parent": parent, "tag": [n.tag for n in nodes], "key": [n.key for n in nodes], "text": [-1 if n.blocks else n.text for n in nodes]})
                    sizes.append([0 if n.blocks else n.size for n in nodes])
                    size.append(tree.size)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(out, _TREE), pa.array(sizes, pa.list_(pa.int32())), pa.array(size, pa.int64())], names=["page_id", "host", "tree", "sizes", "size"])

    return pages.select(F.col("page_id").cast("long"), "host", "html").mapInArrow(rows, f"page_id long, host string, tree {TREE}, sizes array<int>, size long")


def _by_host(rows: DataFrame, groups: DataFrame, nodes: int) -> DataFrame:
    """The rows of hosts that ``groups``, a written table, holds, with its columns; a large host is dealt over all tasks."""
    return rows.join(F.broadcast(groups.drop("pages")), "host") if nodes <= BROADCAST_NODES else join_groups(rows, groups, "host", "pages", "page_id")


def induce(pages: DataFrame) -> DataFrame:
    """(host, pages, nodes, wrapper): the template nodes, path and text, of every host that has some, and their tree.

    All pages of a host count. A node is constant if it is on TEMPLATE_SHARE of them. Pages with more than COPY_SHARE of
    their text in constant nodes are copies and together count as one page. A constant node is template if it is on
    TEMPLATE_SHARE of the pages so counted, which must be TEMPLATE_PAGES. Counts are added up over all tasks by node, and so
    no host is brought to one place. The wrapper is taken from the page that holds most constant nodes and is no copy.
    """
    read = cut(trees(pages), "trees")
    counted = read.groupBy("host").agg(F.count("*").alias("pages")).where(f"pages >= {TEMPLATE_PAGES}")
    leaves = read.selectExpr("host", "explode(array_distinct(filter(arrays_zip(tree.key, tree.text), x -> x.text <> -1))) AS leaf").select("host", F.col("leaf.key").alias("key"), F.col("leaf.text").alias("text"))
    often = leaves.groupBy("host", "key", "text").agg(F.count("*").alias("n")).where(f"n >= {TEMPLATE_SHARE} * {TEMPLATE_PAGES}")
    nodes = F.collect_list(F.struct("key", "text")).alias("nodes")
    constant = cut(often.join(counted, "host").where(f"n >= {TEMPLATE_SHARE} * pages").groupBy("host").agg(F.first("pages").alias("pages"), nodes), "constant")
    size = constant.agg(F.sum(F.size("nodes")).alias("n")).first().n or 0

    def rows(batches):
        known: dict[str, set[tuple[int, int]]] = {}
        votes: dict[tuple[str, int, int], list[int]] = {}
        best: dict[str, tuple[int, int, dict]] = {}

        def told():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in votes], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))] + [pa.array([v[i] for v in votes.values()], pa.int64()) for i in (0, 1)] + [pa.nulls(len(votes), t) for t in (pa.int64(), pa.int64(), _TREE)], names=names_
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.string())] + [pa.nulls(len(best), pa.int64())] * 4 + [pa.array([v[i] for v in best.values()], t) for i, t in enumerate((pa.int64(), pa.int64(), _TREE))], names=names_
            )
            votes.clear()
            best.clear()

        for batch in batches:
            for b in slices(batch):
                found = b.column("nodes")
                for i, (host, tree, sizes, whole) in enumerate(zip(*(b.column(c).to_pylist() for c in ("host", "tree", "sizes", "size")), strict=True)):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = {(x["key"], x["text"]) for x in found[i].as_py()}
                    held, same = set(), 0
                    for k, t, n in zip(tree["key"], tree["text"], sizes, strict=True):
                        if t != -1 and (k, t) in known[host]:
                            held.add((k, t))
                            same += n
                    copy = same > COPY_SHARE * max(1, whole)
                    for k, t in (*held, (0, -1)):
                        votes.setdefault((host, k, t), [0, 0])[copy] += 1
                    if not copy and (host not in best or len(held) >= best[host][0]):
                        mine = (len(held), hash((*tree["key"], *tree["text"])))
                        if host not in best or mine > best[host][:2]:
                            best[host] = (*mine, pruned(tree, held))
                    if len(votes) > VOTES:
                        yield from told()
        yield from told()

    names_ = ["host", "key", "text", "n", "copies", "rank", "tie", "tree"]
    votes = cut(_by_host(read, constant, size).select("host", "tree", "sizes", "size", "nodes").mapInArrow(rows, f"host string, key long, text long, n long, copies long, rank long, tie long, tree {TREE}"), "votes")
    sums = votes.where("tree IS NULL").groupBy("host", "key", "text").agg((F.sum("n") + F.least(F.sum("copies"), F.lit(1))).alias("n"))
    whole = sums.where(f"text = -1 AND n >= {TEMPLATE_PAGES}").select("host", F.col("n").alias("whole"))
    template = sums.where("text <> -1").join(whole, "host").where(f"n >= {TEMPLATE_SHARE} * whole").groupBy("host").agg(nodes)
    wrapper = votes.where("tree IS NOT NULL").groupBy("host").agg(F.max_by("tree", F.struct("rank", "tie")).alias("wrapper"))
    return template.join(wrapper, "host").join(constant.select("host", "pages"), "host").select("host", "pages", "nodes", "wrapper")


def renamed(tree: Node, template: set[tuple[int, int]], wrapper: Node | None) -> set[int]:
    """Identities of the leaves that tree matching pairs with a template node of the same text and another path."""
    if wrapper is None or template <= {(n.key, n.text) for n in with_text(tree) if not n.blocks}:
        return set()
    pairs: list[tuple[Node, Node]] = []
    align(wrapper, tree, pairs)
    return {id(q) for p, q in pairs if not p.blocks and not q.blocks and p.text == q.text and p.key != q.key}


def main_text(page: str, template: set[tuple[int, int]], wrapper: Node | None = None) -> str:
    tree = skeleton(parse(page))
    others = renamed(tree, template, wrapper)
    found: list[tuple[int, int, Node]] = []
    _roots(tree, found, "article main")
    if not found:
        _roots(tree, found, "")
    inside = bool(found)
    roots = [n for is_article, _, n in found if is_article] or [max(found, key=lambda x: x[:2])[2] if found else next((n for n in _walk(tree) if n.tag == "body"), tree)]
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        t = plain("".join(held))
        if t:
            blocks.append(t)
        held.clear()

    todo: list = [x for root in reversed(roots) for x in (None, root)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif not any(x is r for r in roots) and furniture(x, inside):
            if x.tag not in INLINE:
                flush()
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.parts)
        elif template and x.key is not None and ((x.key, x.text) in template or id(x) in others) and x.tag not in ("h1", "title"):
            flush()
        elif not inside and _linked(x):
            flush()
        elif x.words is not None:
            flush()
            if x.words:
                blocks.append(x.words)
        else:
            flush()
            todo.append(None)
            todo += reversed(x.parts)
    flush()
    return "\n".join(blocks)


def _walk(node: Node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += reversed(n.children)


def _roots(node: Node, found: list, tags: str) -> None:
    """Outermost articles (of tag, role or, without tags, name) that aren't furniture, with their text's length."""
    stack = [node]
    while stack:
        n = stack.pop()
        if n is not node:
            a = attributes(n) if n.attrs.strip() else {}
            hit = n.tag in tags.split() or a.get("role", "") in ("main", "article") if tags else n.tag in ("div", "section", "td") and bool(names(n) & MAIN_NAMES)
            if furniture(n, False):
                continue
            if hit and own_text(n):
                inner: list = []
                if n.tag == "main" or not tags:
                    _roots(n, inner, "article")
                if len(inner) > 1 and n.tag == "main":  # several articles and what stands between them
                    inner = [(True, len(own_text(n)), n)]
                found += inner or [(n.tag == "article", len(own_text(n)), n)]
                continue
        stack += reversed(n.children)


def _linked(node: Node) -> bool:
    """Whether nearly all text of a list, table or division is link text."""
    if node.tag not in ("ul", "ol", "dl", "table", "div", "section", "p"):
        return False
    whole = len(own_text(node))
    links = sum(len(own_text(n)) for n in _walk(node) if n.tag == "a")
    return whole > 0 and links > 0.8 * whole and sum(n.tag == "a" for n in _walk(node)) > 1


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the article's blocks in page order, joined by a line feed.

    Null and empty html give an empty text and n_chars 0; a null url is a host of its own. Of several articles all are
    kept, in a main element with what stands between them. Pages without an article or main element are read from the
    division named as such, else from the body. What is the same on nearly all pages of a host goes, however long; pages
    that are copies of each other keep their text. Repeated rows give one row each; extra
    columns are ignored; an empty table gives an empty result.
    """
    hosted = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1), F.lit(""))).alias("host"))
    template = cut(induce(hosted), "template")
    size = template.agg(F.sum(F.size("nodes") + F.size("wrapper.key")).alias("n")).first().n or 0
    if size <= BROADCAST_NODES:
        joined = hosted.join(F.broadcast(template.drop("pages")), "host", "left")
    else:
        every = hosted.groupBy("host").agg(F.count("*").alias("pages")).join(template.drop("pages"), "host", "left")
        none = {"nodes": F.expr("CAST(array() AS array<struct<key: long, text: long>>)"), "wrapper": F.expr(f"named_struct('parent', CAST(array() AS array<int>), 'tag', CAST(array() AS array<string>), 'key', CAST(array() AS array<long>), 'text', CAST(array() AS array<long>))")}
        joined = _by_host(hosted, cut(every.withColumns({c: F.coalesce(c, e) for c, e in none.items()}), "hosts"), size)

    def rows(batches):
        known: dict[str, tuple[set[tuple[int, int]], Node | None]] = {}
        for batch in batches:
            for b in slices(batch):
                texts = []
                for i, (host, page) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        nodes = {(x["key"], x["text"]) for x in b.column("nodes")[i].as_py() or ()}
                        known[host] = nodes, grown(pruned(b.column("wrapper")[i].as_py(), nodes)) if nodes else None
                    texts.append(main_text(page, *known[host]) if page else "")
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "nodes", "wrapper").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
