"""Substring dedup: repeated paragraphs by MinHash bands, repeated passages inside and across lines by window MinHash.

Two kinds of unit are sought in one scan. A *paragraph* is a line of MIN_WORDS words or more: its MinHash bands are
joined, colliding paragraphs are verified by exact Jaccard similarity. A *passage* is any run of LEAST words or more,
wherever its lines break. Every window of LEAST words is a unit of its own there, and its MinHash, the least of its
runs of ANCHOR words, is its only band of one row; windows that follow each other mostly share it, so about one word
in sixteen is kept. Equal windows have equal MinHashes, so none is missed. Collisions are extended word by word to
maximal runs and kept if these reach LEAST words. Both kinds are clustered by components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import cut, drop_cut, join_groups, slices
from .components import components
from .simjoin import bucket_components, verify_jaccard

#: Words of the shortest paragraph; wanted chance that a pair at the threshold collides; hash ranges whose counts bound an overlap.
MIN_WORDS, RECALL, BINS = 25, 0.998, 64
#: Words of the shortest passage, and of the runs (a multiple of four) whose least hash is a window's MinHash. REACH words beyond an anchor complete a window.
LEAST, ANCHOR = 50, 20
REACH = LEAST - ANCHOR
#: Documents that are extended against one leader in one group.
GROUP_DOCS = 256
#: Characters laid out together.
PORTION = 1_000_000

UNITS = """row long, doc_id long, anchors array<struct<key: long, pos: int, cs: int, ce: int>>,
    lines array<struct<start: int, length: int, n: int, h1: long, h2: long, bands: array<long>, bins: array<tinyint>>>"""


def tune(least: float, rows: int = 4, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows) with the fewest bands that miss a pair of similarity ``least`` with a chance of 1 - recall at most."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - least**rows))), rows


class Layout:
    """Several texts laid out as one run of words, each with its document and its place in code points."""

    def __init__(self, texts: list[str]):
        data = [T.encode(t) for t in texts]
        joined = b"\n".join(data)
        self.first = np.cumsum([0, *(len(d) + 1 for d in data)])  # first byte of each text
        self.h, self.start, self.end = T.words(joined)
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        a = np.frombuffer(joined, np.uint8)
        self.breaks = np.flatnonzero(a == 10)
        self.chars = None if joined.isascii() else np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
        self.word = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # first word of each text

    def place(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Code points of a text before the byte ``at``."""
        return (at - self.first[doc] if self.chars is None else self.chars[at] - self.chars[self.first[doc]]).astype(np.int32)


def sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f over every window, two steps an element whatever the width."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, x[-1])]).reshape(-1, width)
    ahead, behind = f.accumulate(blocks, axis=1).ravel(), f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(at: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the least run of ANCHOR words of every window of LEAST words."""
    if len(at.h) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    part = ANCHOR // 4
    r = T.runs(at.h, part)
    g = T.mix(sum(r[i * part : len(r) - (3 - i) * part] * T.PLACE[i] for i in range(4)))
    least = sliding(np.minimum, g, REACH + 1)
    least[at.doc[: len(least)] != at.doc[LEAST - 1 :]] = 0
    pad = np.zeros(REACH, np.uint64)
    most = sliding(np.maximum, np.concatenate([pad, least, pad]), REACH + 1)
    found = (most == g) & (most > 0)
    found[1:] &= g[1:] != g[:-1]
    p = np.flatnonzero(found)
    return p, g[p]


def paragraphs(at: Layout, k: int, bands: int, width: int, min_words: int, seeds: np.ndarray):
    """(document, start, length, n, h1, h2, bands, bins) of the lines of ``min_words`` words or more."""
    line = np.searchsorted(at.breaks, at.start)
    heads = np.flatnonzero(np.diff(line, prepend=-1))
    sizes = np.diff(heads, append=len(line))
    heads, sizes = heads[sizes >= min_words], sizes[sizes >= min_words]
    m = len(heads)
    if not m:
        return None
    held = sizes - k + 1
    ends = np.cumsum(held)
    which = np.repeat(np.arange(m), held)
    s = T.runs(at.h, k)[np.arange(ends[-1]) + np.repeat(heads - ends + held, held)]
    order = np.lexsort((s, which))
    s = s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (which[1:] != which[:-1])
    s, which = s[new], which[new]
    first = np.searchsorted(which, np.arange(m))
    n = np.diff(first, append=len(s))
    h1, h2 = np.add.reduceat(s, first), np.add.reduceat(T.mix(s ^ T.PLACE[14]), first)
    least = np.stack([np.minimum.reduceat(s * x, first) for x in seeds]).reshape(bands, width, m)
    key = T.mix((least * T.PLACE[:width, None]).sum(1, dtype=np.uint64) + T.mix(np.arange(bands, dtype=np.uint64))[:, None]).T
    bins = np.bincount(which * BINS + (s >> np.uint64(58)).astype(np.int64), minlength=m * BINS).reshape(m, BINS)
    doc = at.doc[heads]
    begin = np.concatenate([[0], at.breaks + 1])[line[heads]]
    end = np.concatenate([at.breaks, [at.first[-1] - 1]])[line[heads]]
    start = at.place(begin, doc)
    return doc, start, at.place(end, doc) - start, n, h1, h2, key, bins


def units(docs: DataFrame, k: int, bands: int, width: int, min_words: int) -> DataFrame:
    """The anchors and paragraphs of every row(row, doc_id, text) that has any."""
    seeds = T.mix(np.arange(1, bands * width + 1, dtype=np.uint64)) | np.uint64(1)

    def lists(values: pa.Array, doc: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)

    def table(rows, ids, texts):
        at = Layout(texts)
        p, key = anchors(at)
        doc = at.doc[p]
        marks = pa.StructArray.from_arrays(
            [pa.array(T.as_long(key)), pa.array((p - at.word[doc]).astype(np.int32)), pa.array(at.place(at.start[p], doc)), pa.array(at.place(at.end[p + ANCHOR - 1], doc))], ["key", "pos", "cs", "ce"]
        )
        marks = lists(marks, doc, len(ids))
        got = paragraphs(at, k, bands, width, min_words, seeds)
        doc, start, length, n, h1, h2, key, bins = got or (*(np.zeros(0, np.int64),) * 4, *(np.zeros(0, np.uint64),) * 2, np.zeros((0, bands), np.uint64), np.zeros((0, BINS), np.int64))
        wide = pa.array(bins.max(1, initial=0) > 127)
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BINS), pa.array(np.minimum(bins, 127).astype(np.int8).ravel()), mask=wide)
        banded = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(T.as_long(np.ascontiguousarray(key)).ravel()))
        ints = [pa.array(x.astype(np.int32)) for x in (start, length, n)]
        lines = pa.StructArray.from_arrays([*ints, pa.array(T.as_long(h1)), pa.array(T.as_long(h2)), banded, held], ["start", "length", "n", "h1", "h2", "bands", "bins"])
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), marks, lists(lines, doc, len(ids))], names=["row", "doc_id", "anchors", "lines"])

    def scan(batches):
        for b in batches:
            for x in slices(b, PORTION):
                yield table(x.column("row").to_pylist(), x.column("doc_id").to_pylist(), [t or "" for t in x.column("text").to_pylist()])

    return docs.mapInArrow(scan, UNITS).where("size(anchors) > 0 OR size(lines) > 0")


def repeated_lines(docs: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """Paragraphs of a cluster of more than one, with ``kept`` true for the first (doc_id, start) of each."""
    classes = found.groupBy("h1", "h2", "n").agg(F.min("pid").alias("id"), F.min_by(F.struct("row", "start", "length", "bands", "bins"), "pid").alias("at"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes, "classes")
    entries = classes.select(F.explode("at.bands").alias("key"), "id", F.col("size").alias("rank"), "n", F.floor(100 * F.col("n") / percent).cast("int").alias("top"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        spots = classes.join(ids, "id", "left_semi").select("id", "h1", "at.row", "at.start", "at.length")
        texts = spots.join(docs.select("row", "text"), "row").select("id", F.substring(F.col("text"), F.col("start") + 1, F.col("length")).alias("text"), "h1")
        return verify_jaccard(pairs, texts, k, percent)

    _, parts = bucket_components(entries, percent, verify, classes.select("id", "at.bins"))
    named = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster_id", F.coalesce("component", "id"))
    all_ = cut(found.join(named.select("h1", "h2", "n", "cluster_id"), ["h1", "h2", "n"]).select("row", "doc_id", "start", "length", "cluster_id"), "members")
    sizes = all_.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(F.struct("doc_id", "start", "row")).alias("first")).where("cluster_size > 1")
    return join_groups(all_, cut(sizes, "sizes"), "cluster_id", "cluster_size", "row").withColumn("kept", F.struct("doc_id", "start", "row") == F.col("first")).drop("first")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted(row, pos, after, run, l_row, l_pos, lead): hashes and steps of up to REACH words before or after a word.

    A place is wanted as the end of a run with its leader's end (l_row, l_pos), as such a leader's end (lead), or for
    its windows alone. ``edge`` is the outer edge of the word itself and ``steps`` hold the code points from one word's
    edge to the next one's, a byte each where they fit. A row's wants are distinct places of its own text, so a group
    is no larger than the text that it is joined with.
    """
    place = ["row", "pos", "after"]
    more = ["run", "l_row", "l_pos", "lead"]
    once = wanted.groupBy(*place).agg(*(F.max(c).alias(c) for c in more))
    asked = once.groupBy("row").agg(F.collect_list(F.struct("pos", "after", *more)).alias("asked"))

    def scan(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]
            for x in slices(b):
                for row, t, places in zip(*(c.to_pylist() for c in x.columns), strict=True):
                    at = Layout([t or ""])
                    h = (at.h >> np.uint64(32)).astype("<u4")
                    zero = np.zeros(len(h), np.int64)
                    starts, ends = at.place(at.start, zero), at.place(at.end, zero)
                    for want in places:
                        p, after = want["pos"], want["after"]
                        span = slice(p + 1, p + 1 + REACH) if after else slice(max(0, p - REACH), p)
                        step = 1 if after else -1
                        edges = ends[p : p + 1 + REACH] if after else starts[max(0, p - REACH) : p + 1][::-1]
                        steps = np.abs(np.diff(edges))
                        steps = steps.astype("u1" if steps.max(initial=0) < 256 else "<i4")
                        for c, v in zip(cols, (row, p, after, *(want[c] for c in more), h[span][::step].tobytes(), int(edges[0]), steps.tobytes()), strict=True):
                            c.append(v)
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*place, *more, "h", "edge", "steps"])

    rows = docs.select("row", "text").join(asked, "row").dropDuplicates(["row"])
    return rows.select("row", "text", "asked").mapInArrow(scan, "row long, pos int, after boolean, run int, l_row long, l_pos int, lead boolean, h binary, edge int, steps binary")


def edges(n: int, edge: int, steps: bytes, after: bool) -> np.ndarray:
    """Outer edges of the n words of a context, in code points."""
    far = np.cumsum(np.frombuffer(steps, "u1" if len(steps) == n else "<i4"), dtype=np.int64)
    return edge + far if after else edge - far


def extend(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Runs with ``words`` grown to both sides as far as the text equals the leader's; cs, ce, l_cs and l_ce follow.

    The ends of all runs of a document with one leading document are one row. Such rows stream by the marks of their
    leader, which are held once: a leader and GROUP_DOCS of its documents or so are a group, sorted so that the leader
    comes first, and a leader of many documents is split. Both lists are places of one text.
    """
    own = found.where("l_row IS NOT NULL").groupBy("row", "l_row").agg(F.collect_list(F.struct("run", "after", "l_pos", "h", "edge", "steps")).alias("ends"))
    lead = found.where("lead").groupBy(F.col("row").alias("l_row")).agg(F.collect_list(F.struct("pos", "after", "h", "edge", "steps")).alias("marks"))

    parts = own.groupBy("l_row").agg(F.ceil(F.count(F.lit(1)) / GROUP_DOCS).cast("int").alias("parts"))
    asked = own.join(parts, "l_row").select("l_row", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "row", "ends", F.lit(None).cast(lead.schema["marks"].dataType).alias("marks"))
    held = lead.join(parts, "l_row").select("l_row", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("row"), F.lit(None).cast(own.schema["ends"].dataType).alias("ends"), "marks")
    both = asked.union(held).repartition("l_row", "part").sortWithinPartitions("l_row", "part", F.col("row").asc_nulls_first())

    def scan(batches):
        held = {}
        for batch in batches:
            for x in slices(batch):
                out: dict[tuple[int, int], list] = {}
                for row, ends, marks in zip(*(x.column(c).to_pylist() for c in ("row", "ends", "marks")), strict=True):
                    if marks is not None:
                        held = {(m["pos"], m["after"]): m for m in marks}
                        continue
                    for e in ends:
                        m, after = held[e["l_pos"], e["after"]], e["after"]
                        p, q = np.frombuffer(e["h"], "<u4"), np.frombuffer(m["h"], "<u4")
                        n = min(len(p), len(q))
                        off = np.flatnonzero(p[:n] != q[:n])
                        n = int(off[0]) if len(off) else n
                        got = out.setdefault((row, e["run"]), [0, None, None, None, None])
                        got[0] += n
                        if n:
                            got[1 + after], got[3 + after] = int(edges(len(p), e["edge"], e["steps"], after)[n - 1]), int(edges(len(q), m["edge"], m["steps"], after)[n - 1])
                columns = list(zip(*((*k, *v) for k, v in out.items()), strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.int32()] * 6], strict=True)], names=["row", "pos", "grown", "own_b", "own_a", "their_b", "their_a"])

    # both ends of a run are in one row here, so a run comes out once
    got = both.mapInArrow(scan, "row long, pos int, grown int, own_b int, own_a int, their_b int, their_a int")
    more = [c for c in got.columns if c not in ("row", "pos")]
    rest = [c for c in runs.columns if c not in ("row", "pos")]
    both = runs.select("row", "pos", *rest, *[F.lit(None).cast("int").alias(c) for c in more]).union(got.select("row", "pos", *[F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in rest], *more))
    out = both.groupBy("row", "pos").agg(*[F.max(c).alias(c) for c in [*rest, *more]]).withColumn("words", F.expr("last - pos + 1 + grown"))
    for c, edge in (("cs", "own_b"), ("ce", "own_a"), ("l_cs", "their_b"), ("l_ce", "their_a")):
        out = out.withColumn(c, F.coalesce(edge, c))
    return out


def windows(lone: DataFrame) -> DataFrame:
    """(name, row, doc_id, cs, ce) of all windows of LEAST words around an anchor(row, doc_id, pos, key, cs, ce, b, sb, a, sa).

    b and a are its contexts, sb and sa their steps.
    """
    place = np.arange(REACH, dtype=np.uint64) * T.PLACE[13]

    def scan(batches):
        for x in batches:
            cols: list[list] = [[] for _ in range(5)]
            for row, doc, key, b, sb, a, sa, cs, ce in zip(*(c.to_pylist() for c in x.columns), strict=True):
                before, after = np.frombuffer(b, "<u4"), np.frombuffer(a, "<u4")
                starts, ends = edges(len(before), cs, sb, False), edges(len(after), ce, sa, True)
                for j in range(max(0, REACH - len(after)), min(REACH, len(before)) + 1):
                    words = np.concatenate([before[:j][::-1], after[: REACH - j]]).astype(np.uint64)
                    name = T.sum_name(T.mix(np.concatenate([words + place, np.array([key, j], np.int64).view(np.uint64)])))
                    for c, v in zip(cols, (name, row, doc, int(starts[j - 1]) if j else cs, int(ends[REACH - j - 1]) if j < REACH else ce), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.int32()) for c in cols[3:])], names=["name", "row", "doc_id", "cs", "ce"])

    return lone.select("row", "doc_id", "key", "b", "sb", "a", "sa", "cs", "ce").mapInArrow(scan, "name long, row long, doc_id long, cs int, ce int")


def repeated_runs(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Runs of LEAST words or more that occur twice; ``kept`` is false where an earlier (doc_id, row, place) has the same words.

    Every anchor is compared with the first occurrence of its key alone, its leader. Anchors of one document on one
    diagonal with one leader are one run, which is extended at both ends. Anchors of a run that doesn't reach LEAST
    words may still share a window with another member of their key: all their windows are named by hash and counted,
    so no pair of members is ever made.
    """
    lead = marks.groupBy("key").agg(F.min(F.struct("doc_id", "row", "pos", "cs", "ce")).alias("l"), F.count(F.lit(1)).alias("members")).where("members > 1")
    lead = cut(lead.selectExpr("key", "members", "l.doc_id AS l_doc", "l.row AS l_row", "l.pos AS l_pos", "l.cs AS l_cs", "l.ce AS l_ce"), "leaders")
    pairs = marks.join(lead, "key").where("row <> l_row OR pos <> l_pos").withColumn("diagonal", F.expr("pos - l_pos"))
    line = Window.partitionBy("row", "l_row", "diagonal").orderBy("pos")
    split = F.when(F.col("pos") - F.lag("pos").over(line) <= REACH + 1, None).otherwise(F.col("pos"))
    # a run has the place of its first anchor as its name, since an anchor has one leader
    chain = pairs.withColumn("head", split).withColumn("run", F.last("head", True).over(line))
    part = Window.partitionBy("row", "l_row", "diagonal", "run")
    chain = cut(chain.withColumn("last", (F.max("pos").over(part) + ANCHOR - 1).cast("int")).drop("head"), "chain")
    drop_cut(lead)
    runs = chain.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("l_doc").alias("l_doc"), F.first("l_row").alias("l_row"), F.first("last").alias("last"), F.min("l_pos").alias("l_pos"),
        F.min("cs").alias("cs"), F.max("ce").alias("ce"), F.min("l_cs").alias("l_cs"), F.max("l_ce").alias("l_ce"),
    )
    runs = cut(runs.withColumnRenamed("run", "pos").withColumn("l_last", F.expr("l_pos + last - pos")), "runs")
    wanted = runs.selectExpr("""inline(array(
        struct(row, pos, false AS after, pos AS run, l_row, l_pos, false AS lead), struct(row, last AS pos, true AS after, pos AS run, l_row, l_last AS l_pos, false AS lead),
        struct(l_row AS row, l_pos AS pos, false AS after, cast(null AS int) AS run, cast(null AS long) AS l_row, cast(null AS int) AS l_pos, true AS lead),
        struct(l_row AS row, l_last AS pos, true AS after, cast(null AS int) AS run, cast(null AS long) AS l_row, cast(null AS int) AS l_pos, true AS lead)))""")
    short = chain.where(f"members > 2 AND last - run + 1 < {LEAST}").select("row", "run", "last", "doc_id", "pos", "key", "cs", "ce")
    inner = short.where(f"pos > run OR pos + {ANCHOR - 1} < last").selectExpr(f"""inline(array(
        struct(row, pos, false AS after, cast(null AS int) AS run, cast(null AS long) AS l_row, cast(null AS int) AS l_pos, false AS lead),
        struct(row, pos + {ANCHOR - 1} AS pos, true AS after, cast(null AS int) AS run, cast(null AS long) AS l_row, cast(null AS int) AS l_pos, false AS lead)))""")
    found = cut(contexts(docs, wanted.union(inner)), "contexts")
    grown = cut(extend(runs, found), "grown")
    lone = short.join(grown.where(f"words < {LEAST}").selectExpr("row", "pos AS run"), ["row", "run"], "left_semi").dropDuplicates(["row", "pos"])
    lone = cut(lone, "lone")
    drop_cut(runs)
    drop_cut(chain)
    before, after = (found.where(f"after = {x}").selectExpr("row", "pos" if x == "false" else f"pos - {ANCHOR - 1} AS pos", f"h AS {h}", f"steps AS s{h}") for x, h in (("false", "b"), ("true", "a")))
    named = cut(windows(lone.join(before, ["row", "pos"]).join(after, ["row", "pos"])), "windows")
    drop_cut(found)
    drop_cut(lone)
    first = named.groupBy("name").agg(F.min(F.struct("doc_id", "row", "cs", "ce")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1")
    more = named.join(cut(first, "first"), "name").where("row <> l.row OR cs <> l.cs").selectExpr("row", "doc_id", "cs", "ce", "l.row AS l_row", "l.doc_id AS l_doc", "l.cs AS l_cs", "l.ce AS l_ce")
    links = cut(grown.where(f"words >= {LEAST}").select(*more.columns).union(more).distinct(), "run_links")
    drop_cut(grown)
    drop_cut(named)
    spans = links.selectExpr("inline(array(struct(doc_id, row, cs, ce, false AS kept), struct(l_doc AS doc_id, l_row AS row, l_cs AS cs, l_ce AS ce, true AS kept)))")
    spans = cut(spans.groupBy("doc_id", "row", "cs", "ce").agg(F.min("kept").alias("kept")).withColumn("node", F.xxhash64("row", "cs", "ce")), "spans")
    by_row = Window.partitionBy("row").orderBy("cs", "ce")
    touch = spans.select("node", "cs", F.lag("node").over(by_row).alias("b"), F.max("ce").over(by_row.rowsBetween(Window.unboundedPreceding, -1)).alias("reach")).where("cs < reach")
    parts = components(links.selectExpr("xxhash64(row, cs, ce) AS a", "xxhash64(l_row, l_cs, l_ce) AS b").union(touch.selectExpr("node AS a", "b")))
    out = spans.join(parts, "node").select("row", "doc_id", F.col("cs").alias("start"), F.expr("ce - cs AS length"), F.col("component").alias("cluster_id"), "kept")
    out = cut(out, "members")
    return join_groups(out, cut(out.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size")), "sizes"), "cluster_id", "cluster_size", "row")


def repeated_passages(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = MIN_WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, start, length, cluster_id, cluster_size, kept, kind, row) of every paragraph and passage that repeats.

    ``start`` and ``length`` count code points. Of kind ``line``: a line of at least ``min_words`` words; two belong
    together if the Jaccard similarity of their sets of k-word shingles is at least percent/100, and the occurrence of
    the smallest (doc_id, start) is kept. Of kind ``run``: a maximal run of LEAST equal words or more, inside a line or
    across lines, upper and lower case A-Z and white space set aside; where an earlier place holds the same words it
    isn't kept, so the first occurrence always stays. Clusters are the components of these links; runs of one document
    that overlap are in one cluster. Repeats inside one document count too, but not one word over and over. A line may be part of a run: both are
    given. Rows of equal doc_id and text are one document; rows that repeat a doc_id with other texts, or have none,
    are documents of their own, which ``row`` tells apart. Null and empty texts have no passage; extra columns are
    ignored; an empty table gives an empty result.
    """
    bands, width = tune(percent / 100, recall=recall)
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    found = cut(units(docs, k, bands, width, min_words), "units")
    lines = cut(found.selectExpr("row", "doc_id", "inline(lines)").withColumn("pid", F.monotonically_increasing_id()).dropDuplicates(["row", "start"]), "paragraphs")
    near = repeated_lines(docs, lines, k, percent).withColumn("kind", F.lit("line"))
    runs = repeated_runs(docs, found.selectExpr("row", "doc_id", "inline(anchors)")).withColumn("kind", F.lit("run"))
    out = ["doc_id", "start", "length", "cluster_id", "cluster_size", "kept", "kind", "row"]
    return near.select(*out).union(runs.select(*out))


def remove_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, text) without the passages that aren't kept; a line of which nothing is left goes with its line feed.

    Null texts become empty; rows without passages stay as they are; an empty table gives an empty result.
    """
    gone = passages.where("NOT kept").groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("gone"))

    def scan(batches):
        for b in batches:
            for x in slices(b):
                out = []
                for t, spans in zip(x.column("text").to_pylist(), x.column("gone").to_pylist(), strict=True):
                    t, at, kept = t or "", 0, []
                    for s in sorted(spans or (), key=lambda s: s["start"]):
                        end = s["start"] + s["length"]
                        if end > at:
                            kept.append(t[at : max(at, s["start"])])
                            whole = (max(at, s["start"]) == 0 or "".join(kept)[-1:] in ("", "\n")) and t[end : end + 1] == "\n"
                            at = end + whole
                    out.append("".join([*kept, t[at:]]))
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").join(gone, "row", "left")
    return rows.select("doc_id", "text", "gone").mapInArrow(scan, "doc_id long, text string")
