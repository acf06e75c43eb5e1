"""Embedding near-duplicates: a forest of random-projection trees with spill, comparison in leaves, union of the links."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Trees, vectors the upper trees are fitted on at most, rows of an upper and of a lower leaf, least share that spills at a split.
TREES, SAMPLE_ROWS, UPPER_LEAF, LEAF, SPILL, SEED = 10, 20_000, 3000, 256, 0.08, 13


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit binary doubles, raw name) of the vectors that may link."""

    def rows(batches):
        for b in batches:
            ids, labels, dims, units = [], [], [], []
            for i, label, v in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                if label is None or not v or any(x is None for x in v):
                    continue
                x = np.array(v, float)
                if not np.isfinite(x).all() or not x.any():
                    continue
                x = x / np.abs(x).max()
                ids.append(i)
                labels.append(label)
                dims.append(len(x))
                units.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.string()), "dim": pa.array(dims, pa.int32()), "unit": pa.array(units, pa.binary())})

    label = F.col("label")
    if vectors.schema["label"].dataType.typeName() in ("float", "double"):
        label = label + F.lit(0.0)  # of the two zeros one
    plain = vectors.where("vec_id IS NOT NULL").select("vec_id", label.cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(rows, "vec_id long, label string, dim int, unit binary")


def halves(p: np.ndarray, least: float) -> tuple[float, float] | None:
    """The ends of the band around the median that goes to both sides, or None if a split saves no comparisons.

    Projections of a link's ends differ by sqrt(2 - 2 least) or less in the mean square, and the band is at least as wide. Inside
    a group of near copies it holds most rows, so such a group is compared in full instead of being cut.
    """
    lo, mid, hi = np.quantile(p, [0.5 - SPILL, 0.5, 0.5 + SPILL])
    w = np.sqrt(max(0.0, 2 - 2 * least)) / 2
    lo, hi = min(lo, mid - w), max(hi, mid + w)
    left, right = int((p <= hi).sum()), int((p >= lo).sum())
    return (float(lo), float(hi)) if left * left + right * right < 0.9 * len(p) * len(p) else None


def grow(x: np.ndarray, share: float, total: float, leaf: int, rng: np.random.Generator, least: float = 0.93) -> dict | None:
    """A tree of random splits fitted on a sample of ``share * total`` rows; None is a leaf."""
    if share * total <= leaf or len(x) < 64:
        return None
    d = rng.normal(size=x.shape[1])
    p = x @ d
    ends = halves(p, least)
    if ends is None:
        return None
    lo, hi = ends
    left, right = x[p <= hi], x[p >= lo]
    part = share / len(x)
    return {"d": d, "lo": lo, "hi": hi, "left": grow(left, part * len(left), total, leaf, rng, least), "right": grow(right, part * len(right), total, leaf, rng, least)}


def route(tree: dict | None, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of every leaf that rows fall in; rows in a split's band fall in both sides."""
    out, todo = [], [(tree, 1, np.arange(len(x)))]
    while todo:
        t, name, at = todo.pop()
        if t is None:
            out.append((name, at))
            continue
        p = x[at] @ t["d"]
        todo += [(t["left"], 2 * name, at[p <= t["hi"]]), (t["right"], 2 * name + 1, at[p >= t["lo"]])]
    return out


def near_pairs(x: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Pairs of rows with cosine >= ``least`` found by splitting down to small leaves and comparing within."""
    found, todo = [], [(np.arange(len(x)), 0)]
    leaves = 0
    while todo:
        at, depth = todo.pop()
        if len(at) > LEAF and depth < 40:
            p = x[at] @ rng.normal(size=x.shape[1])
            ends = halves(p, least)
            if ends is not None:
                todo += [(at[p <= ends[1]], depth + 1), (at[p >= ends[0]], depth + 1)]
                continue
        leaves += 1
        y, step = x[at], max(1, 2_000_000 // max(1, len(at)))
        for s in range(0, len(at), step):  # blocks bound memory; the whole leaf is compared
            i, j = np.nonzero(y[s : s + step] @ y[s:].T >= least)
            ok = i < j
            found.append(at[i[ok] + s] * len(x) + at[j[ok] + s])  # ``at`` ascends
    keys = np.concatenate(found) if found else np.zeros(0, np.int64)
    if leaves > 1:
        keys = np.unique(keys)
    return np.column_stack(np.divmod(keys, max(1, len(x))))


def fit_forest(units: DataFrame, total: int, trees: int, least: float) -> list[dict | None]:
    """Upper trees fitted on at most SAMPLE_ROWS vectors of the most common dimension, those of the smallest hash."""
    rng = np.random.default_rng(SEED)
    if total <= UPPER_LEAF:
        return [None] * trees
    got = units.select("dim", "unit").orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).collect()
    dims = pd.Series([r.dim for r in got])
    dim = int(dims.mode()[0])
    x = np.stack([np.frombuffer(r.unit) for r in got if r.dim == dim])
    return [grow(x, 1.0, float(total), UPPER_LEAF, rng, least) for _ in range(trees)]


def near_duplicates(vectors: DataFrame, least: float = 0.93, trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Only vectors of one non-null label and one length are compared. Null, empty and zero vectors and those with null or
    non-finite components link with nothing. Equal vectors of a label are one class, linked throughout; the forest
    finds links between classes: every class is routed through all upper trees, compared within the leaves, and the
    verified pairs of all trees are united. Recall against brute force is measured in the tests. Labels of any type that has a text form are compared by it,
    the two zeros as one. Repeated vec_ids count as vectors of their own, each with its own links, but share a component. A row whose vec_id is null can't be named: it links with nothing, its component_id is null and it is kept. Extra columns are ignored; an empty table gives an empty result.
    """
    units = cut(unit_rows(vectors), "units")
    keyed = units.withColumn("name", F.sha2("unit", 256))
    classes = keyed.groupBy("label", "dim", "name").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("unit").alias("unit"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # a rep may stand for several classes, a number for one
    total = classes.count()
    forest = fit_forest(classes.select(F.col("rep").alias("vec_id"), "dim", "unit"), total, trees, least)
    sent = vectors.sparkSession.sparkContext.broadcast(forest)
    dims = {len(t["d"]) for t in forest if t}

    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            dim = b.column("dim").to_numpy()
            cols: list[list] = [[], [], []]
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                x = np.stack([np.frombuffer(u) for u in b.column("unit").take(pa.array(rows)).to_pylist()])
                for t, tree in enumerate(sent.value):
                    for leaf, at in route(tree if d in dims else None, x):
                        cols[0].append(rows[at])
                        cols[1].append(np.full(len(at), t, np.int32))
                        cols[2].append(np.full(len(at), leaf, np.int64))
            at = np.concatenate(cols[0])
            out = b.select(["class", "label", "dim", "unit"]).take(pa.array(at))
            yield out.append_column("tree", pa.array(np.concatenate(cols[1]), pa.int32())).append_column("leaf", pa.array(np.concatenate(cols[2]), pa.int64()))

    def compare(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(u) for u in table.column("unit").to_pylist()])
        name = table.column("class").to_numpy()
        seed = [SEED, int(table.column("tree")[0].as_py()), int(table.column("leaf")[0].as_py())]
        pairs = near_pairs(x, least, np.random.default_rng(seed))
        a, b = name[pairs[:, 0]], name[pairs[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    placed = classes.select("class", "label", "dim", "unit").mapInArrow(spread, "class long, label string, dim int, unit binary, tree int, leaf long")
    links = cut(placed.groupBy("label", "dim", "tree", "leaf").applyInArrow(compare, "a long, b long").where("a <> b").distinct(), "links")
    both = links.union(links.selectExpr("b AS a", "a AS b"))
    beside = both.join(classes.select(F.col("class").alias("b"), "size"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("others"))
    named = cut(keyed.select("vec_id", "label", "dim", "name").join(classes.select("label", "dim", "name", "class", "rep", "size"), ["label", "dim", "name"]), "named")
    # components of vec_ids: linked classes by their reps, and the classes that share a vec_id
    of = classes.select("class", "rep")
    edges = links.join(of.select(F.col("class").alias("a"), F.col("rep").alias("x")), "a").join(of.select(F.col("class").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    shared = named.groupBy("vec_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("vec_id")
    edges = edges.union(named.join(shared, "vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    found = components(edges)
    linked = named.join(beside, "class", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.select("vec_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    ids = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    bad = F.col("label").isNull() | F.col("e").isNull() | (F.size("e") == 0) | F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("e", lambda v: F.coalesce(v, F.lit(0.0)) != 0.0)
    alone = ids.where(F.col("vec_id").isNull() | F.coalesce(bad, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
