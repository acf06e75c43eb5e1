"""Links inside buckets without emitting all pairs of a bucket.

A bucket is the set of records that share a key (a prefix shingle, a MinHash band). Round one compares every
record with two leaders of each of its buckets, so the work is linear in the records even if one bucket holds a third
of them. Linked records fall into components. Round two pairs only records of one bucket that lie in different
components, so no link between components is lost, and links inside a component cannot change it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, drop_cut, slices
from .components import components

#: Pairs of one hub that are verified in one group.
GROUP_PAIRS = 256


def bucket_components(entries: DataFrame, percent: int, verify: Callable[[DataFrame], DataFrame], bins: DataFrame | None = None, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``entries(key, id, rank, n, top)`` -> (links(a, b), components(node, component)).

    Linked records differ in size n by the factor percent/100 at most, and in some bucket that both are in neither is
    larger than the other's ``top``; records whose top is below every size of a bucket drop out of it. The leaders of
    a bucket are its record of the highest rank, the likeliest to be linked with many, and of the least id, of those
    that may have a partner of their own size if there are any. ``verify`` takes distinct pairs (a < b) and returns
    those that are links. ``bins(id, bins)`` may give counts of a record's shingles by hash range; the sum of the smaller
    counts bounds the overlap and so spares round two most pairs (null: no bound). ``more(a, b)`` are links known beforehand.
    """
    e = F.struct("id", "n", "top")
    tight = F.col("top") < F.col("n")
    # most keys are of one record: they go before leaders are sought, so that little but keys is shuffled for them
    common = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where("members > 1")
    kept = cut(entries.join(common, "key").where("top >= least").select("key", "id", "rank", "n", "top"), "kept")
    lead = kept.groupBy("key").agg(
        F.min(F.struct(tight.alias("t"), e.alias("e")))["e"].alias("lo"), F.min(F.struct(tight.alias("t"), (-F.col("rank")).alias("r"), e.alias("e")))["e"].alias("hi"), F.count(F.lit(1)).alias("members")
    )
    shared = cut(kept.join(lead.where("members > 1"), "key").select("key", e.alias("e"), "lo", "hi", "members"), "shared")
    first = shared.select(F.explode(F.array(F.struct(F.col("e").alias("x"), F.col("lo").alias("y")), F.struct(F.col("e").alias("x"), F.col("hi").alias("y")))).alias("p")).select("p.x", "p.y")
    links = cut(verify(_pairs(first, percent)), "links")
    found = cut(components(links), "found")
    crowd = shared.where("members > 2 AND e.id <> lo.id AND e.id <> hi.id").select("key", "e", F.col("e.id").alias("node"))
    placed = cut(crowd.join(found, "node", "left").select("key", "e", F.coalesce("component", "node").alias("c")), "placed")
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("e.n").alias("least")).where("c0 <> c1").select("key", "least")
    open_ = cut(placed.join(mixed, "key").where("e.top >= least").select("key", "e", "c"), "open")
    may = _may_link(percent)
    if bins is not None:
        open_ = cut(open_.withColumn("id", F.col("e.id")).join(bins, "id").select("key", F.struct("e.*", "bins").alias("e"), "c"), "open")
        same = "aggregate(zip_with(x.bins, y.bins, (p, q) -> cast(least(p, q) AS int)), 0, (s, v) -> s + v)"
        may = f"{may} AND coalesce({100 + percent} * {same} >= {percent} * (x.n + y.n), true)"
    second = open_.selectExpr("key", "e AS x", "c AS cx").join(open_.selectExpr("key", "e AS y", "c AS cy"), "key").where(f"cx <> cy AND x.id < y.id AND {may}")
    links = links.union(cut(verify(_pairs(second.select("x", "y"), percent)), "links"))
    for t in (kept, shared, placed, open_):
        drop_cut(t)
    links = links if more is None else links.union(more)
    return links, components(links)


def _may_link(percent: int) -> str:
    return f"x.n <= y.top AND y.n <= x.top AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"


def _pairs(xy: DataFrame, percent: int) -> DataFrame:
    return xy.where(f"x.id <> y.id AND {_may_link(percent)}").selectExpr("least(x.id, y.id) AS a", "greatest(x.id, y.id) AS b").distinct()


def verify_jaccard(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets of k-word shingles reach the threshold, from the whole ``texts(id, text, h1)``.

    Of a pair the record with more pairs is the hub. A text is shuffled once, then goes to each group that needs it: a
    group is a hub and GROUP_PAIRS of its pairs or so, sorted so that the hub comes first and its set alone is kept
    while the others stream by. So no row holds two texts, and a hub of any number of pairs is split. A text whose
    set hasn't the name h1 is not the record's.
    """
    pairs = cut(pairs, "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    sized = pairs.join(degree.selectExpr("id AS a", "d AS da"), "a").join(degree.selectExpr("id AS b", "d AS db"), "b")
    spokes = sized.selectExpr("IF(da >= db, a, b) AS hub", "IF(da >= db, b, a) AS id", "greatest(da, db) AS d").selectExpr("id", "hub", f"pmod(xxhash64(id), ceil(d / {GROUP_PAIRS})) AS part", "true AS spoke")
    spokes = cut(spokes, "spokes")
    wanted = spokes.union(spokes.selectExpr("hub AS id", "hub", "part", "false AS spoke").distinct())
    rows = texts.join(wanted, "id").select("hub", "part", "spoke", "id", "text", "h1").repartition("hub", "part").sortWithinPartitions("hub", "part", "spoke")

    def verify(batches):
        at, base = None, None
        for batch in batches:
            a, b = [], []
            for x in slices(batch):
                for hub, part, spoke, i, t, name in zip(*(c.to_pylist() for c in x.columns), strict=True):
                    s = T.shingle_set(t or "", k)
                    if T.sum_name(s) != name:
                        continue
                    if not spoke:
                        at, base = (hub, part), s
                    elif at == (hub, part):
                        same = T.overlap(base, s)
                        if same and 100 * same >= percent * (len(base) + len(s) - same):
                            a.append(min(hub, i))
                            b.append(max(hub, i))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.mapInArrow(verify, "a long, b long").distinct()
