"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters, one verification per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, text_rows
from .simjoin import bucket_components, verify_jaccard

#: Counters of the document-frequency sketch and bins of the suffix filter: fixed sizes, whatever the corpus.
SKETCH_BITS, BINS = 18, 64


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """One row per document: doc_id, n, h1, h2, bins: set size, an order-free 128-bit name of the set, its counts by hash range.

    Every task adds a row of ``counts`` alone: how many documents of the task hold a shingle of each of the
    2**SKETCH_BITS hash ranges.
    """

    def rows(batches):
        seen, held, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for b in batches:
            ids, n, h1, h2, bins = [], [], [], [], []
            for i, t in text_rows(b):
                s = T.shingle_set(t, k)
                ids.append(i)
                n.append(len(s))
                h1.append(T.sum_name(s))
                h2.append(int(T.mix(s ^ T.PLACE[14]).sum(dtype=np.uint64).astype(np.int64)))
                bins.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS), 65535).astype("<u2").tobytes())
                held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                size += len(s)
                if size > 1 << 20:
                    seen += np.bincount(np.concatenate(held), minlength=len(seen))
                    held, size = [], 0
            yield _profile(ids, n, h1, h2, bins, [None] * len(ids))
        if held:
            seen += np.bincount(np.concatenate(held), minlength=len(seen))
        yield _profile([None], [None], [None], [None], [None], [np.minimum(seen, (1 << 32) - 1).astype("<u4").tobytes()])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n long, h1 long, h2 long, bins binary, counts binary")


def _profile(ids, n, h1, h2, bins, counts) -> pa.RecordBatch:
    longs = [pa.array(c, pa.int64()) for c in (ids, n, h1, h2)]
    return pa.RecordBatch.from_arrays([*longs, pa.array(bins, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "h1", "h2", "bins", "counts"])


def sketch(counts: DataFrame) -> np.ndarray:
    """The tasks' ``counts`` added up in two steps, so that neither a task nor the driver holds more than a few."""

    def add(batches):
        got = np.zeros(1 << SKETCH_BITS, np.uint64)
        for b in batches:
            for i in range(b.num_rows):
                x = b.column("counts")[i].as_buffer()
                got += np.frombuffer(x, "<u4" if x.size == 4 << SKETCH_BITS else "<u8")
        yield pa.RecordBatch.from_pydict({"counts": pa.array([got.tobytes()], pa.binary())})

    first = counts.repartition(max(1, round(counts.count() ** 0.5))).mapInArrow(add, "counts binary")
    found = first.repartition(1).mapInArrow(add, "counts binary").collect()
    return np.frombuffer(found[0].counts, "<u8") if found else np.zeros(1 << SKETCH_BITS, np.uint64)


def prefixes(texts: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """From texts(id, text, h1), those whose set has the name h1: (key, id, rank, n, top): the shortest rare-first prefix that any partner at the threshold must share a key with.

    top is the positional filter: if this is the first key that both share, a partner has ``top`` shingles at most.

    rank is the mean logarithm of the frequencies in the prefix: highest for the text that a group's copies derive from.
    """
    known = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def rows(batches):
        df = known.value
        for b in batches:
            key, ids, rank, n, top = [], [], [], [], []
            for i, t, name in text_rows(b, "id", more="h1"):
                s = T.shingle_set(t, k)
                m = len(s)
                if not m or T.sum_name(s) != name:
                    continue
                size = m - -(-percent * m // 100) + 1
                freq = df[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((s, freq))[:size]
                key.append(T.as_long(s[order]))
                ids.append(np.full(size, i, np.int64))
                rank.append(np.full(size, int(1000 * np.log2(freq[order] + 1.0).mean()), np.int32))
                n.append(np.full(size, m, np.int32))
                top.append(((100 + percent) * (m - np.arange(size, dtype=np.int64)) // percent - m).astype(np.int32))
            if key:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(key), "id": np.concatenate(ids), "rank": np.concatenate(rank), "n": np.concatenate(n), "top": np.concatenate(top)})

    return texts.mapInArrow(rows, "key long, id long, rank int, n int, top int")


def suffix_filter(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose counts by hash range bound their overlap below the threshold."""
    a = info.selectExpr("id AS a", "n AS na", "bins AS ba")
    b = info.selectExpr("id AS b", "n AS nb", "bins AS bb")

    def rows(batches):
        for x in batches:
            if not x.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(x.column(c).to_pylist()), "<u2").reshape(-1, BINS).astype(np.int32) for c in ("ba", "bb"))
            na, nb = x.column("na").to_numpy(), x.column("nb").to_numpy()
            full = (p == 65535) & (q == 65535)  # saturated counters bound nothing
            most = np.minimum(p, q).sum(1) + np.where(full.any(1), np.minimum(na, nb), 0)
            ok = (100 + percent) * most >= percent * (na + nb)
            yield pa.RecordBatch.from_pydict({"a": x.column("a").filter(pa.array(ok)), "b": x.column("b").filter(pa.array(ok))})

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(rows, "a long, b long")


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document: similarity classes under Jaccard >= percent/100.

    Texts with no word (null, empty, white space) have an empty set and are linked with nothing. With fewer than
    ``k`` words the whole sequence is the one shingle. Exact copies of a set form one class, whose smallest doc_id
    stands for it; links are sought between classes. Rows that repeat a doc_id are one document: it has the links of
    all its rows and the same component in each, and every row gives a row with its own n_shingles. A row whose doc_id
    is null can't be named: it is linked with nothing and its component is null. Extra columns are ignored. An empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    both = cut(profiles(docs, k), "profiles")
    info, counts = both.where("counts IS NULL").drop("counts"), sketch(both.where("counts IS NOT NULL").select("counts"))
    full = info.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")).withColumn("id", F.monotonically_increasing_id()), "classes")
    texts = docs.join(classes.selectExpr("rep AS doc_id", "id", "h1"), "doc_id").select("id", "text", "h1")
    entries = cut(prefixes(texts, k, percent, counts), "entries")
    bins = full.join(classes, ["h1", "h2", "n"]).where("doc_id = rep").select("id", "n", "bins").dropDuplicates(["id"])
    bins = cut(bins, "bins")

    def verify(pairs: DataFrame) -> DataFrame:
        return verify_jaccard(suffix_filter(pairs, bins, percent), texts, k, percent)

    # classes that one doc_id has rows of belong together
    owned = full.join(classes, ["h1", "h2", "n"]).select("doc_id", "id").distinct()
    least = owned.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    same_id = owned.join(least, "doc_id").where("id > a").selectExpr("a", "id AS b")
    _, found = bucket_components(entries, percent, verify, more=same_id)
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    named = named.join(named.groupBy("part").agg(F.min("rep").alias("component_id")), "part").select("h1", "h2", "n", "component_id")
    named = info.join(named, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every similarity class, that of the smallest doc_id; all columns stay.

    Rows without a word and rows whose doc_id is null are copies of nothing, and all of the latter stay. Of rows that repeat a doc_id one
    stays, any one of them if they differ.
    """
    kept = ngram_components(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return one.union(docs.where("doc_id IS NULL"))
