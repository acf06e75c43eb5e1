"""Ranked retrieval: an inverted index with BM25 impacts, top-k under score bounds, nearest vectors and rank fusion.

Impacts are whole numbers, so that sums don't depend on their order and ties are ties on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Saturation and length weight of BM25, and the constant of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Units of a score of one, impacts kept for each term's bound (the largest k that can be asked for), queries compared at a time.
UNIT, BOUND_DEPTH, QUERY_BLOCK = 1_000_000, 100, 512
#: Pairs of a posting and a query that a task sums at a time.
PAIRS = 500_000

_CAMEL, _WORD, _PART = r"([\p{Ll}\p{N}])(\p{Lu})", r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}]+"
_COMPOUND = r"[\p{Ll}\p{N}]\p{Lu}|[\p{L}\p{N}]_+[\p{L}\p{N}]"


def terms(text: Column) -> Column:
    """Lower-cased terms of a text: words cut at underscores and before capitals, and words that were cut as a whole too."""
    text = F.coalesce(text, F.lit(""))
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(text, _CAMEL, "$1 $2")), F.lit(_PART), 0)
    whole = F.transform(F.filter(F.regexp_extract_all(text, F.lit(_WORD), 0), lambda w: w.rlike(_COMPOUND)), F.lower)
    return F.concat(parts, whole)


@dataclass
class Index:
    """``postings(term, key, impact)``, and ``lists(term, docs, top)`` with the largest impacts of a term, descending."""

    postings: DataFrame
    lists: DataFrame


def build(docs: DataFrame, key: str = "id", text: str = "text") -> Index:
    """The inverted index of ``docs``: every text whole, each (term, text) one posting.

    A null text has no terms but counts as a text. Rows of one key count as one text each for the lengths and are one
    text in the postings; rows of a null key are left out.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), terms(F.col(text)).alias("t")).where("key IS NOT NULL")
    found = cut(docs.select("key", F.explode("t").alias("term")).groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf")), "postings")
    lengths = cut(found.groupBy("key").agg(F.sum("tf").alias("length")), "lengths")
    whole = docs.agg(F.count_distinct("key").alias("n")).crossJoin(lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total")))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    x = found.join(df, "term").join(lengths, "key").crossJoin(F.broadcast(whole))  # one row
    rare = F.log(1 + (F.col("n") - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    near = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (F.col("total") / F.col("n"))))
    postings = cut(x.select("term", "key", F.floor(UNIT * rare * near).cast("long").alias("impact")), "impacts")
    by_impact = Window.partitionBy("term").orderBy(F.desc("impact"))
    best = postings.select("term", "impact", F.row_number().over(by_impact).alias("r")).where(F.col("r") <= BOUND_DEPTH)
    tops = best.groupBy("term").agg(F.sort_array(F.collect_list("impact"), asc=False).alias("top"))
    return Index(postings, cut(df.join(tops, "term"), "lists"))


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best texts of every ``queries(query_id, text)``, ties by key.

    A query's terms are ordered by the largest impact in their lists. The k-th largest impact of any one list is reached
    by k texts, so it bounds the k-th score from below; texts that hold only terms whose largest impacts together stay
    under that bound can't be among the k. Candidates thus come from the lists of the other terms alone. The terms are sent
    in blocks of QUERY_BLOCK queries; postings of them are dealt by text, and a task sums the scores of its texts and keeps
    the k best of each query, so that no more than k rows a query leave a task and no pair of a query and a text is
    shuffled. Queries without a known term have no rows.
    """
    if not 1 <= k <= BOUND_DEPTH:
        raise ValueError(f"k must be 1 to {BOUND_DEPTH}")
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    asked = asked.join(index.lists, "term").select("query_id", "term", F.col("top")[0].alias("most"), F.coalesce(F.get("top", F.lit(k - 1)), F.lit(0)).alias("kth"))
    per, ascending = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("most", "term")
    asked = asked.withColumn("floor", F.max("kth").over(per)).withColumn("below", F.sum("most").over(ascending.rowsBetween(Window.unboundedPreceding, 0)))
    asked = cut(asked.select("query_id", "term", (F.col("below") >= F.col("floor")).alias("opens")), "asked")
    found, held, ids = None, [], set()
    for row in asked.orderBy("query_id").toLocalIterator():
        if row.query_id not in ids and len(ids) == QUERY_BLOCK:
            found, held, ids = _scored(found, index, held, k), [], set()
        ids.add(row.query_id)
        held.append(row)
    if held or found is None:
        found = _scored(found, index, held, k)
    return ranked(found, F.desc("score"), k)


def _scored(before: DataFrame | None, index: Index, held: list, k: int) -> DataFrame:
    """Adds the k best texts that each task finds for a block of (query_id, term, opens), which is sent to all."""
    spark = index.postings.sparkSession
    queries, words = sorted({r.query_id for r in held}), sorted({r.term for r in held})
    number, place = {q: i for i, q in enumerate(queries)}, {w: i for i, w in enumerate(words)}
    by_word = sorted((place[r.term], number[r.query_id], r.opens) for r in held)
    of, opens = np.array([x[1] for x in by_word], np.int64), np.array([x[2] for x in by_word], bool)
    many = np.bincount(np.array([x[0] for x in by_word], np.int64), minlength=len(words))
    sent = spark.sparkContext.broadcast((np.array(queries, np.int64), many, np.cumsum(many) - many, of, opens))  # at most QUERY_BLOCK queries

    def rows(batches):
        ids, many, first, of, opens = sent.value
        score, mine = np.full((len(ids), 0), -1.0), np.full((len(ids), 0), 0, np.int64)

        def scored(keys, words, impacts):
            """The best of before and of whole texts, whose postings follow one another."""
            new = np.r_[True, keys[1:] != keys[:-1]]
            texts, text = keys[new], np.cumsum(new) - 1
            n = many[words]
            at = np.repeat(np.arange(len(words)), n)
            pair = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[words][at]
            cell, shape = of[pair] * len(texts) + text[at], (len(ids), len(texts))
            sums = np.bincount(cell, weights=impacts[at], minlength=len(ids) * len(texts)).reshape(shape)
            known = np.bincount(cell[opens[pair]], minlength=len(ids) * len(texts)).reshape(shape) > 0
            s, m = np.hstack([score, np.where(known, sums, -1.0)]), np.hstack([mine, np.broadcast_to(texts, shape)])
            order = np.lexsort((m, -s), axis=1)[:, :k]
            return np.take_along_axis(s, order, 1), np.take_along_axis(m, order, 1)

        parts, size = [], 0
        for b in batches:
            parts.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "word", "impact")])
            size += int(many[parts[-1][1]].sum())
            if size < PAIRS:
                continue
            keys, words, impacts = (np.concatenate(x) for x in zip(*parts, strict=True))
            end = int(np.searchsorted(keys, keys[-1]))  # the last text may go on
            if end:
                score, mine = scored(keys[:end], words[:end], impacts[:end])
            parts, size = [[keys[end:], words[end:], impacts[end:]]], 0
        if parts:
            keys, words, impacts = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(keys):
                score, mine = scored(keys, words, impacts)
        got = score >= 0
        who = np.broadcast_to(ids[:, None], score.shape)
        yield pa.RecordBatch.from_arrays([pa.array(who[got]), pa.array(mine[got]), pa.array(score[got].astype(np.int64))], names=["query_id", "key", "score"])

    numbers = spark.createDataFrame(list(place.items()), "term string, word int")
    near = index.postings.join(F.broadcast(numbers), "term").select("key", "word", "impact").repartition("key").sortWithinPartitions("key")
    found = near.mapInArrow(rows, "query_id long, key long, score long")
    return found if before is None else before.union(found)


def ranked(scores: DataFrame, order: Column, k: int | None) -> DataFrame:
    """Rows with their rank (from 1) within query_id; of equal ones the smaller key comes first."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "key")))
    return out if k is None else out.where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, key, similarity, rank): the ``k`` nearest of ``vectors(key, vector)`` to every ``queries(query_id, vector)``.

    Exact cosine in double precision, to twelve decimals, ties by key. The queries are sent in blocks of QUERY_BLOCK, and
    a task keeps the k best of its rows for each, so that no more than k rows a query leave a task. Null, empty and zero
    vectors, vectors with null or non-finite components and vectors of another length than the query's have no rows.
    """
    found = None
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    todo: list = []
    for row in asked.orderBy("query_id").toLocalIterator():
        todo.append((row.query_id, row.vector))
        if len(todo) == QUERY_BLOCK:
            found, todo = _block(found, vectors, todo, k), []
    if todo or found is None:
        found = _block(found, vectors, todo, k)
    return ranked(found, F.desc("similarity"), k)


def _unit(v: list | None) -> np.ndarray | None:
    if not v or any(x is None for x in v):
        return None
    x = np.array(v, float)
    size = np.abs(x).max()
    if not np.isfinite(size) or size == 0 or np.isnan(x).any():
        return None
    x = x / size
    return x / np.sqrt(x @ x)


def _block(before: DataFrame | None, vectors: DataFrame, asked: list, k: int) -> DataFrame:
    by_size: dict[int, tuple[list, list]] = {}
    for i, v in asked:
        if (u := _unit(v)) is not None:
            ids, units = by_size.setdefault(len(u), ([], []))
            ids.append(i)
            units.append(u)
    sent = vectors.sparkSession.sparkContext.broadcast({n: (ids, np.stack(units)) for n, (ids, units) in by_size.items()})  # at most QUERY_BLOCK vectors

    def rows(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            given: dict[int, tuple[list, list]] = {}
            for key, v in zip(batch.column("key").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                u = _unit(v)
                if u is not None and len(u) in sent.value:
                    keys, units = given.setdefault(len(u), ([], []))
                    keys.append(key)
                    units.append(u)
            for n, (keys, units) in given.items():
                near = np.round(sent.value[n][1] @ np.stack(units).T, 12)
                mine = np.broadcast_to(np.array(keys), near.shape)
                if n in best:
                    near, mine = np.hstack([best[n][0], near]), np.hstack([best[n][1], mine])
                order = np.lexsort((mine, -near), axis=1)[:, :k]
                best[n] = np.take_along_axis(near, order, 1), np.take_along_axis(mine, order, 1)
        for n, (near, mine) in best.items():
            ids = np.repeat(np.array(sent.value[n][0]), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(mine.ravel(), pa.int64()), pa.array(near.ravel())], names=["query_id", "key", "similarity"])

    plain = vectors.where("key IS NOT NULL").select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    found = plain.mapInArrow(rows, "query_id long, key long, similarity double")
    return found if before is None else before.union(found)


def fuse(lists: list[tuple[DataFrame, float]], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """(query_id, key, score, rank) of ranked ``lists`` of (query_id, key, rank) with their weights, by reciprocal ranks.

    A text that a list doesn't hold gets nothing from it. The lists are joined in full outer joins, each on
    (query_id, key), so they must hold a text once a query; the sum is made in the lists' order, ties go by key.
    """
    whole = None
    for i, (ranks, _) in enumerate(lists):
        one = ranks.select("query_id", "key", F.col("rank").alias(f"rank_{i}"))
        whole = one if whole is None else whole.join(one, ["query_id", "key"], "full")
    score: Column = F.lit(0.0)
    for i, (_, weight) in enumerate(lists):
        score = score + F.coalesce(F.lit(float(weight)) / (constant + F.col(f"rank_{i}")), F.lit(0.0))
    return ranked(whole.select("query_id", "key", score.alias("score")), F.desc("score"), k)
