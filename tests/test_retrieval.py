"""Retrieval against brute force: terms, BM25, bounds, nearest vectors, fusion."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkatlas.operators import retrieval


def test_terms_cut_identifiers(spark):
    text = "MutateAdmission snake_case __init__ HTTPServer2Go x1 Étude_Ünï plain don't"
    got = spark.range(1).select(retrieval.terms(F.lit(text)).alias("t")).first().t
    assert got == ["mutate", "admission", "snake", "case", "init", "httpserver2", "go", "x1", "étude", "ünï", "plain", "don", "t", "mutateadmission", "snake_case", "httpserver2go", "étude_ünï"]
    assert spark.range(1).select(retrieval.terms(F.lit(None).cast("string")).alias("t")).first().t == []


def brute(docs, queries, k):
    n, total = len(docs), sum(map(len, docs.values()))
    out = set()
    for q, words in queries.items():
        scores = {}
        for w in set(words):
            df = sum(w in d for d in docs.values())
            for i, d in docs.items():
                if tf := d.count(w):
                    part = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / (total / n)))
                    scores[i] = scores.get(i, 0) + math.floor(1e6 * math.log(1 + (n - df + 0.5) / (df + 0.5)) * part)
        out |= {(q, i, s, r) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_equals_brute_force(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    weights = [1000 // (i + 1) for i in range(40)]
    docs = {i: rng.choices(words, weights, k=rng.randrange(0, 60)) for i in range(120)} | {500: ["w39"] * 9, 501: ["w39"] * 9}
    queries = {i: rng.choices(words, k=rng.randrange(1, 6)) for i in range(25)} | {90: ["w0", "w1", "w39"], 91: ["none"]}
    table = spark.createDataFrame([*((i, " ".join(d)) for i, d in docs.items()), (None, "w39")], "id long, text string")
    asked = spark.createDataFrame([*((q, " ".join(w)) for q, w in queries.items()), (None, "w1"), (92, None)], "query_id long, text string")
    index = retrieval.build(table)
    got = {tuple(r) for r in retrieval.search(index, asked, k).select("query_id", "key", "score", "rank").collect()}
    assert got == brute(docs, queries, k)
    with pytest.raises(ValueError):
        retrieval.search(index, asked, 0)


def test_search_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert retrieval.search(retrieval.build(empty), spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    x[70] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (205, [1.0, 2.0]), (None, x[3].tolist())]
    vectors = spark.createDataFrame(rows, "key long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([*((i, x[i].tolist()) for i in range(9)), (50, [3.0, 1.0]), (51, None)], "query_id long, vector array<double>")
    got = {(r.query_id, r.rank): (r.key, r.similarity) for r in retrieval.nearest(asked, vectors, 5).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(9):
        near = np.round(u @ u[q], 12)
        order = sorted(range(80), key=lambda i: (-near[i], i))[:5]
        assert [got[q, r + 1][0] for r in range(5)] == order
    assert got[50, 1][0] == 205 and len(got) == 46


def test_fusion_of_lists(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, key long, rank int")
    two = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (3, 9, 1)], "query_id long, key long, rank int")
    got = {(r.query_id, r.key): (r.rank, r.score) for r in retrieval.fuse([(one, 1.0), (two, 0.5)]).collect()}
    assert got[1, 11] == (1, 1 / 62 + 0.5 / 61) and got[1, 10] == (2, 1 / 61) and got[1, 12] == (3, 0.5 / 62) and got[2, 10][0] == got[3, 9][0] == 1
    tied = retrieval.fuse([(one, 1.0), (one.select("query_id", (21 - F.col("key")).alias("key"), "rank"), 1.0)], 1).where("query_id = 1").collect()
    assert [r.key for r in tied] == [10] and len(got) == 5
