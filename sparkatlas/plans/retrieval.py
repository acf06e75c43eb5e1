"""Retrieval queries: items of ``benchmark`` asked of all ``documents`` and ``embeddings``, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval

#: Ranks kept of each list, of the fused one, and weights of the lexical and the vector list.
LIST, FUSED, LEXICAL, SEMANTIC = 50, 10, 1.0, 0.8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index = retrieval.build(_table(spark, sf_dir, "documents"), "doc_id")
    return retrieval.search(index, _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """An item asks by the vector that has its number."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return retrieval.nearest(items.join(vectors.withColumnRenamed("key", "query_id"), "query_id"), vectors, k)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"query_id": "item_id", "key": "doc_id"})


QUERIES = {
    "bm25_search": lambda spark, d: _named(_bm25(spark, d, FUSED)),
    "nearest_vectors": lambda spark, d: _nearest(spark, d, FUSED).withColumnsRenamed({"query_id": "item_id", "key": "vec_id"}),
    "rrf_fusion": lambda spark, d: _named(retrieval.fuse([(_bm25(spark, d, LIST), LEXICAL), (_nearest(spark, d, LIST), SEMANTIC)], FUSED)),
}


def _terms(t: str) -> str:
    parts = f"regexp_extract_all(lower(regexp_replace(coalesce({t}, ''), '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+')"
    whole = f"list_transform(list_filter(regexp_extract_all(coalesce({t}, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '[\\p{{Ll}}\\p{{N}}]\\p{{Lu}}|[\\p{{L}}\\p{{N}}]_+[\\p{{L}}\\p{{N}}]')), lambda w: lower(w))"
    return f"list_concat({parts}, {whole})"


_BM25 = f"""t AS (SELECT doc_id AS key, {_terms('text')} AS t FROM documents),
    tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(t) AS term FROM t) GROUP BY 1, 2),
    ln AS (SELECT key, CAST(sum(len(t)) AS BIGINT) AS length FROM t GROUP BY key),
    al AS (SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total FROM ln),
    df AS (SELECT term, count(*) AS docs FROM tf GROUP BY term),
    po AS (SELECT tf.term, tf.key, CAST(floor({retrieval.UNIT}.0::DOUBLE * ln(1 + (n - docs + 0.5::DOUBLE) / (docs + 0.5::DOUBLE))
            * (tf * ({retrieval.K1}::DOUBLE + 1) / (tf + {retrieval.K1}::DOUBLE * (1 - {retrieval.B}::DOUBLE + {retrieval.B}::DOUBLE * length / (CAST(total AS DOUBLE) / n))))) AS BIGINT) AS impact
            FROM tf JOIN df USING (term) JOIN ln USING (key) CROSS JOIN al),
    q AS (SELECT item_id AS query_id, unnest(list_distinct({_terms('text')})) AS term FROM benchmark),
    sc AS (SELECT query_id, key, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN po USING (term) GROUP BY 1, 2),
    lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM sc)"""
_NEAR = """v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    si AS (SELECT item_id AS query_id, y.key, round(list_cosine_similarity(x.e, y.e), 12) AS similarity FROM benchmark JOIN v x ON x.key = item_id CROSS JOIN v y),
    sem AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS INTEGER) AS rank FROM si)"""

ORACLE = {
    "bm25_search": f"WITH {_BM25} SELECT query_id AS item_id, key AS doc_id, score, rank FROM lex WHERE rank <= {FUSED}",
    "nearest_vectors": f"WITH {_NEAR} SELECT query_id AS item_id, key AS vec_id, similarity, rank FROM sem WHERE rank <= {FUSED}",
    "rrf_fusion": f"""WITH {_BM25}, {_NEAR},
        f AS (SELECT coalesce(a.query_id, b.query_id) AS item_id, coalesce(a.key, b.key) AS doc_id,
              0.0::DOUBLE + coalesce({LEXICAL}::DOUBLE / ({retrieval.RRF_K} + a.rank), 0.0::DOUBLE) + coalesce({SEMANTIC}::DOUBLE / ({retrieval.RRF_K} + b.rank), 0.0::DOUBLE) AS score
              FROM (SELECT * FROM lex WHERE rank <= {LIST}) a FULL JOIN (SELECT * FROM sem WHERE rank <= {LIST}) b ON a.query_id = b.query_id AND a.key = b.key),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f)
        SELECT * FROM r WHERE rank <= {FUSED}""",
}
