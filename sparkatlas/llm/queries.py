"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_dedup, fim, html_extract, license_scan, line_dedup, lm_score, ngram_join, packing, quality, spelling, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_html_extract(spark, sf_dir):
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op9_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_lm_score(spark, sf_dir):
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op12_fim(spark, sf_dir):
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_license_scan, op3_html_extract, op4_toxicity, op5_embedding_dedup, op6_substring_dedup, op7_line_dedup, op8_packing, op9_decontamination, op10_quality, op11_lm_score, op12_fim, op13_spelling, pipeline)}

ORACLE = {
    "op1_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g
            FROM w),
        n AS (SELECT doc_id, len(g) AS n FROM s),
        e AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
        r AS (SELECT doc_id AS root, doc_id AS node FROM n UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.node),
        c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id FROM n JOIN c ON c.node = n.doc_id""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
              WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
        r AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.node),
        c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id""",
    "op7_line_dedup": """
        WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l0 AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
        l1 AS (SELECT doc_id, pos, line, list_transform(list_filter(regexp_split_to_array(line, '[ \\t\\r\\f\\v]+'), lambda x: x <> ''),
                    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM l0),
        l AS (SELECT doc_id, pos, line, t, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf, array_to_string(t, ' ') AS form FROM l1),
        f AS (SELECT DISTINCT doc_id, leaf, form, t FROM l WHERE len(t) > 0),
        x AS (SELECT leaf, form, count(*) AS docs, min(doc_id) AS first FROM f GROUP BY leaf, form),
        g1 AS (SELECT f.doc_id, f.form FROM f JOIN x USING (form) WHERE x.docs >= 8 AND f.doc_id <> x.first),
        v AS (SELECT leaf, sum(docs) AS docs FROM x GROUP BY leaf HAVING sum(docs) >= 8 AND count(*) > 1),
        o AS (SELECT f.* FROM f JOIN v USING (leaf)),
        w AS (SELECT leaf, place, token, count(*) AS c FROM (SELECT leaf, generate_subscripts(t, 1) AS place, unnest(t) AS token FROM o) GROUP BY ALL),
        m AS (SELECT w.leaf, w.place, max({'c': w.c, 'token': w.token}) AS m FROM w GROUP BY 1, 2),
        k AS (SELECT m.leaf, m.place, m.m.token AS token FROM m JOIN v USING (leaf) WHERE m.m.c >= 0.5 * v.docs),
        a AS (SELECT y.leaf, y.doc_id, y.form FROM (SELECT leaf, doc_id, form, len(t) AS n, generate_subscripts(t, 1) AS place, unnest(t) AS token FROM o) y
              JOIN k ON k.leaf = y.leaf AND k.place = y.place AND k.token = y.token GROUP BY y.leaf, y.doc_id, y.form, y.n HAVING count(*) >= 0.75 * y.n),
        b AS (SELECT leaf, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM a GROUP BY leaf HAVING count(DISTINCT doc_id) >= 8),
        gone AS (SELECT doc_id, form FROM g1 UNION SELECT a.doc_id, a.form FROM a JOIN b USING (leaf) WHERE a.doc_id <> b.first),
        z AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.doc_id IS NULL) AS text, count(*) AS n, count(gone.doc_id) AS m
              FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.form = l.form AND len(l.t) > 0 GROUP BY l.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(z.text, '') END AS text,
               CAST(CASE WHEN d.text IS NULL THEN 0 ELSE z.n END AS INTEGER) AS n_lines, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE z.m END AS INTEGER) AS n_dropped
        FROM d JOIN z USING (doc_id)""",
    "op12_fim": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        x AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                     CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                     least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM x),
        c AS (SELECT *, left(t, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f),
        o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END AS output FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o""",
    "op13_spelling": """
        WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
        r AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+'), lambda x: length(x) >= 7)) AS run FROM documents),
        g AS (SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
        h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
                lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS h FROM g, tab),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
              WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        d AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
        p AS (SELECT x.word AS a, y.word AS b, y.n AS n FROM d x JOIN d y ON x.v = y.v AND x.i = y.i AND x.word <> y.word
              UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.v UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.v),
        k AS (SELECT a AS word, count(*) AS n_near, min({'n': -n, 'b': b}) AS m FROM p GROUP BY a),
        f AS (SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN -k.m.n >= 10 * w.n THEN k.m.b END AS form, CASE WHEN -k.m.n >= 10 * w.n THEN -k.m.n END AS form_n FROM w LEFT JOIN k USING (word)),
        c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
        t AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
        SELECT f.word, f.form, t.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN t USING (word)""",
}
