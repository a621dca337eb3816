"""The queries of the ten operators and of the pipeline, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import bpe, chat, embedding_dedup, media, ngram_join, packing, quality, token_files, toxicity, warc
from lexiloom.llm.common import scratch, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write(table(spark, sf_dir, "documents"), scratch(spark, "token-files"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), check=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "toxicity_score", "toxicity_reject")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classes(table(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.verify_archive(spark, table(spark, sf_dir, "pages"))


def warc_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same audit against a replica with spoilt, lost and added records."""
    return warc.drill(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "quality_score", "quality_keep")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.deduplicated(table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


#: Records, offsets and three levels of range hashes, as warc.py defines them, where no id has many rows.
_WARC = r"""
WITH body AS (
  SELECT page_id, coalesce(url, '') AS url,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(regexp_replace(url, '[\r\n]', ' ', 'g'), '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages),
rec AS (SELECT page_id, url, CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS digest, CAST(coalesce(page_id // 4096, -1) AS BIGINT) AS volume, coalesce(page_id % 4096 // 16, 0) AS slot FROM body),
placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM rec WINDOW w AS (PARTITION BY volume ORDER BY page_id NULLS FIRST, url, digest, length)),
one AS (SELECT volume, slot, digest, count(*) AS copies, min("offset") AS o, CAST(sum(length) AS BIGINT) AS l, page_id FROM placed GROUP BY volume, slot, digest, page_id),
s1 AS (SELECT *, min(o) OVER (PARTITION BY volume, slot) AS b FROM one),
l1 AS (SELECT volume, slot AS node, min(o) AS o, sum(l) AS l, sha256(string_agg((o - b) || ':' || l || ':' || copies || ':' || digest, chr(10) ORDER BY o)) AS d FROM s1 GROUP BY ALL),
s2 AS (SELECT volume, node // 16 AS up, o, l, d, min(o) OVER (PARTITION BY volume, node // 16) AS b FROM l1),
l2 AS (SELECT volume, min(o) AS o, sum(l) AS l, sha256(string_agg((o - b) || ':' || l || ':1:' || d, chr(10) ORDER BY o)) AS d FROM s2 GROUP BY volume, up),
l3 AS (SELECT volume, sha256(string_agg(o || ':' || l || ':1:' || d, chr(10) ORDER BY o)) AS volume_digest FROM l2 GROUP BY volume)
SELECT page_id, volume, CASE WHEN page_id IS NULL THEN -1 ELSE 0 END AS section, CAST(seq AS BIGINT) AS seq, "offset", length, digest, volume_digest, 'ok' AS status FROM placed JOIN l3 USING (volume)
"""

#: What is spoilt on purpose is all that the audit may find.
_DRILL = "SELECT page_id, CASE page_id % 10 WHEN 3 THEN 'corrupt' WHEN 5 THEN 'missing' ELSE 'extra' END AS status FROM pages WHERE page_id % 10 IN (3, 5, 7)"

#: All other rows by exact cosine, and the least id of the chain.
_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
n AS (SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v),
j AS MATERIALIZED (SELECT a.r AS r, a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.r <> b.r WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM j),
c AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
least AS (SELECT a AS vec_id, min(b) AS class_id FROM c GROUP BY 1),
links AS (SELECT r, count(*) AS n_links FROM j GROUP BY 1)
SELECT vec_id, coalesce(class_id, vec_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM v LEFT JOIN links USING (r) LEFT JOIN least USING (vec_id)
"""

#: Distinct word bigrams (the whole text where it has one word), all rows that join any, and the least id of the chain.
_NGRAMS = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x20\x7f]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS overlap FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
j AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE overlap >= 0.55 * (x.n + y.n - overlap)),
e AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM j JOIN w x ON x.r = a JOIN w y ON y.r = b),
c AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS class_id FROM c GROUP BY 1),
links AS (SELECT a AS r, count(*) AS n_links FROM j GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM w LEFT JOIN links USING (r) LEFT JOIN least USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_packing": op1_packing,
        "op2_token_files": op2_token_files,
        "op3_bpe": op3_bpe,
        "op4_toxicity": op4_toxicity,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_ngram_join": op6_ngram_join,
        "op7_warc": op7_warc,
        "warc_drill": warc_drill,
        "op8_quality": op8_quality,
        "op9_media": op9_media,
        "op10_chat": op10_chat,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_embedding_dedup": _EMBEDDINGS, "op6_ngram_join": _NGRAMS, "op7_warc": _WARC, "warc_drill": _DRILL}
