"""Queries that apply the operators of this subpackage to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import licenses, mixing, negatives, quality, secrets, spelling, url_filter
from tidemark.llm._spark import documents
from tidemark.llm.extraction import extract_pages
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.ngram_lm import score_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.repeats import repeated_passages
from tidemark.llm.topk import top_inner_products


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("row")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_pages(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_pages(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(documents(spark, sf_dir)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_minhash_near_dedup, op3_exact_topk, op4_html_extraction, op5_mix_sources,
        op6_packing, op7_lm_scoring, op8_quality_rules, op9_url_filter, op10_secret_scan,
        op11_license_scan, op12_hard_negatives, op13_spelling_variants,
    )
}

#: Repeats, near copies and exact top-k are brute force in SQL; the others are the operators' own definitions written anew.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": r"""
        WITH texts AS (SELECT DISTINCT doc_id, text FROM documents),
        docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM texts),
        starts AS (SELECT d, doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM docs WHERE len(ws) >= 50),
        hashed AS (SELECT d, doc_id, s, md5(array_to_string(ws[s + 1 : s + 50], ' ')) AS h FROM starts),
        seen AS (
          SELECT d, doc_id, s, count(*) OVER (PARTITION BY h) AS times, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, d, s) AS nth FROM hashed
        ), marked AS (
          SELECT 'repeated' AS kind, d, doc_id, s FROM seen WHERE times > 1 UNION ALL SELECT 'later', d, doc_id, s FROM seen WHERE nth > 1
        ), breaks AS (
          SELECT *, coalesce(s - lag(s) OVER (PARTITION BY kind, d ORDER BY s) > 50, true)::INT AS opens FROM marked
        ), islands AS (
          SELECT *, sum(opens) OVER (PARTITION BY kind, d ORDER BY s) AS island FROM breaks
        ), spans AS (
          SELECT kind, d, doc_id, min(s) AS a, max(s) + 50 AS b FROM islands GROUP BY kind, d, doc_id, island
        )
        SELECT doc_id, coalesce(sum(b - a) FILTER (kind = 'repeated'), 0)::BIGINT AS n_repeated, coalesce(sum(b - a) FILTER (kind = 'later'), 0)::BIGINT AS n_later,
          coalesce(string_agg(concat(a, '-', b), ',' ORDER BY a) FILTER (kind = 'repeated'), '') AS repeated,
          coalesce(string_agg(concat(a, '-', b), ',' ORDER BY a) FILTER (kind = 'later'), '') AS later
        FROM spans GROUP BY d, doc_id
    """,
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE docs AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), sets AS (
          SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM docs
        ), keyed AS (
          SELECT doc_id, shingles, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS same FROM sets
        ), class AS (
          SELECT min(doc_id) AS class_id, same, any_value(shingles) AS shingles, any_value(n) AS n FROM keyed WHERE n > 0 AND doc_id IS NOT NULL GROUP BY same
        ), members AS (
          SELECT class_id, n, unnest(shingles) AS shingle FROM class
        ), links AS (
          SELECT a.class_id AS a, b.class_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.class_id <> b.class_id
          GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
          SELECT class_id AS a, class_id AS b FROM class UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        ), least AS (
          SELECT a, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE l.component_id END AS component_id,
          coalesce(k.doc_id = CASE WHEN k.n = 0 THEN k.doc_id ELSE l.component_id END, true) AS kept,
          CASE WHEN k.n = 0 THEN k.doc_id ELSE c.class_id END AS class_id
        FROM keyed k LEFT JOIN class c ON c.same = k.same AND k.n > 0 AND k.doc_id IS NOT NULL LEFT JOIN least l ON l.a = c.class_id
    """,
    "op3_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op8_quality_rules": quality.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
    "op10_secret_scan": secrets.ORACLE_SQL,
    "op12_hard_negatives": negatives.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
