"""Queries of the language-model data problems (p3, p6, p7, p8) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import leakage, neardup, packing, spam
from memloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "patches"), most=None)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "patches"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_by_item(spark: SparkSession, d: str) -> DataFrame:
    return leakage.by_item(table(spark, d, "documents"), table(spark, d, "eval_items")).drop("item_share")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"), table(spark, d, "doc_labels")).select("doc_id", "lang", "n_words", "distance", "cosine", "share", "outlier", "spam")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_groups, p6_pack, p6_report, p7_found, p7_by_item, p8_found, p8_scores)}

_GRAMS = """
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
, item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL)
, item_grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, UNNEST(range(1, len(w) - 10)) AS i FROM item_words WHERE len(w) >= 12))
, doc_grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 10)) AS i FROM doc_words WHERE len(w) >= 12))
"""

ORACLES: dict[str, str] = {
    "p3_found": """
WITH counted AS (SELECT row_id, payload, regexp_replace(lower(trim(patch_type, ' ')), 's+$', '') AS ty FROM patches
  WHERE conv_id IS NOT NULL AND patch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, patch_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1)
, sets AS (SELECT row_id, list_distinct(regexp_extract_all(lower(payload), '[\\p{L}\\p{N}]+')) AS w FROM counted WHERE payload IS NOT NULL AND (ty IS NULL OR ty <> 'slot'))
, words AS (SELECT row_id, len(w) AS n, UNNEST(w) AS t FROM sets)
, freq AS (SELECT t, count(*) AS f FROM words GROUP BY 1)
, placed AS (SELECT w.row_id, w.n, w.t, row_number() OVER (PARTITION BY w.row_id ORDER BY f.f, w.t) AS pos FROM words w JOIN freq f ON f.t = w.t)
, prefix AS (SELECT row_id, n, t FROM placed WHERE pos <= n - ceil(3 * n / 5.0) + 1)
, cand AS (SELECT DISTINCT a.row_id AS row_id_a, b.row_id AS row_id_b FROM prefix a JOIN prefix b ON a.t = b.t AND a.row_id < b.row_id AND 5 * a.n >= 3 * b.n AND 5 * b.n >= 3 * a.n)
SELECT c.row_id_a, c.row_id_b FROM cand c JOIN sets a ON a.row_id = c.row_id_a JOIN sets b ON b.row_id = c.row_id_b
WHERE len(list_intersect(a.w, b.w)) * 5 >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
""",
    "p7_found": _GRAMS + "SELECT DISTINCT doc_id, item_id FROM doc_grams d JOIN item_grams i ON i.g = d.g",
}
