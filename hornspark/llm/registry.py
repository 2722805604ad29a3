"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hornspark.llm import (
    best_fit_packing,
    chat_windows,
    layout_text,
    license_templates,
    quality_ledger,
    spaced_seeds,
    substring_dedup,
    url_templates,
    warc_legacy,
)
from hornspark.llm.common import read_table
from hornspark.llm.ngram_jaccard import ngram_jaccard

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(spark, read_table(spark, sf_dir, "documents"))


def op2_warc_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_legacy.legacy_to_warc(spark, read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.result(spark, read_table(spark, sf_dir, "documents"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark, read_table(spark, sf_dir, "documents"))


def op6_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.license_scan(spark, read_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(spark, read_table(spark, sf_dir, "documents"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_windows.with_probe(spark, read_table(spark, sf_dir, "conversations"))
    return chat_windows.read_back(chat_windows.chat_windows(spark, turns))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.url_verdicts(spark, read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op10_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_text.layout_text(spark, read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_warc_legacy,
        op3_quality_ledger,
        op4_spaced_seeds,
        op5_ngram_jaccard,
        op6_license_templates,
        op7_best_fit_packing,
        op8_chat_windows,
        op9_url_templates,
        op10_layout_text,
    )
}

SQL: dict[str, str] = {
    "op2_warc_legacy": warc_legacy.SQL,
    "op3_quality_ledger": quality_ledger.SQL,
    "op6_license_templates": license_templates.SQL,
    "op9_url_templates": url_templates.SQL,
}

SQL["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
  FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * k >= 80 * (nx + ny - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS z FROM s UNION SELECT r.d, e.y FROM r JOIN e ON r.z = e.x),
m AS (SELECT d, min(z) AS component_id FROM r GROUP BY d),
k AS (SELECT component_id, count(*) AS component_rows FROM m GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, k.component_rows
FROM s JOIN m ON m.d = s.doc_id JOIN k USING (component_id)
"""
