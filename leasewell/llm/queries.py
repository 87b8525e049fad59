"""The queries of this subpackage: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasewell.llm import decontaminate, html_extract, language_id, license_scan, near_duplicates, packing, repeats, sentencepiece_fst, vector_search, warc
from leasewell.llm.session import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item: doc_id, item_id, containment, shared and all shingles."""
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip of every document."""
    return sentencepiece_fst.encoded(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive of all pages into the shared folder and read it back."""
    path = scratch(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path)


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed id matrices of all documents."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every vector whose id is divisible by 20."""
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license found in a document: doc_id, license, coverage, begin_word, end_word, excerpt."""
    return license_scan.license_matches(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return language_id.language_of(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return repeats.repeat_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    return {f.__name__: f for f in (op1_decontaminate, op2_main_text, op3_sentencepiece, op4_warc, op5_packed_ids, op6_exact_top_k, op7_license_scan, op8_jaccard_join, op9_language_id, op10_suffix_array_dedup)}


#: DuckDB SQL for the queries that SQL can express in reasonable time.
ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
        o AS (SELECT html, max(page_id) AS owner FROM p GROUP BY html)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN strlen(html) >= 1000 AND page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(html) >= 1000 AND page_id < owner THEN owner END AS refers_to,
               url AS target_uri
        FROM p JOIN o USING (html)""",
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                     vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
