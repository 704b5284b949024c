"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attribution import section_token_counts
from .binary import round_trip
from .common import table
from .exact import exact_groups, half_is_snapshot
from .lm import pseudo_likelihood
from .packing import pack_pieces, token_pieces
from .simhash import fp_hex, simhash_groups
from .substring import substring_dedup
from .toxicity import score_documents
from .warc import archive_round_trip
from .winnow import decontaminate


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), fp_hex().alias("fingerprint"), "component_id")


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_groups(table(spark, sf_dir, "documents"), half_is_snapshot())
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_pseudo_likelihood, op3_packing, op4_token_files, op5_toxicity, op6_token_counts, op7_exact, op8_substring, op9_decontamination, op10_warc)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses at a bearable cost."""
    return {
        "op7_exact": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
            FROM d WINDOW w AS (PARTITION BY s ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "op8_substring": rf"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
            g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i+19], ' ') ORDER BY doc_id, i) AS n FROM p),
            r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM g WHERE n > 1),
            x AS (SELECT doc_id, list(j) AS js FROM r GROUP BY doc_id),
            k AS (SELECT d.doc_id, w, coalesce(js, []) AS js FROM d LEFT JOIN x USING (doc_id))
            SELECT doc_id, len(w)::BIGINT AS n_words, len(js)::BIGINT AS n_removed, sha256(coalesce(array_to_string(list_filter(w, lambda y, j: NOT list_contains(js, j)), ' '), '')) AS kept_sha256 FROM k""",
        "op10_warc": r"""
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
            h AS (SELECT page_id, octet_length(b) AS n, b, sha1(b) AS x FROM p),
            m AS (SELECT page_id, n, x, min(page_id) OVER (PARTITION BY b) AS f FROM h)
            SELECT page_id, n::BIGINT AS payload_bytes,
                array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
                CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM m""",
    }
