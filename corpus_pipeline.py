"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm.common import materialize, table
from rippleframe.llm.exact import exact_dedup
from rippleframe.llm.packing import pack_pieces, token_pieces
from rippleframe.llm.simhash import near_dedup
from rippleframe.llm.toxicity import toxic_rows
from rippleframe.llm.winnow import decontaminate


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a key of each row's id and text, as ids may be null or repeat; rows that repeat both are judged alike."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; null and wordless texts hold no passage and stay. Fitted on labelled rows outside the held-out ids."""
    rows = _rows(docs)
    return rows.join(toxic_rows(rows, table(spark, sf_dir, "labels"), "_row"), "_row", "left_anti").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without ASCII white space the one with the most code points, then the smallest id, stays; null counts as empty.

    Decided by id and text: another text of a dropped id stays, and rows that repeat the kept id and text all stay.
    """
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more the smallest id stays.

    Texts without words are equal; a null id counts as the largest; rows that repeat id and text stay or go together.
    """
    return near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of a benchmark item go; null and wordless texts stay."""
    rows = _rows(docs)
    hit = decontaminate(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select(F.col("id").alias("_row")).distinct()
    return rows.join(hit, "_row", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row with their places in sequences of 2048; a null or empty text is its end token."""
    pieces = token_pieces(docs)
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL expresses neither the trained score nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
