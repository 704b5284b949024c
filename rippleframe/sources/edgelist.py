"""Edge-list text files: scan with counters, validation before use, writing, discovery, content hashes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, comments: str) -> DataFrame:
    line = F.trim(F.regexp_replace("value", "[,\\t]", " "))
    lines = spark.read.text(path).select(line.alias("line"))
    return lines.filter((F.col("line") != "") & ~F.substring("line", 1, 1).isin(list(comments)))


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.select(*[F.expr(f"try_cast(try_element_at(split(line, ' +'), {i}) AS BIGINT)").alias(c) for i, c in ((1, "u"), (2, "v"))])


def read_edgelist(spark: SparkSession, path: str, comments: str = "#%") -> DataFrame:
    """(u, v) of every parsable row: first two integer fields, separated by spaces, commas or tabs; blank and comment rows go."""
    return _parsed(_lines(spark, path, comments)).filter("u IS NOT NULL AND v IS NOT NULL")


def inspect_edgelist(spark: SparkSession, path: str, comments: str = "#%") -> DataFrame:
    """One row (rows, unparsed, u_min, u_max) that tells whether a file may be used."""
    p = _parsed(_lines(spark, path, comments))
    bad = F.col("u").isNull() | F.col("v").isNull()
    return p.agg(F.count("*").alias("rows"), F.count_if(bad).alias("unparsed"), F.min(F.least("u", "v")).alias("u_min"), F.max(F.greatest("u", "v")).alias("u_max"))


def checked_edgelist(spark: SparkSession, path: str, rows: int | None = None, sha256: str | None = None, comments: str = "#%") -> DataFrame:
    """read_edgelist() after checks of content hash and row count; fails before anything is made from the file."""
    seen = inspect_edgelist(spark, path, comments).first()
    if seen.rows == seen.unparsed:
        raise ValueError(f"no edges in {path}")
    if rows is not None and seen.rows - seen.unparsed != rows:
        raise ValueError(f"{path} has {seen.rows - seen.unparsed} edges, not {rows}")
    if sha256 is not None and (got := file_hashes(spark, path).first().sha256) != sha256:
        raise ValueError(f"{path} has SHA-256 {got}")
    return read_edgelist(spark, path, comments)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_edgelist(edges: DataFrame, path: str, header: str = "") -> None:
    """Two tab-separated columns; header becomes comment rows at the top of each part."""
    rows = edges.select(F.concat_ws("\t", "u", "v").alias("value"))
    if header:
        note = edges.sparkSession.createDataFrame([(f"# {x}",) for x in header.splitlines()], "value string")
        rows = note.coalesce(1).unionAll(rows)
    rows.write.mode("overwrite").text(path)


def discover_networks(spark: SparkSession, folder: str, pattern: str = r"([^/]+)\.(?:txt|edges)$") -> DataFrame:
    """(network, path) of the files in a folder whose names match."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.filter(F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1).alias("network"), "path")


def tag_of(path: str) -> str:
    return re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1])
