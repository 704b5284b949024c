"""Result tables that grow cell by cell: CSV and JSON scans, appends that refuse repeats, inputs bound by hash."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .edgelist import file_hashes


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV files with a header, their columns in schema's order; a header that differs or a cell that does not fit fails the read."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST", nullValue="")


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header alone; no cell is read."""
    return spark.read.csv(path, header=True).columns


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """One document a file, nested values as structs and arrays."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One line a row, nested columns as nested values, null fields kept."""
    df.write.option("ignoreNullFields", False).json(path)


def stored_cells(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_cells(cells: DataFrame, path: str, keys: list[str]) -> None:
    """Append finished cells; refuses repeated keys, keys that are there already, and other columns.

    Files of a write that did not end have no commit and are not read, so a torn end needs no repair. One driver writes.
    """
    if cells.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("the new cells repeat a key")
    old = stored_cells(cells.sparkSession, path)
    if old is not None:
        if [(f.name, f.dataType) for f in old.schema] != [(f.name, f.dataType) for f in cells.schema]:
            raise ValueError(f"columns {cells.columns} do not fit the stored {old.columns}")
        if cells.join(old.select(*keys), keys, "left_semi").limit(1).count():
            raise ValueError("cells that are stored already")
    cells.write.mode("append").parquet(path)


def canonical_hash(value: dict | list) -> str:
    """SHA-256 of a value's JSON with sorted keys and no spaces; NaN and infinities are refused."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def column_fingerprint(columns: list[str]) -> str:
    """Hash of an ordered column list: the order of columns changes a seeded forest."""
    return canonical_hash(list(columns))


def input_record(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, file, sha256) of every file of the named inputs."""
    parts = [file_hashes(spark, p).withColumn("name", F.lit(n)) for n, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("name", F.element_at(F.split("path", "/"), -1).alias("file"), "sha256")


def bind_inputs(spark: SparkSession, paths: dict[str, str], record: str) -> DataFrame:
    """Write the record of the inputs beside a run's results, or hold them against the one that is there and refuse any change."""
    now, old = input_record(spark, paths), stored_cells(spark, record)
    if old is None:
        now.write.parquet(record)
        return spark.read.parquet(record)
    other = now.exceptAll(old).unionByName(old.exceptAll(now)).select("name", "file").distinct().limit(5).collect()
    if other:
        raise ValueError(f"inputs changed since the run began: {[tuple(r) for r in other]}")
    return old
