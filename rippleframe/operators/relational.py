"""Table shapes that analyses share: long form, common rows, joins that must not multiply rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row (ids, name, value) for each of the columns values, as doubles; nulls stay."""
    return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(ids, values, name, value)


def common_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows in both tables, columns by left's names; nulls are equal."""
    return left.intersect(right.select(left.columns))


def lookup_join(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """df with ref's other columns by key, nulls where ref has none; a key that ref repeats fails the job.

    The guard is part of the join's own grouping by key, so it costs no further shuffle.
    """
    others = [c for c in ref.columns if c != key]
    repeats = F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")
    once = ref.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*others)).alias("_v"))
    once = once.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(repeats)).select(key, *(F.col("_v")[c].alias(c) for c in others))
    return df.join(once, key, "left")
