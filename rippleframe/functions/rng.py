"""Counter-based uniforms: a double in [0, 1) that depends only on its key, the same in any engine and on any partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two to the power 52.
SPAN = 4503599627370496


def uniform(*key: str | int | Column) -> Column:
    """Uniform of the key's parts joined by '|'."""
    parts = [k if isinstance(k, Column) else F.col(k) if isinstance(k, str) else F.lit(k) for k in key]
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(SPAN))


def uniform_sql(*key: str) -> str:
    """The same in DuckDB."""
    joined = ", ".join(f"cast({k} AS VARCHAR)" for k in key)
    return f"(cast(cast('0x' || substring(md5(concat_ws('|', {joined})), 1, 13) AS BIGINT) AS DOUBLE) / cast({SPAN} AS DOUBLE))"
