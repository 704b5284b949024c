"""Connected components by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def connected_components(edges: DataFrame, keys: tuple[str, ...] = (), max_rounds: int = 80) -> DataFrame:
    """(keys, node, comp) for every linked node of edges (keys, u, v); comp is the smallest node reachable under equal keys.

    A round replaces each link by one to a smaller node, so links never grow; the number of rounds is about the
    logarithm of the largest diameter.
    """
    k = list(keys)
    e = stored(edges.filter("u <> v").select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*k, "u").agg(F.min("v").alias("m")).select(*k, "u", F.least("u", "m").alias("m"))
        large = both.join(low, [*k, "u"]).filter("v > u").select(*k, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*k, "u"]).filter("v <> m").select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionAll(least.select(*k, "u", F.col("m").alias("v"))).distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(*k, F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(*k, F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots)
