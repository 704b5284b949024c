"""Connected components on written tables: union-find in one task for few links, alternating large-star and small-star steps (Kiveris et al., 2014) beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Links that one task holds at a time (16 bytes each).
IN_TASK = 2_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and for each the smallest node reachable."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        i, j = label[x], label[y]
        low, new = np.minimum(i, j), label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one task to links (node, smallest node reachable in them), at most one a node."""
    held = [batch for batch in it if batch.num_rows]
    if held:
        nodes, low = roots_of(*(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(2)))
        up = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[up]), pa.array(low[up])], ["u", "v"])


def components(edges: DataFrame, max_rounds: int = 60, in_task: int = IN_TASK) -> DataFrame:
    """(a, b) links to one row (node, root) per linked node, root the smallest node reachable.

    Links are dealt to tasks of at most in_task links, each of which leaves one link a node at most; when one task is
    enough, its result is the components. Beyond that, each star step replaces links by links to a smaller node, so
    the number of links does not grow. Rows with a null end and self-links are ignored; an empty table gives an empty
    table.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), "cc")
    n = e.count()
    while True:
        new = materialize(e.coalesce(max(1, -(-n // in_task))).mapInArrow(forest, "u long, v long"), "cc")
        left = new.count()
        discard(e)
        e = new
        if n <= in_task:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        if left > in_task and left > 0.7 * n:
            break
        n = left
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
