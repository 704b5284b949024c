"""Edges and event counts from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import simple_edges


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) per tumbling window of a stream or table of events; later rows than the watermark go."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) per session of a user."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def grow_edge_table(raw: DataFrame, path: str, checkpoint: str):
    """Start a query that adds each batch's new simple edges to the Parquet table at path; returns the query.

    A batch that runs again after a failure writes to its own folder again, so edges are never doubled.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = simple_edges(batch)
        spark = batch.sparkSession
        try:
            held = spark.read.parquet(path).filter(F.col("batch") < number)
            new = new.join(held.select("u", "v"), ["u", "v"], "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
