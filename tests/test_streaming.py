"""Streams against the same operators on tables."""

import datetime as dt

from rippleframe.streaming import edges


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    schema = "ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(f"{tmp_path}/in")
    stream = edges.windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = edges.windowed_counts(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    assert sum(r.n for r in edges.sessions(spark.read.parquet(f"{tmp_path}/in"), "10 minutes").collect()) == 60


def test_growing_edges(spark, tmp_path):
    src, out, chk = (f"{tmp_path}/{x}" for x in ("raw", "edges", "chk"))
    for part in ([(1, 2), (2, 1), (3, 3)], [(1, 2), (2, 3)]):
        spark.createDataFrame(part, "u long, v long").write.mode("append").parquet(src)
        edges.grow_edge_table(spark.readStream.schema("u long, v long").parquet(src), out, chk).awaitTermination(120)
    assert sorted((r.u, r.v) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 3)]
