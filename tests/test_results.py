"""Result tables: scans, appends, bound inputs."""

import pytest

from rippleframe.sources import results


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("radius,tau,name\n1,0.5,x\n2,,\n")
    path, schema = str(tmp_path / "a.csv"), "radius int, tau double, name string"
    assert results.csv_columns(spark, path) == ["radius", "tau", "name"]
    assert [tuple(r) for r in results.read_csv(spark, path, schema).collect()] == [(1, 0.5, "x"), (2, None, None)]
    with pytest.raises(Exception, match="(?i)header"):
        results.read_csv(spark, path, "radius int, name string, tau double").collect()
    (tmp_path / "b.csv").write_text("radius\nx\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        results.read_csv(spark, str(tmp_path / "b.csv"), "radius int").collect()
    df = spark.sql("SELECT 1 AS k, named_struct('a', array(1, 2), 'b', CAST(NULL AS string)) AS v")
    results.write_json(df, str(tmp_path / "j"))
    assert results.read_json(spark, str(tmp_path / "j"), df.schema).collect() == df.collect()
    (tmp_path / "n.json").write_text('{\n "net": {"n": 3,\n "edges": [[0, 1], [1, 2]]}\n}')
    assert results.read_json(spark, str(tmp_path / "n.json")).first().net.edges == [[0, 1], [1, 2]]


def test_append(spark, tmp_path):
    path = str(tmp_path / "cells")
    cells = lambda *r: spark.createDataFrame(list(r), "k int, tau double")
    assert results.stored_cells(spark, path) is None
    results.append_cells(cells((1, 0.1), (2, 0.2)), path, ["k"])
    results.append_cells(cells((3, 0.3)), path, ["k"])
    for bad in (cells((3, 0.4)), cells((4, 0.1), (4, 0.1)), cells((5, 0.1)).withColumnRenamed("tau", "rho")):
        with pytest.raises(ValueError):
            results.append_cells(bad, path, ["k"])
    assert sorted(r.k for r in results.stored_cells(spark, path).collect()) == [1, 2, 3]


def test_hashes(spark, tmp_path):
    assert results.canonical_hash({"b": [1, 2], "a": "é"}) == results.canonical_hash({"a": "é", "b": [1, 2]})
    assert results.column_fingerprint(["a", "b"]) != results.column_fingerprint(["b", "a"])
    with pytest.raises(ValueError):
        results.canonical_hash({"a": float("nan")})
    (tmp_path / "x.txt").write_text("1 2\n")
    (tmp_path / "y.txt").write_text("2 3\n")
    paths, record = {n: str(tmp_path / f"{n}.txt") for n in "xy"}, str(tmp_path / "record")
    assert results.bind_inputs(spark, paths, record).count() == 2 == results.bind_inputs(spark, paths, record).count()
    (tmp_path / "y.txt").write_text("2 4\n")
    with pytest.raises(ValueError, match="y.txt"):
        results.bind_inputs(spark, paths, record)
