"""Rank statistics that must not grow with the square of the rows or put all rows into one task."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippleframe.operators import descriptors, graph, rankstats


def test_inversions_and_contributions_against_pairs():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (2, 1), (40, 3), (65, 100), (200, 9)):
        a, b = rng.integers(0, top, n), rng.integers(0, top, n) - 2
        assert rankstats.inversions(a) == sum(int(a[i] > a[j]) for i in range(n) for j in range(i + 1, n))
        want = (np.sign(a[:, None] - a[None, :]) * np.sign(b[:, None] - b[None, :])).sum(axis=1)
        assert rankstats.contributions(a, b).tolist() == want.tolist()


def test_contributions_of_many_rows_are_quick():
    x = np.random.default_rng(2).random(300_000)
    t = time.time()
    s = rankstats.contributions(x, -x)
    assert time.time() - t < 60 and (s == 1 - len(x)).all()
    assert rankstats.inversions(-np.sort(x)) == len(x) * (len(x) - 1) // 2


def test_adjusted_p_by_ranges(spark):
    p = [0.2, 0.01, 0.04, 0.04, 0.9, 0.011, 0.5, 0.04]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "node long, p double")
    for dependent in (False, True):
        got = [r.q for r in rankstats.benjamini_hochberg(df, "p", dependent=dependent).orderBy("node").collect()]
        grouped = [r.q for r in rankstats.benjamini_hochberg(df.withColumn("g", F.lit("a")), "p", ["g"], dependent).orderBy("node").collect()]
        f = sum(1 / i for i in range(1, len(p) + 1)) if dependent else 1.0
        want = [min([1.0, *(y * len(p) * f / sum(z <= y for z in p) for y in p if y >= x)]) for x in p]
        assert got == pytest.approx(want) and grouped == pytest.approx(want)


def test_no_task_holds_all_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("node"), F.rand(3).alias("p"), F.lit(1).alias("k"))
    n = graph.numbered(df, ["p", "node"], "at")
    assert [r.node for r in n.orderBy("at").collect()] == [r.node for r in df.orderBy("p", "node").collect()]
    assert n.groupBy("_p").count().agg(F.max("count")).first()[0] < 2500
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan(descriptors.configuration_model(df, 7))


def test_numbered_takes_any_number_of_ranges(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    dealt = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *cols: dealt(self, max(n, 41), *cols))
    assert graph.numbered(df, ["x"], "at").filter("x = at").count() == 500
    assert graph.numbered(df.filter("x < 0"), ["x"], "at").count() == 0


def test_evaluate_in_one_pass(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(c, i, float(rng.integers(0, 9)), float(rng.integers(0, 5))) for c in ("a", "b") for i in range(130)], "cell string, node long, y double, pred double")
    got = {r.cell: r for r in rankstats.evaluate(df, ["cell"]).collect()}
    parts = [rankstats.spearman(df, ["cell"], "y", "pred"), rankstats.rmse(df, ["cell"], "y", "pred"), rankstats.precision_at(df, ["cell"], "y", "pred", 100), rankstats.precision_at(df, ["cell"], "y", "pred", 20)]
    for part, name in zip(parts, ("spearman", "rmse", "precision_at_1pct", "precision_at_5pct"), strict=True):
        for r in part.collect():
            assert got[r.cell][name] == pytest.approx(r[1])
