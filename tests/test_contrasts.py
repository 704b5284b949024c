"""Contrasts on small tables with known answers, and refusals."""

import math

import pytest
from pyspark.sql import functions as F

from rippleframe.plans import contrasts


def student_by_sum(t, df, steps=200_000, far=400.0):
    """P(|T| >= t) by the trapezoid rule."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    h = t / steps
    return 1 - 2 * h * (sum(f(i * h) for i in range(1, steps)) + (f(0) + f(t)) / 2)


def test_student(spark):
    cases = [(t, df) for t in (0.3, 2.5) for df in (1, 2, 3, 4, 5, 9, 10, 30)]
    got = spark.createDataFrame(cases, "t double, df int").select("t", "df", contrasts.student_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert len(got) == len(cases) and all(abs(r.p - student_by_sum(r.t, r.df, 20_000)) < 1e-7 for r in got)


def test_sign(spark):
    cases = [(k, n) for n in range(0, 13) for k in range(n + 1)]
    got = spark.createDataFrame(cases, "k int, n int").select("k", "n", contrasts.sign_two_sided(F.col("k"), F.col("n")).alias("p")).collect()
    want = lambda k, n: sum(math.comb(n, i) for i in range(n + 1) if math.comb(n, i) <= math.comb(n, k)) / 2**n
    assert all(abs(r.p - want(r.k, r.n)) < 1e-12 for r in got)


def test_paired_tests_without_spread(spark):
    rows = [("zero", 0.0)] * 3 + [("same", 0.5)] * 3 + [("one", 0.5)]
    got = {r.k: r for r in contrasts.paired_tests(spark.createDataFrame(rows, "k string, g double"), ["k"]).collect()}
    assert got["zero"].p_t == 1 and not got["zero"].starred and got["zero"].p_sign == 1
    assert got["same"].p_t == 0 and got["same"].starred
    assert got["one"].p_t is None and got["one"].sd is None


def test_mixture_is_exact(spark):
    """Zeros below all positive rows, told apart perfectly: the mixture of the positive rows' tau is tau of all."""
    from rippleframe.operators.rankstats import tau_b

    import numpy as np

    y = np.array([0, 0, 0, 1, 2, 3, 4.0])
    for x, tied in ((np.array([1, 2, 3, 5, 4, 7, 6.0]), False), (np.array([0, 0, 0, 5, 4, 7, 6.0]), True)):
        row = spark.createDataFrame([(float(tau_b(x[3:], y[3:])), 7, 3)], "tau double, n int, z int")
        assert abs(row.select(contrasts.mixture_tau("tau", "n", "z", tied)).first()[0] - tau_b(x, y)) < 1e-12


def test_refusals(spark):
    bad = [float("nan"), float("inf"), None]
    for v in bad:
        with pytest.raises(ValueError):
            contrasts.require_finite(spark.createDataFrame([(1.0,), (v,)], "x double"), ["x"])
    refit = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2)], "r int, rep int, tau_refit double")
    frozen = spark.createDataFrame([(1, 0.1, 0.2)], "r int, target_noise_sd double, seed_sd double")
    assert contrasts.replicate_noise(refit, frozen, ["r"], 2).count() == 1
    for a, b, n in ((refit, frozen, 3), (refit, frozen.union(frozen), 2), (refit, frozen.filter("r > 1"), 2)):
        with pytest.raises(ValueError):
            contrasts.replicate_noise(a, b, ["r"], n)
    cells = spark.createDataFrame([(1, 0, 5, 0.1), (1, 1, 5, 0.1 + 1e-8), (2, 0, 5, 0.3)], "k int, seq int, n int, tau double")
    kept, removed = contrasts.reconcile(cells, ["k"], ["n"], "tau")
    assert sorted((r.k, r.seq) for r in kept.collect()) == [(1, 1), (2, 0)] and [(r.k, r.seq) for r in removed.collect()] == [(1, 0)]
    for other in ([(1, 2, 6, 0.1)], [(1, 2, 5, 0.2)]):
        with pytest.raises(ValueError):
            contrasts.reconcile(cells.union(spark.createDataFrame(other, cells.schema)), ["k"], ["n"], "tau")
