"""Two numbers a node give the non-backtracking spectrum without an array over arcs."""

import random

import numpy as np
import pytest

from rippleframe.operators import graph, spectral


def test_gap_and_radius_without_arc_arrays(spark, monkeypatch):
    rng = random.Random(5)
    net = graph.build_network(spark.createDataFrame([(rng.randrange(25), rng.randrange(25)) for _ in range(80)], "u long, v long"))
    arcs = [(r.u, r.v) for r in net.arcs.collect()]
    b = np.array([[float(p[1] == q[0] and p[0] != q[1]) for q in arcs] for p in arcs])
    want = np.sort(np.abs(np.linalg.eigvals(b)))[::-1]

    def never(_):
        raise AssertionError("an array over arcs")

    monkeypatch.setattr(spectral, "_csr", never)
    assert spectral.nonbacktracking_radius(net) == pytest.approx(want[0], rel=1e-6)
    first, second, gap = spectral.nonbacktracking_gap(net, rounds=2000)
    assert (first, second) == (pytest.approx(want[0], rel=1e-6), pytest.approx(want[1], rel=1e-2)) and gap == 1 - second / first
