"""Kernels over the packed network against the joined shells, also where blocks have to be halved."""

import random

import numpy as np
import pytest

from rippleframe.operators import dynamics, features, graph, local, motifs, rankstats, shells, targets


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)] + [(0, x) for x in range(1, 30)]
    return graph.build_network(spark.createDataFrame(edges, "u long, v long"))


@pytest.fixture(scope="module")
def joined(net):
    return shells.shells(net.arcs, 3)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns) and dict(a.dtypes) == dict(b.dtypes)
    cols = sorted(a.columns)
    x, y = (sorted(tuple(float("nan" if r[c] is None else r[c]) for c in cols) for r in df.collect()) for df in (a, b))
    assert len(x) == len(y) and all(p == pytest.approx(q, rel=1e-9, abs=1e-9) for p, q in zip(x, y, strict=True))


def test_shell_queries_need_no_shell_table(net, joined):
    same(shells.shell_counts(net), shells.shell_counts(net, joined))
    same(shells.shell_features(net), shells.shell_features(net, joined))
    same(shells.ball2_features(net), shells.ball2_features(net, joined))
    same(shells.percolation_reach(net, None, 0.3), shells.percolation_reach(net, joined, 0.3))
    same(shells.coverage(net), shells.coverage(net, joined))
    same(features.branch_anisotropy(net), features.branch_anisotropy(net, joined))
    same(features.semilocal_features(net), features.semilocal_features(net, joined))


@pytest.mark.parametrize("r", [1, 2])
def test_balls(net, joined, r):
    same(shells.induced_ball(net, None, r), shells.induced_ball(net, joined, r))
    same(shells.observer_view(net, None, r), shells.observer_view(net, joined, r))


def test_moran(net, joined):
    z = net.degree.selectExpr("node", "cast(k as double) z")
    same(rankstats.moran(net, z, 3), rankstats.moran(joined, z, 3))
    same(rankstats.moran_null(net, z, 1, 2), rankstats.moran_null(joined, z, 1, 2))


def test_threshold_cascades(net, joined):
    a = dynamics.threshold_cascades(net, 1, 3).groupBy("src").count().selectExpr("src node", "count size")
    same(dynamics.threshold_sizes(net, 1, 3), a)
    for num, den, r in ((1, 3, 2), (1, 5, 1), (1, 4, 3)):
        same(dynamics.truncated_threshold_sizes(net, num, den, None, r), dynamics.truncated_threshold_sizes(net, num, den, joined, r))


def test_truncated_betweenness(net, joined):
    for k in (1, 2, 3):
        same(targets.truncated_betweenness(net, None, k), targets.truncated_betweenness(net, joined, k))


def test_wide_blocks_are_halved(spark, net, monkeypatch):
    g = local.collect_packed(net)
    assert [g.nbr[g.ptr[i] : g.ptr[i + 1]].tolist() for i in range(net.n)] == [r.neighbours for r in graph.neighbour_lists(net).orderBy("node").collect()]
    monkeypatch.setattr(local, "WIDE", 10)
    with pytest.raises(local.TooWide):
        local.expand(g, g.ptr[:-1] * 0 + range(net.n))
    assert len(local.expand(g, g.ptr[:-1] * 0 + range(net.n), False)[0]) == 2 * net.m


def test_cascades_and_outbreaks_from_every_node(net):
    arcs = dynamics.arc_probability(net, "weighted")
    same(dynamics.direct_cascades(arcs, net, 1, 1), dynamics.direct_cascades(arcs, net.nodes.select("node"), 1, 1))
    same(dynamics.sir(net, None, 0.05, 0.9, 1), dynamics.sir(net, net.nodes.select("node"), 0.05, 0.9, 1))


def test_percolation_labels(net, monkeypatch):
    edges = net.edges.selectExpr("u", "v", "0.3 p")
    packed = dynamics.percolation(net, edges, 3)
    none = dynamics.percolation(net, net.edges.selectExpr("u", "v", "0.0 p"), 2)
    assert none.filter("comp = node AND size = 1").count() == 2 * net.n
    monkeypatch.setattr(local, "MOST_ARCS", 0)
    same(packed, dynamics.percolation(net, edges, 3))


def test_ego_betweenness_needs_no_wedges(net, monkeypatch):
    packed = features.ego_betweenness(net)
    monkeypatch.setattr(local, "MOST_ARCS", 0)
    same(packed, features.ego_betweenness(net))


def test_four_node_orbits_list_no_sets(spark, net, monkeypatch):
    rng = random.Random(9)
    dense = [(100 + rng.randrange(12), 100 + rng.randrange(12)) for _ in range(45)] + [(200 + a, 200 + b) for a in range(5) for b in range(a)] + [(300, 301)]
    some = graph.build_network(net.edges.unionByName(spark.createDataFrame(dense, "u long, v long")), False)
    some = graph.Network(some.nodes.unionByName(spark.createDataFrame([(some.n, 999, 0)], "node long, original_id long, degree long")), some.edges)
    counts = [motifs.node_orbits, motifs.edge_orbits, motifs.edge_orbit_features]
    with monkeypatch.context() as m:
        m.setattr(local, "MOST_ARCS", 0)
        listed = [f(some, 4).localCheckpoint() for f in counts]
    monkeypatch.setattr(motifs, "connected_sets", None)
    for f, want in zip(counts, listed, strict=True):
        same(f(some, 4), want)


def test_four_sets_in_runs(net, monkeypatch):
    g, tri = local.Packed(*net.packed.value), local.triangles(net)
    whole = local.four_sets(g, np.arange(g.n), tri)[2]
    assert all((x >= 0).all() for x in whole.values())
    monkeypatch.setattr(local, "WIDE", 8)
    parts = [local.four_sets(g, np.array([x]), tri)[2] for x in range(g.n)]
    assert all((np.concatenate([p[c] for p in parts]) == whole[c]).all() for c in whole)
    assert [(s.start, s.stop) for s in local.runs(np.array([1, 1, 9, 1, 1, 1]), 2)] == [(0, 2), (2, 3), (3, 5), (5, 6)]


def test_exact_betweenness_over_whole_layers(net, monkeypatch):
    monkeypatch.setattr(targets, "adjacency", None)  # its lower limit of arcs no longer binds
    same(targets.exact_betweenness(net), targets.truncated_betweenness(net, None, 12).withColumnRenamed("b_12", "betweenness"))


def test_dependencies_on_a_long_path_and_an_isolated_node():
    n = 400
    ptr = np.array([0, 1, *range(3, 2 * n - 2, 2), 2 * n - 2, 2 * n - 2])  # a path of n nodes and one node alone
    nbr = np.array([1, *[y for x in range(1, n - 1) for y in (x - 1, x + 1)], n - 2], np.int32)
    assert (targets.brandes(ptr, nbr, range(n + 1)) / 2).tolist() == [*[i * (n - 1 - i) for i in range(n)], 0]
