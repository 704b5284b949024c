"""Graph operators on hand-checkable networks and against plain Python."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from rippleframe.functions import md5
from rippleframe.operators import descriptors, dynamics, features, graph, motifs, rankstats, shells, spectral, targets
from rippleframe.sources import edgelist

PATH4 = [(0, 1), (1, 2), (2, 3)]
STAR4 = [(0, 1), (0, 2), (0, 3)]
TRIANGLE = [(0, 1), (1, 2), (2, 0)]
PENDANT = [*TRIANGLE, (2, 3)]
PATH5 = [*PATH4, (3, 4)]


def net_of(spark, edges, connected=True):
    return graph.build_network(spark.createDataFrame(edges, "u long, v long"), connected)


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.fixture(scope="module")
def net(spark):
    return net_of(spark, random_edges(30, 60, 1))


@pytest.fixture(scope="module")
def near(net):
    out = {r.node: set() for r in net.nodes.collect()}
    for r in net.arcs.collect():
        out[r.u].add(r.v)
    return out


def distances(near, s):
    dist, front = {s: 0}, [s]
    while front:
        x = front.pop(0)
        for y in near[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                front.append(y)
    return dist


@pytest.fixture(scope="module")
def shell(net):
    return shells.shells(net.arcs, 3)


@pytest.mark.parametrize(
    ("edges", "walks"),
    [(PATH4, [[1, 2, 2, 1], [1, 1, 1, 1], [1, 0, 0, 1]]), (STAR4, [[3, 1, 1, 1], [0, 2, 2, 2], [0, 0, 0, 0]]), (TRIANGLE, [[2, 2, 2]] * 3), (PENDANT, [[2, 2, 3, 1], [3, 3, 2, 2], [3, 3, 2, 2]]), (PATH5, [[1, 2, 2, 2, 1], [1, 1, 2, 1, 1], [1, 1, 0, 1, 1]])],
)
def test_walks(spark, edges, walks):
    got = sorted(features.walk_counts(net_of(spark, edges)).collect(), key=lambda r: r.node)
    assert [[r[f"nbw_{s}"] for r in got] for s in (1, 2, 3)] == walks


def test_cleaning_and_components(spark):
    raw = [(5, 5), (1, 2), (1, 2), (2, 1), (2, 3), (10, 11), (12, 13), (13, 14)]
    df = spark.createDataFrame(raw, "u long, v long")
    assert graph.cleaning_counts(df).first().asDict() == {"raw_rows": 8, "self_loops": 1, "multi_edges": 1, "reciprocals": 1, "simple_edges": 5}
    n = graph.build_network(df)
    assert [(r.node, r.original_id, r.degree) for r in sorted(n.nodes.collect())] == [(0, 1, 1), (1, 2, 2), (2, 3, 1)]  # the tie goes to the smallest node
    assert graph.cleaning_counts(df.limit(0)).first().raw_rows == 0


def test_shells_and_ball(net, near, shell):
    got = {(r.src, r.node): r.d for r in shell.collect()}
    want = {(s, x): d for s in near for x, d in distances(near, s).items() if d <= 3}
    assert got == want
    view = shells.observer_view(net, shell, 1).groupBy("src").count().collect()
    assert {r.src for r in view} == set(near)


def test_one_hop_features(net, near):
    ego = {r.node: r for r in features.ego_features(net).collect()}
    eb = {r.node: r.ego_betweenness for r in features.ego_betweenness(net).collect()}
    for x, ns in near.items():
        tri = sum(b in near[a] for a, b in combinations(ns, 2))
        assert (ego[x].triangle_count, ego[x].ego_net_edges) == (tri, tri + len(ns))
        assert ego[x].edges_leaving_ego == sum(y not in ns and y != x for a in ns for y in near[a])
        want = sum(1 / (1 + len(ns & near[a] & near[b])) for a, b in combinations(ns, 2) if b not in near[a])
        assert eb[x] == pytest.approx(want)


def test_h_index_and_core(net, near):
    def h(vals):
        return max((min(v, i + 1) for i, v in enumerate(sorted(vals, reverse=True))), default=0)

    held = {x: len(ns) for x, ns in near.items()}
    ladder = {r.node: r for r in features.h_index_ladder(net).collect()}
    for s in (1, 2, 3):
        held = {x: h([held[y] for y in ns]) for x, ns in near.items()}
        assert held == {x: ladder[x][f"h_index_{s}"] for x in near}
    while (new := {x: h([held[y] for y in ns]) for x, ns in near.items()}) != held:
        held = new
    assert held == {r.node: r.core for r in targets.core_numbers(net).collect()}


def test_betweenness(net, near, shell):
    ptr, nbr = targets.adjacency(net)
    whole = targets.brandes(ptr, nbr, range(len(near))) / 2
    got = {r.node: r.betweenness for r in targets.exact_betweenness(net).collect()}
    assert all(got[x] == pytest.approx(whole[x]) for x in near)
    deep = max(max(distances(near, s).values()) for s in near)
    far = shells.shells(net.arcs, deep)
    bk = {r.node: r[f"b_{deep}"] for r in targets.truncated_betweenness(net, far, deep).collect()}
    assert all(bk[x] == pytest.approx(whole[x]) for x in near)  # at the diameter b_k is betweenness
    b2 = {r.node: r.b_2 for r in targets.b2(net).collect()}
    via = {r.node: r.b_2 for r in targets.truncated_betweenness(net, shell, 2).collect()}
    assert all(b2[x] == pytest.approx(via[x]) for x in near)
    zero = {r.node for r in targets.zero_set(net.arcs, net.nodes).collect()}
    assert zero == {x for x in near if whole[x] < 1e-9}


def test_percolation_equals_direct_cascades(spark, net):
    edges = net.edges.withColumn("p", __import__("pyspark").sql.functions.lit(0.4))
    live = [(r.draw, r.u, r.v) for r in dynamics.live_edges(edges, 5).collect()]
    got = {(r.draw, r.node): r["size"] for r in dynamics.percolation(net, edges, 5).collect()}
    for draw in range(5):
        near = {r.node: set() for r in net.nodes.collect()}
        for d, u, v in live:
            if d == draw:
                near[u].add(v)
                near[v].add(u)
        assert all(got[draw, x] == len(distances(near, x)) for x in near)


@pytest.mark.parametrize(("num", "den", "want"), [(1, 2, 5), (3, 5, 2)])
def test_threshold_path(spark, num, den, want):
    sizes = {r.node: r["size"] for r in dynamics.threshold_sizes(net_of(spark, PATH5), num, den).collect()}
    assert sizes[0] == want


def test_threshold_isolate_stays_alone(spark):
    n = net_of(spark, [(0, 1), (1, 2)], connected=False)
    extra = graph.Network(n.nodes.unionByName(spark.createDataFrame([(3, 3, 0)], "node long, original_id long, degree long")), n.edges)
    assert [r["size"] for r in sorted(dynamics.threshold_sizes(extra, 1, 10).collect())] == [3, 3, 3, 1]


@pytest.mark.parametrize("size", [3, 4, 5])
def test_orbits_against_enumeration(net, near, size):
    rows, _, classes = motifs.tables(size)
    assert classes == {3: 2, 4: 6, 5: 21}[size]
    assert len({(c, o) for c, os in rows.values() for o in os}) == {3: 3, 4: 11, 5: 58}[size]
    if size == 5:
        return
    pairs = list(combinations(range(size), 2))
    want: dict = {}
    for s in combinations(sorted(near), size):
        code = sum(1 << i for i, (a, b) in enumerate(pairs) if s[b] in near[s[a]])
        if code in rows:
            c, orbits = rows[code]
            for x, o in zip(s, orbits, strict=True):
                want[x, c, o] = want.get((x, c, o), 0) + 1
    assert {(r.node, r.cls, r.orbit): r.n for r in motifs.node_orbits(net, size).collect()} == want


def test_thresholds(spark, net):
    assert spectral.epidemic_threshold(net_of(spark, PATH5)) == float("inf")
    assert spectral.epidemic_threshold(net_of(spark, TRIANGLE)) == 1.0
    k5 = net_of(spark, list(combinations(range(5), 2)))
    assert spectral.epidemic_threshold(k5) == pytest.approx(1 / 3)
    assert spectral.epidemic_threshold(k5, "adjacency") == pytest.approx(1 / 4)
    square = net_of(spark, [(a, b) for a in range(3) for b in range(3, 6)])  # bipartite: eigenvalues in +- pairs
    assert spectral.epidemic_threshold(square) == pytest.approx(1 / 2)
    with pytest.raises(ValueError):
        spectral.transmission_probability(float("inf"))


def test_rank_statistics(spark):
    rng = random.Random(4)
    x, y = [rng.randrange(6) for _ in range(60)], [rng.randrange(6) for _ in range(60)]
    sign = lambda a: (a > 0) - (a < 0)
    pairs = [(sign(x[i] - x[j]), sign(y[i] - y[j])) for i, j in combinations(range(60), 2)]
    s = sum(a * b for a, b in pairs)
    assert rankstats.concordance(np.array(x), np.array(y)) == (s, len(pairs), sum(a == 0 for a, _ in pairs), sum(b == 0 for _, b in pairs))
    assert rankstats.tau_b(np.array([1, 1]), np.array([1, 2])) is None
    y0, s0 = np.array([0, 0, 1, 2, 3]), np.array([0, 1, 0, 3, 2])
    assert rankstats.tau_b(y0[2:], s0[2:]) == pytest.approx(1 / 3)
    assert rankstats.kendall_critical(4) == 1.0
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "node int, p double")
    q = [r.q for r in sorted(rankstats.benjamini_hochberg(df, "p").collect())]
    assert q == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_leakage_guard():
    targets.assert_no_leakage(["degree", "ego_betweenness", "collective_influence_2"])
    for bad in ("log_PageRank", "spread_mean", "betweenness_norm"):
        with pytest.raises(ValueError):
            targets.assert_no_leakage(["degree", bad])


def test_edge_list_files(spark, tmp_path):
    (tmp_path / "toy.txt").write_text("# head\n% note\n\n1 2 0.5\n3,4\n5\t6\nx y\n7\n")
    path = f"file://{tmp_path}/toy.txt"
    assert sorted(map(tuple, edgelist.read_edgelist(spark, path).collect())) == [(1, 2), (3, 4), (5, 6)]
    seen = edgelist.inspect_edgelist(spark, path).first()
    assert (seen.rows, seen.unparsed) == (5, 2)
    with pytest.raises(ValueError):
        edgelist.checked_edgelist(spark, path, rows=4)
    with pytest.raises(ValueError):
        edgelist.checked_edgelist(spark, path, sha256="0")
    assert edgelist.discover_networks(spark, f"file://{tmp_path}").first().network == "toy"
    edgelist.write_edgelist(edgelist.read_edgelist(spark, path), f"file://{tmp_path}/out", "two columns")
    assert edgelist.read_edgelist(spark, f"file://{tmp_path}/out").count() == 3


def test_generators_and_swaps(spark):
    from collections import Counter

    e = [(r.u, r.v) for r in descriptors.holme_kim(spark, 60, 3, 0.7, 1).collect()]
    swapped = descriptors.double_edge_swap(e, 50, 2)
    deg = lambda es: Counter(x for p in es for x in p)
    assert deg(e) == deg(swapped) and len(set(swapped)) == len(e)
    assert descriptors.watts_strogatz(spark, 20, 4, 0.0, 1).count() == 40
    z = descriptors.hurwitz_zeta(np.array([2.0, 4.0]), 1.0)
    assert z == pytest.approx([np.pi**2 / 6, np.pi**4 / 90])
    for net_ in (net_of(spark, e),):
        assert descriptors.structural_profile(net_).first().n == 60


def test_damage_keeps_nodes(net):
    hurt = graph.delete_edges(net, 0.9, 1)
    assert hurt.nodes.count() == net.n and hurt.edges.count() < net.m
    row = graph.align_columns(hurt.nodes.select("node", "degree"), ["degree", "gone"]).first()
    assert row.gone == 0.0


def test_planted_communities():
    for mixing in (0.1, 0.4):
        edges, home = descriptors.planted_communities(600, 8.0, mixing, seed=3)
        across = np.mean([home[u] != home[v] for u, v in edges])
        assert abs(across - mixing) < 0.1 and (home >= 0).all()
        assert len({home[x] for x in range(600)}) > 2


@pytest.mark.parametrize("den", [2, 3])
def test_threshold_cascades_against_loops(net, near, shell, den):
    def run(src, ball):
        active = {src, *near[src]} & ball
        while new := {v for v in ball - active if den * len(near[v] & active) >= len(near[v])}:
            active |= new
        return active

    got = {r.node: r.size for r in dynamics.threshold_sizes(net, 1, den).collect()}
    assert got == {s: len(run(s, set(near))) for s in near}
    inside = dynamics.truncated_threshold_sizes(net, 1, den, shell, 2)
    want = {}
    for s in near:
        dist = distances(near, s)
        active = run(s, {v for v, d in dist.items() if d <= 2})
        want[s] = (len(active), all(dist[v] < 2 for v in active))
    assert {r.node: (r.size, r.contained) for r in inside.collect()} == want
    assert {r.node: r.prediction for r in dynamics.censored_predictor(inside, len(near)).collect()} == {s: n if c else len(near) + 1 for s, (n, c) in want.items()}


def test_loops_that_do_not_end_raise(spark, net):
    with pytest.raises(RuntimeError):
        dynamics.sir(net, net.nodes.select("node").limit(1), 1.0, 0.0, 1, max_steps=2)
    with pytest.raises(RuntimeError):
        dynamics.threshold_cascades(net_of(spark, [(i, i + 1) for i in range(8)]), 1, 2, max_steps=1)


def plain_uniform(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52


@pytest.mark.parametrize(("seed", "scale"), [(7, 1.0), (-3, 0.02), (10**16, 1.0)])
def test_sieve_keeps_every_link(seed, scale):
    rng = np.random.default_rng(1)
    ids = np.unique(np.concatenate([np.arange(120), rng.integers(-(10**6), 10**12, 100), [2**62, 2**63 - 1]]))
    w = np.where(rng.random(len(ids)) < 0.2, 0.0, rng.integers(1, 40, len(ids))).astype(float)
    total = float(w.sum()) * scale  # at 0.02 most products are above one
    want = {(a, b) for (a, x), (b, y) in combinations(zip(ids.tolist(), w.tolist(), strict=True), 2) if plain_uniform(a, b, seed) < x * y / total}
    got = [(a, b) for u, v, _ in md5.sieve(ids, w, ids, w, total, seed) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    assert want <= set(got) and len(got) == len(set(got))
    if scale == 1.0 and seed == 7:
        assert len(got) == len(want)


def test_chung_lu_by_blocks(spark, monkeypatch):
    """Blocks of nodes meet in tasks of their own, however few partitions the weights have; links are those of the definition."""
    monkeypatch.setattr(descriptors, "LEAST_BLOCK", 16)
    w = [(3 * i, 1.0 + i % 7) for i in range(150)]
    out = descriptors.chung_lu(spark.createDataFrame([*w, (1, None)], "node long, w double").coalesce(1), 7)
    assert out.rdd.getNumPartitions() == 55
    total = sum(x for _, x in w)
    want = [(a, b) for (a, x), (b, y) in combinations(w, 2) if plain_uniform(a, b, 7) < x * y / total]
    assert sorted((r.u, r.v) for r in out.collect()) == want
    assert descriptors.chung_lu(spark.createDataFrame([], "node long, w double"), 7).count() == 0
