"""One query per operator over the part co-purchase network; names start with the operators they show."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rng import uniform
from .operators import descriptors, dynamics, features, graph, rankstats, relational, shells, spectral, targets
from .plans import contrasts, horizon
from .sources.tables import stored, table

DRAWS, P, SEEDS = 8, 0.1, 5
_NETWORKS: dict[tuple[str, str], dict] = {}


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts that one order takes at the same discount, from all of lineitem: the network's definition."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_linenumber", "l_partkey")
    a, b = (li.select("l_orderkey", "l_discount", F.col("l_linenumber").alias(x), F.col("l_partkey").alias(u)) for x, u in (("x", "u"), ("y", "v")))
    return a.join(b, ["l_orderkey", "l_discount"]).filter("x < y").select("u", "v")


def _held(spark: SparkSession, sf_dir: str) -> dict:
    return _NETWORKS.setdefault((spark.sparkContext.applicationId, sf_dir), {})


def network(spark: SparkSession, sf_dir: str) -> graph.Network:
    """The prepared network of a data folder, made once a session."""
    held = _held(spark, sf_dir)
    if "net" not in held:
        held["net"] = graph.build_network(raw_edges(spark, sf_dir))
    return held["net"]


def percolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir)
    if "perc" not in held:
        net = network(spark, sf_dir)
        held["perc"] = stored(dynamics.percolation(net, net.edges.withColumn("p", F.lit(P)), DRAWS), "perc")
    return held["perc"]


def sweep_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of closed-form rules against b_2 over all nodes; each seed breaks the rules' ties another way."""
    held = _held(spark, sf_dir)
    if "cells" not in held:
        net = network(spark, sf_dir)
        k = features.degree_features(net).select("node", F.col("degree").alias("x0"))
        nd = features.neighbour_degree_features(net).select("node", F.col("nbr_degree_sum").alias("x1"))
        ego = features.ego_features(net).select("node", F.col("edges_leaving_ego").alias("y1"))
        sh = shells.shell_features(net).select("node", "reach_within_2", "reach_within_3", "collective_influence_2", "collective_influence_3")
        b = targets.b2(net).select("node", F.round("b_2", 6).alias("y"))
        wide = stored(k.join(nd, "node").join(ego, "node").join(sh, "node").join(b, "node"), "rules")
        rule = lambda r, q, c: F.struct(F.lit(r).alias("radius"), F.lit(q).alias("richness"), F.col(c).cast("double").alias("x"))
        rules = F.array(rule(0, "node", "x0"), rule(1, "node", "x1"), rule(2, "node", "reach_within_2"), rule(3, "node", "reach_within_3"), rule(0, "all", "x0"), rule(1, "all", "y1"), rule(2, "all", "collective_influence_2"), rule(3, "all", "collective_influence_3"))
        long = wide.select("node", "y", F.explode(rules).alias("r")).select("node", "y", "r.*", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed"))
        long = long.withColumn("x", F.col("x") + 0.001 * uniform("node", "seed"))
        held["cells"] = stored(rankstats.kendall(long, ["radius", "richness", "seed"], "y", "x", "kendall_tau").withColumn("kendall_tau", F.round("kendall_tau", 9)), "cells")
    return held["cells"]


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits, without negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def flagship_influencers(s, d):
    """The 20 nodes of highest two-hop collective influence with degree, h-index and reach."""
    net = network(s, d)
    sh = shells.shell_features(net).select("node", "collective_influence_2", "reach_within_2")
    j = sh.join(features.h_index_ladder(net, 1), "node").join(net.nodes, "node")
    return dynamics.top_k(j.select("node", "original_id", "degree", "h_index_1", "collective_influence_2", "reach_within_2"), "collective_influence_2", 20)


@query
def p1_p4_cleaning_counts(s, d):
    return graph.cleaning_counts(raw_edges(s, d))


@query
def p6_components(s, d):
    from .operators.components import connected_components

    return connected_components(graph.simple_edges(raw_edges(s, d)))


@query
def p5_p8_network_nodes(s, d):
    return network(s, d).nodes.select("node", "original_id", F.col("degree").cast("long").alias("degree"))


@query
def p9_s13_neighbour_lists(s, d):
    return graph.neighbour_lists(network(s, d)).select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query
def p11_directed_arcs(s, d):
    return graph.directed_arcs(raw_edges(s, d), False).groupBy("u").agg(F.count("*").alias("out_degree"), F.sum("v").alias("sum_v"))


@query
def p12_p13_deleted_edges(s, d):
    net = graph.delete_edges(network(s, d), 0.2, 3)
    return graph.align_columns(net.nodes.select("node", "degree"), ["degree", "triangle_count"])


@query
def p14_ball_arcs(s, d):
    return shells.induced_ball(network(s, d), None, 1).groupBy("src").agg(F.count("*").alias("arcs"))


@query
def p15_observer_view(s, d):
    v = shells.observer_view(network(s, d), None, 1)
    return v.groupBy("src").agg(F.count("*").alias("arcs"), F.count_if(F.col("v") < 0).alias("stubs"))


@query
def f1_degree(s, d):
    return _round(features.degree_features(network(s, d)))


@query
def f2_f7_ego(s, d):
    return _round(features.ego_features(network(s, d)))


@query
def f8_f9_edges(s, d):
    return _round(features.edge_features(network(s, d)), 9)


@query
def f10_f11_f28_neighbour_degree(s, d):
    return _round(features.neighbour_degree_features(network(s, d)))


@query
def f12_ego_betweenness(s, d):
    return _round(features.ego_betweenness(network(s, d)))


@query
def f13_cluster_rank(s, d):
    return _round(features.cluster_rank(network(s, d)))


@query
def f14_f15_h_index_ladder(s, d):
    return features.h_index_ladder(network(s, d))


@query
def f17_shell_counts(s, d):
    return shells.shell_counts(network(s, d))


@query
def f16_f22_shell_features(s, d):
    return _round(shells.shell_features(network(s, d)))


@query
def f21_ball2(s, d):
    return _round(shells.ball2_features(network(s, d)))


@query
def f23_neighbour_triangles(s, d):
    return _round(features.neighbour_triangle_features(network(s, d)))


@query
def f24_semilocal(s, d):
    return _round(features.semilocal_features(network(s, d)))


@query
def f25_percolation_reach(s, d):
    return _round(shells.percolation_reach(network(s, d), None, P))


@query
def f26_a16_coverage(s, d):
    return _round(shells.coverage(network(s, d)))


@query
def f27_walk_counts(s, d):
    return features.walk_counts(network(s, d))


@query
def f29_branch_anisotropy(s, d):
    return _round(features.branch_anisotropy(network(s, d)))


@query
def f30_node_orbits_4(s, d):
    from .operators import motifs

    return motifs.node_orbits(network(s, d), 4)


@query
def f32_f33_edge_orbits_4(s, d):
    from .operators import motifs

    return _round(motifs.edge_orbit_features(network(s, d), 4))


@query
def d1_edge_probability(s, d):
    return dynamics.edge_probability(network(s, d), "trivalency", seed=5)


@query
def d2_arc_probability(s, d):
    return _round(dynamics.arc_probability(network(s, d), "weighted"))


@query
def d3_d9_percolation(s, d):
    return percolated(s, d)


@query
def d4_direct_cascades(s, d):
    net = network(s, d)
    return dynamics.direct_cascades(dynamics.arc_probability(net, "weighted"), net, 4, 1)


@query
def d5_sir(s, d):
    return dynamics.sir(network(s, d), None, 0.03, 0.5, 2)


@query
def d6_spread_statistics(s, d):
    return _round(dynamics.spread_statistics(percolated(s, d), network(s, d).n))


@query
def d7_noise_report(s, d):
    return _round(dynamics.noise_report(dynamics.spread_statistics(percolated(s, d), network(s, d).n)))


@query
def d8_transmission_sweep(s, d):
    return _round(dynamics.transmission_sweep(network(s, d), [0.1, 0.3], 4))


@query
def d10_truncated_cascades(s, d):
    net = network(s, d)
    return dynamics.truncated_cascades(net, net.edges.withColumn("p", F.lit(P)), [1, 2], 4)


@query
def d11_threshold_cascades(s, d):
    return dynamics.threshold_sizes(network(s, d), 1, 3)


@query
def d12_d13_truncated_threshold(s, d):
    net = network(s, d)
    t = dynamics.truncated_threshold_sizes(net, 1, 3, None, 2)
    return t.join(dynamics.censored_predictor(t, net.n), "node")


@query
def d14_ignition_gate(s, d):
    return _round(dynamics.ignition_gate(percolated(s, d), network(s, d).n))


def _largest(s, d):
    net = network(s, d)
    each = [dynamics.largest_two(dynamics.percolation(net, net.edges.withColumn("p", F.lit(m / 10)), 6, 2)).withColumn("m", F.lit(m)) for m in (2, 4, 6)]
    return reduce(DataFrame.unionByName, each)


@query
def d15_largest_two(s, d):
    return dynamics.largest_two(percolated(s, d)).select("draw", F.col("s1").cast("long").alias("s1"), F.col("s2").cast("long").alias("s2"))


@query
def d16_susceptibility_peak(s, d):
    chi = stored(dynamics.susceptibility(_largest(s, d)), "chi")
    return dynamics.locate_peak(chi).crossJoin(_round(chi.agg(F.max("chi").alias("chi"))))


@query
def d17_bootstrap_peak(s, d):
    return dynamics.bootstrap_peak(_largest(s, d), 10, 6)


@query
def d18_set_spread(s, d):
    return dynamics.set_spread(percolated(s, d), dynamics.top_k(network(s, d).degree, "k", 5))


@query
def d19_greedy_seeds(s, d):
    return dynamics.greedy_seeds(percolated(s, d), 3)


@query
def d20_degree_discount(s, d):
    return dynamics.degree_discount(network(s, d), 3, P)


@query
def d21_top_k(s, d):
    return dynamics.top_k(network(s, d).degree, "k", 25)


@query
def c1_nonbacktracking_pairs(s, d):
    return spectral.nonbacktracking_pairs(network(s, d).arcs).groupBy("v").agg(F.count("*").alias("pairs"), F.sum(F.col("u") * F.col("w")).alias("uw"))


@query
def c3_power_steps(s, d):
    return _round(spectral.power_steps(network(s, d), 4))


@query
def c4_cyclomatic_excess(s, d):
    return spectral.cyclomatic_excess(network(s, d))


@query
def c5_c7_c8_thresholds(s, d):
    net = network(s, d)
    b = spectral.epidemic_threshold(net)
    first, second, gap = spectral.nonbacktracking_gap(net, rounds=60)
    return s.createDataFrame([(b, spectral.epidemic_threshold(net, "adjacency"), spectral.transmission_probability(b), first, second, gap)], "beta_c double, beta_adjacency double, p double, first double, second double, gap double")


@query
def c6_mean_field_threshold(s, d):
    return s.createDataFrame([(round(spectral.epidemic_threshold(network(s, d), "mean_field"), 9),)], "beta double")


@query
def t1_exact_betweenness(s, d):
    return _round(targets.exact_betweenness(network(s, d)), 4)


@query
def t3_b2(s, d):
    return _round(targets.b2(network(s, d)))


@query
def t3_b3(s, d):
    return _round(targets.truncated_betweenness(network(s, d), None, 3))


@query
def t4_variance_residual(s, d):
    return _round(targets.variance_residual(dynamics.spread_statistics(percolated(s, d), network(s, d).n), 10))


@query
def t5_targets(s, d):
    net = network(s, d)
    b = targets.b2(net).withColumnRenamed("b_2", "betweenness")
    return _round(targets.build_targets(dynamics.spread_statistics(percolated(s, d), net.n), b, 10))


@query
def t7_core_numbers(s, d):
    return targets.core_numbers(network(s, d))


@query
def t8_distance_to_hubs(s, d):
    return targets.distance_to_hubs(network(s, d))


@query
def a31_zero_set(s, d):
    return targets.zero_set(network(s, d).arcs, network(s, d).nodes)


@query
def a32_witnesses(s, d):
    w = targets.witnesses(network(s, d))
    return w.select("node", "a", "b", "common", "num", F.col("den").cast("long").alias("den"))


@query
def g1_g2_g3_descriptors(s, d):
    return _round(descriptors.structural_profile(network(s, d)))


@query
def g4_g5_power_law_tail(s, d):
    return descriptors.fit_tail(network(s, d), 3)


@query
def g7_erdos_renyi(s, d):
    return descriptors.erdos_renyi(s, 200, 4.0, 7)


@query
def g8_chung_lu(s, d):
    w = network(s, d).degree.select("node", F.col("k").cast("double").alias("w"))
    return descriptors.chung_lu(w, 7)


@query
def g9_configuration_model(s, d):
    return descriptors.configuration_model(network(s, d).degree, 7)


@query
def k1_k5_evaluate(s, d):
    """All cell metrics of degree against b_2."""
    j = targets.b2(network(s, d)).select("node", F.round("b_2", 6).alias("y")).join(network(s, d).degree.select("node", F.col("k").cast("double").alias("pred")), "node").withColumn("cell", F.lit("degree"))
    return _round(rankstats.evaluate(j, ["cell"]))


@query
def k6_k7_percentile_rank(s, d):
    k = network(s, d).degree
    return _round(k.select("node", rankstats.percentile_rank("k").alias("pct"), rankstats.centred_rank("k").alias("centred")))


@query
def k8_k9_somers(s, d):
    j = targets.b2(network(s, d)).select("node", F.round("b_2", 6).alias("y")).join(network(s, d).degree, "node").toPandas()
    t = rankstats.tied_pairs(network(s, d).degree, "k").select(F.col("tied_pairs").cast("long").alias("tied_pairs"))
    return t.withColumn("somers_d", F.round(F.lit(rankstats.somers_d(j["y"].to_numpy(), j["k"].to_numpy())), 6))


@query
def k10_cliffs_delta(s, d):
    zero = targets.zero_set(network(s, d).arcs, network(s, d).nodes).withColumn("z", F.lit(True))
    j = network(s, d).degree.join(zero, "node", "left").select(F.coalesce("z", F.lit(False)).alias("z"), "k")
    return _round(rankstats.cliffs_delta(j, "z", "k").select("delta"))


@query
def k11_zero_inflation(s, d):
    return _round(rankstats.zero_inflation(targets.b2(network(s, d)), "b_2"))


@query
def k14_pair_contributions(s, d):
    j = targets.b2(network(s, d)).select("node", F.round("b_2", 6).alias("y")).join(network(s, d).degree, "node")
    return rankstats.pair_contributions(j, "y", "k")


@query
def k16_adjusted_p(s, d):
    p = network(s, d).nodes.select("node", uniform("node", F.lit("p")).alias("p"))
    q = rankstats.benjamini_hochberg(p, "p").join(rankstats.benjamini_hochberg(p, "p", dependent=True).select("node", F.col("q").alias("q_by")), "node")
    return _round(q)


@query
def k17_a20_paired_gain(s, d):
    return _round(rankstats.paired_gain(sweep_cells(s, d), ["radius"], "richness", "all", "node", "kendall_tau"))


@query
def k19_moran(s, d):
    return _round(rankstats.moran(network(s, d), network(s, d).degree.select("node", F.col("k").cast("double").alias("z")), 3))


@query
def k13_two_number_report(s, d):
    net = network(s, d)
    zero = targets.zero_set(net.arcs, net.nodes).withColumn("z", F.lit(True))
    j = targets.b2(net).select("node", F.round("b_2", 6).alias("y")).join(net.degree, "node").join(zero, "node", "left").select("y", "k", F.coalesce("z", F.lit(False)).alias("z"))
    return _round(rankstats.two_number_report(j, "y", "k", "z"))


@query
def k15_tie_broken_tau(s, d):
    j = targets.b2(network(s, d)).select("node", F.round("b_2", 6).alias("y")).join(network(s, d).degree, "node")
    return _round(rankstats.tie_broken_tau(j, "k", "y", 2))


@query
def k20_moran_null(s, d):
    return _round(rankstats.moran_null(network(s, d), network(s, d).degree.select("node", F.col("k").cast("double").alias("z")), 1, 3))


@query
def m10_buffered_plan(s, d):
    from .plans.models import buffered_plan, folds

    return buffered_plan(network(s, d), folds(network(s, d).nodes.select("node"), 5, 0), 0)


@query
def m11_transfer(s, d):
    """Degree and neighbour degrees fitted on one network's b_2 ranks, applied to a damaged copy's, and the other way."""
    from .plans.models import transfer

    each = {}
    for name, net in (("whole", network(s, d)), ("damaged", graph.delete_edges(network(s, d), 0.2, 3))):
        x = features.degree_features(net).join(features.neighbour_degree_features(net), "node")
        each[name] = (x, targets.b2(net).select("node", F.col("b_2").alias("y")))
    return transfer(each, ["degree", "nbr_degree_mean", "nbr_degree_max"], "ridge", 0)


@query
def m1_r5_fold_digest(s, d):
    from .plans.models import folds

    return horizon.fold_digest(folds(network(s, d).nodes.select("node"), 5, 0))


@query
def m9_subsample(s, d):
    from .plans.models import folds, subsample

    return subsample(folds(network(s, d).nodes.select("node"), 5, 0), 0.25, 0)


@query
def m2_m8_locality_sweep(s, d):
    """Out-of-fold quality of a ridge at radii 0 to 2 against b_2."""
    from .plans.models import locality_sweep

    net = network(s, d)
    x = features.degree_features(net).join(features.ego_features(net), "node").join(features.neighbour_degree_features(net), "node").join(shells.shell_features(net), "node")
    y = targets.b2(net).select("node", F.col("b_2").alias("y"))
    return locality_sweep(x, y, "b_2", [0, 1, 2], ["node"], [0], "ridge")


@query
def a0_sweep_cells(s, d):
    return _round(sweep_cells(s, d))


@query
def a1_horizon(s, d):
    return _round(horizon.horizon(sweep_cells(s, d), ["richness", "seed"], 0.05))


@query
def a2_a11_modal_horizon(s, d):
    return horizon.modal_horizon(horizon.horizon(sweep_cells(s, d), ["richness", "seed"], 0.05), ["richness"])


@query
def a3_curve(s, d):
    return _round(horizon.curve(sweep_cells(s, d), ["richness"]))


@query
def a4_seed_matrix(s, d):
    return _round(horizon.seed_matrix(sweep_cells(s, d), ["richness"], [0, 1, 2, 3]))


@query
def a5_keep_last(s, d):
    c = sweep_cells(s, d)
    log = c.withColumn("seq", F.lit(1)).unionByName(c.filter("seed < 2").withColumn("kendall_tau", F.col("kendall_tau") / 2).withColumn("seq", F.lit(2)))
    return _round(horizon.keep_last(log, ["radius", "richness", "seed"]))


@query
def a7_pareto(s, d):
    c = horizon.curve(sweep_cells(s, d), ["richness"]).withColumn("seconds", F.col("radius") * 10 + F.when(F.col("richness") == "all", 5).otherwise(0))
    return _round(horizon.pareto(c.select("richness", "radius", "seconds", F.round("tau_mean", 9).alias("tau_mean")), [], "seconds"))


@query
def a8_depth_against_richness(s, d):
    return _round(horizon.depth_against_richness(sweep_cells(s, d), [], "node", "all"))


@query
def a9_noise_horizon(s, d):
    return horizon.noise_horizon(sweep_cells(s, d), ["richness"])


@query
def a10_a26_radius_gains(s, d):
    return _round(horizon.radius_gains(sweep_cells(s, d), ["richness"]))


@query
def a12_standardised_residual(s, d):
    net = network(s, d)
    b = targets.b2(net).withColumn("b_2", F.round("b_2", 6))
    j = net.degree.join(b, "node").select("node", "k", (rankstats.percentile_rank("b_2") - rankstats.percentile_rank("k")).alias("delta"))
    return _round(horizon.standardised_residual(j, "k", "delta", 4))


@query
def a13_tails(s, d):
    return horizon.tails(network(s, d).degree, "k")


@query
def a25_certificate_ratio(s, d):
    return _round(horizon.certificate_ratio(sweep_cells(s, d), ["richness"]))


@query
def a28_radius_rule(s, d):
    return horizon.radius_rule(horizon.curve(sweep_cells(s, d), ["richness"]), ["richness"], "tau_mean", 3, 0.9)


@query
def a29_verdicts(s, d):
    return horizon.verdicts(horizon.radius_gains(sweep_cells(s, d), ["richness"]), ["richness"])


@query
def a33_a34_grid_scan(s, d):
    return _round(horizon.grid_scan(table(s, d, "lineitem"), "l_discount", 0.01))


@query
def a33_pair_labels(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "_filtered").otherwise("")).alias("label"))  # two label kinds from one table
    return horizon.pair_labels(o, "label", "o_orderkey")


@query
def a38_compare_runs(s, d):
    c = sweep_cells(s, d)
    new = c.filter("radius > 0").withColumn("kendall_tau", F.when(F.col("seed") == 1, F.col("kendall_tau") + 0.01).otherwise(F.col("kendall_tau")))
    return _round(horizon.compare_runs(c.filter("radius < 3"), new, ["radius", "richness", "seed"]))


@query
def r1_missing_cells(s, d):
    c = sweep_cells(s, d).select("radius", "richness", "seed")
    return horizon.missing_cells(c, c.filter("seed < 4"), c.filter("radius <> 2"), ["radius", "richness", "seed"])


@query
def x1_unpivot_features(s, d):
    return _round(relational.unpivot(features.degree_features(network(s, d)), ["node"], ["degree", "degree_normalized"]))


@query
def x2_common_leaders(s, d):
    net = network(s, d)
    by_neighbours = features.neighbour_degree_features(net).select("node", F.col("nbr_degree_sum").alias("k"))
    return relational.common_rows(dynamics.top_k(net.degree, "k", 100).select("node"), dynamics.top_k(by_neighbours, "k", 100).select("node"))


@query
def x3_lookup_parts(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("original_id"), "p_brand", "p_size")
    return relational.lookup_join(network(s, d).nodes.select("node", "original_id"), part, "original_id")


def _richness_gains(s, d):
    """(radius, seed, g): the richer rules' paired gain."""
    c = sweep_cells(s, d)
    a, b = (c.filter(F.col("richness") == r).select("radius", "seed", F.col("kendall_tau").alias(x)) for r, x in (("all", "a"), ("node", "b")))
    return a.join(b, ["radius", "seed"]).select("radius", "seed", F.round(F.col("a") - F.col("b"), 9).alias("g"))


def _hop_gains(s, d):
    """(radius, seed, g): each radius's gain over the one before, all rules."""
    c = sweep_cells(s, d).filter("richness = 'all'").select("radius", "seed", "kendall_tau")
    prev = c.select((F.col("radius") + 1).alias("radius"), "seed", F.col("kendall_tau").alias("p"))
    return c.join(prev, ["radius", "seed"]).select("radius", "seed", F.round(F.col("kendall_tau") - F.col("p"), 9).alias("g"))


@query
def k12_mixture_tau(s, d):
    c = sweep_cells(s, d).withColumn("n", F.lit(1000)).withColumn("n_zero", 100 * (F.col("radius") + 1))
    return _round(c.select("radius", "richness", "seed", contrasts.mixture_tau("kendall_tau", "n", "n_zero").alias("untied"), contrasts.mixture_tau("kendall_tau", "n", "n_zero", True).alias("tied")))


@query
def k16_paired_tests(s, d):
    """Gains of radius 0 are all zero: the case without a t statistic."""
    return _round(contrasts.paired_tests(_richness_gains(s, d), ["radius"]))


@query
def a17_horizon_agreement(s, d):
    return contrasts.horizon_agreement(sweep_cells(s, d), [], "richness", "node", 0.05)


@query
def a21_families(s, d):
    parts = {"richness": contrasts.paired_tests(_richness_gains(s, d), ["radius"]), "hop": contrasts.paired_tests(_hop_gains(s, d), ["radius"])}
    return _round(contrasts.families(parts, "p_sign").select("family", "radius", "p_sign", "q", "q_by"))


@query
def a22_rung_gains(s, d):
    c = sweep_cells(s, d).withColumn("n_features", F.when(F.col("radius") == 0, 1).when(F.col("richness") == "all", 2).otherwise(1))
    both = c.withColumn("objective", F.lit("raw")).unionByName(c.withColumn("objective", F.lit("log1p")).withColumn("kendall_tau", F.col("kendall_tau") * (1 + 0.01 * F.col("seed"))))
    return _round(contrasts.rung_gains(both, ["radius", "objective"], "node", "all"))


@query
def a23_share_drops(s, d):
    c = sweep_cells(s, d).withColumn("fraction", F.when(F.col("richness") == "node", 0.2).otherwise(1.0))
    return _round(contrasts.share_drops(c, ["radius"], 0.2))


@query
def a24_transfer_summary(s, d):
    c = sweep_cells(s, d)
    within = c.filter("richness = 'all' AND radius < 3").groupBy("radius").agg(F.avg("kendall_tau").alias("within"))
    floor = c.filter("richness = 'all' AND radius > 0").groupBy("radius").agg(F.min("kendall_tau").alias("floor"))
    return _round(contrasts.transfer_summary(c.filter("richness = 'node'"), within, floor, ["radius"]))


@query
def a27_arm_contrasts(s, d):
    c = sweep_cells(s, d).withColumn("status", F.when((F.col("radius") == 3) & (F.col("richness") == "node") & (F.col("seed") == 1), "infeasible").otherwise("complete"))
    c = c.filter("NOT (radius = 2 AND richness = 'all' AND seed = 0)")
    return _round(contrasts.arm_contrasts(c, ["radius"], "richness", [("all", "node"), ("node", "all")], SEEDS))


@query
def a36_pooled_noise(s, d):
    return _round(contrasts.pooled_noise(sweep_cells(s, d), ["richness"], "radius"), 9)


@query
def a39_replicate_noise(s, d):
    c = sweep_cells(s, d).filter("radius > 0")
    refit = c.select("radius", "richness", F.col("seed").alias("rep"), F.col("kendall_tau").alias("tau_refit"))
    frozen = c.select("radius", "richness").distinct().withColumn("target_noise_sd", 0.01 * F.col("radius")).withColumn("seed_sd", F.lit(0.002))
    return _round(contrasts.replicate_noise(refit, frozen, ["radius", "richness"], SEEDS).select("radius", "richness", "sd_refit", "tau_refit_mean", "refit_over_frozen"))


@query
def a40_evicted_cells(s, d):
    c = sweep_cells(s, d)
    keys = c.select("radius", "richness").distinct()
    lists = lambda *names: F.array(*map(F.lit, names))
    old = keys.withColumn("columns", lists("a", "b", "c"))
    new = keys.withColumn("columns", F.when(F.col("radius") == 1, lists("b", "a", "c")).when(F.col("radius") == 2, lists("a", "b", "d")).otherwise(lists("a", "b", "c")))
    return contrasts.evict([c], contrasts.reordered_cells(old, new, ["radius", "richness"]), ["radius", "richness"])[0].select("radius", "richness", "seed")


@query
def a41_benchmark_errors(s, d):
    c = sweep_cells(s, d)
    a, b = (c.filter(F.col("richness") == r).select("radius", "seed", F.col("kendall_tau").alias(x)) for r, x in (("node", "tau_all"), ("all", "tau_filtered")))
    c = a.join(b, ["radius", "seed"]).withColumn("n", F.lit(1000)).withColumn("n_zero", 100 * (F.col("radius") + 1))
    return _round(contrasts.benchmark_errors(c, ["radius"]))


@query
def r10_reconciled_cells(s, d):
    c = sweep_cells(s, d)
    twice = c.withColumn("seq", F.lit(0)).unionByName(c.filter("seed < 2").withColumn("seq", F.lit(1)).withColumn("kendall_tau", F.col("kendall_tau") + 1e-8)).withColumn("n_features", F.col("radius") + 1)
    kept, removed = contrasts.reconcile(twice, ["radius", "richness", "seed"], ["n_features"], "kendall_tau")
    return kept.select("radius", "richness", "seed", "seq", F.lit(True).alias("kept")).unionByName(removed.select("radius", "richness", "seed", "seq", F.lit(False).alias("kept")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)
