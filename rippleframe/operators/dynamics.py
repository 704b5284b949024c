"""Spreading processes drawn from hash uniforms, and statistics of their sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..sources.tables import stored
from . import local
from .components import connected_components
from .graph import Network
from .shells import held_shell, shells

SYMMETRIC = ("uniform", "trivalency")


def edge_probability(net: Network, convention: str = "uniform", p: float = 0.1, seed: int = 0) -> DataFrame:
    """(u, v, p) per edge, the same in both directions."""
    if convention == "uniform":
        value: Column = F.lit(float(p))
    elif convention == "trivalency":
        value = F.element_at(F.array(*[F.lit(x) for x in (0.001, 0.01, 0.1)]), (F.floor(uniform("u", "v", seed) * 3) + 1).cast("int"))
    else:
        raise ValueError(f"{convention} is not symmetric")
    return net.edges.withColumn("p", value)


def arc_probability(net: Network, convention: str = "uniform", p: float = 0.1, seed: int = 0) -> DataFrame:
    """(u, v, p) per arc; 'weighted' is one over the receiver's degree."""
    if convention == "weighted":
        return net.arcs.join(net.degree.select(F.col("node").alias("v"), "k"), "v").select("u", "v", (1.0 / F.col("k")).alias("p"))
    e = edge_probability(net, convention, p, seed)
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "p"))


def draws(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("draw"))


def live_edges(edges: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """(draw, u, v): each edge of (u, v, p) lives in a draw when its uniform is under p; the uniforms do not depend on p."""
    numbered = edges.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    return numbered.filter(uniform("u", "v", "draw", seed) < F.col("p")).select("draw", "u", "v")


def percolation(net: Network, edges: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """(draw, node, comp, size): components of the live graph, which are the cascade of every seed at once."""
    if local.fits(net):
        return local.live_components(net, live_edges(edges, n_draws, seed), n_draws)
    linked = connected_components(live_edges(edges, n_draws, seed), ("draw",))
    every = net.nodes.select("node").crossJoin(F.broadcast(draws(net.nodes.sparkSession, n_draws)))  # as many rows as the result
    comp = every.join(linked, ["draw", "node"], "left").select("draw", "node", F.coalesce("comp", "node").alias("comp"))
    size = comp.groupBy("draw", "comp").agg(F.count("*").cast("int").alias("size"))
    return comp.join(size, ["draw", "comp"]).select("draw", "node", "comp", "size")


def direct_cascades(arcs: DataFrame, seeds: DataFrame | Network, n_draws: int, seed: int = 0, max_steps: int = 1000) -> DataFrame:
    """(src, draw, size): one attempt per arc, its coin a hash of (u, v, draw), for any convention; arcs has (u, v, p).

    A network as seeds starts from each of its nodes, source by source over the packed live arcs of the draws.
    """
    live = stored(live_edges(arcs, n_draws, seed), "live")
    if isinstance(seeds, Network):
        if live.count() <= local.MOST_ARCS:
            return local.reached_counts(seeds, live, n_draws)
        seeds = seeds.nodes.select("node")
    every = seeds.select(F.col("node").alias("src")).crossJoin(F.broadcast(draws(live.sparkSession, n_draws)))
    reached = stored(every.select("draw", "src", F.col("src").alias("node")), "reached")
    front = reached
    for _ in range(max_steps):
        new = front.join(live.withColumnRenamed("u", "node"), ["draw", "node"]).select("draw", "src", F.col("v").alias("node")).distinct()
        front = stored(new.join(reached, ["draw", "src", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        reached = stored(reached.unionByName(front), "reached")
    else:
        raise RuntimeError("cascades did not end")
    return reached.groupBy("src", "draw").agg(F.count("*").cast("int").alias("size"))


def sir(net: Network, seeds: DataFrame | None, beta: float, mu: float, n_draws: int, seed: int = 0, max_steps: int = 200) -> DataFrame:
    """(src, draw, size): discrete SIR; each step an infected node tries all neighbours, then recovers with probability mu.

    Without seeds from every node, source by source over the packed network.
    """
    if seeds is None and local.fits(net):
        return local.outbreak_counts(net, beta, mu, n_draws, seed, max_steps)
    seeds = net.nodes.select("node") if seeds is None else seeds
    every = seeds.select(F.col("node").alias("src")).crossJoin(F.broadcast(draws(net.nodes.sparkSession, n_draws)))
    ill = stored(every.select("draw", "src", F.col("src").alias("node")), "ill")
    ever = ill
    for t in range(max_steps):
        tried = ill.join(net.arcs.withColumnRenamed("u", "node"), "node").filter(uniform("src", "draw", F.lit(t), "node", "v", seed) < beta)
        new = tried.select("draw", "src", F.col("v").alias("node")).distinct().join(ever, ["draw", "src", "node"], "left_anti")
        new = stored(new, "new")
        stay = ill.filter(uniform("src", "draw", F.lit(t), "node", F.lit("r"), seed) >= mu)
        ill = stored(stay.unionByName(new), "ill")
        if ill.isEmpty():
            break
        ever = stored(ever.unionByName(new), "ever")
    else:
        raise RuntimeError("outbreaks did not end")
    return ever.groupBy("src", "draw").agg(F.count("*").cast("int").alias("size"))


def spread_statistics(sizes: DataFrame, n: int, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """Mean, sample deviation, standard error, coefficient of variation and how often more than 5 % of n is reached."""
    g = sizes.groupBy(*by).agg(F.avg("size").alias("spread_mean"), F.stddev_samp("size").alias("spread_std"), F.avg((F.col("size") > 0.05 * n).cast("double")).alias("spread_ignition"), F.count("*").alias("_n"))
    return g.select(*by, "spread_mean", "spread_std", (F.col("spread_std") / F.sqrt("_n")).alias("spread_stderr"), F.when(F.col("spread_mean") > 0, F.col("spread_std") / F.col("spread_mean")).otherwise(0.0).alias("spread_cv"), "spread_ignition")


def noise_report(stats: DataFrame, limit: float = 0.1) -> DataFrame:
    """Median standard error against the spread of the means between nodes."""
    r = stats.agg(F.percentile("spread_stderr", 0.5).alias("median_stderr"), F.stddev_pop("spread_mean").alias("between"))
    return r.select("median_stderr", "between", (F.col("median_stderr") / F.col("between")).alias("noise_ratio"), (F.col("median_stderr") / F.col("between") < limit).alias("quiet"))


def transmission_sweep(net: Network, ps: list[float], n_draws: int, seed: int = 0) -> DataFrame:
    """Mean size, deviation between nodes and ignition at each p, over common draws."""
    rows = []
    for p in ps:
        s = spread_statistics(percolation(net, net.edges.withColumn("p", F.lit(float(p))), n_draws, seed), net.n)
        rows.append(s.agg(F.avg("spread_mean").alias("mean_size"), F.stddev_pop("spread_mean").alias("between_nodes"), F.avg("spread_ignition").alias("ignition")).select(F.lit(float(p)).alias("p"), "mean_size", "between_nodes", "ignition"))
    return reduce(DataFrame.unionByName, rows)


def truncated_cascades(net: Network, edges: DataFrame, radii: list[int], n_draws: int, seed: int = 0) -> DataFrame:
    """(draw, node, radius, size): nodes within r live hops; radii must rise strictly."""
    if sorted(set(radii)) != list(radii) or radii[0] < 1:
        raise ValueError("radii must rise strictly from 1 on")
    live = live_edges(edges, n_draws, seed)
    arcs = stored(live.unionByName(live.select("draw", F.col("v").alias("u"), F.col("u").alias("v"))), "live")
    every = net.nodes.select(F.col("node").alias("src")).crossJoin(F.broadcast(draws(net.nodes.sparkSession, n_draws)))
    s = shells(arcs, max(radii), every, ("draw",))
    return reduce(DataFrame.unionByName, [s.filter(F.col("d") <= r).groupBy("draw", F.col("src").alias("node")).agg(F.count("*").cast("int").alias("size")).withColumn("radius", F.lit(r)) for r in radii]).select("draw", "node", "radius", "size")


def threshold_cascades(net: Network, num: int, den: int, within: DataFrame | None = None, max_steps: int = 1000) -> DataFrame:
    """(src, node) active at the end: from a closed neighbourhood, a node joins when den * active neighbours >= num * degree.

    The test is on integers. within (src, node) confines each cascade to a ball.
    """
    start = net.nodes.select(F.col("node").alias("src"), "node").unionByName(net.arcs.select(F.col("u").alias("src"), F.col("v").alias("node")))
    active = stored(start, "active")
    for _ in range(max_steps):
        touched = active.join(net.arcs.withColumnRenamed("u", "node"), "node").groupBy("src", F.col("v").alias("node")).agg(F.count("*").alias("c"))
        touched = touched.join(net.degree, "node").filter((F.col("k") > 0) & (den * F.col("c") >= num * F.col("k"))).select("src", "node")
        if within is not None:
            touched = touched.join(within.select("src", "node"), ["src", "node"], "left_semi")
        new = stored(touched.join(active, ["src", "node"], "left_anti"), "new")
        if new.isEmpty():
            break
        active = stored(active.unionByName(new), "active")
    else:
        raise RuntimeError("cascades did not end")
    return active


def threshold_sizes(net: Network, num: int, den: int) -> DataFrame:
    if local.fits(net):
        return local.threshold_counts(net, num, den).select("node", "size")
    return threshold_cascades(net, num, den).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("size"))


def truncated_threshold_sizes(net: Network, num: int, den: int, shell: DataFrame | None, r: int) -> DataFrame:
    """(node, size, contained): the cascade inside the r-ball; contained when it activates no node at distance r."""
    shell = held_shell(net, shell, r)
    if shell is None:
        return local.threshold_counts(net, num, den, r)
    b = shell.filter(F.col("d") <= r).select("src", "node", "d")
    a = threshold_cascades(net, num, den, b).join(b, ["src", "node"])
    return a.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("size"), (~F.bool_or(F.col("d") == r)).alias("contained"))


def censored_predictor(sizes: DataFrame, n: int) -> DataFrame:
    return sizes.select("node", F.when(F.col("contained"), F.col("size")).otherwise(F.lit(n + 1)).cast("long").alias("prediction"))


def ignition_gate(sizes: DataFrame, n: int) -> DataFrame:
    """Whether between a tenth and nine tenths of the cascades pass 5 % of n, with quantiles and distinct sizes."""
    q = F.percentile("size", [0.1, 0.5, 0.9])
    g = sizes.agg(F.avg((F.col("size") > 0.05 * n).cast("double")).alias("fraction"), q.alias("q"), F.count_distinct("size").alias("distinct_sizes"))
    return g.select("fraction", ((F.col("fraction") >= 0.1) & (F.col("fraction") <= 0.9)).alias("passes"), F.col("q")[0].alias("q10"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90"), "distinct_sizes")


def largest_two(sizes: DataFrame) -> DataFrame:
    """(draw, s1, s2) from component sizes as seen from nodes; equal largest ones give s2 = s1, a lone one 0."""
    comps = sizes.groupBy("draw", "size").agg(F.count("*").alias("nodes"))
    bad = F.raise_error(F.lit("sizes do not fit components")).cast("long")
    comps = comps.select("draw", "size", F.when(F.col("nodes") % F.col("size") == 0, F.col("nodes") / F.col("size")).otherwise(bad).cast("long").alias("comps"))
    rank = F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("size")))
    top = comps.withColumn("r", rank).filter("r <= 2").groupBy("draw").agg(F.max(F.when(F.col("r") == 1, F.col("size"))).alias("s1"), F.max(F.when(F.col("r") == 1, F.col("comps"))).alias("c1"), F.max(F.when(F.col("r") == 2, F.col("size"))).alias("next"))
    return top.select("draw", "s1", F.when(F.col("c1") > 1, F.col("s1")).otherwise(F.coalesce("next", F.lit(0))).alias("s2"))


def susceptibility(largest: DataFrame, by: tuple[str, ...] = ("m",)) -> DataFrame:
    """Variance over mean of the largest component's size between draws."""
    return largest.groupBy(*by).agg((F.var_samp("s1") / F.avg("s1")).alias("chi"))


def locate_peak(chi: DataFrame) -> DataFrame:
    """The smallest m with the greatest susceptibility, and whether it is at the grid's edge."""
    g = chi.agg(F.min_by("m", F.struct(-F.col("chi"), "m")).alias("m"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    return g.select("m", ((F.col("m") == F.col("lo")) | (F.col("m") == F.col("hi"))).alias("at_edge"))


def bootstrap_peak(largest: DataFrame, reps: int, n_draws: int, seed: int = 0) -> DataFrame:
    """(rep, m): the peak over resampled draws, the same resample at every m."""
    spark = largest.sparkSession
    pick = spark.range(reps).select(F.col("id").cast("int").alias("rep")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    pick = pick.select("rep", F.floor(uniform("rep", "slot", seed) * n_draws).cast("int").alias("draw"))
    chi = largest.join(F.broadcast(pick), "draw").groupBy("rep", "m").agg((F.var_samp("s1") / F.avg("s1")).alias("chi"))  # reps * n_draws small rows
    return chi.groupBy("rep").agg(F.min_by("m", F.struct(-F.col("chi"), "m")).alias("m"))


def set_spread(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(draw, spread): nodes in the components that the seed set hits."""
    hit = labels.join(seeds.select("node"), "node", "left_semi").select("draw", "comp", "size").distinct()
    return hit.groupBy("draw").agg(F.sum("size").alias("spread"))


def greedy_seeds(labels: DataFrame, k: int) -> DataFrame:
    """(rank, node, gain): each step takes the node whose components not yet hit hold most nodes; ties to the smallest node."""
    left, out = labels, []
    for r in range(1, k + 1):
        gain = left.groupBy("node").agg(F.sum("size").alias("gain"))
        best = gain.agg(F.max_by("node", F.struct("gain", -F.col("node"))).alias("node"), F.max("gain").alias("gain")).first()
        if best.node is None:
            break
        out.append((r, best.node, best.gain))
        hit = left.filter(F.col("node") == best.node).select("draw", "comp")
        left = stored(left.join(hit, ["draw", "comp"], "left_anti"), "left")
    return labels.sparkSession.createDataFrame(out, "rank int, node long, gain long")


def degree_discount(net: Network, k: int, p: float) -> DataFrame:
    """(rank, node): degree discount d - 2t - (d - t) t p, t the chosen neighbours; ties to the smallest node."""
    held = net.degree.select("node", "k", F.lit(0).cast("long").alias("t"))
    out = []
    for r in range(1, k + 1):
        score = F.col("k") - 2 * F.col("t") - (F.col("k") - F.col("t")) * F.col("t") * p
        best = held.agg(F.max_by("node", F.struct(score.alias("s"), -F.col("node"))).alias("node")).first()
        if best.node is None:
            break
        out.append((r, best.node))
        near = net.arcs.filter(F.col("u") == best.node).select(F.col("v").alias("node"), F.lit(1).alias("hit"))
        held = stored(held.filter(F.col("node") != best.node).join(near, "node", "left").select("node", "k", (F.col("t") + F.coalesce("hit", F.lit(0))).alias("t")), "discount")
    return net.nodes.sparkSession.createDataFrame(out, "rank int, node long")


def top_k(df: DataFrame, value: str, k: int, key: str = "node") -> DataFrame:
    """The k highest, ties to the smallest key."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)


