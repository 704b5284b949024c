"""Global quantities that features try to predict: betweenness, residual volatility, coreness, distance to hubs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import local
from .features import h_operator, with_all_nodes
from .graph import Network
from .shells import held_shell


def b2(net: Network) -> DataFrame:
    """Betweenness over pairs at distance two: each non-adjacent pair shares 1 among its common neighbours."""
    if local.fits(net):
        return truncated_betweenness(net, None, 2)
    wedge = net.arcs.alias("a").join(net.arcs.alias("b"), F.expr("a.u = b.u AND a.v < b.v")).select(F.col("a.u").alias("i"), F.col("a.v").alias("j"), F.col("b.v").alias("l"))
    open_ = wedge.join(net.arcs.select(F.col("u").alias("j"), F.col("v").alias("l")), ["j", "l"], "left_anti")
    share = open_.groupBy("j", "l").agg(F.count("*").alias("c"))
    return with_all_nodes(net, open_.join(share, ["j", "l"]).groupBy(F.col("i").alias("node")).agg(F.sum(1.0 / F.col("c")).alias("b_2")))


def truncated_betweenness(net: Network, shell: DataFrame | None, k: int) -> DataFrame:
    """b_k: betweenness over pairs at distance k or less, from path counts out to k and dependencies back.

    Without shells, over the packed network by blocks of sources; with them, both passes are joins of one layer with the
    arcs, keyed by source, so no task needs the graph in memory.
    """
    shell = held_shell(net, shell, k)
    if shell is None:
        return with_all_nodes(net, local.path_shares(net, k).groupBy("node").agg((F.sum("t") / 2).alias(f"b_{k}")))
    layer = {d: shell.filter(F.col("d") == d).select("src", F.col("node").alias("v")) for d in range(k + 1)}
    sigma = {0: net.nodes.select(F.col("node").alias("src"), "node", F.lit(1.0).alias("s"))}
    for d in range(1, k + 1):
        up = sigma[d - 1].withColumnRenamed("node", "u").join(net.arcs, "u")
        sigma[d] = stored(up.join(layer[d], ["src", "v"], "left_semi").groupBy("src", F.col("v").alias("node")).agg(F.sum("s").alias("s")), "sigma")
    delta = sigma[k].select("src", "node", F.lit(0.0).alias("delta"))
    total = None
    for d in range(k - 1, 0, -1):
        below = sigma[d + 1].join(delta, ["src", "node"]).select("src", F.col("node").alias("v"), ((1 + F.col("delta")) / F.col("s")).alias("w"))
        back = below.join(net.arcs, "v").select("src", F.col("u").alias("node"), "w").groupBy("src", "node").agg(F.sum("w").alias("w"))
        delta = sigma[d].join(back, ["src", "node"], "left").select("src", "node", (F.col("s") * F.coalesce("w", F.lit(0.0))).alias("delta"))
        delta = stored(delta, "delta")
        total = delta if total is None else total.unionByName(delta)
    if total is None:
        return net.nodes.select("node", F.lit(0.0).alias(f"b_{k}"))
    return with_all_nodes(net, total.groupBy("node").agg((F.sum("delta") / 2).alias(f"b_{k}")))


def adjacency(net: Network, most_arcs: int = 50_000_000) -> tuple[np.ndarray, np.ndarray]:
    """CSR arrays of a network of at most most_arcs arcs (checked), for per-source kernels."""
    if 2 * net.m > most_arcs:
        raise ValueError("the network is too large to hand to every task; use truncated_betweenness()")
    return local.collect_packed(net)


def _add(total: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """Adds x at places that may repeat; few places do not cost a pass over all."""
    if 4 * len(at) < len(total):
        np.add.at(total, at, x)
    else:
        total += np.bincount(at, x, len(total))


def brandes(ptr: np.ndarray, nbr: np.ndarray, sources) -> np.ndarray:
    """Dependencies of the given sources summed per node (Brandes, 2001), each pair counted once from either end.

    A source's layers are whole-array steps; 12 bytes an arc and 33 a node are kept, besides work arrays of the widest layer.
    """
    n = len(ptr) - 1
    total = np.zeros(n)
    for s in sources:
        seen, sigma, delta = np.zeros(n, bool), np.zeros(n), np.zeros(n)
        seen[s], sigma[s], front, links = True, 1.0, np.array([s]), []
        while True:
            lo = ptr[front]
            k = ptr[front + 1] - lo
            child = nbr[np.arange(int(k.sum())) + np.repeat(lo - (np.cumsum(k) - k), k)]
            new = ~seen[child]
            up, child = np.repeat(front, k)[new], child[new]
            if not len(child):
                break
            _add(sigma, child, sigma[up])
            links.append((up, child))
            seen[child] = True
            front = local.distinct(child)
        for up, child in reversed(links):
            _add(delta, up, sigma[up] * ((1 + delta[child]) / sigma[child]))
        delta[s] = 0.0
        total += delta
    return total


def exact_betweenness(net: Network) -> DataFrame:
    """Undirected betweenness without ends: sources are dealt over tasks, the checked graph goes to each once."""
    if not local.fits(net):
        raise ValueError("the network is too large to hand to every task; use truncated_betweenness()")
    total: list[np.ndarray] = []

    def kernel(g: local.Packed, src: np.ndarray) -> None:
        t = brandes(g.ptr, g.nbr, src.tolist())
        if total:
            total[0] += t
        else:
            total.append(t)

    def finish(g: local.Packed) -> dict:
        t = total.pop()
        at = np.flatnonzero(t)
        return {"node": at, "t": t[at]}

    per = local.per_source(net, "node long, t double", kernel, finish, 2 * net.nodes.sparkSession.sparkContext.defaultParallelism)
    return with_all_nodes(net, per.groupBy("node").agg((F.sum("t") / 2).alias("betweenness")))


def quantile_bins(df: DataFrame, col: str, bins: int) -> tuple[DataFrame, list[float]]:
    """df with column bin (0-based) between the distinct quantile edges of col."""
    edges = df.agg(F.percentile(col, [i / bins for i in range(bins + 1)]).alias("q")).first().q or []
    edges = sorted(set(edges))
    at = F.lit(-1)
    if len(edges) > 1:
        at = F.aggregate(F.array([F.lit(float(x)) for x in edges]), F.lit(0), lambda acc, e: acc + (e <= F.col(col)).cast("int")) - 1
        at = F.least(F.greatest(at, F.lit(0)), F.lit(len(edges) - 2))
    return df.withColumn("bin", at), edges


def variance_residual(stats: DataFrame, bins: int = 30) -> DataFrame:
    """(node, spread_resid): log10 deviation less the median of its bin of log10 mean; with fewer than three edges less the mean."""
    tiny = 1e-12
    x = stats.select("node", F.log10(F.greatest("spread_mean", F.lit(tiny))).alias("lm"), F.log10(F.greatest("spread_std", F.lit(tiny))).alias("ls"))
    binned, edges = quantile_bins(x, "lm", bins)
    centre = binned.agg(F.avg("ls").alias("c")) if len(edges) < 3 else binned.groupBy("bin").agg(F.percentile("ls", 0.5).alias("c"))
    joined = binned.crossJoin(centre) if len(edges) < 3 else binned.join(F.broadcast(centre), "bin")  # at most bins rows
    return joined.select("node", (F.col("ls") - F.col("c")).alias("spread_resid"))


def build_targets(stats: DataFrame, betweenness: DataFrame, bins: int = 30) -> DataFrame:
    """node, spread_mean, spread_std, spread_cv, spread_resid, spread_ignition, betweenness."""
    return stats.join(variance_residual(stats, bins), "node").join(betweenness, "node").select("node", "spread_mean", "spread_std", "spread_cv", "spread_resid", "spread_ignition", "betweenness")


def core_numbers(net: Network, max_steps: int = 1000) -> DataFrame:
    """(node, core): the h-operator repeated from degrees until nothing changes."""
    held = stored(net.degree.select("node", F.col("k").cast("long").alias("core")), "core")
    for _ in range(max_steps):
        x = net.arcs.join(held.select(F.col("node").alias("v"), F.col("core").alias("x")), "v").select(F.col("u").alias("node"), "x")
        new = stored(held.join(h_operator(x), "node", "left").select("node", F.coalesce("h", F.lit(0)).cast("long").alias("core")), "core")
        changed = new.agg(F.sum("core")).first()[0] != held.agg(F.sum("core")).first()[0]
        held = new
        if not changed:
            return held
    raise RuntimeError("coreness did not settle")


def hubs(net: Network, share: float = 0.01) -> DataFrame:
    """The max(1, round(share * n)) nodes of highest degree, ties to the smallest node."""
    return net.degree.orderBy(F.desc("k"), "node").limit(max(1, round(share * net.n))).select("node")


def distance_to_hubs(net: Network, share: float = 0.01) -> DataFrame:
    """(node, hub_distance): hops to the nearest hub, n where there is none."""
    held = stored(hubs(net, share).select("node", F.lit(0).cast("long").alias("hub_distance")), "hub")
    front, d = held, 0
    while True:
        d += 1
        new = front.join(net.arcs.withColumnRenamed("u", "node"), "node").select(F.col("v").alias("node")).distinct().join(held, "node", "left_anti")
        front = stored(new.withColumn("hub_distance", F.lit(d).cast("long")), "front")
        if front.isEmpty():
            break
        held = stored(held.unionByName(front), "hub")
    return net.nodes.select("node").join(held, "node", "left").select("node", F.coalesce("hub_distance", F.lit(net.n).cast("long")).alias("hub_distance"))


#: Parts of column names that carry global information, and names allowed all the same.
LEAKING = ("betweenness", "closeness", "pagerank", "eigenvector", "katz", "harmonic", "eccentricity", "coreness", "core_number", "k_shell", "spread_", "influence_true")
ALLOWED = ("ego_betweenness", "collective_influence_1", "collective_influence_2", "collective_influence_3")


def assert_no_leakage(names: list[str]) -> None:
    """Fails when a column may carry global information."""
    bad = [n for n in names if n.lower() not in ALLOWED and any(x in n.lower() for x in LEAKING)]
    if bad:
        raise ValueError(f"columns with global information: {', '.join(sorted(bad))}")


def zero_set(arcs_out: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that no shortest path passes: every in-neighbour reaches every other out-neighbour directly."""
    a = arcs_out.select(F.col("u").alias("x"), F.col("v").alias("node"))
    b = arcs_out.select(F.col("u").alias("node"), F.col("v").alias("w"))
    bad = a.join(b, "node").filter("x <> w").join(arcs_out.select(F.col("u").alias("x"), F.col("v").alias("w")), ["x", "w"], "left_anti").select("node").distinct()
    return nodes.select("node").join(bad, "node", "left_anti")


def witnesses(net: Network) -> DataFrame:
    """(node, a, b, common, num, den): the non-adjacent neighbour pair with fewest common neighbours; its share bounds the normalised betweenness from below by num / den."""
    wedge = net.arcs.alias("a").join(net.arcs.alias("b"), F.expr("a.u = b.u AND a.v < b.v")).select(F.col("a.u").alias("node"), F.col("a.v").alias("a"), F.col("b.v").alias("b"))
    open_ = wedge.join(net.arcs.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
    common = open_.groupBy("a", "b").agg(F.count("*").alias("common"))
    best = open_.join(common, ["a", "b"]).groupBy("node").agg(F.min(F.struct("common", "a", "b")).alias("w"))
    den = F.lit(net.n - 1).cast("decimal(19,0)") * F.lit(net.n - 2).cast("decimal(19,0)")
    return best.select("node", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.common").alias("common"), F.lit(2).cast("long").alias("num"), (den.cast("decimal(38,0)") * F.col("w.common").cast("decimal(19,0)")).cast("decimal(38,0)").alias("den"))
