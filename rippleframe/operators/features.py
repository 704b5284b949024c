"""Node features of the one-hop neighbourhood, aggregates over neighbours, h-index ladder, walks, branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Network


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0).cast("double")


def with_all_nodes(net: Network, df: DataFrame) -> DataFrame:
    """Nodes without a row get zeros."""
    joined = net.nodes.select("node").join(df, "node", "left")
    return joined.na.fill(0).na.fill(0.0)


def common_neighbours(net: Network) -> DataFrame:
    """(u, v, common) for every edge u < v.

    Links point from the smaller (degree, id) end, so no node has more than about sqrt(2m) outgoing links and hubs do
    not blow up the join; each triangle is found once and counted for its three edges.
    """
    k = net.degree
    d = net.edges.join(k.select(F.col("node").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("node").alias("v"), F.col("k").alias("kv")), "v")
    forward = (F.col("ku") < F.col("kv")) | ((F.col("ku") == F.col("kv")) & (F.col("u") < F.col("v")))
    out = d.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = out.join(out.withColumnRenamed("b", "c"), "a").filter("b <> c").select("a", "b", "c")
    triangle = wedge.join(out.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    pair = F.explode(F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))]))
    counted = triangle.select(pair.alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("common"))
    return net.edges.join(counted, ["u", "v"], "left").na.fill(0, ["common"])


def triangles(net: Network, common: DataFrame | None = None) -> DataFrame:
    common = common if common is not None else common_neighbours(net)
    both = common.select(F.explode(F.array("u", "v")).alias("node"), "common")
    return with_all_nodes(net, both.groupBy("node").agg((F.sum("common") / 2).cast("long").alias("tri")))


def degree_features(net: Network) -> DataFrame:
    n = net.nodes.agg(F.count("*").alias("n"))
    return net.degree.crossJoin(n).select("node", F.col("k").cast("long").alias("degree"), (F.col("k") / F.greatest(F.col("n") - 1, F.lit(1))).cast("double").alias("degree_normalized"))  # n is one row


def ego_features(net: Network) -> DataFrame:
    """Triangles, clustering and the size, links and openness of each closed neighbourhood."""
    common = common_neighbours(net)
    k = net.degree
    tri = triangles(net, common)
    ends = common.select("u", "v", "common").unionAll(common.select(F.col("v").alias("u"), F.col("u").alias("v"), "common"))
    leaving = ends.join(k.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("k") - F.col("common") - 1).cast("long").alias("out"))
    j = k.join(tri, "node").join(leaving, "node", "left").na.fill(0, ["out"])
    t, d = F.col("tri"), F.col("k")
    return j.select(
        "node", t.alias("triangle_count"), ratio(t, d * (d - 1) / 2).alias("clustering_coefficient"), (d + 1).cast("long").alias("ego_net_size"), (t + d).cast("long").alias("ego_net_edges"), ratio(t + d, (d + 1) * d / 2).alias("ego_net_density"),
        F.col("out").alias("edges_leaving_ego"), F.when(d > 0, d - 2 * t / d).otherwise(0.0).cast("double").alias("effective_size"), ratio(F.col("out"), t + d + F.col("out")).alias("boundary_porosity"),
    )


def _stats(c: str, name: str) -> list[Column]:
    return [F.avg(c).cast("double").alias(f"{name}_mean"), F.max(c).cast("double").alias(f"{name}_max"), F.min(c).cast("double").alias(f"{name}_min"), F.stddev_pop(c).alias(f"{name}_std")]


def edge_features(net: Network) -> DataFrame:
    """Embeddedness and overlap of the incident edges (population standard deviation)."""
    k = net.degree
    c = common_neighbours(net).join(k.select(F.col("node").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("node").alias("v"), F.col("k").alias("kv")), "v")
    c = c.withColumn("overlap", ratio(F.col("common"), F.col("ku") + F.col("kv") - 2 - F.col("common"))).select(F.explode(F.array("u", "v")).alias("node"), "common", "overlap")
    return with_all_nodes(net, c.groupBy("node").agg(*_stats("common", "edge_embeddedness"), *_stats("overlap", "edge_overlap")))


def neighbour_degree_features(net: Network) -> DataFrame:
    """Neighbour degrees, their entropy, the local assortativity and the first non-backtracking closed form."""
    j = net.arcs.join(net.degree.withColumnRenamed("node", "v"), "v")
    per = j.groupBy(F.col("u").alias("node")).agg(*_stats("k", "nbr_degree"), F.sum("k").cast("long").alias("nbr_degree_sum"), F.sum(F.col("k") * F.ln("k")).alias("xl"), F.count("*").alias("deg"))
    s = F.col("nbr_degree_sum")
    entropy = F.ln(s) - F.col("xl") / s
    return with_all_nodes(net, per.select("node", *[f"nbr_degree_{x}" for x in ("mean", "max", "min", "std", "sum")], (F.col("nbr_degree_mean") - F.col("deg")).alias("assortativity_local"), entropy.alias("local_entropy"), F.when(F.col("deg") > 1, entropy / F.ln("deg")).otherwise(0.0).alias("local_entropy_norm"), (s - F.col("deg")).cast("long").alias("nbw_2")))


def neighbour_triangle_features(net: Network) -> DataFrame:
    """Neighbours' clustering and triangles; these need two hops."""
    e = ego_features(net).select(F.col("node").alias("v"), "clustering_coefficient", "triangle_count")
    j = net.arcs.join(e, "v").groupBy(F.col("u").alias("node"))
    five = lambda c, name: [*_stats(c, name), F.sum(c).cast("double").alias(f"{name}_sum")]
    return with_all_nodes(net, j.agg(*five("clustering_coefficient", "nbr_clustering"), *five("triangle_count", "nbr_triangles")))


def cluster_rank(net: Network) -> DataFrame:
    e = ego_features(net).select("node", "clustering_coefficient")
    s = neighbour_degree_features(net).select("node", "nbr_degree_sum")
    return net.degree.join(e, "node").join(s, "node").select("node", (F.pow(F.lit(10.0), -F.col("clustering_coefficient")) * (F.col("nbr_degree_sum") + F.col("k"))).alias("cluster_rank"))


def ego_betweenness(net: Network) -> DataFrame:
    """Each non-adjacent pair of neighbours shares 1 with the centre and their common neighbours inside the neighbourhood."""
    from . import local

    if local.fits(net):
        return local.ego_shares(net)
    pair = net.arcs.alias("a").join(net.arcs.alias("b"), F.expr("a.u = b.u AND a.v < b.v")).select(F.col("a.u").alias("i"), F.col("a.v").alias("j"), F.col("b.v").alias("l"))
    open_ = pair.join(net.arcs.select(F.col("u").alias("j"), F.col("v").alias("l")), ["j", "l"], "left_anti")
    near = net.arcs.select(F.col("u").alias("i"), F.col("v").alias("w"))
    both = open_.join(near, "i").join(net.arcs.select(F.col("u").alias("j"), F.col("v").alias("w")), ["j", "w"], "left_semi").join(net.arcs.select(F.col("u").alias("l"), F.col("v").alias("w")), ["l", "w"], "left_semi")
    counted = both.groupBy("i", "j", "l").agg(F.count("*").alias("c"))
    scored = open_.join(counted, ["i", "j", "l"], "left").groupBy(F.col("i").alias("node")).agg(F.sum(1.0 / (1 + F.coalesce("c", F.lit(0)))).alias("ego_betweenness"))
    return with_all_nodes(net, scored)


def h_operator(values: DataFrame, key: str = "node", value: str = "x") -> DataFrame:
    """(node, h): the largest h with at least h values of h or more."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value)))
    return values.select(key, F.least(F.col(value).cast("long"), rank.cast("long")).alias("h")).groupBy(key).agg(F.max("h").alias("h"))


def h_index_ladder(net: Network, steps: int = 3) -> DataFrame:
    """h_index_1..steps: the h-operator over the neighbours' previous values, starting from degrees."""
    held = net.degree.select("node", F.col("k").cast("long").alias("h0"))
    for s in range(1, steps + 1):
        x = net.arcs.join(held.select(F.col("node").alias("v"), F.col(f"h{s - 1}").alias("x")), "v").select(F.col("u").alias("node"), "x")
        held = held.join(h_operator(x).withColumnRenamed("h", f"h{s}"), "node", "left").na.fill(0, [f"h{s}"])
    return held.select("node", *[F.col(f"h{s}").alias(f"h_index_{s}") for s in range(1, steps + 1)])


def walk_counts(net: Network, length: int = 3) -> DataFrame:
    """Non-backtracking walks of length 1 to ``length`` from each node.

    The walks over an arc are those of all arcs behind it less the way back, which avoids joining all successor pairs.
    Overflow fails (ANSI arithmetic).
    """
    arc = net.arcs.withColumn("c", F.lit(1).cast("long"))
    out = net.nodes.select("node")
    for s in range(1, length + 1):
        from_node = arc.groupBy(F.col("u").alias("node")).agg(F.sum("c").alias(f"nbw_{s}"))
        out = out.join(from_node, "node", "left")
        if s < length:
            back = arc.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("c").alias("r"))
            arc = net.arcs.join(from_node.select(F.col("node").alias("v"), F.col(f"nbw_{s}").alias("t")), "v").join(back, ["u", "v"]).select("u", "v", (F.col("t") - F.col("r")).alias("c"))
    return out.na.fill(0)


def branch_anisotropy(net: Network, shell: DataFrame | None = None) -> DataFrame:
    """How unevenly the nodes at distance two hang from the neighbours: largest share, entropy, and whether there are none."""
    from . import local
    from .shells import held_shell

    shell = held_shell(net, shell, 2)
    if shell is None:
        return local.branch_sums(net)
    child = shell.filter("d = 2").select("src", F.col("node").alias("v"))
    parent = shell.filter("d = 1").select("src", F.col("node").alias("u"))
    link = child.join(net.arcs, "v").join(parent, ["src", "u"], "left_semi").select("src", "u", "v")
    mass = link.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("src", "v"))).groupBy("src", "u").agg(F.sum("w").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("src"))
    per = mass.withColumn("p", share).groupBy(F.col("src").alias("node")).agg(F.max("p").alias("branch_max_share"), F.sum(-F.col("p") * F.ln("p")).alias("branch_entropy"))
    return net.nodes.select("node").join(per, "node", "left").select("node", F.coalesce("branch_max_share", F.lit(0.0)).alias("branch_max_share"), F.coalesce("branch_entropy", F.lit(0.0)).alias("branch_entropy"), F.col("branch_max_share").isNull().alias("branch_empty"))


def semilocal_features(net: Network, shell: DataFrame | None = None) -> DataFrame:
    """Sum and mean over neighbours of the size of their 2-ball with themselves."""
    from .shells import shell_counts

    size = shell_counts(net, shell, 2).filter("d <= 2").groupBy(F.col("src").alias("v")).agg(F.sum("n").alias("b"))
    j = net.arcs.join(size, "v").groupBy(F.col("u").alias("node")).agg(F.sum("b").cast("long").alias("semilocal_centrality"), F.avg("b").alias("nbr_reach2_mean"))
    return with_all_nodes(net, j)


def feature_table(net: Network, shell: DataFrame, p: float | None = None) -> DataFrame:
    """The wide table of all features above, one row per node."""
    from .shells import ball2_features, percolation_reach, shell_features

    parts = [degree_features(net), ego_features(net), edge_features(net), neighbour_degree_features(net), neighbour_triangle_features(net), cluster_rank(net), ego_betweenness(net), h_index_ladder(net), shell_features(net, shell), ball2_features(net, shell), semilocal_features(net, shell)]
    if p is not None:
        parts.append(percolation_reach(net, shell, p))
    wide = reduce(lambda a, b: a.join(b, "node"), parts)
    return net.nodes.select("node", "original_id").join(wide, "node")
