"""Exact-distance shells of every source, and what follows from them by aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import local
from .graph import Network


def shells(arcs: DataFrame, radius: int, sources: DataFrame | None = None, keys: tuple[str, ...] = (), store: bool = True) -> DataFrame:
    """(keys, src, node, d) for 0 <= d <= radius; sources has (keys, src), all arc ends by default.

    Each step joins only the last frontier with the arcs and drops what is at a smaller distance already, so every pair
    is shuffled a constant number of times.
    """
    k = list(keys)
    if sources is None:
        sources = arcs.select(*k, F.col("u").alias("src")).distinct()
    front = sources.select(*k, "src", F.col("src").alias("node"), F.lit(0).alias("d"))
    layers = [front]
    step = arcs.select(*k, F.col("u").alias("node"), "v")
    for d in range(1, radius + 1):
        reached = layers[-1].join(step, [*k, "node"]).select(*k, "src", F.col("v").alias("node")).distinct()
        # a neighbour of the last frontier is in it, in the one before, or new
        for old in layers[-2:]:
            reached = reached.join(old.select(*k, "src", "node"), [*k, "src", "node"], "left_anti")
        new = reached.withColumn("d", F.lit(d))
        layers.append(stored(new, f"shell{d}") if store else new)
    return reduce(DataFrame.unionByName, layers)


def ball(shell: DataFrame, r: int) -> DataFrame:
    return shell.filter(F.col("d") <= r)


def held_shell(net: Network, shell: DataFrame | None, radius: int) -> DataFrame | None:
    """The given shells; None where the packed network serves instead, joined shells where it is too large for that."""
    if shell is not None or local.fits(net):
        return shell
    return shells(net.arcs, radius, net.nodes.select(F.col("node").alias("src")))


def shell_counts(net: Network, shell: DataFrame | None = None, radius: int = 3) -> DataFrame:
    """(src, d, n, sum_node): nodes at each distance that has any, and the sum of their ids."""
    shell = held_shell(net, shell, radius)
    if shell is not None:
        return shell.groupBy("src", "d").agg(F.count("*").alias("n"), F.sum("node").alias("sum_node"))
    each = F.array(*[F.struct(F.lit(d).alias("d"), (F.col(f"n{d}") if d else F.lit(1).cast("long")).alias("n"), F.col(f"s{d}").alias("sum_node")) for d in range(radius + 1)])
    return local.shell_sums(net, radius).select("src", F.explode(each).alias("x")).select("src", "x.*").filter("n > 0")


def induced_ball(net: Network, shell: DataFrame | None, r: int) -> DataFrame:
    """(src, u, v): arcs with both ends within r of src."""
    shell = held_shell(net, shell, r)
    if shell is None:
        return local.ball_arcs(net, r)
    b = ball(shell, r)
    left = b.select("src", F.col("node").alias("u")).join(net.arcs, "u")
    return left.join(b.select("src", F.col("node").alias("v")), ["src", "v"], "left_semi").select("src", "u", "v")


def observer_view(net: Network, shell: DataFrame | None, r: int) -> DataFrame:
    """(src, u, v) of the induced ball with one pendant node per missing link of a boundary node; pendants have negative ids."""
    shell = held_shell(net, shell, r)
    if shell is None:
        return local.observed_arcs(net, r)
    inside = induced_ball(net, shell, r)
    b = ball(shell, r).select("src", F.col("node").alias("u"))
    known = b.join(inside, ["src", "u"], "left").groupBy("src", "u").agg(F.count("v").alias("held"))
    missing = known.join(net.degree.withColumnRenamed("node", "u"), "u").filter("k > held")
    stubs = missing.select("src", "u", F.explode(F.expr("sequence(1, cast(k - held as int))")).alias("i"))
    stubs = stubs.select("src", "u", (-(F.row_number().over(Window.partitionBy("src").orderBy("u", "i"))).cast("long")).alias("v"))
    return inside.unionByName(stubs).unionByName(stubs.select("src", F.col("v").alias("u"), F.col("u").alias("v")))


def _shell_wide(net: Network, shell: DataFrame | None, radius: int) -> DataFrame:
    shell = held_shell(net, shell, radius)
    if shell is None:
        means = [F.when(F.col(f"n{d}") > 0, F.col(f"ks{d}") / F.col(f"n{d}")).otherwise(0.0).alias(f"km{d}") for d in range(1, radius + 1)]
        return local.shell_sums(net, radius).select("*", *means)
    per = shell.filter("d > 0").join(net.degree, "node").groupBy("src", "d").agg(F.count("*").alias("n"), F.sum("k").alias("ks"), F.avg("k").alias("km"), F.max("k").alias("kx"))
    at = lambda c, d: F.coalesce(F.max(F.when(F.col("d") == d, F.col(c))), F.lit(0))
    return net.degree.select(F.col("node").alias("src"), "k").join(per, "src", "left").groupBy("src", "k").agg(*[at(c, d).alias(f"{c}{d}") for c in ("n", "ks", "km", "kx") for d in range(1, radius + 1)])


def shell_features(net: Network, shell: DataFrame | None = None, radius: int = 3) -> DataFrame:
    """Counts, degrees, growth, reach, gravity and collective influence by distance; empty shells give zeros."""
    wide = _shell_wide(net, shell, radius)
    cols = [F.col("src").alias("node")]
    for d in range(2, radius + 1):
        cols += [F.col(f"n{d}").cast("long").alias(f"shell_{d}_count"), F.col(f"km{d}").cast("double").alias(f"shell_{d}_degree_mean"), F.col(f"kx{d}").cast("long").alias(f"shell_{d}_degree_max")]
        cols += [F.when(F.col(f"n{d - 1}") > 0, F.col(f"n{d}") / F.col(f"n{d - 1}")).otherwise(0.0).cast("double").alias(f"growth_ratio_{d}")]
        cols += [sum((F.col(f"n{j}") for j in range(2, d + 1)), F.col("n1")).cast("long").alias(f"reach_within_{d}")]
    for d in range(1, radius + 1):
        cols += [((F.col("k") - 1) * (F.col(f"ks{d}") - F.col(f"n{d}"))).cast("long").alias(f"collective_influence_{d}")]
        cols += [(F.col("k") * sum((F.col(f"ks{j}") / float(j * j) for j in range(2, d + 1)), F.col("ks1") / 1.0)).cast("double").alias(f"local_gravity_{d}")]
    return wide.select(*cols)


def ball2_features(net: Network, shell: DataFrame | None = None) -> DataFrame:
    """Edges inside the 2-ball, their density, and the conductance of the ball."""
    shell = held_shell(net, shell, 2)
    if shell is None:
        j = local.ball2_sums(net)
    else:
        b = ball(shell, 2)
        inside = induced_ball(net, shell, 2).groupBy("src").agg((F.count("*") / 2).cast("long").alias("e"))
        size = b.join(net.degree, "node").groupBy("src").agg(F.count("*").alias("n"), F.sum("k").alias("vol"))
        j = size.join(inside, "src", "left").na.fill(0, ["e"])
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return j.select(F.col("src").alias("node"), F.col("e").alias("ball2_edges"), F.when(pairs > 0, F.col("e") / pairs).otherwise(0.0).alias("ball2_density"), F.when(F.col("vol") > 0, (F.col("vol") - 2 * F.col("e")) / F.col("vol")).otherwise(0.0).alias("local_conductance_2"))


def percolation_reach(net: Network, shell: DataFrame | None, p: float, radius: int = 3) -> DataFrame:
    """Expected reach within 2 and 3 hops when each link passes with probability p and paths count as independent."""
    shell = held_shell(net, shell, radius)
    sums = [F.coalesce(f"s{d}", F.lit(0.0)) for d in range(1, radius + 1)]
    # the source counts as reached
    cols = [F.col("src").alias("node"), *[sum(sums[1:d], F.lit(1.0) + sums[0]).alias(f"perc_reach_{d}") for d in range(2, radius + 1)]]
    if shell is None:
        return local.reach_sums(net, p, radius).select(*cols)
    q = shell.filter("d = 0").select("src", "node", F.lit(1.0).alias("q"))
    held, total = q, []
    for d in range(1, radius + 1):
        up = held.select("src", F.col("node").alias("u"), "q").join(net.arcs, "u")
        down = shell.filter(F.col("d") == d).select("src", F.col("node").alias("v"))
        held = up.join(down, ["src", "v"]).groupBy("src", F.col("v").alias("node")).agg((1 - F.exp(F.sum(F.log1p(-p * F.col("q"))))).alias("q"))
        total.append(held.groupBy("src").agg(F.sum("q").alias(f"s{d}")))
    out = net.nodes.select(F.col("node").alias("src"))
    for t in total:
        out = out.join(t, "src", "left")
    return out.select(*cols)


def coverage(net: Network, shell: DataFrame | None = None, radius: int = 3) -> DataFrame:
    """Per radius: quartiles of the share of nodes inside a ball, and how many balls hold more than half."""
    c = shell_counts(net, shell, radius)
    within = F.explode(F.sequence(F.greatest("d", F.lit(1)), F.lit(radius)))
    every = c.select("src", "n", within.alias("radius")).groupBy("src", "radius").agg((F.sum("n") / net.n).alias("share"))
    return every.groupBy("radius").agg(*[F.percentile("share", q).alias(c) for q, c in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))], F.avg((F.col("share") > 0.5).cast("double")).alias("over_half"))
