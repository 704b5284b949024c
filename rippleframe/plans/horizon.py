"""Analyses of sweep cells (network, target, radius, richness, seed, kendall_tau, ...): relational plans only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["network", "target", "radius", "richness", "seed"]


def keep_last(cells: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last written row of each key."""
    return cells.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in cells.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*").select(cells.columns)


def splice(cells: DataFrame, arm: DataFrame, target: str) -> DataFrame:
    """cells with target's rows from arm; the two must cover the same keys and arm may hold nothing else."""
    own = cells.filter(F.col("target") == target)
    keys = [c for c in CELL if c in cells.columns]
    if arm.filter(F.col("target") != target).limit(1).count():
        raise ValueError(f"the arm holds targets besides {target}")
    if own.select(keys).exceptAll(arm.select(keys)).limit(1).count() or arm.select(keys).exceptAll(own.select(keys)).limit(1).count():
        raise ValueError(f"the arm's cells are not those of {target}")
    return cells.filter(F.col("target") != target).unionByName(arm)


def curve(cells: DataFrame, by: list[str], value: str = "kendall_tau") -> DataFrame:
    return cells.groupBy(*by, "radius").agg(F.avg(value).alias("tau_mean"), F.stddev_samp(value).alias("tau_sd"), F.count("*").alias("n"))


def seed_matrix(cells: DataFrame, by: list[str], radii: list[int], value: str = "kendall_tau") -> DataFrame:
    wide = cells.groupBy(*by, "seed").pivot("radius", radii).agg(F.first(value))
    return wide.select(*by, "seed", *[F.col(str(r)).alias(f"r{r}") for r in radii])


def horizon(cells: DataFrame, by: list[str], epsilon: float, value: str = "kendall_tau") -> DataFrame:
    """(by, r_star, ceiling): the smallest radius within epsilon of the best one; undefined (null) where the best is not positive."""
    top = F.max(value).over(Window.partitionBy(*by))
    near = F.when((F.col("_top") > 0) & (F.col(value) >= (1 - epsilon) * F.col("_top")), F.col("radius"))
    return cells.withColumn("_top", top).groupBy(*by).agg(F.min(near).alias("r_star"), F.max("_top").alias("ceiling"))


def modal_horizon(per_seed: DataFrame, by: list[str]) -> DataFrame:
    """(by, r_star, agree, n): the most frequent r_star over seeds, the smaller on ties, and its support."""
    counts = per_seed.filter("r_star IS NOT NULL").groupBy(*by, "r_star").agg(F.count("*").alias("c"))
    return counts.groupBy(*by).agg(F.max_by("r_star", F.struct("c", -F.col("r_star"))).alias("r_star"), F.max("c").alias("agree"), F.sum("c").alias("n"))


def noise_horizon(cells: DataFrame, by: list[str], value: str = "kendall_tau") -> DataFrame:
    """(by, r_star, r_ceiling): smallest radius whose mean paired gap to the best radius is at most two paired deviations."""
    mean = cells.groupBy(*by, "radius").agg(F.avg(value).alias("m"))
    best = mean.groupBy(*by).agg(F.max_by("radius", F.struct("m", -F.col("radius"))).alias("r_ceiling"))
    top = cells.join(best, by).filter("radius = r_ceiling").select(*by, "seed", "r_ceiling", F.col(value).alias("top"))
    gap = cells.join(top, [*by, "seed"]).groupBy(*by, "r_ceiling", "radius").agg(F.avg(F.col("top") - F.col(value)).alias("gap"), F.coalesce(F.stddev_samp(F.col("top") - F.col(value)), F.lit(0.0)).alias("sd"))
    return gap.groupBy(*by, "r_ceiling").agg(F.min(F.when(F.col("gap") <= 2 * F.col("sd"), F.col("radius"))).alias("r_star")).select(*by, "r_star", "r_ceiling")


def radius_gains(cells: DataFrame, by: list[str], value: str = "kendall_tau") -> DataFrame:
    """(by, radius, n, mean, sd, starred): paired gain of each radius over the one before."""
    prev = cells.select(*by, "seed", (F.col("radius") + 1).alias("radius"), F.col(value).alias("_p"))
    g = cells.join(prev, [*by, "seed", "radius"]).withColumn("g", F.col(value) - F.col("_p"))
    s = g.groupBy(*by, "radius").agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"))
    return s.withColumn("starred", F.abs("mean") > 2 * F.col("sd"))


def depth_against_richness(cells: DataFrame, by: list[str], low: str, high: str, value: str = "kendall_tau") -> DataFrame:
    """(by, radius, n, gain_richness, sd): paired gain of the richer set at each radius."""
    a = cells.filter(F.col("richness") == high).select(*by, "radius", "seed", F.col(value).alias("a"))
    b = cells.filter(F.col("richness") == low).select(*by, "radius", "seed", F.col(value).alias("b"))
    g = a.join(b, [*by, "radius", "seed"])
    return g.groupBy(*by, "radius").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("gain_richness"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd"))


def pareto(cells: DataFrame, by: list[str], cost: str, value: str = "tau_mean") -> DataFrame:
    """Rows that beat every cheaper one."""
    w = Window.partitionBy(*by).orderBy(cost, F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_m", F.max(value).over(w)).filter(f"_m IS NULL OR {value} > _m").drop("_m")


def radius_rule(means: DataFrame, by: list[str], value: str, full: int = 3, share: float = 0.98) -> DataFrame:
    """(by, radius): the first radius with at least share of the value at the full radius."""
    top = means.filter(F.col("radius") == full).select(*by, F.col(value).alias("_top"))
    return means.join(top, by).groupBy(*by).agg(F.min(F.when(F.col(value) >= share * F.col("_top"), F.col("radius"))).alias("radius"))


def certificate_ratio(cells: DataFrame, by: list[str], value: str = "kendall_tau") -> DataFrame:
    """(by, seed, ratio): quality at one hop over that at three."""
    at = lambda r: F.max(F.when(F.col("radius") == r, F.col(value)))
    return cells.groupBy(*by, "seed").agg((at(1) / at(3)).alias("ratio"))


def verdicts(gains: DataFrame, by: list[str]) -> DataFrame:
    """(by, verdict): 'deeper' when a starred positive gain exists beyond hop 1, 'local' when none does, 'unscored' when a gain is missing."""
    g = gains.filter("radius > 1").groupBy(*by).agg(F.count_if(F.col("mean").isNull() | F.col("sd").isNull()).alias("missing"), F.max((F.col("starred") & (F.col("mean") > 0)).cast("int")).alias("deep"))
    return g.select(*by, F.when(F.col("missing") > 0, "unscored").when(F.col("deep") == 1, "deeper").otherwise("local").alias("verdict"))


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], value: str = "kendall_tau", tolerance: float = 1e-6) -> DataFrame:
    """Full outer comparison by key: where a cell is, its difference, and whether it agrees."""
    a, b = old.select(*keys, F.col(value).alias("old")), new.select(*keys, F.col(value).alias("new"))
    j = a.join(b, keys, "full_outer")
    side = F.when(F.col("old").isNull(), "new_only").when(F.col("new").isNull(), "old_only").otherwise("both")
    return j.select(*keys, side.alias("side"), (F.col("new") - F.col("old")).alias("diff"), F.coalesce(F.abs(F.col("new") - F.col("old")) <= tolerance, F.lit(False)).alias("agrees"))


def missing_cells(plan: DataFrame, metrics: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Planned cells to run: a cell is done only when it has both metrics and predictions."""
    done = metrics.select(keys).join(predictions.select(keys).distinct(), keys, "left_semi")
    return plan.join(done, keys, "left_anti")


def fold_digest(folds: DataFrame) -> DataFrame:
    """SHA-256 of a realised split (node, fold), the same for any row order."""
    rows = folds.agg(F.sort_array(F.collect_list(F.struct("node", "fold"))).alias("f"))
    return rows.select(F.sha2(F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["node"], x["fold"])), ","), 256).alias("digest"))


def tails(df: DataFrame, value: str, share: float = 0.05, least: int = 10, key: str = "node") -> DataFrame:
    """(key, tail): the k = max(least, round(share n)) lowest and highest rows; ties to the smallest key."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    k = F.greatest(F.lit(least), F.round(n * share).cast("int"))
    up = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(value), key))
    down = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc(value), key))
    r = df.select(key, k.alias("k"), up.alias("up"), down.alias("down"))
    return r.select(key, F.when(F.col("up") <= F.col("k"), "high").when(F.col("down") <= F.col("k"), "low").alias("tail")).filter("tail IS NOT NULL")


def standardised_residual(df: DataFrame, x: str, delta: str, bins: int = 10) -> DataFrame:
    """(node, z): delta less its bin's median over the bin's MAD, bins by quantiles of x; 0 where the MAD is 0."""
    from ..operators.targets import quantile_bins

    b, _ = quantile_bins(df.select("node", x, delta), x, bins)
    med = b.groupBy("bin").agg(F.percentile(delta, 0.5).alias("med"))
    c = b.join(F.broadcast(med), "bin").withColumn("c", F.col(delta) - F.col("med"))  # at most bins rows
    mad = c.groupBy("bin").agg(F.percentile(F.abs("c"), 0.5).alias("mad"))
    return c.join(F.broadcast(mad), "bin").select("node", F.when(F.col("mad") > 0, F.col("c") / F.col("mad")).otherwise(0.0).alias("z"))


def grid_scan(scores: DataFrame, value: str, step: float) -> DataFrame:
    """Audit of exported scores: rows, zeros, values off the grid of step, values at one step, least positive value."""
    v = F.col(value).cast("decimal(38,18)")
    s = F.lit(str(step)).cast("decimal(38,18)")
    return scores.agg(F.count("*").alias("rows"), F.count_if(v == 0).alias("zeros"), F.count_if(v % s != 0).alias("off_grid"), F.count_if(v == s).alias("at_step"), F.min(F.when(v > 0, F.col(value).cast("double"))).alias("least_positive"))


def pair_labels(rows: DataFrame, label: str, order: str, suffix: str = "_filtered") -> DataFrame:
    """(base, nth, plain, filtered): the n-th plain row of a label with the n-th of its filtered twin."""
    base = F.regexp_replace(label, f"{suffix}$", "")
    r = rows.select(base.alias("base"), F.col(label).endswith(suffix).alias("is_f"), F.row_number().over(Window.partitionBy(label).orderBy(order)).alias("nth"), F.col(order).alias("o"))
    p, f = r.filter("NOT is_f").select("base", "nth", F.col("o").alias("plain")), r.filter("is_f").select("base", "nth", F.col("o").alias("filtered"))
    return p.join(f, ["base", "nth"])
