"""Contrasts between arms of sweep cells: paired tests, families, transfer, replicate noise, rank agreement of mixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rankstats import benjamini_hochberg
from .horizon import horizon, modal_horizon


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for a whole number df >= 1 of degrees of freedom, by the finite series in the angle atan(t / sqrt(df))."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos2, odd, terms = F.cos(angle) ** 2, df % 2 == 1, F.floor(df / 2).cast("int")
    begin = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * cos2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.when(terms == 0, 0.0).otherwise(F.aggregate(steps, F.struct(begin.alias("term"), begin.alias("total")), step, lambda a: a["total"]))
    inside = F.when(odd, (angle + F.sin(angle) * total) * 2 / F.pi()).otherwise(F.sin(angle) * total)
    return F.greatest(F.lit(0.0), 1 - inside)


def sign_two_sided(positive: Column, n: Column) -> Column:
    """Exact two-sided binomial p-value at one half; n at most 1,000, 1 at n = 0."""
    low = F.least(positive, n - positive).cast("int")
    begin = F.pow(F.lit(0.5), n.cast("double"))
    steps = F.when(low > 0, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (n - k + 1) / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.aggregate(steps, F.struct(begin.alias("term"), begin.alias("total")), step, lambda a: a["total"])
    return F.least(F.lit(1.0), 2 * tail)


def paired_tests(gains: DataFrame, by: list[str], value: str = "g") -> DataFrame:
    """(by, n, mean, sd, starred, p_t, p_sign) of paired differences.

    Equal differences have no t statistic: p_t is 1 where all are 0 and 0 where they repeat another value; null for one pair.
    """
    v = F.col(value)
    s = gains.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count_if(v > 0).alias("_pos"), F.count_if(v != 0).alias("_nz"))
    t = F.col("mean") / (F.col("sd") / F.sqrt("n"))
    p = F.when(F.col("sd") > 0, student_two_sided(t, F.col("n") - 1)).when(F.col("sd") == 0, (F.col("mean") == 0).cast("double"))
    return s.select(*by, "n", "mean", "sd", (F.abs("mean") > 2 * F.col("sd")).alias("starred"), p.alias("p_t"), sign_two_sided(F.col("_pos"), F.col("_nz")).alias("p_sign"))


def families(parts: dict[str, DataFrame], p: str = "p_t") -> DataFrame:
    """Rows of all parts with their family and p-values adjusted inside it, under independence (q) and any dependence (q_by)."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("family", F.lit(name)) for name, df in parts.items()])
    q = benjamini_hochberg(rows, p, ["family"])
    return benjamini_hochberg(q.withColumnRenamed("q", "_q"), p, ["family"], dependent=True).withColumnRenamed("q", "q_by").withColumnRenamed("_q", "q")


def horizon_agreement(cells: DataFrame, by: list[str], arm: str, baseline, epsilon: float) -> DataFrame:
    """(by, arm, r_star, agree, n, same): the modal horizon of each arm and whether it is the baseline's."""
    modal = modal_horizon(horizon(cells, [*by, arm, "seed"], epsilon), [*by, arm])
    base = modal.filter(F.col(arm) == baseline).select(*by, F.col("r_star").alias("_base"))
    joined = modal.join(base, by, "left") if by else modal.join(base, F.lit(True), "left")  # without by the baseline is one row
    return joined.withColumn("same", F.col("r_star").eqNullSafe(F.col("_base"))).drop("_base")


def rung_gains(cells: DataFrame, by: list[str], low: str, high: str, value: str = "kendall_tau") -> DataFrame:
    """(by, n, gain, sd, degenerate): paired gain of the richer set; a rung whose sets have equally many features measures nothing and has no gain."""
    side = lambda r, x, f: cells.filter(F.col("richness") == r).select(*by, "seed", F.col(value).alias(x), F.col("n_features").alias(f))
    g = side(high, "_a", "_fa").join(side(low, "_b", "_fb"), [*by, "seed"])
    s = g.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("_a") - F.col("_b")).alias("gain"), F.stddev_samp(F.col("_a") - F.col("_b")).alias("sd"), F.bool_and(F.col("_fa") == F.col("_fb")).alias("degenerate"))
    return s.select(*by, "n", *[F.when(~F.col("degenerate"), F.col(c)).alias(c) for c in ("gain", "sd")], "degenerate")


def share_drops(cells: DataFrame, by: list[str], share: float, full: float = 1.0, within: float = 0.02, value: str = "kendall_tau") -> DataFrame:
    """(by, n, drop, within): mean paired change of quality when trained on a share of the rows, and whether it stays close."""
    side = lambda x, c: cells.filter(F.col("fraction") == x).select(*by, "seed", F.col(value).alias(c))
    g = side(share, "_a").join(side(full, "_b"), [*by, "seed"])
    return g.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("_a") - F.col("_b")).alias("drop")).withColumn("within", F.abs(F.round("drop", 9)) <= within)


def transfer_summary(cells: DataFrame, within: DataFrame, floor: DataFrame, by: list[str], value: str = "kendall_tau") -> DataFrame:
    """(by, tau, sd, seeds, within, floor, kept, verdict): quality on a held-out network beside that inside it and a closed form's.

    within and floor have (by, within) and (by, floor); a verdict needs both and is 'unscored' where one is missing.
    """
    s = cells.groupBy(*by).agg(F.avg(value).alias("tau"), F.stddev_samp(value).alias("sd"), F.count("*").alias("seeds"))
    j = s.join(within.select(*by, "within"), by, "left").join(floor.select(*by, "floor"), by, "left")
    verdict = F.when(F.col("within").isNull() | F.col("floor").isNull(), "unscored").when(F.round(F.col("tau") - F.col("floor"), 9) > 0, "transfers").otherwise("floor")
    return j.withColumn("kept", F.col("tau") / F.col("within")).withColumn("verdict", verdict)


def arm_contrasts(cells: DataFrame, by: list[str], arm: str, pairs: list[tuple[str, str]], seeds: int, value: str = "kendall_tau") -> DataFrame:
    """One row per (by, pair): paired difference where both arms are complete under every seed, else the first other status.

    cells has a status; 'complete' cells must have a finite value. A pair with fewer than ``seeds`` seeds is 'missing'.
    """
    require_finite(cells.filter("status = 'complete'"), [value])
    plan = cells.select(*by).distinct()
    out = []
    for left, right in pairs:
        side = lambda a, x: cells.filter(F.col(arm) == a).select(*by, "seed", F.col(value).alias(f"_{x}"), F.col("status").alias(f"_s{x}"))
        g = side(left, "l").join(side(right, "r"), [*by, "seed"])
        other = F.min(F.when(F.col("_sl") != "complete", F.col("_sl")).when(F.col("_sr") != "complete", F.col("_sr")))
        d = F.col("_l") - F.col("_r")
        s = g.groupBy(*by).agg(F.count("*").alias("_n"), other.alias("_o"), F.avg("_l").alias("mean_left"), F.avg("_r").alias("mean_right"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd_difference"), F.covar_samp("_l", "_r").alias("covariance"))
        status = F.when(F.coalesce(F.col("_n"), F.lit(0)) != seeds, "missing").otherwise(F.coalesce("_o", F.lit("scored")))
        j = plan.join(s, by, "left").withColumn("status", status)
        numbers = [F.when(F.col("status") == "scored", F.col(c)).alias(c) for c in ("mean_left", "mean_right", "mean_difference", "sd_difference", "covariance")]
        starred = F.coalesce((F.col("status") == "scored") & (F.abs("mean_difference") > 2 * F.col("sd_difference")), F.lit(False))
        out.append(j.select(*by, F.lit(left).alias("left_arm"), F.lit(right).alias("right_arm"), "status", *numbers, starred.alias("starred")))
    return reduce(DataFrame.unionByName, out)


def replicate_noise(refit: DataFrame, frozen: DataFrame, keys: list[str], replicates: int, value: str = "tau_refit") -> DataFrame:
    """frozen (keys, target_noise_sd, seed_sd) with the deviation over refitted replicates and both ratios; refuses cells with other counts, and keys without their one partner."""
    a = refit.groupBy(*keys).agg(F.countDistinct("rep").alias("_reps"), F.stddev_samp(value).alias("sd_refit"), F.avg(value).alias("tau_refit_mean"))
    j = frozen.join(a, keys, "full_outer")
    wrong = j.filter((F.coalesce("_reps", F.lit(-1)) != replicates) | F.col("target_noise_sd").isNull()).limit(5).collect()
    if wrong or frozen.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"cells without exactly {replicates} replicates, or without one partner: {[tuple(r[k] for k in keys) for r in wrong]}")
    return j.drop("_reps").withColumn("refit_over_frozen", F.col("sd_refit") / F.col("target_noise_sd")).withColumn("seed_over_refit", F.col("seed_sd") / F.col("sd_refit"))


def pooled_noise(cells: DataFrame, by: list[str], inner: str, value: str = "kendall_tau") -> DataFrame:
    """(by, groups, pooled_sd): root mean square, over the values of inner, of the deviation over seeds."""
    s = cells.groupBy(*by, inner).agg(F.var_samp(value).alias("_v"))
    return s.groupBy(*by).agg(F.count("_v").alias("groups"), F.sqrt(F.avg("_v")).alias("pooled_sd"))


def mixture_tau(tau: str, n: str, n_zero: str, tied: bool = False) -> Column:
    """tau-b over all rows from tau-b over the positive ones when zeros are told apart perfectly; tied: the scores are tied on the zeros too."""
    rows, zeros = F.col(n).cast("double"), F.col(n_zero).cast("double")
    rest = rows - zeros
    total = rows * (rows - 1) / 2
    scoreable = total - zeros * (zeros - 1) / 2
    agreed = zeros * rest + F.col(tau) * rest * (rest - 1) / 2
    return agreed / (scoreable if tied else F.sqrt(scoreable * total))


def benchmark_errors(cells: DataFrame, by: list[str], near: float = 0.05) -> DataFrame:
    """(by, n, err, err_tied, hits): median errors of both mixture predictions of tau_all, and how many cells are no better than the floor.

    cells has tau_all, tau_filtered, n and n_zero; the floor is the mixture at tau 0.
    """
    c = cells.withColumn("_none", F.lit(0.0))
    err = lambda tied: mixture_tau("tau_filtered", "n", "n_zero", tied) - F.col("tau_all")
    c = c.select(*by, "tau_all", err(False).alias("_e"), err(True).alias("_t"), mixture_tau("_none", "n", "n_zero").alias("_f"))
    return c.groupBy(*by).agg(F.count("*").alias("n"), F.median("_e").alias("err"), F.median("_t").alias("err_tied"), F.count_if(F.round(F.col("tau_all") - F.col("_f"), 9) <= near).alias("hits"))


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, after a check that no value of columns is null, NaN or infinite."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns])
    if df.filter(bad).limit(1).count():
        raise ValueError(f"values of {columns} that are not finite")
    return df


def reconcile(cells: DataFrame, keys: list[str], identity: list[str], value: str, order: str = "seq", tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the last row of each key; refuses repeats that differ in an identity column or by more than tolerance in value."""
    s = cells.groupBy(*keys).agg(F.max(order).alias("_last"), F.countDistinct(F.struct(*identity)).alias("_ids"), (F.max(value) - F.min(value)).alias("_gap"))
    if s.filter((F.col("_ids") > 1) | (F.col("_gap") > tolerance)).limit(1).count():
        raise ValueError("repeated cells that do not agree")
    j = cells.join(s.select(*keys, "_last"), keys)
    return j.filter(F.col(order) == F.col("_last")).select(cells.columns), j.filter(F.col(order) != F.col("_last")).select(cells.columns)


def reordered_cells(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose ordered column list changed while its set did not; old and new have (keys, columns: array)."""
    j = old.select(*keys, F.col("columns").alias("_o")).join(new.select(*keys, F.col("columns").alias("_n")), keys)
    return j.filter((F.col("_o") != F.col("_n")) & (F.sort_array("_o") == F.sort_array("_n"))).select(*keys)


def evict(tables: list[DataFrame], stale: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Each table without the rows of stale keys, so that metrics and predictions lose the same cells."""
    return [t.join(stale.select(keys), keys, "left_anti") for t in tables]
