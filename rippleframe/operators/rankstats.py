"""Tie-aware rank statistics, per group of rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import local
from .graph import Network, numbered
from .shells import held_shell, shells


def earlier_less(x: np.ndarray) -> np.ndarray:
    """For each place, how many values before it are smaller.

    Bit by bit from the top: values stay grouped by their higher bits, each group in the given order; in a group every one
    counts the noughts before it. So n log n steps, all of them on whole arrays.
    """
    x = np.unique(x, return_inverse=True)[1].astype(np.int64)
    out, at, place = np.zeros(len(x), np.int64), np.arange(len(x)), np.arange(len(x))
    for b in range(int(x.max(initial=0)).bit_length() - 1, -1, -1):
        v = x[at]
        nought = 1 - (v >> b & 1)
        group = v >> (b + 1)
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(start, append=len(x))
        before = np.cumsum(nought) - nought
        before -= np.repeat(before[start], size)
        one, begin = nought == 0, np.repeat(start, size)
        out[at[one]] += before[one]
        to = np.where(one, place + np.repeat(np.add.reduceat(nought, start), size) - before, begin + before)
        new = np.empty_like(at)
        new[to] = at
        at = new
    return out


def inversions(x: np.ndarray) -> int:
    """Pairs i < j with x[i] > x[j]."""
    return int(earlier_less(-np.unique(x, return_inverse=True)[1]).sum())


def tied_pairs_np(x: np.ndarray) -> int:
    c = np.unique(x, return_counts=True)[1].astype(np.int64)
    return int((c * (c - 1) // 2).sum())


def concordance(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int]:
    """(concordant - discordant, all pairs, pairs tied in x, pairs tied in y) in O(n log n)."""
    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    n = len(x)
    order = np.lexsort((y, x))
    both = tied_pairs_np(x.astype(np.int64) * (n + 1) + y)
    all_, tx, ty = n * (n - 1) // 2, tied_pairs_np(x), tied_pairs_np(y)
    discordant = inversions(y[order])
    return all_ - tx - ty + both - 2 * discordant, all_, tx, ty


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    s, all_, tx, ty = concordance(x, y)
    d = math.sqrt((all_ - tx) * (all_ - ty))
    return s / d if d else None


def somers_d(target: np.ndarray, score: np.ndarray) -> float | None:
    """Of the pairs whose scores differ, concordant less discordant."""
    s, all_, _, ty = concordance(target, score)
    return s / (all_ - ty) if all_ != ty else None


def kendall(df: DataFrame, by: list[str], x: str, y: str, name: str = "tau") -> DataFrame:
    """(by, name): tau-b per group; a group must fit one task, which is one cell's nodes."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        tau = tau_b(t.column(x).to_numpy(), t.column(y).to_numpy())
        return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([tau], pa.float64())], [*by, name])

    schema = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    return df.select(*by, x, y).groupBy(*by).applyInArrow(run, f"{schema}, `{name}` double")


def average_rank(col: str, by: list[str] = (), descending: bool = False) -> Column:
    """Ranks from 1 with ties at their mean."""
    order = F.desc(col) if descending else F.asc(col)
    rank = F.rank().over(Window.partitionBy(*by, F.lit(0)).orderBy(order))
    return rank + (F.count("*").over(Window.partitionBy(*by, col)) - 1) / 2.0


def percentile_rank(col: str, by: list[str] = ()) -> Column:
    """Average-tie rank over n."""
    return average_rank(col, by) / F.count("*").over(Window.partitionBy(*by, F.lit(0)))


def centred_rank(col: str, by: list[str] = ()) -> Column:
    """(rank - 1) / (n - 1)."""
    return (average_rank(col, by) - 1) / (F.count("*").over(Window.partitionBy(*by, F.lit(0))) - 1)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    r = df.select(*by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    return r.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"))


def precision_at(df: DataFrame, by: list[str], x: str, y: str, share: int, key: str = "node") -> DataFrame:
    """(by, precision): overlap of the two top sets of max(1, n // share) nodes; ties to the smallest key."""
    w = lambda c: F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(F.desc(c), key))
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(*by, F.lit(0))) / share))
    r = df.select(*by, w(x).alias("a"), w(y).alias("b"), k.alias("k"))
    return r.groupBy(*by).agg((F.count_if((F.col("a") <= F.col("k")) & (F.col("b") <= F.col("k"))) / F.max("k")).alias("precision"))


def rmse(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(x) - F.col(y), 2))).alias("rmse"))


def average_rank_np(x: np.ndarray) -> np.ndarray:
    _, at, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2.0)[at]


def metrics(y: np.ndarray, pred: np.ndarray, key: np.ndarray) -> list[float | None]:
    """kendall_tau, spearman, precision_at_1pct, precision_at_5pct and rmse of one cell."""
    a, b = (average_rank_np(x) - (len(x) + 1) / 2 for x in (y, pred))
    spread = math.sqrt(float((a * a).sum()) * float((b * b).sum()))
    top = lambda x, k: key[np.lexsort((key, -x))[:k]]
    best = [max(1, len(y) // share) for share in (100, 20)]
    hits = [len(np.intersect1d(top(y, k), top(pred, k))) / k for k in best]
    return [tau_b(y, pred), float((a * b).sum()) / spread if spread else None, *hits, math.sqrt(float(((y - pred) ** 2).mean()))]


def evaluate(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred", key: str = "node") -> DataFrame:
    """kendall_tau, spearman, precision_at_1pct, precision_at_5pct and rmse per cell, all from one pass over a cell's rows."""
    names = ["kendall_tau", "spearman", "precision_at_1pct", "precision_at_5pct", "rmse"]

    def run(cell: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        m = metrics(*(t.column(c).to_numpy().astype(float) for c in (y, pred)), t.column(key).to_numpy())
        return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in cell), *(pa.array([x], pa.float64()) for x in m)], [*by, *names])

    schema = ", ".join([*(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by), *(f"{c} double" for c in names)])
    return df.select(*by, key, y, pred).groupBy(*by).applyInArrow(run, schema)


def tied_pairs(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("c")).agg(F.sum(F.col("c").cast("decimal(19,0)") * (F.col("c") - 1) / 2).cast("decimal(38,0)").alias("tied_pairs"))


def cliffs_delta(df: DataFrame, group: str, value: str) -> DataFrame:
    """(delta, p): how often group true exceeds group false, 2U / (n_a n_b) - 1, with a normal approximation."""
    r = df.select(F.col(group).alias("g"), average_rank(value).alias("r"), F.col(value).alias("v"))
    ties = df.groupBy(value).agg(F.count("*").alias("c")).agg(F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("t"))
    a = r.agg(F.sum(F.when(F.col("g"), F.col("r"))).alias("ra"), F.count_if("g").alias("na"), F.count_if(~F.col("g")).alias("nb")).crossJoin(ties)  # one row each
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    n = F.col("na") + F.col("nb")
    var = F.col("na") * F.col("nb") / 12.0 * (n + 1 - F.col("t") / (n * (n - 1)))
    z = F.greatest(F.abs(u - F.col("na") * F.col("nb") / 2.0) - 0.5, F.lit(0.0)) / F.sqrt(var)
    return a.select((2 * u / (F.col("na") * F.col("nb")) - 1).alias("delta"), z.alias("z")).withColumn("p", two_sided("z"))


def two_sided(z: str) -> Column:
    """Normal tail of both sides (Abramowitz and Stegun 26.2.17, error under 1e-7)."""
    # fixed values of the published approximation
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = sum((c * F.pow(t, F.lit(i + 2)) for i, c in enumerate(b[1:])), b[0] * t)
    return F.least(F.lit(1.0), 2 * F.exp(-F.pow(z, F.lit(2)) / 2) / math.sqrt(2 * math.pi) * poly)


def zero_inflation(df: DataFrame, col: str) -> DataFrame:
    """Share of zeros, weight of zero/non-zero pairs among scoreable ones, and the tau floor of telling zeros apart."""
    a = df.agg(F.count("*").alias("n"), F.count_if(F.col(col) == 0).alias("nz")).select("n", "nz", (F.col("n") - F.col("nz")).alias("nn"))
    d = lambda x: x.cast("double")
    pairs = lambda x: d(x) * (d(x) - 1) / 2
    cross, total = d(F.col("nz")) * d(F.col("nn")), pairs(F.col("n"))
    scoreable = total - pairs(F.col("nz"))
    return a.select("n", "nz", (d(F.col("nz")) / d(F.col("n"))).alias("zero_share"), F.when(scoreable > 0, cross / scoreable).alias("w"), F.when(scoreable > 0, cross / F.sqrt(scoreable * total)).alias("tau_floor"))


def _less_within(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place: how many of its group have a smaller x, and how many the same."""
    order = np.lexsort((x, group))
    g, v = group[order], x[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    cut = new | np.concatenate([[True], v[1:] != v[:-1]])
    start = np.flatnonzero(cut)
    size = np.diff(start, append=len(g))
    less, same = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    less[order], same[order] = np.repeat(start, size) - first, np.repeat(size, size)
    return less, same


def contributions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Concordant less discordant partners of each place, in O(n log n)."""
    n, none = len(a), np.zeros(len(a), np.int8)
    if not n:
        return np.zeros(0, np.int64)
    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    order = np.lexsort((-b, a))
    ll = np.empty(n, np.int64)
    ll[order] = earlier_less(b[order])  # smaller in both
    a_less, a_same = _less_within(none, a)
    b_less, b_same = _less_within(none, b)
    a_less_b_same, _ = _less_within(b, a)
    b_less_a_same, both = _less_within(a, b)
    lg = a_less - ll - a_less_b_same
    gl = b_less - ll - b_less_a_same
    gg = n - b_less - b_same - lg - (a_same - b_less_a_same - both)
    return ll + gg - lg - gl


def pair_contributions(df: DataFrame, x: str, y: str, key: str = "node") -> DataFrame:
    """(key, s): concordant less discordant partners of each row, for one cell's nodes in one task."""

    def run(t: pa.Table) -> pa.Table:
        return pa.table({key: t.column(key), "s": contributions(t.column(x).to_numpy(), t.column(y).to_numpy())})

    return df.select(key, x, y, F.lit(0).alias("_g")).groupBy("_g").applyInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, s long")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] = (), dependent: bool = False) -> DataFrame:
    """df with q: adjusted p-values; dependent: Benjamini and Yekutieli's factor.

    Without groups the ranks and the minima from each row on are taken per range of p, so that no task holds all rows.
    """
    value = F.col(p) * F.col("_m") * F.col("_f") / F.col("_r")
    if by:
        w = Window.partitionBy(*by)
        # once a group, not once a row
        factor = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / i) if dependent else F.lit(1.0)
        size = df.groupBy(*by).agg(F.count("*").alias("_m")).select(*by, "_m", factor.alias("_f"))
        ranked = df.join(size, list(by)).withColumn("_r", F.row_number().over(w.orderBy(p))).withColumn("_v", value)
        back = w.orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return ranked.withColumn("q", F.least(F.lit(1.0), F.min("_v").over(back))).select(*df.columns, "q")
    m = df.count()
    factor = float(np.cumsum(1.0 / np.arange(1, m + 1))[-1]) if dependent and m else 1.0
    held = numbered(df, [p], "_r").withColumn("_r", F.col("_r") + 1).withColumn("_m", F.lit(m)).withColumn("_f", F.lit(factor)).withColumn("_v", value)
    least = {r["_p"]: r["v"] for r in held.groupBy("_p").agg(F.min("_v").alias("v")).collect()}  # one small row a range
    after, low = [], 1.0
    for part in range(max(least, default=0), -1, -1):
        after.append(low)
        low = min(low, least[part] if least.get(part) is not None else low)
    back = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = F.element_at(F.array([F.lit(float(x)) for x in after[::-1]]), F.col("_p") + 1)
    return held.withColumn("q", F.least(later, F.min("_v").over(back))).select(*df.columns, "q")


def paired_gain(df: DataFrame, by: list[str], arm: str, a, b, value: str, seed: str = "seed") -> DataFrame:
    """(by, n, mean, sd, starred): value of arm a less arm b under the same seed; starred when |mean| > 2 sd."""
    left = df.filter(F.col(arm) == a).select(*by, seed, F.col(value).alias("x"))
    right = df.filter(F.col(arm) == b).select(*by, seed, F.col(value).alias("y"))
    g = left.join(right, [*by, seed]).withColumn("g", F.col("x") - F.col("y"))
    s = g.groupBy(*by).agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"))
    return s.withColumn("starred", F.abs("mean") > 2 * F.col("sd"))


def kendall_critical(n: int, level: float = 0.05) -> float | None:
    """Least tau of n untied pairs that chance reaches with probability at most level (one-sided), from the exact inversion counts."""
    counts = np.array([1.0])
    for m in range(2, n + 1):
        counts = np.convolve(counts, np.ones(m))
    counts /= counts.sum()
    total, tail, best = n * (n - 1) // 2, 0.0, None
    for inv in range(len(counts)):  # few inversions: high tau
        tail += counts[inv]
        if tail > level:
            break
        best = 1 - 2 * inv / total
    return best


def moran(net_shell: DataFrame | Network, z: DataFrame, max_lag: int) -> DataFrame:
    """(lag, moran_i, n): autocorrelation of z (node, z) at exact hop distance; nodes with an empty shell are left out.

    Shells, or a network whose layers are expanded source by source.
    """
    mean = z.agg(F.avg("z").alias("m"))
    c = z.crossJoin(mean).select("node", (F.col("z") - F.col("m")).alias("c"))  # mean is one row
    if isinstance(net_shell, Network):
        net_shell, net = held_shell(net_shell, None, max_lag), net_shell
    if net_shell is None:
        lagged = local.shell_means(net, local.vectors(net, c, ["c"]), list(range(1, max_lag + 1)))
    else:
        lagged = net_shell.filter((F.col("d") > 0) & (F.col("d") <= max_lag)).join(c, "node").groupBy("src", "d").agg(F.avg("c").alias("w"))
    j = lagged.join(c.select(F.col("node").alias("src"), "c"), "src")
    total = c.agg((F.sum(F.col("c") * F.col("c")) / F.count("*")).alias("v"))
    return j.groupBy(F.col("d").alias("lag")).agg(F.avg(F.col("c") * F.col("w")).alias("a"), F.count("*").alias("n")).crossJoin(total).select("lag", F.when(F.col("v") > 0, F.col("a") / F.col("v")).alias("moran_i"), "n")


def two_number_report(df: DataFrame, y: str, score: str, predicted_zero: str) -> DataFrame:
    """How well zeros are told apart (confusion counts, accuracy), and apart from that tau-b over the positive rows with its ties."""
    zero, said = F.col(y) == 0, F.col(predicted_zero)
    counts = df.agg(F.count("*").alias("n"), F.count_if(zero & said).alias("zero_hit"), F.count_if(zero & ~said).alias("zero_missed"), F.count_if(~zero & said).alias("zero_wrong"), F.avg((zero == said).cast("double")).alias("zero_accuracy"))
    positive = df.filter(F.col(y) > 0).select(F.lit(0).alias("g"), y, score)
    tau = kendall(positive, ["g"], y, score, "tau_positive").select("tau_positive")
    ties = tied_pairs(positive, y).select(F.col("tied_pairs").cast("long").alias("ties_y")).crossJoin(tied_pairs(positive, score).select(F.col("tied_pairs").cast("long").alias("ties_score")))
    return counts.join(tau, F.lit(True), "left").join(ties, F.lit(True), "left")  # one row each


def tie_broken_tau(df: DataFrame, x: str, y: str, reps: int = 5, key: str = "node") -> DataFrame:
    """(rep, tau): tau of y against x with x's ties broken by a hash jitter far below x's resolution; x holds whole numbers."""
    from ..functions.rng import uniform

    many = df.select(key, x, y, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return kendall(many.withColumn("_x", F.col(x) + 0.001 * uniform(key, "rep")), ["rep"], y, "_x")


def moran_null(shell: DataFrame | Network, z: DataFrame, lag: int, reps: int) -> DataFrame:
    """(rep, moran_i): Moran's I at one lag with z dealt anew to the nodes by hashes, once per rep; shells or a network."""
    from ..functions.rng import uniform

    many = z.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    # every rep has the same number of rows, so places over all reps match
    own = numbered(many.select("rep", "node"), ["rep", "node"], "i").select("rep", "node", "i")
    dealt = numbered(many.select("rep", "z", "node", uniform("node", "rep").alias("h")), ["rep", "h", "node"], "i").select("z", "i")
    mean = z.agg(F.avg("z").alias("m"))
    c = own.join(dealt, "i").crossJoin(mean).select("rep", "node", (F.col("z") - F.col("m")).alias("c"))  # mean is one row
    if isinstance(shell, Network):
        # neighbours are the arcs
        shell = shell.arcs.select(F.col("u").alias("src"), F.col("v").alias("node"), F.lit(1).alias("d")) if lag == 1 else shells(shell.arcs, lag)
    lagged = shell.filter(F.col("d") == lag).select("src", "node").join(c, "node").groupBy("rep", "src").agg(F.avg("c").alias("w"))
    total = c.groupBy("rep").agg(F.avg(F.col("c") * F.col("c")).alias("v"))
    j = lagged.join(c.select("rep", F.col("node").alias("src"), "c"), ["rep", "src"])
    return j.groupBy("rep").agg(F.avg(F.col("c") * F.col("w")).alias("a")).join(total, "rep").select("rep", (F.col("a") / F.col("v")).alias("moran_i"))


def buffer_radius(observed: DataFrame, null: DataFrame, level: float = 0.05) -> DataFrame:
    """(buffer): the first lag whose Moran's I is within the null's (lag, rep, moran_i) upper tail."""
    p = observed.select("lag", F.col("moran_i").alias("o")).join(null, "lag").groupBy("lag").agg(((F.count_if(F.col("moran_i") >= F.col("o")) + 1) / (F.count("*") + 1)).alias("p"))
    return p.agg(F.min(F.when(F.col("p") > level, F.col("lag"))).alias("buffer"))
