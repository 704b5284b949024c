"""Cross-validated models over feature tables: folds by hash, out-of-fold predictions, the locality grid."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators.rankstats import evaluate
from ..operators.targets import assert_no_leakage
from ..sources.tables import stored
from .registry import LADDER, select_features


def folds(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, fold): rows in hash order dealt to k folds whose sizes differ by one at most."""
    w = Window.partitionBy(F.lit(0)).orderBy(uniform("node", F.lit(seed)), "node")
    return nodes.select("node", ((F.row_number().over(w) - 1) % k).cast("int").alias("fold"))


def subsample(split: DataFrame, share: float, seed: int) -> DataFrame:
    """(node, fold): the round(share * n) first rows of each fold in hash order; all at share 1."""
    if share >= 1:
        return split
    w = Window.partitionBy("fold")
    rank = F.row_number().over(w.orderBy(uniform("node", F.lit(seed), F.lit("s")), "node"))
    n = F.count("*").over(w)
    return split.select("node", "fold", rank.alias("_r"), n.alias("_n")).filter(F.col("_r") <= F.round(F.col("_n") * share)).select("node", "fold")


def _forest(seed: int):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(numTrees=120, minInstancesPerNode=2, featureSubsetStrategy="all", maxDepth=20, seed=seed)


def _ridge(seed: int):
    from .ridge import RidgeGrid

    return RidgeGrid()


def _boosted(leaf: int) -> Callable:
    def make(seed: int):
        from pyspark.ml.regression import GBTRegressor

        return GBTRegressor(maxIter=100, minInstancesPerNode=leaf, stepSize=0.1, seed=seed)

    return make


#: Factories (seed) -> regressor.
ESTIMATORS: dict[str, Callable] = {"rf": _forest, "ridge": _ridge, "hgb": _boosted(20), "hgb_matched": _boosted(2), "rf_log1p": _forest}


def register_estimator(name: str, factory: Callable) -> None:
    ESTIMATORS[name] = factory


def check_scope(name: str, target: str) -> None:
    """The log1p objective is for betweenness only."""
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name}; there are {sorted(ESTIMATORS)}")
    if name.endswith("_log1p") and target not in ("betweenness", "b_2", "b_3"):
        raise ValueError(f"{name} is for betweenness, not for {target}")


def out_of_fold(x: DataFrame, y: DataFrame, columns: list[str], estimator: str, target: str, seed: int, k: int = 5, split: DataFrame | None = None, share: float = 1.0) -> DataFrame:
    """(node, y, pred): each fold predicted by a model of the other folds; features must be local."""
    from pyspark.ml.feature import VectorAssembler

    assert_no_leakage(columns)
    check_scope(estimator, target)
    split = split if split is not None else folds(x.select("node"), k, seed)
    log = estimator.endswith("_log1p")
    data = x.select("node", *[F.col(c).cast("double").alias(c) for c in columns]).join(y.select("node", "y"), "node").join(split, "node")
    data = data.withColumn("label", F.log1p("y") if log else F.col("y"))
    data = stored(VectorAssembler(inputCols=columns, outputCol="features").transform(data).select("node", "y", "label", "fold", "features"), "design")
    out = []
    for f in range(k):
        train = data.filter(F.col("fold") != f)
        if share < 1:
            train = train.join(subsample(train.select("node", "fold"), share, seed).select("node"), "node", "left_semi")
        model = ESTIMATORS[estimator](seed).fit(train)
        p = model.transform(data.filter(F.col("fold") == f)).select("node", "y", (F.expm1("prediction") if log else F.col("prediction")).alias("pred"))
        out.append(p)
    return reduce(DataFrame.unionByName, out)


def locality_sweep(x: DataFrame, y: DataFrame, target: str, radii: list[int], tiers: list[str], seeds: list[int], estimator: str = "rf", done: DataFrame | None = None) -> DataFrame:
    """One row of metrics per (radius, tier set, seed) not in done."""
    have = {tuple(r) for r in done.select("radius", "richness", "seed").collect()} if done is not None else set()
    rows = []
    for r in radii:
        for t in tiers:
            columns = select_features(x.columns, r, LADDER[t])
            for s in seeds:
                if (r, t, s) in have:
                    continue
                p = out_of_fold(x, y, columns, estimator, target, s).withColumn("cell", F.lit(0))
                rows.append(evaluate(p, ["cell"]).drop("cell").select(F.lit(target).alias("target"), F.lit(r).alias("radius"), F.lit(t).alias("richness"), F.lit(s).alias("seed"), F.lit(len(columns)).alias("n_features"), "*"))
    if not rows:
        raise ValueError("nothing to run")
    return reduce(DataFrame.unionByName, rows)


def add_one(x: DataFrame, y: DataFrame, base: list[str], extra: list[str], estimator: str, target: str, seeds: list[int]) -> DataFrame:
    """(column, seed, metrics): out-of-fold quality of the base columns (column null) and of base with each extra column, on the same folds."""
    out = []
    for column in (None, *extra):
        for s in seeds:
            p = out_of_fold(x, y, [*base, column] if column else base, estimator, target, s).withColumn("cell", F.lit(0))
            out.append(evaluate(p, ["cell"]).drop("cell").select(F.lit(column).cast("string").alias("column"), F.lit(s).alias("seed"), "*"))
    return reduce(DataFrame.unionByName, out)


def held_out_r2(x: DataFrame, column: str, others: list[str], estimator: str = "hgb", seed: int = 0, test: float = 0.3) -> float | None:
    """R squared, on a hash-drawn share of the rows, of rebuilding column from others; None without others or for a constant column."""
    from pyspark.ml.feature import VectorAssembler

    low, high = x.agg(F.min(column), F.max(column)).first()
    if not others or low == high:
        return None
    data = VectorAssembler(inputCols=others, outputCol="features").transform(x.select("node", F.col(column).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in others]))
    data = stored(data.select("features", "label", (uniform("node", F.lit(seed), F.lit("t")) < test).alias("_test")), "rebuilt")
    p = ESTIMATORS[estimator](seed).fit(data.filter("NOT _test")).transform(data.filter("_test"))
    r = p.agg(F.sum((F.col("label") - F.col("prediction")) ** 2).alias("left"), (F.var_pop("label") * F.count("*")).alias("all")).first()
    return 1 - r["left"] / r["all"] if r["all"] else None


def transfer(tables: dict[str, tuple[DataFrame, DataFrame]], columns: list[str], estimator: str, seed: int, most: int = 2000) -> DataFrame:
    """(source-left-out network, node, y, pred): targets as percentile ranks within their network, at most ``most`` hash-drawn rows from each source."""
    from pyspark.ml.feature import VectorAssembler

    from ..operators.rankstats import percentile_rank

    assert_no_leakage(columns)
    every = []
    for name, (x, y) in tables.items():
        every.append(x.select("node", *[F.col(c).cast("double").alias(c) for c in columns]).join(y.select("node", "y"), "node").withColumn("label", percentile_rank("y")).withColumn("network", F.lit(name)))
    data = stored(VectorAssembler(inputCols=columns, outputCol="features").transform(reduce(DataFrame.unionByName, every)), "transfer")
    rank = F.row_number().over(Window.partitionBy("network").orderBy(uniform("node", F.lit(seed)), "node"))
    sampled = data.withColumn("_r", rank).filter(F.col("_r") <= most)
    out = []
    for name in tables:
        model = ESTIMATORS[estimator](seed).fit(sampled.filter(F.col("network") != name))
        out.append(model.transform(data.filter(F.col("network") == name)).select("network", "node", "y", F.col("prediction").alias("pred")))
    return reduce(DataFrame.unionByName, out)


def buffered_exclusion(arcs: DataFrame, test: DataFrame, hops: int) -> DataFrame:
    """(fold, node): nodes within ``hops`` of a fold's test nodes, which its training must leave out; test has (fold, node)."""
    held = test.select("fold", "node")
    front = held
    for _ in range(hops):
        new = front.join(arcs.withColumnRenamed("u", "node"), "node").select("fold", F.col("v").alias("node")).distinct()
        front = stored(new.join(held, ["fold", "node"], "left_anti"), "buffer")
        held = held.unionByName(front)
    return held


def damaged_prediction(models: list, damaged: DataFrame, split: DataFrame, columns: list[str]) -> DataFrame:
    """(node, pred): clean-trained fold models applied to a damaged network's features."""
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="features").transform(damaged.join(split, "node"))
    return reduce(DataFrame.unionByName, [m.transform(data.filter(F.col("fold") == f)).select("node", F.col("prediction").alias("pred")) for f, m in enumerate(models)])


def bfs_order(near: dict[int, list[int]], seed: int) -> list[int]:
    """First-in first-out order from a seeded start, on to the next component when one ends."""
    import numpy as np

    rng = np.random.default_rng(seed)
    left, out = dict.fromkeys(sorted(near)), []
    while left:
        start = list(left)[int(rng.integers(len(left)))]
        queue, at = [start], 0
        del left[start]
        while at < len(queue):
            for y in near[queue[at]]:
                if y in left:
                    del left[y]
                    queue.append(y)
            at += 1
        out += queue
    return out


def region_folds(net, k: int, seed: int) -> DataFrame:
    """(node, fold): k contiguous regions of a breadth-first order, for a network whose size targets.adjacency() checks."""
    from ..operators.targets import adjacency

    ptr, nbr = adjacency(net)
    order = bfs_order({i: nbr[ptr[i] : ptr[i + 1]].tolist() for i in range(len(ptr) - 1)}, seed)
    n = len(order)
    return net.nodes.sparkSession.createDataFrame([(int(x), min(i * k // n, k - 1)) for i, x in enumerate(order)], "node long, fold int")


def buffered_plan(net, split: DataFrame, hops: int, least: int = 30, seed: int = 0) -> DataFrame:
    """(fold, node, arm): training rows per fold, 'buffered' without nodes near the test region and 'control' with as many hash-drawn rows; folds with fewer than ``least`` rows are left out."""
    every = split.select("node").crossJoin(split.select("fold").distinct())  # nodes times folds, the plan's own size
    train = every.join(split, ["fold", "node"], "left_anti")
    kept = stored(train.join(buffered_exclusion(net.arcs, split, hops), ["fold", "node"], "left_anti"), "buffered")
    size = kept.groupBy("fold").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(uniform("node", "fold", F.lit(seed)), "node"))
    control = train.withColumn("_r", rank).join(size, "fold").filter("_r <= n").select("fold", "node", F.lit("control").alias("arm"))
    return kept.join(size, "fold").select("fold", "node", F.lit("buffered").alias("arm")).unionByName(control)
