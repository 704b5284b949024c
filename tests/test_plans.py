"""Registry, folds, models and the sweep on a small network."""

import pytest
from pyspark.sql import functions as F

from rippleframe.operators import descriptors, features, graph, shells, targets
from rippleframe.plans import horizon, models, registry


@pytest.fixture(scope="module")
def tables(spark):
    net = graph.build_network(descriptors.holme_kim(spark, 120, 3, 0.6, 1))
    shell = shells.shells(net.arcs, 3)
    x = features.feature_table(net, shell, 0.2)
    from rippleframe.sources.tables import stored

    return net, stored(x, "x"), stored(targets.b2(net).select("node", F.col("b_2").alias("y")), "y")


def test_registry_covers_the_table(tables):
    _, x, _ = tables
    names = {f.name for f in registry.features()}
    assert set(x.columns) - {"node", "original_id", "nbw_2", "nbr_degree_sum"} <= names | {"nbr_degree_sum"}
    sizes = [len(registry.select_features(x.columns, r, registry.LADDER["all"])) for r in range(4)]
    assert sizes == sorted(set(sizes))
    sets = registry.first_hop_sets(x.columns)
    assert list(sets) == ["degree", "node", "node+edge", "structural"]


def test_feature_cost(spark):
    t = spark.createDataFrame([("degree", 1.0), ("h_index_1", 2.0), ("h_index_2", 4.0), ("h_index_3", 8.0)], "grp string, seconds double")
    assert registry.feature_cost(["degree", "h_index_2"], t).first().seconds == 7.0


def test_folds_and_subsample(tables):
    net, _, _ = tables
    f = models.folds(net.nodes.select("node"), 5, 0)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == net.n
    assert models.subsample(f, 0.5, 1).count() == sum(round(s * 0.5) for s in sizes)
    assert horizon.fold_digest(f).first() == horizon.fold_digest(f.repartition(3)).first()


def test_sweep_improves_with_radius(tables):
    _, x, y = tables
    cells = models.locality_sweep(x, y, "b_2", [0, 1], ["node"], [0], "ridge").collect()
    by = {r.radius: r for r in cells}
    assert by[1].rmse < by[0].rmse and by[1].n_features > by[0].n_features  # what a ridge is fitted for
    with pytest.raises(ValueError):
        models.out_of_fold(x, y, ["degree", "spread_mean"], "ridge", "b_2", 0)
    with pytest.raises(ValueError):
        models.check_scope("rf_log1p", "spread_mean")


def test_buffer_excludes_near_nodes(tables, spark):
    net, _, _ = tables
    test = spark.createDataFrame([(0, 0)], "fold int, node long")
    got = {r.node for r in models.buffered_exclusion(net.arcs, test, 1).collect()}
    assert got == {0} | {r.v for r in net.arcs.filter("u = 0").collect()}


def test_horizon_rules(spark):
    rows = [("t", r, s, v + 0.001 * s) for s in range(3) for r, v in enumerate((0.5, 0.8, 0.9, 0.89))]
    c = spark.createDataFrame(rows, "target string, radius int, seed int, kendall_tau double")
    assert horizon.horizon(c.filter("seed = 0"), ["target"], 0.05).first().r_star == 2
    assert horizon.horizon(c.filter("seed = 0"), ["target"], 0.2).first().r_star == 1
    bad = c.withColumn("kendall_tau", -F.col("kendall_tau"))
    assert horizon.horizon(bad, ["target"], 0.05).first().r_star is None
    assert horizon.noise_horizon(c, ["target"]).first().r_ceiling == 2
    cells = c.select(F.lit("n").alias("network"), "target", "radius", F.lit("all").alias("richness"), "seed", "kendall_tau")
    with pytest.raises(ValueError):
        horizon.splice(cells, cells.filter("radius < 3"), "t")
    assert horizon.splice(cells, cells.withColumn("kendall_tau", F.lit(0.0)), "t").agg(F.sum("kendall_tau")).first()[0] == 0.0


def test_table_shapes(spark):
    from rippleframe.operators import relational

    wide = spark.createDataFrame([(1, 2, 0.5), (2, None, 1.5)], "node long, a long, b double")
    assert {tuple(r) for r in relational.unpivot(wide, ["node"], ["a", "b"]).collect()} == {(1, "a", 2.0), (1, "b", 0.5), (2, "a", None), (2, "b", 1.5)}
    x, y = spark.createDataFrame([(1, "p"), (1, "p"), (2, None)], "k long, v string"), spark.createDataFrame([("p", 1), (None, 2), ("q", 3)], "v string, k long")
    assert {tuple(r) for r in relational.common_rows(x, y).collect()} == {(1, "p"), (2, None)}
    ref = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none")], "k long, word string")
    got = relational.lookup_join(spark.createDataFrame([(1,), (1,), (3,), (None,)], "k long"), ref, "k").collect()
    assert sorted((r.k or 0, r.word or "") for r in got) == [(0, ""), (1, "one"), (1, "one"), (3, "")]
    with pytest.raises(Exception, match="repeated key"):
        relational.lookup_join(spark.createDataFrame([(2,)], "k long"), ref.unionAll(ref), "k").collect()


def test_ridge_grid_equals_leaving_rows_out(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from rippleframe.plans.ridge import RidgeGrid

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(1e6, 1, 40), rng.normal(0, 50, 40), np.full(40, 3.0), rng.uniform(0, 1e-3, 40)])
    y = 0.5 * x[:, 0] + 0.01 * x[:, 1] + rng.normal(0, 1, 40)
    penalties = np.array([0.01, 1.0, 10.0, 1000.0])
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)], ["features", "label"]).repartition(3)
    model = RidgeGrid(penalties).fit(df)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)  # the scaler is fitted once, on all rows

    def fitted(keep, penalty):
        c, m = z[keep] - z[keep].mean(axis=0), y[keep].mean()
        w = np.linalg.solve(c.T @ c + penalty * np.eye(4), c.T @ (y[keep] - m))
        return lambda row: m + (row - z[keep].mean(axis=0)) @ w

    every = np.arange(40)
    errors = [np.mean([(y[i] - fitted(every != i, p)(z[i])) ** 2 for i in every]) for p in penalties]
    assert np.allclose(model.errors, errors, rtol=1e-6) and model.penalty == penalties[int(np.argmin(errors))]
    got = {round(r.label, 9): r.prediction for r in model.transform(df).collect()}
    whole = fitted(every >= 0, model.penalty)
    assert all(abs(got[round(b, 9)] - whole(a)) < 1e-5 for a, b in zip(z, y.tolist(), strict=True))


def test_add_one_and_rebuilding(tables):
    _, x, y = tables
    rows = models.add_one(x, y, ["degree"], ["edges_leaving_ego"], "ridge", "b_2", [0]).collect()
    by = {r.column: r for r in rows}
    assert set(by) == {None, "edges_leaving_ego"} and by["edges_leaving_ego"].rmse < by[None].rmse
    assert models.held_out_r2(x, "ego_net_size", ["degree"], "ridge") > 0.999  # degree + 1
    assert models.held_out_r2(x, "degree", [], "ridge") is None
    assert models.held_out_r2(x.withColumn("flat", F.lit(1.0)), "flat", ["degree"], "ridge") is None
