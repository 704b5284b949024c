"""Queries against their SQL on the smallest tables, where those are at hand."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Quick ones that cover each module; the driver compares all.
NAMES = ["flagship_influencers", "p1_p4_cleaning_counts", "p6_components", "p5_p8_network_nodes", "f2_f7_ego", "f16_f22_shell_features", "f25_percolation_reach", "d3_d9_percolation", "t3_b3", "k1_k5_evaluate", "a1_horizon", "a9_noise_horizon", "a33_pair_labels", "m9_subsample"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df):
    cell = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
