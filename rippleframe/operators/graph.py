"""From raw edge rows to a simple connected network, with the counts of what was dropped."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..sources.tables import stored
from .components import connected_components


def simple_edges(raw: DataFrame) -> DataFrame:
    """Distinct (u < v) without self-loops."""
    return raw.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def arcs_of(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def directed_arcs(raw: DataFrame, symmetrise: bool) -> DataFrame:
    """Distinct arcs without self-loops, with reversed arcs if symmetrise; no component is singled out."""
    raw = raw.filter("u <> v").select("u", "v")
    return (arcs_of(raw) if symmetrise else raw).distinct()


def cleaning_counts(raw: DataFrame) -> DataFrame:
    """One row: raw rows, self-loops, repeats in the same direction, reciprocated pairs, simple edges."""
    loops = raw.agg(F.count("*").alias("raw_rows"), F.count_if(F.col("u") == F.col("v")).alias("self_loops"))
    directed = raw.filter("u <> v").groupBy("u", "v").agg(F.count("*").alias("n"))
    folded = directed.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum(F.col("n") - 1).alias("more"), F.count("*").alias("ways"))
    rest = folded.agg(F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("multi_edges"), F.count_if(F.col("ways") == 2).alias("reciprocals"), F.count("*").alias("simple_edges"))
    return loops.crossJoin(rest)  # one row each


def dense_ids(nodes: DataFrame, col: str = "original_id") -> DataFrame:
    """(original_id, node): positions in ascending order, counted per range so that no task holds all nodes."""
    return numbered(nodes.select(col).distinct(), [col], "node").select(col, "node")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' places from 0 in an order, and _p, the range of the order a row is in; no task holds all rows."""
    parts = max(1, min(4096, df.sparkSession.sparkContext.defaultParallelism * 4))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one small row a range
    before, base = 0, []
    for p in range(max(sizes, default=0) + 1):  # a session may deal more ranges than asked for
        base.append(before)
        before += sizes.get(p, 0)
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn(name, (within + F.element_at(F.array([F.lit(b) for b in base]), F.col("_p") + 1)).cast("long"))


def largest_component(comp: DataFrame) -> DataFrame:
    """Nodes of the largest component; of equal ones that with the smallest node."""
    sizes = comp.groupBy("comp").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("comp"))
    return comp.join(F.broadcast(best), "comp", "left_semi").select("node")  # best is one row


@dataclass
class Network:
    """nodes (node, original_id, degree), edges (u < v) and arcs (both directions) over dense node ids."""

    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def arcs(self) -> DataFrame:
        return arcs_of(self.edges)

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @cached_property
    def m(self) -> int:
        return self.edges.count()

    @cached_property
    def packed(self):
        """Broadcast arrays of the network for the kernels of local.py."""
        from .local import collect_packed

        return self.nodes.sparkSession.sparkContext.broadcast(tuple(collect_packed(self)))

    @property
    def degree(self) -> DataFrame:
        return self.nodes.select("node", F.col("degree").alias("k"))


def build_network(raw: DataFrame, connected: bool = True) -> Network:
    """The load protocol: drop self-loops and repeats, fold directions, keep the largest component, number the nodes densely."""
    simple = stored(simple_edges(raw), "simple")
    ends = arcs_of(simple).select(F.col("u").alias("node")).distinct()
    if connected:
        ends = largest_component(connected_components(simple))
    ids = stored(dense_ids(ends.withColumnRenamed("node", "original_id")), "ids")
    a, b = ids.select(F.col("original_id").alias("u"), F.col("node").alias("nu")), ids.select(F.col("original_id").alias("v"), F.col("node").alias("nv"))
    edges = stored(simple.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v")), "edges")
    degree = arcs_of(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    nodes = stored(ids.join(degree, "node", "left").select("node", "original_id", F.coalesce("degree", F.lit(0)).alias("degree")), "nodes")
    return Network(nodes, edges)


def neighbour_lists(net: Network) -> DataFrame:
    return net.arcs.groupBy(F.col("u").alias("node")).agg(F.sort_array(F.collect_list("v")).alias("neighbours"))


def delete_edges(net: Network, rho: float, seed: int) -> Network:
    """Each edge goes with probability rho by its hash; all nodes stay and no component is singled out."""
    kept = net.edges.filter(uniform("u", "v", seed) >= rho)
    degree = arcs_of(kept).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    nodes = net.nodes.drop("degree").join(degree, "node", "left").select("node", "original_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return Network(nodes, kept)


def align_columns(damaged: DataFrame, columns: list[str], key: str = "node") -> DataFrame:
    """The clean table's columns in its order; what the damaged table lacks is 0.0."""
    held = set(damaged.columns)
    return damaged.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in held else F.lit(0.0).alias(c) for c in columns if c != key])


def describe(counts: dict, net: Network) -> str:
    """A short report of cleaning counts and of the network."""
    lines = [f"{k.replace('_', ' ')}: {v}" for k, v in counts.items()]
    return "\n".join([*lines, f"nodes: {net.n}", f"edges: {net.m}", f"mean degree: {2 * net.m / max(net.n, 1):.3f}"])
