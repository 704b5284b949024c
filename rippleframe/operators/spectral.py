"""Epidemic thresholds from non-backtracking and adjacency spectra, by power iteration on implicit arcs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .components import connected_components
from .graph import Network
from .targets import adjacency


def nonbacktracking_pairs(arcs: DataFrame) -> DataFrame:
    """(u, v, w): the ones of the non-backtracking matrix, arc u-v followed by arc v-w with w other than u."""
    return arcs.join(arcs.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").filter("w <> u").select("u", "v", "w")


def cyclomatic_excess(net: Network) -> DataFrame:
    """(comp, nodes, edges, excess) with excess = edges - nodes + 1."""
    comp = connected_components(net.edges)
    size = comp.groupBy("comp").agg(F.count("*").alias("nodes"))
    links = net.edges.join(comp.withColumnRenamed("node", "u"), "u").groupBy("comp").agg(F.count("*").alias("edges"))
    return size.join(links, "comp").select("comp", "nodes", "edges", (F.col("edges") - F.col("nodes") + 1).alias("excess"))


def _growth(step, x: np.ndarray, rounds: int, tol: float) -> float:
    """Spectral radius from two-step growth, which also settles when eigenvalues come in pairs of opposite sign."""
    last = 0.0
    for _ in range(rounds):
        y = step(step(x))
        norm = float(np.linalg.norm(y))
        if norm == 0:
            return 0.0
        value = math.sqrt(norm / float(np.linalg.norm(x)))
        if abs(value - last) <= tol * max(1.0, value):
            return value
        last, x = value, y / norm
    raise RuntimeError("the spectral radius did not settle")


def _csr(net: Network):
    ptr, nbr = adjacency(net)
    src = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    key = src * (len(ptr) - 1) + nbr
    return ptr, nbr, src, np.searchsorted(key, nbr * (len(ptr) - 1) + src)


def _neighbour_sums(ptr: np.ndarray, nbr: np.ndarray, x: np.ndarray, chunk: int = 200_000) -> np.ndarray:
    """Sum of x over each node's neighbours, some nodes at a time, so that no array has a number per arc."""
    out = np.zeros(len(ptr) - 1)
    for lo in range(0, len(out), chunk):
        p = ptr[lo : lo + chunk + 1]
        some = p[1:] > p[:-1]
        if some.any():
            out[lo : lo + chunk][some] = np.add.reduceat(x[nbr[p[0] : p[-1]]], p[:-1][some] - p[0])
    return out


def _companion(ptr: np.ndarray, nbr: np.ndarray):
    """The non-backtracking matrix on two numbers a node (Ihara and Bass): the same eigenvalues but for m - n times 1 and -1."""
    n, less = len(ptr) - 1, np.diff(ptr) - 1.0
    return lambda x: np.concatenate([_neighbour_sums(ptr, nbr, x[:n]) - less * x[n:], x[:n]])


def nonbacktracking_radius(net: Network, rounds: int = 3000, tol: float = 1e-10) -> float:
    """On the driver over a network of checked size: the way out of an arc is all arcs behind it less the way back.

    With more links than nodes the radius is above 1, and two numbers a node serve instead of one an arc.
    """
    if net.m > net.n:
        ptr, nbr = adjacency(net)
        # all ones would stay as they are: the eigenvector of 1
        return _growth(_companion(ptr, nbr), np.concatenate([np.diff(ptr).astype(float), np.ones(net.n)]), rounds, tol)
    ptr, nbr, src, back = _csr(net)

    def step(x):
        return np.bincount(src, x, len(ptr) - 1)[nbr] - x[back]

    return _growth(step, np.ones(len(nbr)), rounds, tol)


def adjacency_radius(net: Network, rounds: int = 3000, tol: float = 1e-10) -> float:
    ptr, nbr = adjacency(net)
    return _growth(lambda x: _neighbour_sums(ptr, nbr, x), np.ones(len(ptr) - 1), rounds, tol)


def power_steps(net: Network, steps: int) -> DataFrame:
    """(step, total): the sum of the non-backtracking iteration from ones after each step, as DataFrame joins."""
    arc = net.arcs.withColumn("x", F.lit(1.0))
    rows = []
    for s in range(1, steps + 1):
        out = arc.groupBy("u").agg(F.sum("x").alias("t")).withColumnRenamed("u", "v")
        back = arc.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("x").alias("r"))
        arc = stored(net.arcs.join(out, "v").join(back, ["u", "v"]).select("u", "v", (F.col("t") - F.col("r")).alias("x")), "power")
        rows.append(arc.agg(F.sum("x").alias("total")).select(F.lit(s).alias("step"), "total"))
    df = rows[0]
    for r in rows[1:]:
        df = df.unionByName(r)
    return df


def epidemic_threshold(net: Network, method: str = "nonbacktracking") -> float:
    """1 over the spectral radius; forests have no threshold (infinity), networks of single cycles have exactly 1."""
    if method == "mean_field":
        k = net.degree.agg(F.avg("k").alias("a"), F.avg(F.col("k") * F.col("k")).alias("b")).first()
        return k.a / (k.b - k.a) if k.b != k.a else math.inf
    if method == "adjacency":
        r = adjacency_radius(net)
        return 1 / r if r else math.inf
    if method != "nonbacktracking":
        raise ValueError(method)
    most = cyclomatic_excess(net).agg(F.max("excess").alias("e")).first().e
    if most is None or most <= 0:
        return math.inf
    return 1.0 if most == 1 else 1 / nonbacktracking_radius(net)


def transmission_probability(threshold: float, multiple: float = 1.5) -> float:
    p = multiple * threshold
    if not (math.isfinite(p) and 0 < p <= 1):
        raise ValueError(f"{multiple} times the threshold {threshold} is not a probability")
    return p


def nonbacktracking_gap(net: Network, block: int = 8, rounds: int = 400, seed: int = 1) -> tuple[float, float, float]:
    """(largest modulus, second, 1 - second / largest) by subspace iteration on a network of checked size."""
    more = net.m > net.n
    if more:
        ptr, nbr = adjacency(net)
        column, size = _companion(ptr, nbr), 2 * net.n
    else:
        ptr, nbr, src, back = _csr(net)
        column, size = lambda c: np.bincount(src, c, len(ptr) - 1)[nbr] - c[back], len(nbr)

    def step(x):
        y = np.empty_like(x)
        for i in range(len(x)):
            y[i] = column(x[i])
        return y

    def orthonormal(x):
        try:
            return np.linalg.solve(np.linalg.cholesky(x @ x.T), x)
        except np.linalg.LinAlgError:
            return np.ascontiguousarray(np.linalg.qr(x.T)[0].T)

    # rows are the vectors
    x = orthonormal(np.random.default_rng(seed).standard_normal((min(block, size), size)))
    for _ in range(rounds):
        x = orthonormal(step(x))
    found = np.abs(np.linalg.eigvals(step(x) @ x.T))
    found = np.sort(np.concatenate([found, [1.0]]) if more else found)[::-1]
    first, second = float(found[0]), float(found[1]) if len(found) > 1 else 0.0
    return first, second, 1 - second / first if first else 0.0
