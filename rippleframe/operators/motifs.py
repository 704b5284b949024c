"""Induced graphlets of three, four and five nodes: orbit counts per node and per edge.

Orbits of four nodes are counted source by source over the packed network from the common neighbours of linked nodes
(local.four_sets); no node set is listed. For other sizes, and networks that do not fit, connected induced node sets are
enumerated once each by growing paths of links and removing repeats as sorted arrays. A set's adjacency bits index a small
table made on the driver from all graphs of that size, which names the class and the orbit of each position. Column names
carry the class and orbit in canonical order (no external numbering is used).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import local
from .graph import Network


@lru_cache(maxsize=4)
def tables(size: int) -> tuple[dict[int, tuple[int, tuple[int, ...]]], dict[tuple[int, int], int], int]:
    """For each adjacency code of a connected graph of the size: class and orbit of each position; hops an orbit needs; number of classes.

    A code's bit i is the i-th pair of positions in lexicographic order. Classes are numbered by (links, canonical code),
    orbits within a class by the least position of its canonical form.
    """
    pairs = list(combinations(range(size), 2))
    index = {p: i for i, p in enumerate(pairs)}
    perms = list(permutations(range(size)))
    moved = [[index[tuple(sorted((p[a], p[b])))] for a, b in pairs] for p in perms]

    def links(code):
        return [pairs[i] for i in range(len(pairs)) if code >> i & 1]

    def distances(code, start):
        dist, front = {start: 0}, [start]
        while front:
            x = front.pop(0)
            for a, b in links(code):
                y = b if a == x else a if b == x else None
                if y is not None and y not in dist:
                    dist[y] = dist[x] + 1
                    front.append(y)
        return dist

    canonical: dict[int, tuple[int, tuple[int, ...]]] = {}
    for code in range(1 << len(pairs)):
        if code.bit_count() < size - 1 or len(distances(code, 0)) < size:
            continue
        bits = [i for i in range(len(pairs)) if code >> i & 1]
        best, how = min((sum(1 << m[i] for i in bits), k) for k, m in enumerate(moved))
        canonical[code] = (best, perms[how])
    forms = sorted({b for b, _ in canonical.values()}, key=lambda c: (c.bit_count(), c))
    orbit_of, hops = {}, {}
    for form in forms:
        bits = [i for i in range(len(pairs)) if form >> i & 1]
        autos = [perms[k] for k, m in enumerate(moved) if sum(1 << m[i] for i in bits) == form]
        rep = [min(a[x] for a in autos) for x in range(size)]
        order = {r: i for i, r in enumerate(sorted(set(rep)))}
        orbit_of[form] = [order[r] for r in rep]
        for x in range(size):
            hops[(forms.index(form), order[rep[x]])] = max(distances(form, x).values())
    rows = {code: (forms.index(b), tuple(orbit_of[b][p[x]] for x in range(size))) for code, (b, p) in canonical.items()}
    return rows, hops, len(forms)


def connected_sets(net: Network, size: int) -> DataFrame:
    """(s): sorted arrays of the connected node sets of a size, each once."""
    sets = net.edges.select(F.array("u", "v").alias("s"))
    for _ in range(size - 2):
        grown = sets.select("s", F.explode("s").alias("u")).join(net.arcs, "u").filter(~F.array_contains("s", F.col("v")))
        sets = stored(grown.select(F.array_sort(F.concat("s", F.array("v"))).alias("s")).distinct(), "sets")
    return sets


def coded_sets(net: Network, size: int) -> DataFrame:
    """(s, code): connected sets with their adjacency bits."""
    pairs = list(combinations(range(size), 2))
    bit = F.explode(F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.col("s")[a].alias("u"), F.col("s")[b].alias("v")) for i, (a, b) in enumerate(pairs)]))
    pos = connected_sets(net, size).select("s", bit.alias("p")).select("s", "p.*")
    return pos.join(net.edges, ["u", "v"], "left_semi").groupBy("s").agg(F.sum("bit").cast("int").alias("code"))


def _orbit_rows(net: Network, size: int) -> DataFrame:
    rows, _, _ = tables(size)
    table = net.nodes.sparkSession.createDataFrame([(code, c, list(orbits)) for code, (c, orbits) in rows.items()], "code int, cls int, orbits array<int>")
    return coded_sets(net, size).join(F.broadcast(table), "code")  # at most 1,024 rows


def _places(*links: tuple[int, int]) -> tuple[int, tuple[int, ...]]:
    """Class and orbit of each position of a graph of four nodes."""
    pairs = list(combinations(range(4), 2))
    return tables(4)[0][sum(1 << pairs.index(x) for x in links)]


PATH, STAR, CYCLE = ((0, 1), (1, 2), (2, 3)), ((0, 1), (0, 2), (0, 3)), ((0, 1), (0, 3), (1, 2), (2, 3))
PAW, DIAMOND, CLIQUE = ((0, 1), (0, 2), (1, 2), (0, 3)), ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3)), tuple(combinations(range(4), 2))
#: Graph, position, count of local.four_sets() and how often the sum over a node's arcs has each set.
NODE_ORBITS_4 = (
    (PATH, 0, "end_in", 1), (PATH, 1, "middle", 1), (STAR, 0, "star_out", 3), (STAR, 1, "star_in", 1), (CYCLE, 0, "cycle", 2), (PAW, 0, "tail_out", 1),
    (PAW, 1, "base", 1), (PAW, 3, "tail_in", 1), (DIAMOND, 0, "spine", 1), (DIAMOND, 2, "rim_in", 2), (CLIQUE, 0, "clique", 3),
)
#: Graph, positions of a link and the counts that add up to its own.
EDGE_ORBITS_4 = (
    (PATH, 0, 1, ("end_out", "end_in")), (PATH, 1, 2, ("middle",)), (STAR, 0, 1, ("star_out", "star_in")), (CYCLE, 0, 1, ("cycle",)), (PAW, 0, 3, ("tail_out", "tail_in")),
    (PAW, 0, 1, ("fork_out", "fork_in")), (PAW, 1, 2, ("base",)), (DIAMOND, 0, 1, ("spine",)), (DIAMOND, 0, 2, ("rim_out", "rim_in")), (CLIQUE, 0, 1, ("clique",)),
)


def _four(net: Network, schema: str, parts) -> DataFrame:
    """Rows of the schema from the column tuples that parts(sources, row, neighbour, counts) gives for blocks of sources."""
    tri = net.nodes.sparkSession.sparkContext.broadcast(local.triangles(net))  # 8 bytes a node
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = [{"int": np.int32, "long": np.int64, "double": np.float64}[c.strip().split(" ")[1]] for c in schema.split(",")]

    def kernel(g: local.Packed, src: np.ndarray) -> dict:
        columns = zip(*parts(src, *local.four_sets(g, src, tri.value)), strict=True)
        return {c: np.concatenate(x).astype(k) for c, k, x in zip(names, kinds, columns, strict=True)}

    return local.per_source(net, schema, kernel)


def _link_orbits(counts: dict[str, np.ndarray]):
    """(class, smaller orbit, larger orbit, count of each arc's link)."""
    for links, x, y, names in EDGE_ORBITS_4:
        cls, orbit = _places(*links)
        yield cls, min(orbit[x], orbit[y]), max(orbit[x], orbit[y]), sum(counts[c] for c in names)


def _node_orbits_4(net: Network) -> DataFrame:
    def parts(src, row, v, counts):
        for links, x, name, times in NODE_ORBITS_4:
            cls, orbit = _places(*links)
            n = np.zeros(len(src), np.int64)
            np.add.at(n, row, counts[name])
            at = np.flatnonzero(n)
            yield src[at], np.full(len(at), cls), np.full(len(at), orbit[x]), n[at] // times

    return _four(net, "node long, cls int, orbit int, n long", parts)


def _edge_orbits_4(net: Network) -> DataFrame:
    def parts(src, row, v, counts):
        for cls, a, b, n in _link_orbits(counts):
            at = np.flatnonzero((n > 0) & (src[row] < v))
            yield src[row[at]], v[at], np.full(len(at), cls), np.full(len(at), a), np.full(len(at), b), n[at]

    return _four(net, "u long, v long, cls int, a int, b int, n long", parts)


def _edge_orbit_features_4(net: Network) -> DataFrame:
    def parts(src, row, v, counts):
        k = np.bincount(row, minlength=len(src))
        for cls, a, b, n in _link_orbits(counts):
            top = np.zeros(len(src), np.int64)
            np.maximum.at(top, row, n)
            at = np.flatnonzero(top)
            x = n.astype(float)
            mean, square = (np.bincount(row, w, len(src))[at] / k[at] for w in (x, x * x))
            yield src[at], np.full(len(at), cls), np.full(len(at), a), np.full(len(at), b), mean, top[at], np.sqrt(np.maximum(square - mean * mean, 0.0))

    return _four(net, "node long, cls int, a int, b int, mean double, max double, std double", parts)


def node_orbits(net: Network, size: int) -> DataFrame:
    """(node, cls, orbit, n): in how many induced graphlets of a class the node is at a place of an orbit."""
    if size == 4 and local.fits(net):
        return _node_orbits_4(net)
    at = F.explode(F.arrays_zip(F.col("s").alias("node"), F.col("orbits").alias("orbit")))
    return _orbit_rows(net, size).select("cls", at.alias("x")).groupBy(F.col("x.node").alias("node"), "cls", F.col("x.orbit").alias("orbit")).agg(F.count("*").alias("n"))


def edge_orbits(net: Network, size: int) -> DataFrame:
    """(u, v, cls, a, b, n): the same for links; an edge orbit is named by the orbits of its two ends, smaller first."""
    if size == 4 and local.fits(net):
        return _edge_orbits_4(net)
    pairs = list(combinations(range(size), 2))
    r = _orbit_rows(net, size)
    each = F.explode(F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.col("s")[a].alias("u"), F.col("s")[b].alias("v"), F.least(F.col("orbits")[a], F.col("orbits")[b]).alias("a"), F.greatest(F.col("orbits")[a], F.col("orbits")[b]).alias("b")) for i, (a, b) in enumerate(pairs)]))
    held = r.select("cls", "code", each.alias("x")).filter(F.col("code").bitwiseAND(F.col("x.bit")) != 0)
    return held.groupBy("x.u", "x.v", "cls", "x.a", "x.b").agg(F.count("*").alias("n"))


def orbit_features(net: Network, size: int) -> DataFrame:
    """Wide node table; orbits that no node has are left out, as are the two that repeat degree and triangles."""
    long = node_orbits(net, size).withColumn("name", F.concat(F.lit("orbit_c"), F.lit(size).cast("string"), F.lit("_"), "cls", F.lit("_o"), "orbit"))
    names = [r.name for r in long.select("name").distinct().orderBy("name").collect()]  # at most the orbits of the size
    if size == 3:
        _, _, classes = tables(3)
        names = [n for n in names if n != f"orbit_c3_{classes - 1}_o0"]
    wide = long.groupBy("node").pivot("name", names).agg(F.first("n"))
    return net.nodes.select("node").join(wide, "node", "left").na.fill(0)


def edge_orbit_features(net: Network, size: int) -> DataFrame:
    """(node, cls, a, b, mean, max, std): summary over the incident links, absent orbits counting as 0."""
    if size == 4 and local.fits(net):
        return _edge_orbit_features_4(net)
    e = edge_orbits(net, size).select(F.explode(F.array("u", "v")).alias("node"), "cls", "a", "b", "n")
    s = e.groupBy("node", "cls", "a", "b").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"), F.max("n").alias("max")).join(net.degree, "node")
    mean = F.col("t") / F.col("k")
    return s.select("node", "cls", "a", "b", mean.alias("mean"), F.col("max").cast("double").alias("max"), F.sqrt(F.greatest(F.col("q") / F.col("k") - mean * mean, F.lit(0.0))).alias("std"))


def matching_columns(a: DataFrame, b: DataFrame, key: str = "node") -> dict[str, str]:
    """Pairs of columns with equal values over all rows, by an order-free hash of (key, value)."""

    def marks(df):
        cols = [c for c in df.columns if c != key]
        row = df.agg(*[F.sum(F.xxhash64(key, F.col(c).cast("double")).cast("decimal(38,0)")).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}

    left, right = marks(a), marks(b)
    out, used = {}, set()
    for c, m in left.items():
        for d, n in right.items():
            if m == n and d not in used:
                out[c] = d
                used.add(d)
                break
    return out
