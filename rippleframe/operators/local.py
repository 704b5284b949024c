"""What follows from each node's surroundings, source by source in numpy, without a table of all (source, node) pairs.

The packed network (4 bytes an arc, 8 a node) goes to each task once; a task expands blocks of sources layer by layer and
gives only rows about its sources. Larger networks than MOST_ARCS take the joins of shells.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ARCS = 200_000_000
#: Sources of a block, and expanded arcs above which a block of several sources is halved.
BLOCK, WIDE = 512, 8_000_000


class Packed(NamedTuple):
    """Neighbours of node i, ascending: nbr[ptr[i] : ptr[i + 1]]."""

    ptr: np.ndarray
    nbr: np.ndarray

    @property
    def n(self) -> int:
        return len(self.ptr) - 1


class TooWide(Exception):
    pass


def fits(net) -> bool:
    return 2 * net.m <= MOST_ARCS


def collect_packed(net) -> Packed:
    """The network as arrays on the driver, from pieces of 65,536 nodes that tasks sort and pack."""
    n, arcs = net.n, 2 * net.m
    schema = "piece long, counts binary, nbr binary"

    def pack(t: pa.Table) -> pa.Table:
        u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
        piece = int(u[0] >> 16)
        order = np.argsort((u & 65535) * n + v)
        counts = np.bincount(u & 65535, minlength=min(65536, n - (piece << 16))).astype(np.int32)
        return pa.table({"piece": [piece], "counts": [counts.tobytes()], "nbr": [v[order].astype(np.int32).tobytes()]})

    ptr, nbr = np.zeros(n + 1, np.int64), np.empty(arcs, np.int32)
    held: dict[int, bytes] = {}
    for r in net.arcs.select("u", "v").groupBy(F.shiftright("u", 16)).applyInArrow(pack, schema).toLocalIterator():
        first = r.piece << 16
        counts = np.frombuffer(r.counts, np.int32)
        ptr[first + 1 : first + 1 + len(counts)] = counts
        held[r.piece] = r.nbr
    np.cumsum(ptr, out=ptr)
    for piece in sorted(held):
        x = np.frombuffer(held.pop(piece), np.int32)
        nbr[ptr[piece << 16] : ptr[piece << 16] + len(x)] = x
    return Packed(ptr, nbr)


def expand(g: Packed, keys: np.ndarray, many: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(position in keys, key of the neighbour) for every arc out of keys; a key is block row * n + node."""
    node = keys % g.n
    lo = g.ptr[node]
    k = g.ptr[node + 1] - lo
    total = int(k.sum())
    if many and total > WIDE:
        raise TooWide
    at = np.repeat(np.arange(len(keys)), k)
    pos = np.arange(total) + np.repeat(lo - (np.cumsum(k) - k), k)
    return at, (keys - node)[at] + g.nbr[pos]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def place(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the sorted keys, whether it is there) of each x."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    pos = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return pos, keys[pos] == x


def layers(g: Packed, src: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted keys at each distance, and per step the expanded arcs of the layer before."""
    out, steps = [np.arange(len(src)) * g.n + src], []
    for _ in range(radius):
        at, child = expand(g, out[-1], len(src) > 1)
        new = distinct(child)
        for old in out[-2:]:
            new = new[~place(old, new)[1]]
        out.append(new)
        steps.append((at, child))
    return out, steps


def per_source(net, schema: str, kernel: Callable[[Packed, np.ndarray], dict | None], finish: Callable[[Packed], dict | None] | None = None, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """Rows that kernel(network, sources) gives for blocks of sources, and finish() at a task's end."""
    spark, shared = net.nodes.sparkSession, net.packed
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Packed(*shared.value)
        seen = False
        for b in it:
            ids = b.column(0).to_numpy()
            todo = [ids[lo : lo + block] for lo in range(0, len(ids), block)][::-1]
            while todo:
                src = todo.pop()
                seen = True
                try:
                    out = kernel(g, src)
                except TooWide:
                    half = len(src) // 2
                    todo += [src[half:], src[:half]]
                    continue
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names)
        if finish is not None and seen:
            out = finish(g)
            for lo in range(0, len(out[names[0]]), 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(out[c][lo : lo + 1_000_000]) for c in names], names)

    cores = spark.sparkContext.defaultParallelism
    return spark.range(0, net.n, 1, parts or 4 * cores).mapInArrow(run, schema)


def vectors(net, df: DataFrame, cols: list[str], key: str = "node") -> np.ndarray:
    """(column, node) values of df on the driver, NaN where df has no row."""
    out = np.full((len(cols), net.n), np.nan)
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).toArrow()
    at = rows.column(key).to_numpy()
    for i, c in enumerate(cols):
        out[i, at] = rows.column(c).to_numpy()
    return out


def row_sums(g: Packed, keys: np.ndarray, rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(keys // g.n, weight, rows)


def shell_sums(net, radius: int) -> DataFrame:
    """(src, k, n1.., ks1.., kx1.., s0..): per distance the nodes, the sum and the maximum of their degrees, the sum of their ids."""
    ds = range(1, radius + 1)
    schema = ", ".join(["src long", "k long", *[f"{c}{d} long" for c in ("n", "ks", "kx") for d in ds], *[f"s{d} long" for d in range(radius + 1)]])

    def kernel(g: Packed, src: np.ndarray) -> dict:
        held, _ = layers(g, src, radius)
        out = {"src": src, "k": g.ptr[src + 1] - g.ptr[src], "s0": src}
        for d in ds:
            row, node = np.divmod(held[d], g.n)
            k = g.ptr[node + 1] - g.ptr[node]
            count = np.bincount(row, minlength=len(src))
            start = (np.cumsum(count) - count)[count > 0]
            top, ids, sums = (np.zeros(len(src), np.int64) for _ in range(3))
            if len(row):
                top[count > 0] = np.maximum.reduceat(k, start)
                ids[count > 0] = np.add.reduceat(node, start)
                sums[count > 0] = np.add.reduceat(k, start)
            out |= {f"n{d}": count, f"ks{d}": sums, f"kx{d}": top, f"s{d}": ids}
        return out

    return per_source(net, schema, kernel)


def inside_arcs(g: Packed, held: list[np.ndarray], src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of u, key of v) for arcs with both ends in the layers."""
    ball = np.sort(np.concatenate(held))
    at, child = expand(g, ball, len(src) > 1)
    ok = place(ball, child)[1]
    return ball[at[ok]], child[ok]


def ball_arcs(net, r: int) -> DataFrame:
    """(src, u, v): arcs with both ends within r of src; rows of a source come from one task."""

    def kernel(g: Packed, src: np.ndarray) -> dict:
        u, v = inside_arcs(g, layers(g, src, r)[0], src)
        return {"src": src[u // g.n], "u": u % g.n, "v": v % g.n}

    return per_source(net, "src long, u long, v long", kernel)


def observed_arcs(net, r: int) -> DataFrame:
    """(src, u, v): the arcs of ball_arcs() and two for each stub of a boundary node, numbered from -1 down by (u, i)."""

    def kernel(g: Packed, src: np.ndarray) -> dict:
        ball = np.sort(np.concatenate(layers(g, src, r)[0]))
        at, child = expand(g, ball, len(src) > 1)
        ok = place(ball, child)[1]
        end = ball[at[~ok]]  # ascending by source and node
        row = end // g.n
        count = np.bincount(row, minlength=len(src))
        stub = (np.cumsum(count) - count)[row] - np.arange(len(row)) - 1
        u, v = ball[at[ok]], child[ok]
        return {"src": src[np.concatenate([u // g.n, row, row])], "u": np.concatenate([u % g.n, end % g.n, stub]), "v": np.concatenate([v % g.n, stub, end % g.n])}

    return per_source(net, "src long, u long, v long", kernel)


def ball2_sums(net) -> DataFrame:
    """(src, n, vol, e): nodes, degrees and links of the 2-ball."""

    def kernel(g: Packed, src: np.ndarray) -> dict:
        held, steps = layers(g, src, 2)
        rows = len(src)
        ball = np.concatenate(held)
        k = (g.ptr[1:] - g.ptr[:-1])[ball % g.n]
        at, child = expand(g, held[2], rows > 1)
        near = place(held[2], child)[1]
        # layers 0 and 1 have all their arcs inside; those into layer 2 lead back, too
        first = steps[1][1]
        down = place(held[2], first)[1]
        inner = row_sums(g, held[0], rows, (g.ptr[src + 1] - g.ptr[src]).astype(float)) + row_sums(g, first, rows) + row_sums(g, first[down], rows) + row_sums(g, child[near], rows)
        return {"src": src, "n": row_sums(g, ball, rows), "vol": row_sums(g, ball, rows, k.astype(float)).astype(np.int64), "e": (inner / 2).astype(np.int64)}

    return per_source(net, "src long, n long, vol long, e long", kernel)


def reach_sums(net, p: float, radius: int) -> DataFrame:
    """(src, s1..): expected reach at each distance when paths count as independent."""

    def kernel(g: Packed, src: np.ndarray) -> dict:
        held, steps = layers(g, src, radius)
        q, out = np.ones(len(src)), {"src": src}
        for d in range(1, radius + 1):
            at, child = steps[d - 1]
            pos, ok = place(held[d], child)
            q = 1 - np.exp(np.bincount(pos[ok], np.log1p(-p * q)[at[ok]], len(held[d])))
            out[f"s{d}"] = row_sums(g, held[d], len(src), q)
        return out

    return per_source(net, ", ".join(["src long", *[f"s{d} double" for d in range(1, radius + 1)]]), kernel)


def branch_sums(net) -> DataFrame:
    """(node, branch_max_share, branch_entropy, branch_empty) of features.branch_anisotropy()."""

    def kernel(g: Packed, src: np.ndarray) -> dict:
        held, steps = layers(g, src, 2)
        at, child = steps[1]
        pos, ok = place(held[2], child)
        at, pos = at[ok], pos[ok]
        mass = np.bincount(at, 1.0 / np.bincount(pos, minlength=len(held[2]))[pos], len(held[1]))
        row = held[1] // g.n
        p = np.where(mass > 0, mass / np.maximum(np.bincount(row, mass, len(src))[row], 1e-300), 0.0)
        top = np.zeros(len(src))
        np.maximum.at(top, row, p)
        entropy = np.bincount(row, np.where(p > 0, -p * np.log(np.where(p > 0, p, 1.0)), 0.0), len(src))
        return {"node": src, "branch_max_share": top, "branch_entropy": entropy, "branch_empty": row_sums(g, held[2], len(src)) == 0}

    return per_source(net, "node long, branch_max_share double, branch_entropy double, branch_empty boolean", kernel)


def shell_means(net, values: np.ndarray, lags: list[int]) -> DataFrame:
    """(rep, src, d, w): mean of each row of values over the nodes at distance d; without a row where no node has a value."""
    held_values = net.nodes.sparkSession.sparkContext.broadcast(values)

    def kernel(g: Packed, src: np.ndarray) -> dict:
        held, _ = layers(g, src, max(lags))
        parts: list[tuple] = []
        for d in lags:
            for rep, z in enumerate(held_values.value):
                x = z[held[d] % g.n]
                ok = ~np.isnan(x)
                count = row_sums(g, held[d][ok], len(src))
                have = count > 0
                w = row_sums(g, held[d][ok], len(src), x[ok])[have] / count[have]
                parts.append((np.full(len(w), rep, np.int32), src[have], np.full(len(w), d, np.int32), w))
        return dict(zip(("rep", "src", "d", "w"), map(np.concatenate, zip(*parts, strict=True)), strict=True))

    return per_source(net, "rep int, src long, d int, w double", kernel)


def path_shares(net, k: int) -> DataFrame:
    """(node, t): dependencies of all sources on a node over pairs at distance k or less; a task's sums leave it once."""
    total: list[np.ndarray] = []

    def kernel(g: Packed, src: np.ndarray) -> None:
        held, steps = layers(g, src, k)
        if not total:
            total.append(np.zeros(g.n))
        sigma, links = [np.ones(len(src))], []
        for d in range(1, k + 1):
            at, child = steps[d - 1]
            pos, ok = place(held[d], child)
            links.append((at[ok], pos[ok]))
            sigma.append(np.bincount(pos[ok], sigma[-1][at[ok]], len(held[d])))
        delta = np.zeros(len(held[k]))
        for d in range(k - 1, 0, -1):
            at, pos = links[d]
            delta = sigma[d] * np.bincount(at, ((1 + delta) / sigma[d + 1])[pos], len(held[d]))
            np.add.at(total[0], held[d] % g.n, delta)

    def finish(g: Packed) -> dict:
        t = total.pop() if total else np.zeros(g.n)
        at = np.flatnonzero(t)
        return {"node": at, "t": t[at]}

    return per_source(net, "node long, t double", kernel, finish, 2 * net.nodes.sparkSession.sparkContext.defaultParallelism)


def threshold_counts(net, num: int, den: int, r: int | None = None) -> DataFrame:
    """(node, size, contained): the threshold cascade from each closed neighbourhood, inside the r-ball if given."""

    def kernel(g: Packed, src: np.ndarray) -> dict:
        held, _ = layers(g, src, max(1, r or 1))
        ball = None if r is None else np.sort(np.concatenate(held[: r + 1]))
        active = front = np.sort(np.concatenate(held[:2]))
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(front):
            child = expand(g, front, len(src) > 1)[1]
            if ball is not None:
                child = child[place(ball, child)[1]]
            every = np.concatenate([keys, child])
            weight = np.concatenate([counts, np.ones(len(child), np.int64)])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            keys, counts = every[start], np.add.reduceat(weight, start) if len(start) else weight
            fresh = ~place(active, keys)[1]
            keys, counts = keys[fresh], counts[fresh]
            node = keys % g.n
            hit = den * counts >= num * (g.ptr[node + 1] - g.ptr[node])
            front, keys, counts = keys[hit], keys[~hit], counts[~hit]
            if len(src) > 1 and len(active) + len(keys) > WIDE:
                raise TooWide
            active = np.sort(np.concatenate([active, front]))
        if ball is not None:
            active = active[place(ball, active)[1]]
        edge = held[r] if r is not None else np.zeros(0, np.int64)
        return {"node": src, "size": row_sums(g, active, len(src)), "contained": row_sums(g, active[place(edge, active)[1]], len(src)) == 0}

    return per_source(net, "node long, size long, contained boolean", kernel)


def ego_shares(net) -> DataFrame:
    """(node, ego_betweenness): open pairs of neighbours, each at 1 over one more than its common neighbours among them."""

    def kernel(g: Packed, src: np.ndarray) -> dict:
        held, steps = layers(g, src, 1)
        ring, rows, n = held[1], len(src), g.n
        at, child = expand(g, ring, rows > 1)
        to, ok = place(ring, child)
        frm, to = at[ok], to[ok]  # links among neighbours, both ways, as positions in ring
        k = (g.ptr[src + 1] - g.ptr[src]).astype(float)
        score = k * (k - 1) / 2 - row_sums(g, ring[frm], rows) / 2
        # two links from one middle: a pair of neighbours with a common one; frm is ascending
        count = np.bincount(frm, minlength=len(ring))
        lo = (np.cumsum(count) - count)[frm]
        total = int(count[frm].sum())
        if rows > 1 and total > WIDE:
            raise TooWide
        one = np.repeat(np.arange(len(frm)), count[frm])
        two = np.arange(total) + np.repeat(lo - (np.cumsum(count[frm]) - count[frm]), count[frm])
        a, b = to[one], to[two]
        pair = (a * len(ring) + b)[a < b]
        pair = pair[~place(frm * len(ring) + to, pair)[1]]  # closed pairs count for nothing
        pair, c = np.unique(pair, return_counts=True)
        score -= row_sums(g, ring[pair // max(len(ring), 1)], rows, 1 - 1.0 / (1 + c))
        return {"node": src, "ego_betweenness": score}

    return per_source(net, "node long, ego_betweenness double", kernel)


def triangles(net) -> np.ndarray:
    """Links among the neighbours of each node."""

    def kernel(g: Packed, src: np.ndarray) -> dict:
        row, ring = expand(g, np.arange(len(src)) * g.n + src, len(src) > 1)
        mid, far = expand(g, ring, len(src) > 1)
        return {"node": src, "t": np.bincount(row[mid[place(ring, far)[1]]], minlength=len(src)) // 2}

    return vectors(net, per_source(net, "node long, t long", kernel), ["t"])[0].astype(np.int64)


def runs(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive items whose sizes add up to at most most, or of one item."""
    end, lo = np.cumsum(size), 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, most + (end[lo - 1] if lo else 0), "right")))
        yield slice(lo, hi)
        lo = hi


def four_sets(g: Packed, src: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(row, neighbour, counts) of each arc u -> v out of src: induced connected sets of four nodes, by the arc's part in them.

    The rest of a set lies in both = N(u) & N(v), only_u, only_v or beyond; links between these parts follow from the
    common neighbours of pairs, so no set is listed. An _out count has u in the first place named, an _in count has v.
    """
    n, first = g.n, np.arange(len(src)) * g.n + src
    row, ring = expand(g, first, len(src) > 1)
    mid, far = expand(g, ring, len(src) > 1)
    v, arcs = ring % n, len(ring)
    degree = lambda x: g.ptr[x + 1] - g.ptr[x]
    sums = lambda at, x, size=arcs: np.bincount(at, x, size).astype(np.int64)  # noqa: E731  # exact below 2 ** 53
    du, dv = degree(src)[row], degree(v)
    _, which, common = np.unique(far, return_inverse=True, return_counts=True)
    cycles = sums(mid, np.where(far == first[row[mid]], 0, common[which] - 1))
    to, ok = place(ring, far)
    frm, to = mid[ok], to[ok]  # links among neighbours, both ways, as positions in ring
    t = np.bincount(frm, minlength=arcs)
    near, wedge = sums(frm, dv[to]), mid * n + far % n
    twice_both, both_v = np.zeros(arcs, np.int64), np.zeros(arcs, np.int64)
    for part in runs(dv[to], WIDE // 4):  # x in both and z next to x and v
        at, z = expand(g, ring[to[part]], False)
        arc = frm[part][at]
        hit = place(wedge, arc * n + z % n)[1] & (z != first[row[arc]])
        arc, z = arc[hit], z[hit]
        inside = place(ring, z)[1]
        twice_both += np.bincount(arc[inside], minlength=arcs)
        both_v += np.bincount(arc[~inside], minlength=arcs)
    both = twice_both // 2
    both_u = sums(frm, t[to]) - t - twice_both
    a, b = du - 1 - t, dv - 1 - t
    in_u, in_v = tri[src][row] - t - both - both_u, tri[v] - t - both - both_v
    across = cycles - twice_both - both_u - both_v
    return row, v, {
        "clique": both,
        "spine": t * (t - 1) // 2 - both,
        "rim_out": both_u,
        "rim_in": both_v,
        "fork_out": t * a - both_u,
        "fork_in": t * b - both_v,
        "tail_out": in_u,
        "tail_in": in_v,
        "base": near - 2 * t - twice_both - both_u - both_v,
        "cycle": across,
        "star_out": a * (a - 1) // 2 - in_u,
        "star_in": b * (b - 1) // 2 - in_v,
        "middle": a * b - across,
        "end_out": sums(row, dv, len(src))[row] - dv - near - a - 2 * in_u - both_u - across,
        "end_in": sums(mid, degree(far % n)) - du - near - b - 2 * in_v - both_v - across,
    }


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes, by hooking roots to smaller roots and halving paths."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def live_components(net, live: DataFrame, n_draws: int) -> DataFrame:
    """(draw, node, comp, size) of live edges (draw, u, v): a draw's edges meet in one task, 16 bytes each."""
    n, every = net.n, net.nodes.sparkSession.range(n_draws)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keep = t.column("u").is_valid()
        label = components(t.column("u").filter(keep).to_numpy(), t.column("v").filter(keep).to_numpy(), n)
        size = np.bincount(label, minlength=n).astype(np.int32)
        return pa.table({"draw": pa.array(np.full(n, key[0].as_py(), np.int32)), "node": np.arange(n), "comp": label, "size": size[label]})

    # a row without an edge, so that draws without live edges come out, too
    bare = every.select(F.col("id").cast("int").alias("draw"), F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v"))
    both = live.select("draw", "u", "v").unionByName(bare).repartition(n_draws * 2, "draw")
    return both.groupBy("draw").applyInArrow(run, "draw int, node long, comp long, size int")


def reached_counts(net, live: DataFrame, n_draws: int) -> DataFrame:
    """(src, draw, size): nodes that each node reaches over live arcs (draw, u, v), one source at a time over packed draws."""
    spark, n = net.nodes.sparkSession, net.n
    t = live.select("draw", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v")).toArrow()
    d, u, v = (t.column(c).to_numpy() for c in ("draw", "u", "v"))
    order = np.lexsort((u, d))
    row = d[order].astype(np.int64) * n + u[order]
    shared = spark.sparkContext.broadcast((np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_draws * n))]), v[order]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ptr, nbr = (memoryview(x) for x in shared.value)
        for b in it:
            ids = b.column(0).to_numpy()
            out = np.empty(len(ids), np.int32)
            for i, x in enumerate(ids.tolist()):
                base, s = divmod(x, n)
                base *= n
                seen, todo = {s}, [s]
                while todo:
                    y = base + todo.pop()
                    for z in nbr[ptr[y] : ptr[y + 1]]:
                        if z not in seen:
                            seen.add(z)
                            todo.append(z)
                out[i] = len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(ids % n), pa.array((ids // n).astype(np.int32)), pa.array(out)], ["src", "draw", "size"])

    parts = 8 * spark.sparkContext.defaultParallelism
    return spark.range(0, n_draws * n, 1, parts).mapInArrow(run, "src long, draw int, size int")


def outbreak_counts(net, beta: float, mu: float, n_draws: int, seed: int, max_steps: int) -> DataFrame:
    """(src, draw, size) of discrete SIR from every node, with the uniforms of functions.rng drawn as they are needed."""
    from hashlib import md5

    spark, n, shared = net.nodes.sparkSession, net.n, net.packed
    # uniform < x in whole numbers of 2 ** -52, exact for doubles
    span = 1 << 52

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ptr, nbr = (memoryview(x) for x in shared.value)
        infect, recover = beta * span, mu * span
        for b in it:
            ids = b.column(0).to_numpy()
            out = np.empty(len(ids), np.int32)
            for i, x in enumerate(ids.tolist()):
                draw, s = divmod(x, n)
                ever, ill = {s}, [s]
                for t in range(max_steps):
                    new, stay = set(), []
                    for y in ill:
                        head = f"{s}|{draw}|{t}|{y}|"
                        for z in nbr[ptr[y] : ptr[y + 1]]:
                            if z not in ever and z not in new and int(md5(f"{head}{z}|{seed}".encode()).hexdigest()[:13], 16) < infect:
                                new.add(z)
                        if int(md5(f"{head}r|{seed}".encode()).hexdigest()[:13], 16) >= recover:
                            stay.append(y)
                    ever |= new
                    ill = stay + list(new)
                    if not ill:
                        break
                else:
                    raise RuntimeError("outbreaks did not end")
                out[i] = len(ever)
            yield pa.RecordBatch.from_arrays([pa.array(ids % n), pa.array((ids // n).astype(np.int32)), pa.array(out)], ["src", "draw", "size"])

    return spark.range(0, n_draws * n, 1, 8 * spark.sparkContext.defaultParallelism).mapInArrow(run, "src long, draw int, size int")
