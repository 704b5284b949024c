"""Best-fit packing of token pieces into fixed-size sequences, planned on the histogram of piece lengths.

The plan needs only how many pieces there are of each length (at most ``capacity`` numbers), so it is made on the
driver for any corpus. Best-fit decreasing gives the first incumbent. Bin completion (Korf, 2002) then branches on the
fillings of a sequence around the largest piece left: a filling may waste no more than a better solution could still
waste, and reachable sums of the pieces left (bits of one number) lead the enumeration to such fillings alone, of any
number of pieces; those that another filling dominates are not tried. A filling is applied to as many sequences as the
counts allow, and at every branch best-fit decreasing of what is left may give a new incumbent. The search ends at the
lower bound, when nothing is left to try, or after ``work`` distinct lengths handled in branches (a bound on driver
time of some seconds, not on the input).
Pieces are then dealt to the planned places by their rank within their length, on the executors.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import default_vocabulary, encoder

#: A plan is a list of (number of sequences, ((length, how many in each), ...)).
Plan = list[tuple[int, tuple[tuple[int, int], ...]]]


def lower_bound(counts: dict[int, int], cap: int) -> int:
    """Martello and Toth's L2 over all thresholds."""
    sizes = np.array(sorted(counts), np.int64)
    num = np.array([counts[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * num).sum()) // cap)
    for k in [0, *(s for s in sizes.tolist() if s <= cap // 2)]:
        large, mid, low = sizes > cap - k, (sizes <= cap - k) & (2 * sizes > cap), (2 * sizes <= cap) & (sizes >= k)
        room = int(((cap - sizes) * num)[mid].sum())
        best = max(best, int(num[large].sum() + num[mid].sum()) + max(0, -(-(int((sizes * num)[low].sum()) - room) // cap)))
    return best


def best_fit(counts: dict[int, int], cap: int) -> Plan:
    """Best-fit decreasing with all sequences of equal fillings held as one group."""
    groups: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, filling: tuple) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([n, filling])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            room = rooms[i] if i < len(rooms) else cap
            each = room // size
            if i < len(rooms):
                n, filling = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                n, filling = -(-left // each), ()
            full = min(n, left // each)
            put(room - each * size, full, (*filling, (size, each)))
            left -= full * each
            if full < n:
                if rest := min(left, each - 1) if left < each else 0:
                    put(room - rest * size, 1, (*filling, (size, rest)))
                    left -= rest
                    full += 1
                if filling:
                    put(room, n - full, filling)
    return [(n, f) for g in groups.values() for n, f in g]


def _sums(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each i the sums up to room that pieces of sizes[i:] reach, as bits of a number."""
    mask, out, reach = (1 << (room + 1)) - 1, [1], 1
    for s in reversed(sizes):
        n, step = min(counts[s], room // s), 1
        while n > 0:
            k = min(n, step)
            reach |= (reach << k * s) & mask
            n, step = n - k, 2 * step
        out.append(reach)
    return out[::-1]


def fillings(counts: dict[int, int], room: int, waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fillings of room that leave at most waste of it, least first, then by their largest pieces; each with what it leaves."""
    sizes = sorted((s for s in counts if s <= room), reverse=True)
    reach = _sums(sizes, counts, room)

    def exact(i: int, left: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        while i < len(sizes) and reach[i] >> left & 1:
            s = sizes[i]
            for n in range(min(counts[s], left // s), 0, -1):
                if reach[i + 1] >> (left - n * s) & 1:
                    for rest in exact(i + 1, left - n * s):
                        yield (s,) * n + rest
            i += 1

    for lost in range(min(waste, room) + 1):
        if reach[0] >> (room - lost) & 1:
            for filling in exact(0, room - lost):
                yield filling, lost


def dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of other fit into those of one, each piece of one taking any number of them (Martello and Toth)."""
    free = sorted(one)

    def fit(i: int) -> bool:
        if i == len(other):
            return True
        for j in range(len(free)):
            if free[j] >= other[i] and (not j or free[j] != free[j - 1]):
                free[j] -= other[i]
                if fit(i + 1):
                    return True
                free[j] += other[i]
        return False

    return sum(other) <= sum(one) and fit(0)


def _branches(left: dict[int, int], cap: int, waste: int) -> Iterator[tuple[dict[int, int], int]]:
    """Undominated fillings around the largest piece left, with what they lose."""
    big = max(left)
    after = {s: n - (s == big) for s, n in left.items() if n > (s == big)}
    tried: list[tuple[int, ...]] = []
    for filling, lost in fillings(after, cap - big, waste):
        if len(filling) <= 8 and any(len(t) <= len(filling) and dominates(t, filling) for t in tried[-64:]):
            continue
        tried.append(filling)
        need = {big: 1}
        for s in filling:
            need[s] = need.get(s, 0) + 1
        yield need, lost


def complete_bins(counts: dict[int, int], cap: int, work: int = 500_000) -> Plan:
    """Bin completion over a histogram; counts: pieces of each length, 1 to cap."""
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    best = best_fit(counts, cap)
    least, used = lower_bound(counts, cap), sum(n for n, _ in best)
    if used <= least:
        return best
    # a frame: what is left, the plan so far, its sequences, its waste, branches not tried yet
    stack = [(counts, [], 0, 0, _branches(counts, cap, (used - 1) * cap - total))]
    while stack and used > least and work > 0:
        left, plan, begun, waste, branches = stack[-1]
        step = next(branches, None)
        if step is None or waste + step[1] > (used - 1) * cap - total:
            stack.pop()
            continue
        work -= len(left) + 1
        need, lost = step
        times = min(left[s] // k for s, k in need.items())
        if lost:
            times = min(times, ((used - 1) * cap - total - waste) // lost)
        child = {s: n for s, n in ((s, n - times * need.get(s, 0)) for s, n in left.items()) if n}
        new, first, lost = [*plan, (times, tuple(sorted(need.items(), reverse=True)))], begun + times, waste + lost * times
        rest = best_fit(child, cap)
        if first + sum(n for n, _ in rest) < used:
            best, used = new + rest, first + sum(n for n, _ in rest)
        if child and lost <= (used - 1) * cap - total:
            stack.append((child, new, first, lost, _branches(child, cap, (used - 1) * cap - total - lost)))
    return best


class Places:
    """The places of a plan: for the r-th piece of a length, its sequence and its offset there."""

    def __init__(self, plan: Plan):
        rows, base, seen = [], 0, {}
        for n, filling in plan:
            offset = 0
            for size, each in filling:
                rows.append((size, seen.get(size, 0), each, base, offset))
                seen[size] = seen.get(size, 0) + n * each
                offset += size * each
            base += n
        rows.sort()
        self.sequences = base
        self.size, self.rank, self.each, self.base, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        self.key = (self.size << 44) | self.rank

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (size << 44) | rank, "right") - 1
        within = rank - self.rank[i]
        return self.base[i] + within // self.each[i], self.offset[i] + within % self.each[i] * size


def token_pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): whole texts as token ids with end_id behind, cut only if over capacity.

    ids are little-endian unsigned 32-bit. The first piece of a cut document is the short one. A null or empty text
    gives one piece with end_id alone. Repeated rows each give their pieces; extra columns are ignored.
    """
    path = vocabulary or default_vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, enc = int(end_id).to_bytes(4, "little"), encoder(path)
        for batch in it:
            for part in slices(batch, "text", 1 << 21):
                cols: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode_many([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for c, v in zip(cols, (doc, k, a, b - a, ids[4 * a : 4 * b]), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset, in as few sequences of at most capacity as the plan finds; length is 1 to capacity.

    Ties between pieces of one length go by (doc_id, piece). Every row gets a place; an empty table gives an empty one.
    """
    pieces = materialize(pieces, "pieces")
    salts = min(1024, max(64, pieces.count() // 20_000))
    p = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    held = p.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()  # at most capacity * salts rows
    counts: dict[int, int] = {}
    for length, _, n in held:
        counts[length] = counts.get(length, 0) + n
    lines = np.zeros(capacity + 1, np.int64)  # of each length, its line in bases: pieces of the length under smaller salts
    lines[[s for s in counts if s <= capacity]] = np.arange(sum(s <= capacity for s in counts))
    bases = np.zeros((max(len(counts), 1), salts), np.int64)
    for length, salt, n in held:
        if length <= capacity and salt + 1 < salts:
            bases[lines[length], salt + 1] = n
    bases = np.cumsum(bases, axis=1)
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError("piece lengths must be 1 to capacity")
    places = Places(complete_bins(counts, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast((places, lines, bases))  # bounded by capacity * salts numbers
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    fields = [f for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, lines, bases = shared.value
        for batch in it:
            size, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_salt", "_rank"))
            seq, offset = places.of(size, bases[lines[size], salt] + rank - 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(seq), pa.array(offset)], [*(f.name for f in fields), "sequence_id", "offset"])

    return p.withColumn("_rank", F.row_number().over(order)).mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Token pieces of whole documents with their ids and places."""
    return pack_pieces(token_pieces(docs, capacity, vocabulary, end_id), capacity)
