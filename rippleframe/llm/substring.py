"""Substring deduplication with fixed-block anchors.

Every text is cut into non-overlapping blocks of half a window; the blocks' hashes are the index. A window that occurs
twice holds, at either place, a word run that equals a block of the other place, so rolling half-windows of all texts
probe the index and only windows around a hit go on. The index is held as two fixed-size bit tables (blocks seen,
blocks seen twice): their size does not depend on the data, and when they fill up more windows go on, none is lost.
Hits are extended to whole windows, which meet by 96 bits made of two independent hashes of their words (two different
windows among 10^12 would meet with probability 10^-5); the first place of each window stays and runs of later places
are merged to maximal repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_KEEP, Words, gram_hashes, slices, word_hashes

SLICES, SEEN_BITS, TWICE_BITS = 64, 1 << 23, 1 << 21


class Anchors:
    """Bit tables by the first six bits of a hash; seen has two probes a hash, twice has one."""

    def __init__(self):
        self.seen: dict[int, np.ndarray] = {}
        self.twice: dict[int, np.ndarray] = {}

    @staticmethod
    def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (h & np.uint64(SEEN_BITS - 1)).astype(np.int64), ((h >> np.uint64(23)) & np.uint64(SEEN_BITS - 1)).astype(np.int64), ((h >> np.uint64(30)) & np.uint64(TWICE_BITS - 1)).astype(np.int64)

    def add(self, part: int, h: np.ndarray) -> None:
        seen = self.seen.setdefault(part, np.zeros(SEEN_BITS // 8, np.uint8))
        twice = self.twice.setdefault(part, np.zeros(TWICE_BITS // 8, np.uint8))
        u, n = np.unique(h, return_counts=True)
        a, b, c = self._bits(u)
        again = (n > 1) | (((seen[a >> 3] >> (a & 7)) & (seen[b >> 3] >> (b & 7)) & 1) > 0)
        for x in (a, b):
            np.bitwise_or.at(seen, x >> 3, (1 << (x & 7)).astype(np.uint8))
        c = c[again]
        np.bitwise_or.at(twice, c >> 3, (1 << (c & 7)).astype(np.uint8))


def _test(table: np.ndarray, part: np.ndarray, bit: np.ndarray, bits: int) -> np.ndarray:
    at = part * bits + bit
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _aligned(w: Words, k: int) -> np.ndarray:
    return (np.arange(w.n) - np.repeat(w.first[:-1], np.diff(w.first))) % k == 0


def _anchors(docs: DataFrame, k: int) -> tuple[bytes, bytes]:
    """The two bit tables of all blocks of k words, deflated."""

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), WS_KEEP)
                at = w.runs(k)
                h = gram_hashes(word_hashes(w), k)[at[_aligned(w, k)[at]]]
                u, n = np.unique(h, return_counts=True)
                h = np.concatenate([u, u[n > 1]])
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(58)).astype(np.int32)), pa.array(h.view(np.int64))], ["part", "h"])

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Anchors()
        for batch in it:
            part, h = batch.column("part").to_numpy(zero_copy_only=False), batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            for p in np.unique(part).tolist():
                held.add(p, h[part == p])
        for p, seen in held.seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([held.twice[p].tobytes()], pa.binary())], ["part", "seen", "twice"])

    tables = docs.mapInArrow(blocks, "part int, h long").repartition(SLICES, "part").mapInArrow(build, "part int, seen binary, twice binary")
    seen, twice = np.zeros(SLICES * SEEN_BITS // 8, np.uint8), np.zeros(SLICES * TWICE_BITS // 8, np.uint8)
    for r in tables.toLocalIterator():  # 64 rows of fixed size
        seen[r.part * (SEEN_BITS // 8) : (r.part + 1) * (SEEN_BITS // 8)] = np.frombuffer(r.seen, np.uint8)
        twice[r.part * (TWICE_BITS // 8) : (r.part + 1) * (TWICE_BITS // 8)] = np.frombuffer(r.twice, np.uint8)
    return zlib.compress(seen.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def _runs(id_: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (id, tag, pos) merged where pos goes on by one: first rows and lengths."""
    first = np.flatnonzero(np.concatenate([[True], (id_[1:] != id_[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + 1)])) if len(id_) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(id_)))


_WINDOW = "h1 long, h2 int, id long, tag int, pos int, len int"


def _window_rows(h1, h2, id_, tag, pos, length) -> pa.RecordBatch:
    arrays = [pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int32)), pa.array(id_), pa.array(tag), pa.array(pos.astype(np.int32)), pa.array(length.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "id", "tag", "pos", "len"])


def _settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Of windows gathered by one task only the first place goes on (len 0); the others are known to be later (runs of len places)."""
    h1, h2, id_, tag, pos = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((pos, tag, id_, h2, h1))
    h1, h2, id_, tag, pos = h1[order], h2[order], id_[order], tag[order], pos[order]
    same = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
    group = np.cumsum(~same) - 1
    later = id_ > id_[np.flatnonzero(~same)][group]
    text = same & np.concatenate([[False], (id_[1:] == id_[:-1]) & (tag[1:] == tag[:-1])])
    later |= pos > pos[np.flatnonzero(~text)][np.cumsum(~text) - 1]  # a repeated row has its windows at the same places
    go = ~later
    yield _window_rows(h1[go], h2[go], id_[go], tag[go], pos[go], np.zeros(int(go.sum())))
    id_, tag, pos = id_[later], tag[later], pos[later]
    order = np.lexsort((pos, tag, id_))
    id_, tag, pos = id_[order], tag[order], pos[order]
    first, length = _runs(id_, tag, pos)
    if len(first):
        spread = (id_[first].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        yield _window_rows(spread, np.zeros(len(first)), id_[first], tag[first], pos[first], length)


def _later(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by hash and id, the places whose id is above the group's first; settled runs pass."""
    last: tuple | None = None  # hash and first id of the group that a batch ended in
    for batch in it:
        h1, h2, id_, tag, pos, length = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        out = length > 0
        at = np.flatnonzero(~out)
        if len(at):
            a, b, i = h1[at], h2[at], id_[at]
            new = np.concatenate([[last is None or (a[0], b[0]) != last[:2]], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            starts = np.flatnonzero(new)
            lows = np.concatenate([[last[2] if last is not None and not new[0] else 0], i[starts]])
            low = lows[np.cumsum(new)]
            out[at] = i > low
            last = (a[-1], b[-1], low[-1])
        yield pa.RecordBatch.from_arrays([pa.array(id_[out]), pa.array(tag[out]), pa.array(pos[out]), pa.array(np.maximum(length[out], 1))], ["id", "tag", "pos", "len"])


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(id, tag, pos, len): runs of places whose windows also start earlier; docs has id, tag (hash of the text), text."""
    k = window // 2
    shared = docs.sparkSession.sparkContext.broadcast(_anchors(docs, k))  # 80 MB before deflation at any input size

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in shared.value)
        held, size = [], 0
        for batch in it:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), WS_KEEP)
                whole = w.runs(window)
                if not len(whole):
                    continue
                words = word_hashes(w)
                h = gram_hashes(words, k)
                at = w.runs(k)
                own = _aligned(w, k)[at]
                p = (h[at] >> np.uint64(58)).astype(np.int64)
                a, b, c = Anchors._bits(h[at])
                hit = np.zeros(w.n + 1, np.int64)
                hit[at] = np.where(own, _test(twice, p, c, TWICE_BITS), _test(seen, p, a, SEEN_BITS) & _test(seen, p, b, SEEN_BITS))
                total = np.concatenate([[0], np.cumsum(hit)])
                whole = whole[total[whole + window - k + 1] > total[whole]]
                doc = w.doc()[whole]
                h1 = gram_hashes(words, window)[whole].view(np.int64)
                h2 = (gram_hashes(word_hashes(w, 1), window, 0xA0761D6478BD642F)[whole] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                id_, tag = (part.column(x).to_numpy(zero_copy_only=False)[doc] for x in ("id", "tag"))
                held.append((h1, h2, id_, tag, whole - w.first[doc]))
                size += len(whole)
                if size > 600_000:
                    yield from _settle(held)
                    held, size = [], 0
        if held:
            yield from _settle(held)

    return docs.mapInArrow(probe, _WINDOW).repartition("h1").sortWithinPartitions("h1", "h2", "id").mapInArrow(_later, "id long, tag int, pos int, len int")


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_words, n_removed, kept_text, removed_spans) per row of docs.

    A word goes when a window of ``window`` words that covers it also starts earlier: in a smaller id or earlier in the
    same text. Windows are judged on the input. kept_text joins the kept words by one space; removed_spans are maximal
    (start, end) word runs. Null or wordless texts have no words. Rows that repeat an id are not earlier than one
    another; a null id counts as the smallest. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.hash(text).alias("tag"), text.alias("text"))
    gone = repeated_windows(rows, window).groupBy("id", "tag").agg(F.collect_list(F.struct("pos", "len")).alias("runs"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array([packer.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["id", "tag", "packed"])

    packed = rows.mapInArrow(pack, "id long, tag int, packed binary")  # texts cross the shuffle compressed
    joined = packed.join(gone.withColumnsRenamed({"id": "_id", "tag": "_tag"}), (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("id", "packed", "runs")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in it:
            for part in slices(batch, "packed", 1 << 20):
                out: list[list] = [[], [], [], [], []]
                for id_, packed, runs in zip(*(part.column(c).to_pylist() for c in ("id", "packed", "runs")), strict=True):
                    words = opener.decompress(packed).translate(WS_KEEP).split() if packed else []
                    spans: list[list[int]] = []
                    for p, n in sorted((r["pos"], r["len"]) for r in runs or ()):
                        end = p + n - 1 + window
                        if spans and p <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], end)
                        else:
                            spans.append([p, end])
                    kept, at = [], 0
                    for a, b in spans:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    for c, v in zip(out, (None if id_ == -(2**63) else id_, len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), strict=True)], ["id", "n_words", "n_removed", "kept_text", "removed_spans"])

    return joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:int,end:int>>")
