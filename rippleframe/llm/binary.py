"""Token ids as canonical length-limited Huffman codes in independent blocks.

A token archive is a folder: ``codes`` holds the code length of each id once (canonical codes need no more), ``blocks``
one row a block with the range of its doc_ids and the number of ids before it. Each block can be decoded alone: it lists
its documents and, for every ``step`` ids of a document, the bit offset at which they begin (checkpoints), so that a
range of ids of one document is read from the checkpoint before it. Decoding looks up ``max_bits`` bits at a time in a
table and runs over all checkpoints of a block at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, slices, work_dir
from .tokens import default_vocabulary, encoder, forget

MAX_BITS, STEP, BLOCK_IDS = 16, 256, 1 << 18
#: Ids of a part (a sorted run of blocks), and the most parts; beyond, parts grow.
PART_IDS, MOST_PARTS = 2_000_000, 16_384
_HEAD = struct.Struct("<QIIIII")  # ids before it in its part, documents, checkpoints, words, null doc_ids, CRC-32 of the rest


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits by package-merge; ids with count 0 get none."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    while len(ids) > 1 << max_bits:
        raise ValueError("max_bits is too small for so many ids")
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[order].astype(np.int64)
    n, levels, merged = len(leaf), [], leaf
    for _ in range(max_bits - 1):  # merged: leaves and packages of the level below, by weight
        packs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, packs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
    take, size = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):  # of the first items of a level, leaves gain a bit, packages open two items below
        leaves = int(is_leaf[:take].sum())
        size[:leaves] += 1
        take = 2 * (take - leaves)
    size[:take] += 1
    out[order] = size
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    size = lengths[ids].astype(np.int64)
    if len(ids):
        top = int(size.max())
        ends = np.cumsum(np.int64(1) << (top - size))  # places of full depth used so far
        codes[ids] = ((ends - (np.int64(1) << (top - size))) >> (top - size)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each pattern of top bits: the id and the length of its code."""
    top = int(lengths.max()) if len(lengths) else 0
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    spread = 1 << (top - lengths[ids].astype(np.int64))
    table = np.zeros(1 << top, np.uint32)
    size = np.ones(1 << top, np.uint8)
    n = int(spread.sum())
    table[:n], size[:n] = np.repeat(ids, spread), np.repeat(lengths[ids], spread)
    return table, size, top


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, first: int, nulls: int = 0) -> bytes:
    """One block: head, documents, checkpoints, bits. first: ids of its part before it; nulls: how many of the first doc_ids are null."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    words = np.zeros(bits // 32 + 3)
    at, shift = begins >> 5, 64 - (begins & 31) - size
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    # bits of different ids never overlap, so sums of 32-bit halves are exact in doubles
    words += np.bincount(at, (value >> np.uint64(32)).astype(np.float64), len(words))
    words[1:] += np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words) - 1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    lanes = np.concatenate([np.arange(a, b, STEP) for a, b in zip(starts, starts[1:], strict=False)]) if len(counts) else np.zeros(0, np.int64)
    marks = begins[lanes].astype("<u4")
    body = doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + marks.tobytes() + words.astype(">u4").tobytes()
    return _HEAD.pack(first, len(doc_ids), len(marks), len(words), nulls, zlib.crc32(body)) + body


def _open_block(block: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, docs, marks, words, nulls, crc = _HEAD.unpack_from(block)
    if zlib.crc32(memoryview(block)[_HEAD.size :]) != crc:
        raise ValueError("a block is damaged")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    counts = np.frombuffer(block, "<u4", docs, at + 8 * docs).astype(np.int64)
    pos = np.frombuffer(block, "<u4", marks, at + 12 * docs).astype(np.int64)
    return first, nulls, doc_ids, counts, pos, np.frombuffer(block, ">u4", words, at + 12 * docs + 4 * marks)


def decode_block(block: bytes, table: np.ndarray, size: np.ndarray, top: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(first, nulls, doc ids, counts, ids) of a block; fails on a damaged one."""
    first, nulls, doc_ids, counts, pos, bits = _open_block(block)
    bits = bits.astype(np.uint64)
    pairs = (bits[:-1] << np.uint64(32)) | bits[1:]
    lanes_of = -(-counts // STEP)
    starts = np.cumsum(counts) - counts
    within = np.arange(len(pos)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    begin = np.repeat(starts, lanes_of) + within * STEP
    left = np.minimum(STEP, np.repeat(counts, lanes_of) - within * STEP)
    order = np.argsort(-left, kind="stable")
    pos, begin, left = pos[order], begin[order], left[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    down = np.uint64(64 - top)
    for step in range(STEP):
        n = int(np.searchsorted(-left, -step, "left"))  # lanes with more than step ids
        if not n:
            break
        p = pos[:n]
        key = ((pairs[p >> 5] << (p & 31).astype(np.uint64)) >> down).astype(np.int64)
        out[begin[:n] + step] = table[key]
        pos[:n] += size[key]
    return first, nulls, doc_ids, counts, out


def decode_range(block: bytes, document: int, begin: int, end: int, table: np.ndarray, size: np.ndarray, top: int) -> np.ndarray:
    """Ids begin to end of one document of a block, read from the checkpoint at or before begin."""
    _, _, _, counts, pos, bits = _open_block(block)
    end = min(end, int(counts[document]))
    if begin >= end:
        return np.zeros(0, np.uint32)
    lane = int((-(-counts[:document] // STEP)).sum()) + begin // STEP
    at, out = int(pos[lane]), []
    for _ in range(end - begin // STEP * STEP):
        pair = int(bits[at >> 5]) << 32 | int(bits[(at >> 5) + 1])
        key = pair >> (64 - top - (at & 31)) & (1 << top) - 1
        out.append(table[key])
        at += int(size[key])
    return np.array(out[begin % STEP :], np.uint32)


def pack_ids(ids: bytes, packer: zstandard.ZstdCompressor) -> bytes:
    """Ids as byte planes, two where all ids are below 65536 and else four, compressed; for tables and shuffles between the two passes."""
    wide = np.frombuffer(ids, "<u4")
    narrow = wide.astype("<u2") if not len(wide) or wide.max() < 1 << 16 else wide
    return bytes([narrow.itemsize]) + packer.compress(narrow.view(np.uint8).reshape(-1, narrow.itemsize).T.tobytes())


def unpack_ids(packed: bytes, opener: zstandard.ZstdDecompressor) -> bytes:
    planes = np.frombuffer(opener.decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{packed[0]}")[:, 0].astype("<u4").tobytes()


def token_rows(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, packed: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): whole texts encoded, end_id behind; ids as little-endian unsigned 32-bit, null text: empty.

    packed: ids as pack_ids() makes them, and one more row a batch (n_tokens -1) with how often the batch has each id.
    """
    path = vocabulary or default_vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, packer = encoder(path), int(end_id).to_bytes(4, "little"), zstandard.ZstdCompressor(level=1)
        for batch in it:
            total = np.zeros(0, np.int64)
            for part in slices(batch, "text", 1 << 22):
                ids = [x + end for x in enc.encode_many([t or "" for t in part.column("text").to_pylist()])]
                if packed:
                    total = _added(total, np.bincount(np.frombuffer(b"".join(ids), "<u4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([pack_ids(x, packer) for x in ids] if packed else ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
            if packed and len(total):
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (a, b) if len(a) > len(b) else (b, a)
    out = a.astype(np.int64)
    out[: len(b)] += b
    return out


def _tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in it:
        for x in batch.column("ids").to_pylist():
            total = _added(total, np.frombuffer(x, "<i8"))
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], ["id", "n"])


def write_tokens(rows: DataFrame, path: str, max_bits: int = MAX_BITS) -> None:
    """Write packed token_rows() as a token archive at path, blocks in ascending doc_id order over (part, block).

    Null doc_ids come first; rows of equal doc_id stay side by side in any order. No rows: an archive without blocks.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "ids")
    tally = rows.filter("n_tokens < 0").mapInArrow(_tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many as the vocabulary has
    counts = np.zeros(max((r.id for r in tally), default=0) + 1, np.int64)
    for r in tally:
        counts[r.id] = r.n
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(bytearray(zlib.compress(lengths.tobytes(), 6)),)], "lengths binary").write.parquet(f"{path}/codes")
    parts = min(max(1, int(counts.sum() // PART_IDS)), MOST_PARTS)
    ordered = rows.filter("n_tokens >= 0").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    shared = spark.sparkContext.broadcast(lengths)  # one byte an id of the vocabulary

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        lengths, part = shared.value, TaskContext.get().partitionId()
        codes, opener = canonical_codes(lengths), zstandard.ZstdDecompressor()
        docs, held, n, before, number = [], [], 0, 0, 0

        def closed():
            nulls = sum(d is None for d in docs)
            known = docs[nulls:]
            ids = np.frombuffer(b"".join(held), "<u4")
            block = encode_block(ids, np.array([0] * nulls + known, np.int64), np.array([len(x) // 4 for x in held], np.int64), lengths, codes, before, nulls)
            row = ([part], [number], [before], [len(ids)], [known[0] if known else None], [known[-1] if known else None], [block])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "first", "ids", "low", "high", "data"])

        for batch in it:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                held.append(unpack_ids(x, opener))
                n += len(held[-1]) // 4
                if n >= BLOCK_IDS:
                    yield closed()
                    docs, held, n, before, number = [], [], 0, before + n, number + 1
        if docs:
            yield closed()

    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(rows)


_BLOCKS = "part int, block int, first long, ids long, low long, high long, data binary"


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the archive at path; start: ids of all documents before it.

    low, high: only documents with doc_id in these bounds; blocks without any are not read.
    """
    files = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    held = files.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()  # MOST_PARTS small rows at most
    before = dict(zip((r.part for r in held), np.concatenate([[0], np.cumsum([r.ids for r in held])]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((lengths_of(spark, path), before))  # one byte an id of the vocabulary, one number a part
    wanted = files
    if low is not None:
        wanted = wanted.filter(F.col("high") >= low)
    if high is not None:
        wanted = wanted.filter(F.col("low") <= high)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        lengths, before = shared.value
        table, size, top = decode_table(lengths)
        for batch in it:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                first, nulls, docs, counts, ids = decode_block(block.as_buffer().to_pybytes(), table, size, top)
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=np.arange(len(docs)) < nulls), pa.array(before[part] + first + ends - counts), pa.array(counts), pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    out = wanted.select("part", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    if low is not None:
        out = out.filter(F.col("doc_id") >= low)
    return out if high is None else out.filter(F.col("doc_id") <= high)


def lengths_of(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(spark.read.parquet(f"{path}/codes").first().lengths), np.uint8)


def read_range(spark: SparkSession, path: str, doc_id: int, begin: int, end: int) -> list[np.ndarray]:
    """Ids begin to end of each document with this id: its blocks alone are read, from the checkpoint before begin."""
    table, size, top = decode_table(lengths_of(spark, path))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").filter((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).select("data")
    out = []
    for r in blocks.toLocalIterator():  # the blocks of one id
        nulls, docs = _open_block(bytes(r.data))[1:3]
        out += [decode_range(bytes(r.data), int(i), begin, end, table, size, top) for i in np.flatnonzero(docs == doc_id) if i >= nulls]
    return out


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Encode documents, write the archive (into the shared folder unless path is given), read it back.

    (doc_id, start, n_tokens, ids) per row of docs; null texts are empty, null ids stay null and come first, extra
    columns are ignored, an empty table gives an empty one.
    """
    path = path or f"{work_dir(docs.sparkSession)}/rf-tokens-{uuid.uuid4().hex}"
    write_tokens(token_rows(docs, vocabulary, end_id, packed=True), path)
    return read_tokens(docs.sparkSession, path)
