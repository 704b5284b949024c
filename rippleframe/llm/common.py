"""Shared helpers: session folders, written intermediate tables, word spans and hashes over Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where the session names none and runs on this machine alone (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="rippleframe-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
        spark.sparkContext.setCheckpointDir(_LOCAL[0])
    return f"file://{_LOCAL[0]}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/rf-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rf_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_rf_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def keep_pages() -> None:
    """Work arrays up to 16 MB then come from memory that the process keeps (64 MB of it unused at most), not from fresh pages.

    Without it glibc maps and unmaps the arrays of every numpy step, whose page faults cost more than the arithmetic.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


# ---------------------------------------------------------------- words of whole Arrow batches

_WS = bytes(range(9, 14)) + b" "
#: Byte tables for bytes.translate: every separator becomes a space, other bytes stay (or are lower-cased).
WS_KEEP = bytes(32 if b in _WS else b for b in range(256))
WS_LOWER = bytes(32 if b in _WS else b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_LOWER = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def slices(batch: pa.RecordBatch, col: str, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about max_bytes of text, so that work arrays stay small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // max_bytes if len(lengths) else np.zeros(0, int)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """Word spans of a run of texts: buf holds the translated bytes, word i is buf[start[i]:end[i]], the words of text d are first[d]..first[d+1]."""

    def __init__(self, texts: pa.Array, translate: bytes):
        raw, offsets = utf8_buffer(texts)
        self.text = raw.translate(translate)
        self.buf = np.frombuffer(self.text, np.uint8)
        self.offsets = offsets
        word = self.buf != 32
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inside = offsets[(offsets > 0) & (offsets < len(word))]
        begins[inside] = word[inside]
        ends[inside - 1] = word[inside - 1]
        self.word = word
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words of each text joined by one space, with the spans of words in that."""
        keep = self.word.copy()
        after = self.end[self.end < len(keep)]
        keep[after] = True  # the separator after a word, or the next text's first byte, which is a word's or unused
        at = np.cumsum(keep)
        return self.buf[keep].tobytes(), at[self.start] - 1, at[self.end - 1]

    def runs(self, k: int) -> np.ndarray:
        """Indices of words that start k words of one text."""
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.n)
        return np.flatnonzero(room >= k)


def utf8_buffer(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
    return raw, offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process; hashes of different seeds are independent.

    Eight bytes at a time are mixed with their place in the word before they are added up, so that no arithmetic
    pattern of equal letters makes two words meet (as Thue-Morse words do in a polynomial hash).
    """
    if not w.n:
        return np.zeros(0, np.uint64)
    size = w.end - w.start
    blocks = (size + 7) >> 3
    begins = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum())) - np.repeat(begins, blocks)
    at = np.repeat(w.start, blocks) + 8 * within
    left = np.minimum(np.repeat(w.end, blocks) - at, 8)
    value = np.ndarray((len(w.buf) + 1,), "<u8", w.text + bytes(16), strides=(1,))[at] & _MASKS[left]
    key = np.uint64(seed * 0xA0761D6478BD642F + 1 & (2**64 - 1))
    value = mix64(value ^ mix64(within.astype(np.uint64) * _ODD + key))
    return mix64(np.add.reduceat(value, begins) + size.astype(np.uint64) * _ODD + key)


def gram_hashes(words: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of words[i:i+k] for every i; the last k-1 places are not meant to be used."""
    out = np.zeros(len(words), np.uint64)
    m, p = len(words) - k + 1, 1
    if m > 0:
        for j in range(k):
            out[:m] += words[j : j + m] * np.uint64(p)
            p = p * base % 2**64
    return mix64(out)


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    part: list[dict] = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)
