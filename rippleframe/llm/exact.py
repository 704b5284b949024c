"""Exact deduplication against an immutable snapshot, screened by static binary-fuse filters.

The snapshot's digests are dealt to buckets by their first bits, and each bucket gets one binary fuse filter (Graf and
Lemire, 2022), built once. Distinct digests of the incoming batch are screened in their bucket; only positives are
joined with the snapshot's exact rows. Duplicates inside the new batch are grouped separately. The texts of every digest
that then has more than one row are checked byte by byte: equal digests with different normalised texts fail the job.
A bit table of fixed size, made of those digests, keeps other texts out of that check's shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, text_or_empty

#: Digests a filter bucket is sized for.
BUCKET = 200_000
#: Parts of the bit table of digests with more than one row, and bits of a part (8 MB together).
SLICES, SLICE_BITS = 16, 1 << 22


class BinaryFuse8:
    """Static filter with 8-bit fingerprints: no false negatives, about 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        base = first * np.uint64(segment)
        g = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
        at = np.stack([base + (g & mask), base + np.uint64(segment) + ((g >> np.uint64(21)) & mask), base + np.uint64(2 * segment) + ((g >> np.uint64(42)) & mask)], axis=1)
        return at.astype(np.int64), ((h ^ (h >> np.uint64(29))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 1)
        segment = 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        count = max(1, -(-int(n * factor) // segment) - 2)
        for seed in range(1, 200):
            at, fp = cls._places(keys, seed, segment, count)
            size = (count + 2) * segment
            held = np.bincount(at.ravel(), minlength=size)
            xor = np.zeros(size, np.int64)
            np.bitwise_xor.at(xor, at.ravel(), np.repeat(np.arange(len(keys)), 3))
            alone, rounds, left = np.flatnonzero(held == 1), [], len(keys)
            while len(alone) and left:
                key, pick = np.unique(xor[alone], return_index=True)
                rounds.append((key, alone[pick]))
                left -= len(key)
                touched = at[key].ravel()
                np.subtract.at(held, touched, 1)
                np.bitwise_xor.at(xor, touched, np.repeat(key, 3))
                touched = np.unique(touched)
                alone = touched[held[touched] == 1]
            if left:
                if seed % 20 == 0:
                    count += max(1, count // 10)
                continue
            table = np.zeros(size, np.uint8)
            for key, place in reversed(rounds):
                table[place] = fp[key] ^ np.bitwise_xor.reduce(table[at[key]], axis=1)
            return cls(seed, segment, count, table)
        raise RuntimeError("no filter found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, fp = self._places(keys.astype(np.uint64), self.seed, self.segment, self.count)
        return np.bitwise_xor.reduce(self.table[at], axis=1) == fp


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digests), "<u8") if len(digests) else np.zeros(0, np.uint64)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, norm, points, digest, _snap if docs has it): text without ASCII white space, its SHA-256, code points of the original text."""
    text = text_or_empty(text_col).cast("string")
    mark = ["_snap"] if "_snap" in docs.columns else []
    return docs.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("norm"), F.length(text).cast("long").alias("points"), *mark).withColumn("digest", F.unhex(F.sha2("norm", 256)))


def _best():
    """The row with the most code points, then the smallest id; a null id only where there is no other."""
    return F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), F.col("id")))


def _buckets(rows: int) -> int:
    return max(1, -(-rows // BUCKET))


def _bucket(n: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(n)).cast("int")


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, segment, count, table) from the snapshot's distinct digests."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse8.build(_keys(pdf["digest"]))
        return pd.DataFrame({"bucket": [key[0]], "seed": [f.seed], "segment": [f.segment], "count": [f.count], "table": [f.table.tobytes()]})

    return groups.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, count int, table binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Digests of incoming that may be in the snapshot."""

    def test(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right) or not len(left):
            return pd.DataFrame({"digest": pd.Series([], dtype=object)})
        r = right.iloc[0]
        f = BinaryFuse8(int(r["seed"]), int(r["segment"]), int(r["count"]), np.frombuffer(r["table"], np.uint8))
        return left.loc[f.contains(_keys(left["digest"])), ["digest"]]

    return incoming.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "digest binary")


def _bits(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Part and bit of each digest."""
    h = np.frombuffer(b"".join(d[:8] for d in digests), ">u8") if digests else np.zeros(0, np.uint64)
    return (h >> np.uint64(60)).astype(np.int64), ((h >> np.uint64(16)) & np.uint64(SLICE_BITS - 1)).astype(np.int64)


def _repeated(groups: DataFrame):
    """A test of digests that lets all digests of groups through and few others (more as the table fills)."""

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in it:
            part, bit = _bits(batch.column("digest").to_pylist())
            for p in np.unique(part).tolist():
                b = bit[part == p]
                np.bitwise_or.at(held.setdefault(p, np.zeros(SLICE_BITS // 8, np.uint8)), b >> 3, (1 << (b & 7)).astype(np.uint8))
        for p, table in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], ["part", "table"])

    first = F.conv(F.substring(F.hex("digest"), 1, 1), 16, 10).cast("int")
    parts = groups.select("digest", first.alias("part"), F.pmod(F.xxhash64("digest"), F.lit(8)).alias("salt")).repartition("part", "salt").select("digest").mapInArrow(build, "part int, table binary")
    tables = np.zeros((SLICES, SLICE_BITS // 8), np.uint8)
    for r in parts.toLocalIterator():  # at most 8 * SLICES rows of fixed size
        tables[r.part] |= np.frombuffer(zlib.decompress(r.table), np.uint8)
    shared = groups.sparkSession.sparkContext.broadcast(zlib.compress(tables.tobytes(), 1))

    @F.pandas_udf("boolean")
    def test(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.frombuffer(zlib.decompress(shared.value), np.uint8).reshape(SLICES, -1)
        for digests in parts:
            part, bit = _bits(digests.tolist())
            yield pd.Series((table[part, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0)

    return test


def exact_groups(docs: DataFrame, in_snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, keep_id, group_size, kept, digest) per row of docs.

    in_snapshot: boolean column, true for rows of the immutable snapshot, else rows of the incoming batch. Texts are
    equal when identical without ASCII white space; null counts as empty. The row with the most code points stays,
    then the smallest id. Of rows that repeat that id, all are marked kept. Extra columns are ignored.
    """
    whole = docs.withColumn("_snap", F.coalesce(in_snapshot, F.lit(False)))
    base = materialize(digests(whole, id_col, text_col).select("id", "digest", "points", F.col("_snap").alias("snap")), "digests")
    snap = base.filter("snap").groupBy("digest").agg(F.count("*").alias("n"), _best().alias("best"))
    new = base.filter("not snap").groupBy("digest").agg(F.count("*").alias("n"), _best().alias("best"))
    snap, new = materialize(snap, "snap"), materialize(new, "new")
    buckets = _buckets(max(snap.count(), new.count()))  # a bucket's filter and the digests it screens stay small
    positive = screen(new, snapshot_filters(snap, buckets), buckets)
    both = positive.join(snap, "digest").select("digest", "n", "best")
    groups = (
        new.unionAll(both).groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
        .unionAll(snap.filter("n > 1").join(new, "digest", "left_anti").select("digest", "n", "best"))
        .filter("n > 1")
    )
    groups = materialize(groups.select("digest", "n", F.col("best.id").alias("keep_id")), "groups")
    # copies meet in the map-side half of this aggregate, so that no task gets all texts of a large group
    texts = digests(docs, id_col, text_col).filter(_repeated(groups)("digest")).groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    fail = F.raise_error(F.lit("two texts share a digest")).cast("boolean")
    groups = materialize(texts.join(groups, "digest").filter(F.when(F.col("low") == F.col("high"), F.lit(True)).otherwise(fail)).select("digest", "n", "keep_id"), "checked")
    out = base.join(groups, "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "digest")


def half_is_snapshot(id_col: str = "doc_id"):
    """A fixed split of one table into snapshot and incoming batch, by a hash of the id."""
    return F.pmod(F.xxhash64(id_col), F.lit(2)) == 0


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() does not keep, told by id and text: other texts of a dropped id stay."""
    dropped = exact_groups(docs, half_is_snapshot(id_col), id_col, text_col).filter("not kept").select(F.col("id").alias("_drop"), F.col("digest").alias("_text")).distinct()
    norm = F.regexp_replace(text_or_empty(text_col).cast("string"), r"[\x20\x09-\x0D]+", "")
    own = docs.withColumn("_digest", F.unhex(F.sha2(norm, 256)))
    return own.join(dropped, (own["_digest"] == dropped["_text"]) & own[id_col].eqNullSafe(dropped["_drop"]), "left_anti").drop("_digest")
