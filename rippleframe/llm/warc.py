"""Content-addressed WARC archive: payload bytes once by verified digest, exact record heads apart, records by joins."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, work_dir

EPOCH = "1970-01-01T00:00:00Z"  # the table has no fetch time


def _payloads(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in it:
        for part in slices(batch, "html", 1 << 22):
            raw = [(x or "").encode() for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array([hashlib.sha1(x).digest() for x in raw], pa.binary()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64()), pa.array([packer.compress(x) for x in raw], pa.binary())],
                ["id", "url", "sha1", "sha256", "bytes", "packed"],
            )


def _target(url: str | None) -> str:
    """A URI without characters that would break a header line."""
    return "".join(c if c > " " and c != "\x7f" else "%" + format(ord(c), "02X") for c in url) if url else "urn:absent"


def record_id(id_: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{id_}')}>"


def _heads(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = batch.to_pylist()
        heads = []
        for r in rows:
            digest = base64.b32encode(r["sha1"]).decode()
            lines = ["WARC/1.1", f"WARC-Type: {'response' if r['refers_to'] is None else 'revisit'}", f"WARC-Record-ID: {record_id(r['id'])}", f"WARC-Target-URI: {_target(r['url'])}", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if r['id'] is None else r['id']}"]
            if r["refers_to"] is None:
                lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {r['bytes']}"]
            else:
                lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(r['refers_to'])}", f"X-Refers-To-Page-ID: {r['refers_to']}", "Content-Length: 0"]
            heads.append(("\r\n".join(lines) + "\r\n\r\n").encode())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha256"), pa.array(heads, pa.binary())], ["page_id", "payload_key", "head"])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the archive of pages (page_id, url, html) to path/payloads and path/records.

    Of equal payloads of at least min_bytes the smallest page_id is the response and the others revisit it; smaller
    payloads are all responses. A null html is an empty payload, a null url 'urn:absent'; a null page_id is a
    response only where no other row has its payload, and rows that repeat the response's page_id are responses too.
    A payload's bytes are stored once under their SHA-256, after a check that one SHA-256 has one SHA-1 and length.
    Extra columns are ignored; an empty table gives an empty archive.
    """
    cols = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = cols.mapInArrow(_payloads, "id long, url string, sha1 binary, sha256 binary, bytes long, packed binary")
    # equal payloads meet before the shuffle; the packed bytes of equal payloads are equal
    store = rows.groupBy("sha256").agg(F.first("packed").alias("packed"), F.min("bytes").alias("bytes"), F.max("bytes").alias("most"), F.min("sha1").alias("sha1"), F.max("sha1").alias("other"), F.min("id").alias("first_id"), F.count("*").alias("n"))
    sound = (F.col("bytes") == F.col("most")) & (F.col("sha1") == F.col("other"))
    store = store.filter(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("boolean")))
    store.select(F.col("sha256").alias("payload_key"), "packed", "bytes", "first_id", "n").write.option("compression", "uncompressed").parquet(f"{path}/payloads")
    shared = pages.sparkSession.read.parquet(f"{path}/payloads").filter((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).select(F.col("payload_key").alias("sha256"), "first_id")
    small = cols.select("id", "url", F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("sha1"), F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("sha256"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"))
    heads = small.join(shared, "sha256", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    heads.select("id", "url", "sha1", "sha256", "bytes", "refers_to").mapInArrow(_heads, "page_id long, payload_key binary, head binary").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, head, payload): each record as written, its payload joined by digest (for revisits the response's)."""
    records, store = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads").select("payload_key", "packed")
    joined = records.join(store, "payload_key").select("page_id", "head", "packed")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in it:
            for part in slices(batch, "packed", 1 << 21):
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("head"), pa.array([opener.decompress(x) for x in part.column("packed").to_pylist()], pa.binary())], ["page_id", "head", "payload"])

    return joined.mapInArrow(run, "page_id long, head binary, payload binary")


def record_bytes(head: bytes, payload: bytes) -> bytes:
    """The WARC record: a revisit's block is empty."""
    return head + (b"" if b"WARC-Type: revisit" in head else payload) + b"\r\n\r\n"


def parsed(records: DataFrame) -> DataFrame:
    """Fields of read_archive() rows, from the heads; the payload is checked against its head's digest and length."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[], [], [], [], []]
            for head, payload in zip(batch.column("head").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                kind = lines["WARC-Type"]
                if lines["WARC-Payload-Digest"] != f"sha1:{digest}" or (kind == "response" and int(lines["Content-Length"]) != len(payload)):
                    raise ValueError("a payload differs from its record's head")
                own, ref = lines.get("X-Page-ID"), lines.get("X-Refers-To-Page-ID")
                for c, v in zip(out, (int(own) if own else None, len(payload), digest, kind, int(ref) if ref else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    path = path or f"{work_dir(pages.sparkSession)}/rf-warc-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    return parsed(read_archive(pages.sparkSession, path))
