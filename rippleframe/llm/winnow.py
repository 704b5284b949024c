"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-gram hashes the smallest are kept as fingerprints, on both sides, so any
shared run of ``window`` words shares a fingerprint (Schleimer, Wilkerson and Aiken, 2003). Texts' fingerprints are
screened by a bit table of fixed size made from the benchmark's, the rest are joined by hash and extended word by word
to the shared run around them; equal passages of several items are one there. Items shorter than a window are one window: their whole hash is the fingerprint, and
texts give their hashes of those few lengths as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, Words, gram_hashes, materialize, slices, word_hashes

K, SCREEN_BITS = 5, 1 << 24
_PRINTS = "array<struct<h:bigint,len:int,pos:int,before:int,words:string>>"


def _select(w: Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: k-grams that are the least of some window's."""
    span = window - K + 1
    at = w.runs(window)
    if not len(at):
        return at
    g = gram_hashes(hashes, K)
    least = g[at].copy()
    for j in range(1, span):
        np.minimum(least, g[at + j], out=least)
    chosen = np.zeros(w.n, bool)
    for j in range(span):
        chosen[at[g[at + j] == least] + j] = True
    return np.flatnonzero(chosen)


def _prints(w: Words, window: int, short: list[int], screen: np.ndarray | None) -> list[list[dict]]:
    docs = len(w.first) - 1
    out: list[list[dict]] = [[] for _ in range(docs)]
    if not w.n:
        return out
    hashes, of = word_hashes(w), w.doc()
    for m in [0, *short]:
        at = w.runs(m) if m else _select(w, hashes, window)
        h = gram_hashes(hashes, m or K)[at] ^ np.uint64(m * 0x9E3779B97F4A7C15 & (2**64 - 1))
        if screen is not None:
            bit = (h >> np.uint64(40)).astype(np.int64)
            hit = (screen[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            at, h = at[hit], h[hit]
        for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
            d = int(of[p])
            a, b = (p, p + m) if m else (max(int(w.first[d]), p - window + K), min(int(w.first[d + 1]), p + window))
            words = b" ".join(w.text[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)).decode()
            out[d].append({"h": x, "len": m, "pos": p - int(w.first[d]), "before": p - a, "words": words})
    return out


def _printed(rows: DataFrame, window: int, short: list[int], screen, only_short: bool = False) -> DataFrame:
    """(id, n_words, prints) of rows (id, text); an item of fewer words than a window has its whole as one print."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = screen.value if screen is not None else None
        for batch in it:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM_LOWER)
                n = np.diff(w.first)
                lengths = sorted({int(x) for x in n if 0 < x < window}) if only_short else short
                prints = _prints(w, window, lengths, bits)
                if only_short:
                    prints = [[p for p in own if p["len"] in (0, c)] for own, c in zip(prints, n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n.astype(np.int64)), pa.array(prints, pa.list_(pa.struct([("h", pa.int64()), ("len", pa.int32()), ("pos", pa.int32()), ("before", pa.int32()), ("words", pa.string())])))], ["id", "n_words", "prints"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, prints {_PRINTS}")


def _extend(it: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out: list[list] = [[], [], [], []]
        for r in batch.to_pylist():
            mine, theirs = r["words"].split(" "), r["item_words"].split(" ")
            i, j = r["before"], r["item_before"]
            if r["len"]:
                if mine != theirs:
                    continue
                a, b = 0, r["len"]
            else:
                a = b = 0
                while i + b < len(mine) and j + b < len(theirs) and mine[i + b] == theirs[j + b]:
                    b += 1
                while a < min(i, j) and mine[i - a - 1] == theirs[j - a - 1]:
                    a += 1
                if a + b < window:
                    continue
                a = -a
            for c, v in zip(out, (r["row"], r["passage"], r["pos"] + a, r["pos"] + b), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["row", "passage", "start", "end"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row (id, n_words, n_hit, item_ids, spans) per row of docs.

    Words are runs of lower-cased ASCII letters, digits and any other characters beyond ASCII. An item's windows are
    its runs of ``window`` words, or all its words if there are fewer; a word of a text inside any occurrence of a
    window is hit. item_ids: ids (as sorted strings) of the items with occurring windows; spans: the hit runs as
    found. Null or wordless texts and items give nothing; a null item id is not listed; repeated items count once;
    each repeated document row gets its own result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    bench = _printed(items.select(F.col(item_col).cast("string").alias("id"), F.col("text").cast("string").alias("text")), window, [], None, True)
    bench = bench.select("id", F.explode("prints").alias("p")).select("id", "p.*")
    bench = bench.groupBy("h", "len", "before", "words").agg(F.collect_set("id").alias("ids"))  # a text at an item's print is held against each passage once
    bench = materialize(bench.withColumn("passage", F.monotonically_increasing_id()), "items")
    short = sorted(r.len for r in bench.filter("len > 0").select("len").distinct().collect())  # fewer than window values
    word = F.shiftrightunsigned("h", 40)
    bits = bench.select(F.shiftright(word, 3).cast("int").alias("w"), F.expr("shiftleft(1, cast(shiftrightunsigned(h, 40) & 7 as int))").alias("b"))
    screen = np.zeros(SCREEN_BITS // 8, np.uint8)
    for r in bits.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most 2**21 small rows
        screen[r.w] = r.b
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    printed = _printed(rows, window, short, spark.sparkContext.broadcast(screen))
    printed = materialize(printed.withColumn("row", F.monotonically_increasing_id()), "prints")
    mine = printed.filter(F.size("prints") > 0).select("row", F.explode("prints").alias("p")).select("row", "p.*")
    theirs = bench.select("h", "len", "passage", F.col("before").alias("item_before"), F.col("words").alias("item_words"))
    pairs = mine.join(theirs, ["h", "len"]).select("row", "len", "pos", "before", "words", "passage", "item_before", "item_words")
    hits = pairs.mapInArrow(lambda it: _extend(it, window), "row long, passage long, start int, end int").distinct()
    items_of = bench.select("passage", "ids")
    ids = hits.select("row", "passage").distinct().join(items_of, "passage").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    per = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")).join(ids, "row")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate("spans", start, lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")))["n"]
    out = printed.select("row", "id", "n_words").join(per.select("row", "item_ids", "spans", covered.alias("n_hit")), "row", "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans")
