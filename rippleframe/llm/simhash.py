"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has eight byte positions. Two fingerprints that differ in at most four bits differ in at most four
bytes, so they share at least four positional bytes (the guaranteed minimum). Postings of single positional bytes
would grow with the square of the input, so postings are kept for the twenty position triples of a covering: every
four positions contain one of these triples, hence every pair with the guaranteed minimum meets in a posting. For
each met pair the shared positional bytes are tallied, pairs under the minimum are dropped, the rest verified bit
by bit. Inside a posting a found fingerprint leaves the search, so that one link a fingerprint goes on, and of all
postings of a task only a spanning forest leaves it.

Postings with more than ``split`` fingerprints go on under a fourth shared position, which every pair that meets there
must have as well. Those still over ``split`` never reach one task: their fingerprints are linked through variants with
up to two flipped bits (two fingerprints at four bits or fewer have a common variant, and a common variant implies four
bits or fewer), which is exact and linear in the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_LOWER, Words, gram_hashes, materialize, mix64, slices, word_hashes
from .components import components, roots_of

POSITIONS, MAX_BITS, MIN_SHARED = 8, 4, 4


def _cover() -> list[tuple[int, int, int]]:
    """Position triples such that each set of four positions contains one of them."""
    part = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for p in part for t in combinations(p, 3)]
    for i, p in enumerate(part):
        out += [(*two, one) for two in combinations(p, 2) for one in part[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in out]


TRIPLES = _cover()
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


#: near_dedup(): words in a shingle, least Jaccard similarity, and the part fingerprints (BANDS of ROWS least hashes each).
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 5
#: Postings of part fingerprints with more rows meet through pivots first; then pairs still apart whose sketches of BINS bytes say LIKELY or more.
WHOLE, CHUNK, BINS, LIKELY = 16, 2048, 512, 0.74
_DRAW = np.random.default_rng(20250117)
_TIMES = _DRAW.integers(0, 2**31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _DRAW.integers(0, 2**32, BANDS * ROWS).astype(np.uint32)


def _fingerprints(w: Words, joined: tuple[bytes, np.ndarray, np.ndarray], k: int, seed: int) -> np.ndarray:
    docs = len(w.first) - 1
    counts = np.diff(w.first)
    if not w.n:
        return np.zeros(docs, np.uint64)
    text, start, end = joined
    head = w.runs(k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    a = np.concatenate([start[head], start[w.first[short]]])
    b = np.concatenate([end[head + k - 1], end[w.first[short + 1] - 1]])
    doc = np.concatenate([w.doc()[head], short])
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(text[i:j], seed) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    byte = hashes.view(np.uint8).reshape(-1, 8)
    total = np.bincount(doc, minlength=docs)
    out = np.zeros((docs, 8), np.uint8)
    for p in range(POSITIONS):
        tally = np.bincount(doc * 256 + byte[:, p], minlength=docs * 256).reshape(docs, 256).astype(np.float64) @ _BITS
        out[:, p] = np.packbits(2 * tally > total[:, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", views: tuple[tuple[int, int], ...] = ((4, 42),)) -> DataFrame:
    """(id, fp, fp1, ...): 64-bit SimHashes of each whole text over lower-cased word shingles, one per (words, seed); null and wordless texts: 0."""
    names = ["fp", *(f"fp{i}" for i in range(1, len(views)))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column("text"), WS_LOWER)
                joined = w.joined()
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(_fingerprints(w, joined, k, seed).view(np.int64)) for k, seed in views)], ["id", *names])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(["id long", *(f"{n} long" for n in names)]))


def _near(x: np.ndarray) -> np.ndarray:
    """Of differing bits of pairs: the shared positional bytes reach the minimum, and the verified distance is in bounds."""
    shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
    return (shared >= MIN_SHARED) & (np.bitwise_count(x) <= MAX_BITS)


def _small_postings(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows of equal key (sorted; at most ``most`` rows a key)."""
    a, b = [fp[:0]], [fp[:0]]
    for step in range(1, most):
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        i = i[_near(fp[i] ^ fp[i + step])]
        a.append(fp[i + step])
        b.append(fp[i])
    return np.concatenate(a), np.concatenate(b)


def _large_posting(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of one posting: what is found from a root leaves the search."""
    a, b = [], []
    while len(fp) > 1:
        front, root, fp = fp[:1], fp[0], fp[1:]
        while len(front) and len(fp):
            near = np.zeros(len(fp), bool)
            for at in range(0, len(front), 64):
                near |= _near(front[at : at + 64, None] ^ fp[None, :]).any(axis=0)
            front, fp = fp[near], fp[~near]
            a.append(front)
            b.append(np.full(len(front), root))
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _bucket_links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, fp) to links (a, b); of the links of a task only a spanning forest goes on."""
    rest = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def find(key, fp):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(starts, len(key)))
        small = np.repeat(n <= 32, n)
        yield _small_postings(key[small], fp[small], 32)
        for s, m in zip(starts[n > 32].tolist(), n[n > 32].tolist(), strict=True):
            yield _large_posting(fp[s : s + m])

    def out():
        nodes, low = roots_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        up = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[up].view(np.int64)), pa.array(low[up].view(np.int64))], ["a", "b"])

    for batch in it:
        key = np.concatenate([rest[0], batch.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([rest[1], batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        for x in find(key[:cut], fp[:cut]):
            held.append(x)
            size += len(x[0])
        rest = (key[cut:], fp[cut:])
        if size > 1_000_000:
            yield out()
            held, size = [], 0
    held += find(*rest)
    if held:
        yield out()


def _variants(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = [1 << i for i in range(64)]
    masks = np.array([0, *one, *(x | y for x, y in combinations(one, 2))], np.uint64)
    for batch in it:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 64):
            part = fp[at : at + 64]
            v = (part[:, None] ^ masks[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array(v.view(np.int64))], ["fp", "v"])


def _in_postings(members: DataFrame) -> DataFrame:
    return members.select(F.col("key").cast("long").alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links, "a long, b long")


def links(fps: DataFrame, split: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp; their components are those of all links at four bits or fewer."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(POSITIONS)]
    keys = [F.lit(n << 24).bitwiseOR(F.shiftleft(byte[p], 16)).bitwiseOR(F.shiftleft(byte[q], 8)).bitwiseOR(byte[r]) for n, (p, q, r) in enumerate(TRIPLES)]
    index = fps.select("fp").select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = materialize(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "posting")
    members = index.join(sizes, "key")
    found = _in_postings(members.filter(F.col("n") <= split))
    if sizes.filter(F.col("n") > split).limit(1).count():
        others = F.array(*(F.array(*(F.lit(p) for p in range(POSITIONS) if p not in t)) for t in TRIPLES))
        fourth = members.filter(F.col("n") > split).select("fp", "key", F.explode(F.element_at(others, (F.shiftright("key", 24) + 1).cast("int"))).alias("p"))
        fourth = fourth.select("fp", F.shiftleft("key", 11).bitwiseOR(F.shiftleft("p", 8)).bitwiseOR(F.expr("shiftrightunsigned(fp, 8 * p) & 255")).alias("key"))
        sizes = materialize(fourth.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "posting")
        members = fourth.join(sizes, "key")
        found = found.unionAll(_in_postings(members.filter(F.col("n") <= split)))
        if sizes.filter(F.col("n") > split).limit(1).count():
            hot = materialize(members.filter(F.col("n") > split).select("fp").distinct().mapInArrow(_variants, "fp long, v long"), "variants")
            root = hot.groupBy("v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("v", "b")
            found = found.unionAll(hot.join(root, "v").filter("fp <> b").select(F.col("fp").alias("a"), "b"))
    return found


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, split: int = 4096) -> DataFrame:
    """One row (id, fp, component_id, group_size) per document row.

    Documents link when their fingerprints differ in at most four bits; component_id is the smallest id reachable.
    Texts that are null or hold no word have fingerprint zero and link like any other. Fewer words than a shingle:
    the whole word sequence is the one shingle. Repeated rows each get a row; rows with a null id take part in links
    but are never the smallest id (component_id is null only where all ids of a component are null). Extra columns
    are ignored; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, ((words, seed),)), "fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "fpnode")
    roots = components(links(nodes, split))
    own = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    group = own.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("group_size"))
    return fps.join(own.join(group, "root").select("fp", "component_id", "group_size"), "fp")


def fp_hex(col: str = "fp"):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of k words of each text, ascending, and where each text's begin (and the last's end). Fewer words: one shingle."""
    docs = len(w.first) - 1
    if not w.n:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    words, doc = word_hashes(w), w.doc()
    head = w.runs(k)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    few = [gram_hashes(words[w.first[d] : w.first[d + 1]], int(counts[d]))[:1] + np.uint64(counts[d]) for d in short.tolist()]
    h = np.concatenate([gram_hashes(words, k)[head], *few])
    of = np.concatenate([doc[head], short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(docs + 1))


def _parts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS part fingerprints per text: each the hash of the ROWS shingles that come first in ROWS fixed random orders."""
    docs = len(first) - 1
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((docs, BANDS), np.uint64)
    low = (h >> np.uint64(32)).astype(np.uint32)
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            least = np.minimum.reduceat(low * _TIMES[r] + _PLUS[r], first[full]) if len(full) else np.zeros(0, np.uint32)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[full, b] = key
    return out


def _views(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for part in slices(batch, "text", 1 << 20):
            w = Words(part.column("text"), WS_LOWER)
            fp = _fingerprints(w, w.joined() if w.n else None, SHINGLE, 42)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(_parts(*shingle_sets(w)).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("id"), pa.array(fp.view(np.int64)), keys], ["node", "id", "fp", "keys"])


def _packed_sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for part in slices(batch, "text", 1 << 20):
            h, first = shingle_sets(Words(part.column("text"), WS_LOWER))
            packed = [h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(packed, pa.binary())], ["node", "shingles"])


def _similar(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their packed sets those at a Jaccard similarity of SIMILAR or more; two empty sets are equal."""
    for batch in it:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = x.as_buffer(), y.as_buffer()
            n, m = x.size // 8, y.size // 8
            if min(n, m) < SIMILAR * max(n, m) - 1e-9:
                continue
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = shared >= SIMILAR * (n + m - shared) - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), "similar")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _profiles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed shingle hashes (ascending) and part fingerprints to a sketch, a byte of the least hash in each of BINS ranges (0: none), and the packed parts."""
    for batch in it:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        out = np.zeros((len(sets), BINS), np.uint8)
        for i, h in enumerate(sets):
            at = (h >> np.uint64(55)).astype(np.int64)
            new = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
            out[i, at[new]] = h[new] % np.uint64(255) + np.uint64(1)
        parts = [np.array(k, np.int64).tobytes() for k in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in out], pa.binary()), pa.array(parts, pa.binary())], ["node", "sketch", "parts"])


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of each sketch in x with each in y."""
    same, either = (np.zeros((len(x), len(y)), np.int32) for _ in range(2))
    for c in range(0, BINS, 16):  # few bytes at a time keep the work arrays small
        p, q = x[:, None, c : c + 16], y[None, :, c : c + 16]
        some = (p | q) > 0
        either += some.sum(axis=2, dtype=np.int32)
        same += ((p == q) & some).sum(axis=2, dtype=np.int32)
    return same / np.maximum(either, 1)


def _across(it: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, chunk), asking rows first: pairs of an asking and another row of different roots whose sketches say LIKELY.

    A pair goes on only from the first of its common postings; best: of each asking row only the likeliest pair, if it
    is likely a link.
    """
    asking: list[tuple] = []
    at = None

    for batch in it:
        key, chunk, asks, node, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "chunk", "asks", "node", "root"))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        parts = np.frombuffer(b"".join(batch.column("parts").to_pylist()), np.int64).reshape(-1, BANDS)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])) if len(key) else np.zeros(0, np.int64)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist(), strict=True):
            if at != (key[a], chunk[a]):
                at, asking = (key[a], chunk[a]), []
            ask, own = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
            if len(ask):
                asking.append((node[ask], root[ask], sketch[ask], parts[ask]))
            if not asking or not len(own):
                continue
            n, r, s, k = (np.concatenate(x) for x in zip(*asking, strict=True))
            for i in range(0, len(n), 32):
                alike = np.where(r[i : i + 32, None] != root[None, own], _alike(s[i : i + 32], sketch[own]), 0.0)
                if best:
                    x, y = np.arange(len(alike)), alike.argmax(axis=1)
                    ok = alike[x, y] >= SIMILAR
                    x, y = x[ok], y[ok]
                else:
                    x, y = np.nonzero(alike >= LIKELY)
                    common = k[i : i + 32][x] == parts[own[y]]
                    first = common.argmax(axis=1)
                    ok = k[i : i + 32][x, first] == key[a] if len(x) else np.zeros(0, bool)
                    x, y = x[ok], y[ok]
                if len(x):
                    p, q = n[i : i + 32][x], node[own][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])


def _apart(large: DataFrame, ok: DataFrame, views: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """Likely pairs (a, b) of members of one large posting that the links ok leave in different components."""
    roots = components(ok).withColumnRenamed("node", "_node")
    own = materialize(large.join(roots, large.node == roots._node, "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")).distinct(), "own")
    each = own.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = materialize(own.join(each.filter("roots > 1").select("key", "main"), "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "mixed")
    asks = mixed.filter("root <> main").select("key", "node", "root", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("asks"))
    held = mixed.select("key", "node", "root", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("asks"))
    wanted = mixed.select("node").distinct()
    known = views.select("node", "keys").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("keys").alias("keys")).join(sets, "node")
    profiles = known.select("node", "shingles", "keys").mapInArrow(_profiles, "node long, sketch binary, parts binary")
    met = asks.unionAll(held).join(profiles, "node").repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.desc("asks"))
    return met.select("key", "chunk", "asks", "node", "root", "sketch", "parts").mapInArrow(lambda it: _across(it, best), "a long, b long").distinct()


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(node, id) per row, node a hash of id and text, and (a, b) links of nodes whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidates are SimHash links of the whole text and equal fingerprints of text parts: each of 24 parts holds the five
    shingles that come first in five random orders, so a pair at 0.8 shares one with probability 0.9999. Each candidate
    is verified on the exact sets of shingles. Members of a posting of more than WHOLE meet three pivots first; then
    members outside the posting's largest component are held against all others, CHUNK at a time, by sketches of 512
    bytes: first each one's likeliest pair is verified, then all pairs still in different components whose sketches say
    0.74 or more (a pair at 0.8 does with probability 0.999).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(F.xxhash64("id", "text").alias("node"), "id", "text")
    views = materialize(rows.mapInArrow(_views, "node long, id long, fp long, keys array<long>"), "views")
    nodes = materialize(views.groupBy("fp").agg(F.min("node").alias("rep"), F.max("node").alias("most")), "fpnode")
    same = views.select("node", "fp").join(nodes.filter("rep < most"), "fp")
    left, right = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    linked = links(nodes).join(left, "a").join(right, "b")
    found = _pairs(same, "node", "rep").unionAll(_pairs(linked, "ra", "rb"))
    index = views.select("node", F.explode("keys").alias("key"))
    sizes = materialize(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "posting")
    members = materialize(index.join(sizes, "key"), "members")
    lists = members.filter(F.col("n") <= WHOLE).groupBy("key").agg(F.collect_set("node").alias("s"))
    found = found.unionAll(lists.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b"))
    large = members.filter(F.col("n") > WHOLE)
    central = large.groupBy("node").agg(F.sum("n").alias("c"))  # texts in many large postings lie in the middle of a group
    drawn = (F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(2))
    pivots = large.join(central, "node").groupBy("key").agg(F.array(F.max_by("node", F.struct("c", "node")), *drawn).alias("p"))
    found = found.unionAll(_pairs(large.join(pivots, "key").select("node", F.explode("p").alias("p")), "node", "p"))
    found = materialize(found.distinct(), "pairs")
    wanted = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = rows.join(wanted.hint("merge"), "node", "left_semi").select("node", "text")
    sets = materialize(texts.mapInArrow(_packed_sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    ok = _verified(found, sets)
    if sizes.filter(F.col("n") > WHOLE).limit(1).count():
        likely = materialize(_apart(large, ok, views, sets, True).join(found, ["a", "b"], "left_anti"), "likely")
        ok = ok.unionAll(_verified(likely, sets))
        ok = ok.unionAll(_verified(_apart(large, ok, views, sets, False).join(found.unionAll(likely), ["a", "b"], "left_anti"), sets))
    return views.select("node", "id"), ok


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies: of each group of near_links() the row with the smallest id stays.

    A null id counts as larger than all others. Rows with the same id and text stay or go together. Two texts without
    words are equal.
    """
    rows, ok = near_links(docs, id_col, text_col)
    roots = components(ok)
    own = rows.distinct().join(roots, "node").select("root", "node", F.struct(F.col("id").isNull().alias("none"), "id", "node").alias("rank"))
    best = own.groupBy("root").agg(F.min("rank").alias("best"))
    dropped = own.join(best, "root").filter(F.col("node") != F.col("best.node")).select(F.col("node").alias("_drop"))
    node = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(dropped, node == dropped["_drop"], "left_anti")
