"""Toxic passages by maximum-scoring segments.

Token scores are log-odds of document counts between toxic and clean training documents under an informative Dirichlet
prior (the pooled counts; Monroe, Colaresi and Quinn, 2008); whole words and their beginnings are tokens. Tokens
without a significant score get a small negative one. A linear-time scan (Ruzzo and Tompa, 1999) finds all maximal
scoring segments of a text. Their scores follow an extreme-value law for clean text (Karlin and Altschul, 1990), whose
two parameters come from the clean training documents; a document's evidence is the sum of its segments' normalised
scores, and a logistic curve fitted on the training documents turns it into a score from 0 to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, slices

HEADS = (4, 5, 6, 7, 8)
#: Labelled documents a model is fitted on at most (about; chosen by a hash of the id).
TRAIN_ROWS = 30_000
MIN_DOCS, MIN_ODDS, MIN_Z, TOP, REST = 3, 1.0, 4.0, 6.0, -0.1


def _tokens(words) -> set[bytes]:
    out = set(words)
    for w in list(out):
        for k in HEADS:
            if len(w) > k:
                out.add(w[:k] + b"~")
    return out


@dataclass
class Model:
    scores: dict[bytes, float]
    scale: float = 1.0  # lambda of the extreme-value law
    factor: float = 1.0  # K of the extreme-value law
    bias: float = -4.0
    slope: float = 0.0

    def __post_init__(self):
        self.starts = {t.rstrip(b"~")[:4] for t in self.scores}

    def token(self, w: bytes) -> float:
        s = self.scores
        return max(s.get(w, 0.0), *(s.get(w[:k] + b"~", 0.0) if len(w) > k else 0.0 for k in HEADS))

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Maximal scoring segments (start, end, score) in order."""
        starts = self.starts
        hits = [(i, s) for i, w in enumerate(words) if w[:4] in starts and (s := self.token(w)) > 0]
        return maximal_segments(hits)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        base = math.log(self.factor * max(n, 1))
        return sum(max(0.0, self.scale * s - base) for _, _, s in segments)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(evidence)))))


def maximal_segments(hits: list[tuple[int, float]], rest: float = REST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence with the given positive scores and rest elsewhere (Ruzzo and Tompa).

    Each candidate keeps the sums before its left end and up to its right end; a new one is merged into the last
    candidate that starts lower, as long as that one does not also end higher.
    """
    found: list[list] = []  # start, end, sum before, sum up to
    total, last = 0.0, 0
    for i, s in hits:
        total += rest * (i - last)
        new = [i, i + 1, total, total + s]
        total, last = total + s, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge."""
    w, design = np.zeros(2), np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + np.array([0.0, 0.01]) * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-9, 0.01])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on docs (id, text) and labels (id, toxic); rows without a 0 or 1 label are left out.

    Repeated texts count once, so that groups of copies do not make their own words look toxic.
    """
    labels = labels.filter("toxic in (0, 1) and id is not null")
    n = labels.count()
    if n > train_rows:
        share = int(train_rows / n * 1_000_000)
        labels = labels.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    sample = docs.join(F.broadcast(labels), "id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))  # labels: about train_rows rows at most
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, "text", 1 << 23):
                held: dict[bytes, list[int]] = {}
                docs_of = [0, 0]
                for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    docs_of[y] += 1
                    for t in _tokens(text.encode().translate(ALNUM_LOWER).split()):
                        held.setdefault(t, [0, 0])[y] += 1
                held[b""] = docs_of
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["token", "clean", "toxic"])

    counts = sample.mapInArrow(count, "token binary, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = counts.filter((F.col("toxic") >= MIN_DOCS) | (F.length("token") == 0)).collect()  # tokens of toxic documents of the bounded sample
    size = next(((r.clean, r.toxic) for r in rows if not r.token), (0, 0))
    clean, toxic = size
    if not clean or not toxic:
        return Model({})
    prior = (clean + toxic) / 4  # pseudo-documents
    scores: dict[bytes, float] = {}
    for r in rows:
        if r.token:
            a = prior * (r.toxic + r.clean) / (clean + toxic)
            odds = math.log((r.toxic + a) / max(0.5, toxic + prior - r.toxic - a)) - math.log((r.clean + a) / max(0.5, clean + prior - r.clean - a))
            z = odds / math.sqrt(1 / (r.toxic + a) + 1 / (r.clean + a))
            if odds > MIN_ODDS and z > MIN_Z:
                scores[bytes(r.token)] = min(odds, TOP)
    model = Model(scores)
    if not scores:
        return model

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = text.encode().translate(ALNUM_LOWER).split()
                segments = model.segments(words)
                hits = [x for w in words if w[:4] in model.starts and (x := model.token(w)) > 0] if segments else []
                out.append({"toxic": y, "n": len(words), "hits": hits, "segments": [s for _, _, s in segments]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("hits", pa.list_(pa.float64())), ("segments", pa.list_(pa.float64()))]))

    seen = sample.mapInArrow(best, "toxic int, n long, hits array<double>, segments array<double>").collect()  # one small row a document of the bounded sample
    null = [r for r in seen if not r.toxic]
    words = max(sum(r.n for r in null), 1)
    hits = np.array([x for r in null for x in r.hits] or [float(np.median(list(scores.values())))])
    low, high = 1e-6, 50.0  # lambda: the mean of e^(lambda score) over the words of clean documents is 1
    for _ in range(100):
        mid = (low + high) / 2
        if np.exp(np.minimum(700, mid * hits)).sum() + (words - len(hits)) * math.exp(mid * REST) > words:
            high = mid
        else:
            low = mid
    model.scale = low
    best_of = np.array([max(r.segments, default=0.0) for r in null])
    least = float(np.median(best_of[best_of > 0])) if (best_of > 0).any() else min(scores.values())
    model.factor = max(int((best_of >= least).sum()), 0.5) / max(sum(r.n for r in null) * math.exp(-low * least), 1e-12)
    x = np.array([math.log1p(model.evidence([(0, 0, s) for s in r.segments], r.n)) for r in seen])
    model.bias, model.slope = _fit_logistic(x, np.array([r.toxic for r in seen], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score, passages) for docs (id, text); passages: word spans with their p-values, significant ones only.

    A null or wordless text has no passage; its score is the curve's lowest value.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # significant tokens of the bounded sample

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in it:
            for part in slices(batch, "text", 1 << 22):
                scores, passages = [], []
                for text in part.column("text").to_pylist():
                    words = (text or "").encode().translate(ALNUM_LOWER).split()
                    segments = m.segments(words) if m.scores else []
                    base = math.log(m.factor * max(len(words), 1))
                    scores.append(m.score(m.evidence(segments, len(words))))
                    passages.append([{"start": a, "end": b, "p": -math.expm1(-math.exp(base - m.scale * s))} for a, b, s in segments if m.scale * s > base])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["id", "score", "passages"])

    return docs.mapInArrow(run, "id long, score double, passages array<struct<start:int,end:int,p:double>>")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def known(labels: DataFrame) -> DataFrame:
    """(id, toxic) of the rows that may be learned from."""
    return labels.filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))


def toxic_rows(docs: DataFrame, labels: DataFrame, key: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The values of docs' long column key whose texts score 0.5 or more; the rest as score_documents()."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), known(labels), train_rows)
    scored = score(docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")), model)
    return scored.filter("score >= 0.5").select(F.col("id").alias(key)).distinct()


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages), one row per row of docs; fitted on labels outside the held-out rows.

    Empty tables, null texts and null labels are allowed; without both classes every score is near 0. Extra columns
    are ignored and repeated rows each get a row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    out = score(rows, fit(rows, known(labels), train_rows))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
