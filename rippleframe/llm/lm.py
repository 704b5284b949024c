"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Words fall into classes: the most frequent words of the corpus one each, all others by a hash. A small network sees the
classes of the two words on either side and predicts the class in between; a word in a shared class then has its share
of the class's occurrences in the corpus. The sum of these conditional log-probabilities scores a document.

Class tables come from counts over all documents; the counts of all words stay a partitioned table, which the words of
the documents are joined with. Texts become byte strings of classes, dealt by a hash to blocks of about BLOCK_WORDS words
and ordered inside a block, so that training depends on the rows alone and not on how they lie in partitions or which
executors were lost. The network is trained in rounds: each block starts from the shared weights and takes gradient
steps over every ROUNDS-th place of its documents, other places each round, so that every place is a target once; the
blocks' weights are averaged, weighted by their places, as whole numbers, whose sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_LOWER, Words, keep_pages, materialize, slices, word_hashes

FREQUENT, HASHED, SIDE, WIDTH, HIDDEN = 191, 64, 2, 12, 24
#: The last class stands beyond the ends of a text.
EDGE = FREQUENT + HASHED
CLASSES = EDGE + 1
ROUNDS, BATCH, RATE = 2, 2048, 0.5
BLOCK_WORDS, RUN_WORDS = 2_000_000, 1 << 16
#: Weights are averaged as multiples of 2**-24, shares of words as multiples of 2**-30.
FINE, SHARE = float(1 << 24), float(1 << 30)
_LINE = 1024
_ONES = np.ones(CLASSES, np.float32)
_CELL = np.arange(CLASSES * WIDTH).reshape(CLASSES, WIDTH)


@dataclass
class Network:
    embed: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, prior: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return cls(draw(CLASSES, WIDTH), draw(2 * SIDE * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), np.zeros((HIDDEN, CLASSES), np.float32), np.log(prior).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.hidden, self.hidden_bias, self.out, self.out_bias)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for shape in ((CLASSES, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)):
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return cls(*parts)

    def table(self) -> np.ndarray:
        """What each class adds to the hidden layer from each side position."""
        return np.stack([self.embed @ self.hidden[j * WIDTH : (j + 1) * WIDTH] for j in range(2 * SIDE)])

    def _layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden layer of its inputs x with a column of ones, and the classes' sums with their biases."""
        h = np.ones((len(x), HIDDEN + 1), np.float32)
        np.tanh(x, out=h[:, :HIDDEN])
        z = h @ np.vstack([self.out, self.out_bias])
        return h, z

    def log_probs(self, context: np.ndarray, target: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        table = self.table() if table is None else table
        x = self.hidden_bias + table[0].take(context[:, 0], axis=0)
        for j in range(1, 2 * SIDE):
            x += table[j].take(context[:, j], axis=0)
        _, z = self._layers(x)
        own = z[np.arange(len(target)), target]
        top = self._top(z)
        np.exp(z, out=z)
        return own - top - np.log(z @ _ONES)

    def _top(self, z: np.ndarray) -> np.ndarray | float:
        """Takes each row's maximum off z where the weights do not bound z well inside float32's exponents."""
        if float(np.abs(self.out).sum(axis=0).max() + np.abs(self.out_bias).max()) < 60:
            return 0.0
        top = z.max(axis=1)
        z -= top[:, None]
        return top

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        n, at = len(target), context.ravel()
        x = self.embed.take(at, axis=0).reshape(n, -1)
        h, z = self._layers(x @ self.hidden + self.hidden_bias)
        self._top(z)
        np.exp(z, out=z)
        total = z @ _ONES
        z[np.arange(n), target] -= total
        scale = (1 / (n * total))[:, None]  # by which a row of z is the gradient; the narrow factors take it
        own = h[:, :HIDDEN]
        dh = (z @ self.out.T) * (scale * (1 - own * own))
        dx = dh @ self.hidden.T
        h *= scale
        out = (z.T @ h).T
        self.out -= rate * out[:HIDDEN]
        self.out_bias -= rate * out[HIDDEN]
        self.hidden -= rate * (x.T @ dh)
        self.hidden_bias -= rate * dh.sum(axis=0)
        self.embed -= rate * np.bincount(_CELL.take(at, axis=0).ravel(), dx.ravel(), CLASSES * WIDTH).reshape(CLASSES, WIDTH).astype(np.float32)


@dataclass
class Vocabulary:
    """Hashes of the frequent words, the occurrences of each class and their smoothed shares."""

    frequent: np.ndarray
    total: np.ndarray
    prior: np.ndarray
    order: np.ndarray = field(init=False)
    maybe: np.ndarray = field(init=False)

    def __post_init__(self):
        self.order = np.argsort(self.frequent)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.frequent >> np.uint64(48)] = True

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        out = FREQUENT + (hashes >> np.uint64(33)).astype(np.int64) % HASHED
        held, at = self.frequent[self.order], np.flatnonzero(self.maybe[hashes >> np.uint64(48)])
        if len(at):
            i = np.minimum(np.searchsorted(held, hashes[at]), len(held) - 1)
            same = held[i] == hashes[at]
            out[at[same]] = self.order[i[same]]
        return out


def build_vocabulary(rows: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """From counts of every word of rows (id, text); also the table (h, n) of these counts."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, n, len(u)).astype(np.int64)

        size = 0
        for batch in it:
            for part in slices(batch, "text"):
                u, n = np.unique(word_hashes(Words(part.column("text"), WS_LOWER)), return_counts=True)
                held.append((u, n))
                size += len(u)
                if size > 2_000_000:  # keep the task's memory bounded
                    u, n = merged()
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])
                    held, size = [], 0
        if held:
            u, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])

    words = materialize(rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    top = words.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    frequent = np.array([r.h for r in top], np.int64).view(np.uint64)
    rest = words.groupBy(F.pmod(F.shiftrightunsigned("h", 33), F.lit(HASHED)).alias("c")).agg(F.sum("n").alias("n")).collect()
    total = np.zeros(CLASSES)
    for r in rest:
        total[FREQUENT + r.c] = r.n
    for i, r in enumerate(top):
        total[FREQUENT + (r.h % 2**64 >> 33) % HASHED] -= r.n
        total[i] = r.n
    prior = (total + 0.5) / (total + 0.5).sum()
    return Vocabulary(frequent, total, prior), words


def class_rows(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(block, row, id, classes) of rows (id, text, row): a byte a word, sorted by block, row, id and classes."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        for batch in it:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), WS_LOWER)
                own = shared.value.classes(word_hashes(w)).astype(np.uint8).tobytes()
                first = w.first.tolist()
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array([own[a:b] for a, b in zip(first, first[1:], strict=False)], pa.binary())], ["row", "id", "classes"])

    blocks = max(1, round(float(vocabulary.total.sum()) / BLOCK_WORDS))
    out = rows.select("row", "id", "text").mapInArrow(run, "row long, id long, classes binary").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return materialize(out.repartition("block").sortWithinPartitions("block", "row", "id", "classes"), "classes")


def _contexts(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The classes of each place's neighbours, EDGE beyond the ends of a text."""
    n = len(own)
    context = np.full((2 * SIDE, n), EDGE, np.int64).T  # a side's neighbours lie together
    for j, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -d), n - max(0, d)
        if b > a:
            same = doc[a:b] == doc[a + d : b + d]
            context[a:b, j][same] = own[a + d : b + d][same]
    return context


def _joined(classes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all places of some texts and the number of each place's text."""
    own = np.frombuffer(b"".join(classes), np.uint8).astype(np.int64)
    return own, np.repeat(np.arange(len(classes)), [len(c) for c in classes])


def targets(n: int, r: int, rounds: int = ROUNDS) -> Iterator[slice]:
    """The places of a run of n words that round r trains on, in batches; over all rounds every place once."""
    for a in range(0, n, BATCH * rounds):
        if a + r < n:
            yield slice(a + r, a + BATCH * rounds, rounds)


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Trains on class_rows(): each round every rounds-th place of all documents is a target, others each round."""
    flat = Network.start(vocabulary.prior).flat()
    for r in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(flat)  # fixed size

        def run(it: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            keep_pages()
            sums, places = np.zeros(len(shared.value), object), 0  # whole numbers of any size
            net, seen, block, held, words = None, 0, None, [], 0

            def steps():
                nonlocal seen, held, words
                own, doc = _joined(held)
                context = _contexts(own, doc)
                for at in targets(len(own), r, rounds):
                    net.step(context[at], own[at], RATE / (1 + r))
                    seen += len(own[at])
                held, words = [], 0

            def closed():
                nonlocal places
                if held:
                    steps()
                if seen:
                    sums[:] += np.rint(net.flat().astype(np.float64) * FINE).astype(np.int64).astype(object) * seen
                    places += seen

            for batch in it:
                for b, classes in zip(batch.column("block").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                    if b != block:
                        if block is not None:
                            closed()
                        net, seen, block, held, words = Network.of(shared.value), 0, b, [], 0
                    held.append(classes)
                    words += len(classes)
                    if words >= RUN_WORDS:
                        steps()
            if block is not None:
                closed()
            if places:
                lines = [sums[a : a + _LINE].tolist() for a in range(0, len(sums), _LINE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), pa.array([places] * len(lines), pa.int64()), pa.array([[str(x) for x in line] for line in lines], pa.list_(pa.string()))], ["line", "places", "sums"])

        whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        parts = texts.select("block", "classes").mapInArrow(run, "line int, places long, sums array<string>")
        means = parts.select("line", "places", F.posexplode("sums").alias("at", "v")).groupBy("line", "at").agg(whole("v").alias("v"), F.sum("places").alias("n")).orderBy("line", "at").collect()  # one row a weight
        if means:
            flat = np.array([int(m.v) / m.n / FINE for m in means], np.float32)
    return Network.of(flat)


def _rare(rows: DataFrame, words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, rare): of each row's words in shared classes the summed log of their share of the class's occurrences.

    Rows of equal id and text share a value of row, over which the sum is divided by their number.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        for batch in it:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), WS_LOWER)
                h, doc = word_hashes(w), w.doc()
                at = shared.value.classes(h) >= FREQUENT
                h, doc = h[at], doc[at]
                bits = np.uint64(max(1, len(part).bit_length()))
                order = np.argsort(doc.astype(np.uint64) << (np.uint64(64) - bits) | h >> bits)  # words that meet here may split a count, whose parts add up
                h, doc = h[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
                k = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(doc[first])), pa.array(h[first].view(np.int64)), pa.array(k.astype(np.int32))], ["row", "h", "k"])

    total = F.array(*(F.lit(float(x)) for x in np.log(np.maximum(vocabulary.total[FREQUENT:EDGE], 1))))
    share = words.select("h", (F.log("n") - F.element_at(total, (F.pmod(F.shiftrightunsigned("h", 33), F.lit(HASHED)) + 1).cast("int"))).cast("float").alias("share"))
    uses = rows.mapInArrow(run, "row long, h long, k int")
    part = F.rint(F.col("k") * F.col("share").cast("double") * SHARE).cast("long")  # whole numbers add up alike in any order
    return uses.join(share.hint("merge"), "h").groupBy("row").agg((F.sum(part) / SHARE).alias("rare"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, mean_log_likelihood) per row of docs.

    Words are lower-cased (A-Z) runs without ASCII white space. Scores have four digits: the network's part of a text is
    added up from single-precision numbers, whose last digits depend on the batch a text is scored in. Null or wordless texts score 0.0 with a null mean.
    Repeated rows each get a row; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("id", "text"))
    vocabulary, words = build_vocabulary(rows.select("text"))
    texts = class_rows(rows, vocabulary)
    net = train(texts, vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast(net.flat())  # fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        net = Network.of(shared.value)
        table = net.table()
        for batch in it:
            for part in slices(batch, "classes", 1 << 19):
                classes = part.column("classes").to_pylist()
                own, doc = _joined(classes)
                context = _contexts(own, doc)
                lp = np.concatenate([net.log_probs(context[a : a + 1024], own[a : a + 1024], table) for a in range(0, len(own), 1024)]) if len(own) else np.zeros(0)
                score = np.bincount(doc, lp.astype(np.float64), len(classes))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array([len(c) for c in classes], pa.int64()), pa.array(np.round(score, 4))], ["row", "id", "n_words", "score"])

    scored = texts.select("row", "id", "classes").mapInArrow(run, "row long, id long, n_words long, score double")
    rare = _rare(rows, words, vocabulary).withColumnRenamed("row", "_row")
    times = F.count("*").over(Window.partitionBy("row"))
    both = scored.withColumn("times", times).join(rare, F.col("row") == F.col("_row"), "left")
    log = F.round(F.col("score") + F.coalesce(F.col("rare") / F.col("times"), F.lit(0.0)), 4)
    return both.select("id", "n_words", log.alias("log_likelihood")).withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
