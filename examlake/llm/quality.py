"""Quality classifier: random-indexing vectors pooled per document, and a two-layer network.

Every word, and every word shape (its runs of letters, capitals, digits and signs), is a unit. The most frequent words,
``VOCABULARY`` at most, have a vector of their own; all other words share ``BUCKETS`` vectors by hash. A unit's context
vector is the sum of the sparse random index vectors (``SIGNS`` entries of 1 or -1 in ``DIMS``) of the units up to two
words away, over all documents; each task sums its own, and the sums are added by blocks of units, a fixed number at a
time. So the vectors cover the whole corpus, while their size is set by the parameters. A document is the weighted mean
and spread of its units' vectors. The network is trained on the driver, on at most ``PER_CLASS`` documents of each
label, and its temperature is fitted on a fifth of each label's (on all where a label has under five).

Defined cases: null text is the empty text, which has a score like any other; with no labels, or one kind only,
every score is the share of label 1 (0.5 without labels); any number of labels of both kinds is learned from; repeated
rows score alike; an empty table gives an empty result; labels, languages, sources and ids are no inputs; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added_up, bounded_batches, narrow, packed, released, slices, stored, texts, unpacked
from .labelled import class_weights, fifths, labelled_sample, sigmoid, temperature
from .words import seeded, shape_hashes, word_spans

VOCABULARY, BUCKETS, SHAPES = 1 << 16, 1 << 14, 1 << 10
DIMS, SIGNS = 64, 4
BLOCK = 256
STRETCH = 1 << 16
#: distinct words that a task holds before it passes their counts on
HELD = 500_000
PER_CLASS = 6000
HIDDEN, DECAY = 32, 1e-3
THRESHOLD = 0.7


class Units:
    """The numbers of words and shapes: words of the vocabulary first, then buckets of other words, then shapes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.sort(words)
        self.size = len(words) + BUCKETS + SHAPES

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, shapes, offsets) of all texts."""
        data, starts, ends, hashes, offsets = word_spans(column, lower=False)
        shape = shape_hashes(data, starts, ends) if len(hashes) else hashes
        n = len(self.words)
        word = n + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        if n:
            place = np.minimum(np.searchsorted(self.words, hashes), n - 1)
            word = np.where(self.words[place] == hashes, place, word)
        return word, n + BUCKETS + (shape % np.uint64(SHAPES)).astype(np.int64), offsets

    def index_vectors(self) -> np.ndarray:
        """The index vector of each unit, by hash of the word or number: one sign in each of as many parts."""
        key = np.concatenate([self.words, np.arange(BUCKETS + SHAPES, dtype=np.uint64)])
        out, part = np.zeros((len(key), DIMS), np.int8), DIMS // SIGNS
        for k in range(SIGNS):
            h = seeded(key, k + 1)
            out[np.arange(len(key)), k * part + (h % np.uint64(part)).astype(np.int64)] = np.where(h >> np.uint64(63), 1, -1)
        return out


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's words, distinct within what it holds."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(place, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

    def batch() -> pa.RecordBatch:
        words, n = merged()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    for b in slices(batches):
        held.append(np.unique(word_spans(b.column("text"), lower=False)[3], return_counts=True))
        if sum(len(w) for w, _ in held[1:]) > max(100_000, len(held[0][0])):
            held = [merged()]
            if len(held[0][0]) > HELD:
                yield batch()
                held = []
    if held:
        yield batch()


def vocabulary(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, as many classes of counts as hold ``VOCABULARY`` words at most."""
    counts = texts(docs).select("text").mapInArrow(released(_word_counts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.select("word", F.floor(F.log2("n") * 8).cast("int").alias("level")), "words")
    levels, kept, lowest = {r.level: r["count"] for r in counts.groupBy("level").count().collect()}, 0, 1 << 30
    for level in sorted(levels, reverse=True):
        kept += levels[level]
        if kept > VOCABULARY:
            break
        lowest = level
    some = counts.where(F.col("level") >= lowest).select("word").toArrow().column("word").to_numpy()
    return np.sort(np.ascontiguousarray(some).view(np.uint64))


def _contexts(units: Units):
    """Tasks over texts: sums of the index vectors around each unit, and how often it stands, by blocks of units."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, seen = units.index_vectors(), np.zeros((units.size, DIMS), np.int64), np.zeros(units.size, np.int64)
        for b in slices(batches):
            word, shape, offsets = units.of(b.column("text"))
            doc = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            for low in range(0, len(word), STRETCH):
                high = min(len(word), low + STRETCH)
                # two words more on either side are context alone
                left, right = max(0, low - 2), min(len(word), high + 2)
                own, whose = index[word[left:right]] + index[shape[left:right]], doc[left:right]
                around = np.zeros((right - left, DIMS), np.int8)
                for step in (1, 2):
                    same = (whose[step:] == whose[:-step])[:, None]
                    around[step:] += own[:-step] * same
                    around[:-step] += own[step:] * same
                around = around[low - left : high - left]
                for unit in (word[low:high], shape[low:high]):
                    order = np.argsort(unit, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], unit[order][1:] != unit[order][:-1]]))
                    total[unit[order][first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
                    seen[unit[order][first]] += np.diff(np.append(first, len(unit)))
        for at in range(0, units.size, BLOCK):
            rows = np.flatnonzero(seen[at : at + BLOCK])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([_sums(rows, total[at + rows], seen[at + rows])])], names=["block", "sums"])

    return run


def _sums(rows: np.ndarray, total: np.ndarray, seen: np.ndarray) -> bytes:
    return packed(narrow(rows), narrow(seen), narrow(total.ravel()))


def _dense(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, seen, total = unpacked(data)
    out, n = np.zeros((BLOCK, DIMS), np.int64), np.zeros(BLOCK, np.int64)
    out[rows], n[rows] = total.reshape(-1, DIMS), seen
    return out, n


def _add(rows: pa.Table) -> pa.Table:
    total, seen = (sum(x) for x in zip(*(_dense(x.as_py()) for x in rows.column("sums")), strict=True))
    there = np.flatnonzero(seen)
    return pa.table({"block": rows.column("block")[:1], "source": rows.column("source")[:1], "sums": pa.array([_sums(there, total[there], seen[there])])})


def word_vectors(docs: DataFrame) -> tuple[Units, np.ndarray, np.ndarray]:
    """(units, vectors, weights): vectors of unit length by random indexing over all ``docs``, and the units' weights in a mean."""
    bounded_batches(docs.sparkSession)
    units = Units(vocabulary(docs))
    sent = docs.sparkSession.sparkContext.broadcast(units)
    parts = texts(docs).select("text").mapInArrow(released(lambda batches: _contexts(sent.value)(batches)), "block int, sums binary")
    added = added_up(parts.withColumn("source", F.spark_partition_id()), "block", _add, "block int, source int, sums binary", "contexts")
    vectors, seen = np.zeros((units.size + BLOCK, DIMS), np.float32), np.zeros(units.size + BLOCK)
    for r in added.select("block", "sums").toLocalIterator():
        total, n = _dense(bytes(r.sums))
        vectors[r.block * BLOCK : (r.block + 1) * BLOCK], seen[r.block * BLOCK : (r.block + 1) * BLOCK] = np.sign(total) * np.log1p(np.abs(total)), n
    vectors, seen = vectors[: units.size], seen[: units.size]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = seen / max(seen.sum() / 2, 1)
    return units, vectors, (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(column: pa.Array, units: Units, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of features per text: means and spreads of its units' vectors, and its length."""
    word, shape, offsets = units.of(column)
    out = np.zeros((len(column), 4 * DIMS + 1), np.float32)
    count = np.diff(offsets)
    # sums by text, over stretches of words so that one very long text needs no more memory than others
    for low in range(0, len(word), STRETCH):
        stop = min(len(word), low + STRETCH)
        doc = np.searchsorted(offsets, np.arange(low, stop), "right") - 1
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for k, ids in enumerate((word[low:stop], shape[low:stop])):
            v = vectors[ids] * weights[ids][:, None]
            out[doc[edges], k * DIMS : (k + 1) * DIMS] += np.add.reduceat(v, edges, axis=0)
            out[doc[edges], (k + 2) * DIMS : (k + 3) * DIMS] += np.add.reduceat(v * v, edges, axis=0)
    out[:, :-1] /= np.maximum(count, 1)[:, None]
    out[:, 2 * DIMS : -1] = np.sqrt(np.maximum(out[:, 2 * DIMS : -1] - out[:, : 2 * DIMS] ** 2, 0))
    out[:, -1] = np.log1p(count)
    return out


class Network:
    """Features, standardised, to one hidden layer of rectified units and a logit, with a temperature."""

    def __init__(self, constant: float | None = None) -> None:
        self.constant, self.t = constant, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> None:
        rng = np.random.default_rng(7)
        calibrate, train = fifths(y, rng)
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(rounds):
            rng.shuffle(train)
            for at in range(0, len(train), 128):
                i = train[at : at + 128]
                hidden = np.maximum(z[i] @ p[0] + p[1], 0)
                error = (sigmoid(hidden @ p[2] + p[3]) - y[i]) * weight[i] / len(i)
                back = np.outer(error, p[2]) * (hidden > 0)
                grads = [z[i].T @ back + DECAY * p[0], back.sum(0), hidden.T @ error + DECAY * p[2], np.array([error.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        self.t = temperature(self.logit(x[calibrate]), y[calibrate], weight[calibrate])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else sigmoid(self.logit(x) / self.t)


def train(docs: DataFrame, labels: DataFrame, label: str, held: Column) -> tuple[Network, Units, np.ndarray, np.ndarray]:
    """(network, *vectors): vectors from all documents, the network from labelled ones that are not ``held``."""
    vectors = word_vectors(docs)
    sample, counts = labelled_sample(docs, labels, label, held, PER_CLASS)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pooled(b.column("text"), *sent.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = sorted(sample.select("doc_id", "y", "text").mapInArrow(released(features), "doc_id long, y int, x binary").collect(), key=lambda r: (r.doc_id, r.y))
    y = np.array([r.y for r in rows])
    if not len({*y.tolist()}) > 1:
        total = sum(counts.values())
        return Network(counts.get(1, 0) / total if total else 0.5), *vectors
    network = Network()
    network.fit(np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64), y, class_weights(y, counts))
    return network, *vectors


def score(docs: DataFrame, labels: DataFrame, label: str, held: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document; ``held`` is a condition on ``doc_id``."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, held))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, *vectors = sent.value
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(network.score(pooled(b.column("text"), *vectors)))], names=["doc_id", "score"])

    made = texts(docs).mapInArrow(released(run), "doc_id long, score double")
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
