"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is made of four hashed parts: of the whole word and of its first four, five and six bytes, so that
inflected forms share what their stems have learned. Filters over one, two and three words run along the whole text;
each gives its largest value; a logit is a weighted sum of those. It is trained on every labelled document, whole texts
of any length, dealt by hash of the id into blocks of about ``BLOCK`` documents: in an epoch each block goes on from the
same network by itself, and what the blocks changed is averaged, an embedding over those that touched it. Embeddings
start from the smoothed log-odds of their bucket, zero for buckets not seen. Changes and counts are added up as whole
numbers, so their order does not matter. Scoring reads every text whole, in stretches of bounded size whose largest
values are combined.

Thresholds are calibrated by language on a fifth of the labelled documents, by hash of the id, which is not trained on, or on all where a label has
under five or one of the parts has none; logits are counted in steps of 1 / ``FINE``. The language is one that a small model of word
buckets reads off the text itself, learned from the same documents; the ``lang`` column is no input of a score. A
document's logit is taken from its language's threshold, so that 0.5 is the threshold in each language.

Defined cases: null text is the empty text, which has a score like any other; with no labels, or one kind only, every
score is the share of label 1 (0 without labels), and ``accept`` keeps every row, as nothing tells them apart; any
number of labels of both kinds is learned from; repeated rows score alike; an empty table gives an empty result;
labels, sources and ids are no inputs; other columns are not looked at.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed, released, slices, stored, texts, unpacked
from .labelled import known_labels, sigmoid, temperature
from .words import span_hashes, word_spans

PARTS, BUCKETS, DIMS = 4, 1 << 17, 4
WIDTHS, FILTERS = (1, 2, 3), 16
STRETCH = 1 << 16
EPOCHS = 6
#: documents, about, and words, at most but for one text, that a task trains on between two averages
BLOCK, BLOCK_WORDS = 4096, 1 << 19
#: steps of logits that are counted alike, and of changes, to tables and to the rest, that are added up as whole numbers
FINE, COARSE, UNIT = 1 << 12, 2.0**20, 2.0**36
#: labelled ids, at most, that are broadcast to the documents; more are joined by a shuffle
SENT = 1 << 22


def word_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): for each word its bucket in each of the four tables."""
    data, starts, ends, hashes, offsets = word_spans(column)
    out = np.empty((len(starts), PARTS), np.int32)
    out[:, 0] = hashes % np.uint64(BUCKETS)
    if len(starts):
        for k, made in enumerate(span_hashes(data, starts, [ends, *(np.minimum(starts + n, ends) for n in (4, 5, 6))])[1:]):
            out[:, k + 1] = made % np.uint64(BUCKETS)
    return out, offsets


class ConvNet:
    """Embedding tables, filters and a logit; and what calibrates it."""

    def __init__(self, constant: float | None = None) -> None:
        self.constant = constant
        rng = np.random.default_rng(11)
        self.tables = np.zeros((PARTS, BUCKETS + 1, DIMS), np.float32)
        self.filters = [rng.normal(0, (1 / (w * PARTS * DIMS)) ** 0.5, (w * PARTS * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.out_bias = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0
        self.t, self.default, self.thresholds = 1.0, 0.0, {}
        self.langs: list[str] = []
        self.lang_weights = np.zeros((BUCKETS, 0), np.float32)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        # an embedding of a part is as wide as a complex number, and such are taken faster than rows
        out = np.empty((len(ids), PARTS), np.complex128)
        for k in range(PARTS):
            out[:, k] = self.tables[k].view(np.complex128)[ids[:, k], 0]
        return out.view(np.float32)

    def maxima(self, ids: np.ndarray, offsets: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest value of each filter in each text, 0 at least; and, if asked, the word where it begins."""
        n, size, most = len(offsets) - 1, PARTS * DIMS, len(WIDTHS) * FILTERS
        top = np.zeros((n, most), np.float32)
        place = np.full(top.shape, -1, np.int64) if where else None
        bias = np.concatenate(self.bias)
        # one product for all filters: what is taken of the first word, of the second by the filters that have one, and so on
        weights = np.concatenate([f[step * size : (step + 1) * size].T for step in range(max(WIDTHS)) for width, f in zip(WIDTHS, self.filters, strict=True) if step < width])
        for low in range(0, len(ids), STRETCH):
            high = min(len(ids), low + STRETCH)
            made = weights @ self.embed(ids[low : high + max(WIDTHS) - 1]).T
            doc = np.searchsorted(offsets, np.arange(low, high), "right") - 1
            edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            left = offsets[doc + 1] - np.arange(low, high)  # words of the text from here on
            value, at = made[:most, : high - low], most
            for step in range(1, max(WIDTHS)):
                skip = sum(width <= step for width in WIDTHS) * FILTERS
                more = made[at : at + most - skip, step : high - low + step]
                more[:, np.flatnonzero(left[: more.shape[1]] <= step)] = 0
                value[skip:, : more.shape[1]] += more
                at += most - skip
            whose, best = doc[edges], np.maximum.reduceat(value, edges, axis=1).T + bias
            if where:
                better = best > top[whose]
                stop = np.append(edges[1:], high - low)
                for e in np.flatnonzero(better.any(1)):
                    place[whose[e]] = np.where(better[e], low + edges[e] + value[:, edges[e] : stop[e]].argmax(1), place[whose[e]])
            top[whose] = np.maximum(top[whose], best)
        return top, place

    def logits(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.maxima(ids, offsets)[0] @ self.out + self.out_bias

    def languages(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of each text's likeliest language, -1 where none is known."""
        n = len(offsets) - 1
        if not self.langs:
            return np.full(n, -1)
        total = np.zeros((n, len(self.langs)))
        for low in range(0, len(ids), STRETCH):
            high = min(len(ids), low + STRETCH)
            doc = np.searchsorted(offsets, np.arange(low, high), "right") - 1
            edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            total[doc[edges]] += np.add.reduceat(self.lang_weights[ids[low:high, 0]], edges, axis=0)
        return np.where(np.diff(offsets) > 0, total.argmax(1), -1)

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        limit = np.array([*(self.thresholds.get(x, self.default) for x in range(len(self.langs))), self.default])
        return sigmoid((self.logits(ids, offsets) - limit[self.languages(ids, offsets)]) / self.t)


def _gather(docs: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = [docs[r] for r in rows]
    return np.concatenate([np.zeros((0, PARTS), np.int32), *some]), np.concatenate([[0], np.cumsum([len(x) for x in some])])


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, which): the distinct rows of ``ids``, and for each row which of them it is."""
    _, which = np.unique(ids[:, 0].astype(np.int64) * BUCKETS + ids[:, 1], return_inverse=True)
    _, first, which = np.unique((which.astype(np.int64) * BUCKETS + ids[:, 2]) * BUCKETS + ids[:, 3], return_index=True, return_inverse=True)
    return ids[first], which.astype(np.int32)


def _blocks(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(data, langs, t0, t1, c0, c1): the labelled documents in blocks, one row each, their number by fold and label; of an id's rows one is taken, by hash of the text."""
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), lang.alias("lang"))
    k = -(-n // BLOCK) or 1
    rows = text.join(F.broadcast(known) if n <= SENT else known, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(k))).withColumn("fold", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0).cast("int"))
    rows = rows.repartition(k, "block").sortWithinPartitions("block", "doc_id", F.xxhash64("text", "lang"), "text", "lang").select("block", "doc_id", "y", "fold", "lang", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        last, now, words = None, None, 0

        def row() -> pa.RecordBatch:
            parts, y, fold, langs = zip(*own, strict=True)
            ids, y, fold = np.concatenate(parts), np.array(y, np.int32), np.array(fold, np.int32)
            words, which = _distinct(ids)
            data = packed(np.array([len(x) for x in parts], np.int64), y, fold, which, *(words[:, k] for k in range(PARTS)))
            counts = [pa.array([int(((fold == f) & (y == v)).sum())], pa.int64()) for f in (0, 1) for v in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([list(langs)], pa.list_(pa.string())), *counts], names=["data", "langs", "t0", "t1", "c0", "c1"])

        for b in slices(batches):
            ids, offsets = word_parts(b.column("text"))
            for i, (block, doc, y, fold, lang) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "doc_id", "y", "fold", "lang")), strict=True)):
                if doc == last:
                    continue
                if own and (block != now or words > BLOCK_WORDS):
                    yield row()
                    own, words = [], 0
                last, now, words = doc, block, words + int(offsets[i + 1] - offsets[i])
                own.append((ids[offsets[i] : offsets[i + 1]].copy(), y, fold, lang))
        if own:
            yield row()

    return stored(rows.mapInArrow(released(run), "data binary, langs array<string>, t0 long, t1 long, c0 long, c1 long"), "labelled", "uncompressed")


def _over(blocks: DataFrame, each: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list], tuple[np.ndarray, ...]], columns: list[str]) -> pa.Table:
    """Sums by ``at`` of the whole numbers that ``each(ids, offsets, y, fold, langs)`` makes of every block: (at, columns)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, langs in zip(b.column("data"), b.column("langs"), strict=True):
                sizes, y, fold, which, *words = unpacked(data.as_py())
                made = each(np.stack(words, axis=1)[which], np.concatenate([[0], np.cumsum(sizes)]), y, fold, langs.as_py())
                for low in range(0, len(made[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(a[low : low + (1 << 16)].astype(np.int64)) for a in made], names=["at", *columns])

    parts = blocks.select("data", "langs").mapInArrow(released(run), ", ".join(f"{c} long" for c in ("at", *columns)))
    return parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _start(net: ConvNet, blocks: DataFrame, both: bool, n: np.ndarray) -> None:
    """Embeddings from log-odds and the model of languages, both counted over all blocks; ``n`` has the labels' numbers."""
    net.langs = sorted(r.lang for r in blocks.select(F.explode("langs").alias("lang")).where("lang IS NOT NULL").distinct().collect())
    number, odds = {x: k for k, x in enumerate(net.langs)}, 2 * PARTS * BUCKETS

    def count(ids: np.ndarray, offsets: np.ndarray, y: np.ndarray, fold: np.ndarray, langs: list) -> tuple[np.ndarray, ...]:
        doc = np.repeat(np.arange(len(y)), np.diff(offsets))
        use = both | (fold == 0)
        seen = []
        for k in range(PARTS):
            pairs = np.unique((doc * BUCKETS + ids[:, k])[use[doc]])
            seen.append((y[pairs // BUCKETS].astype(np.int64) * PARTS + k) * BUCKETS + pairs % BUCKETS)
        which = np.array([number.get(x, -1) for x in langs], np.int64)
        seen.append((odds + which[doc] * BUCKETS + ids[:, 0])[use[doc] & (which[doc] >= 0)])
        return np.unique(np.concatenate(seen), return_counts=True)

    got = _over(blocks, count, ["n"])
    total = np.zeros(odds + len(net.langs) * BUCKETS)
    total[_column(got, "at")] = _column(got, "n")
    for k in range(PARTS):
        seen = total[:odds].reshape(2, PARTS, BUCKETS)[:, k]
        share = (seen + 0.5) / (n + 1)[:, None]
        net.tables[k, :BUCKETS, 0] = np.where(seen.sum(0) > 1, np.log(share[1] / share[0]) * seen.sum(0) / (seen.sum(0) + 5), 0)
    if net.langs:
        words = total[odds:].reshape(-1, BUCKETS) + 0.1
        net.lang_weights = np.log(words / words.sum(1, keepdims=True)).T.astype(np.float32)


def fit(blocks: DataFrame, both: bool, n: np.ndarray) -> ConvNet:
    """A network trained and calibrated on all blocks; ``both``: every document does both; ``n``: how many of each label are trained on."""
    net, context = ConvNet(), blocks.sparkSession.sparkContext
    _start(net, blocks, both, n)
    state, share = State(net), n / n.sum()
    for epoch in range(EPOCHS):
        sent = context.broadcast((net, state))

        def train(ids: np.ndarray, offsets: np.ndarray, y: np.ndarray, fold: np.ndarray, langs: list, epoch: int = epoch, sent: object = sent) -> tuple[np.ndarray, ...]:
            own, past = copy.deepcopy(sent.value)
            rows = np.flatnonzero(both | (fold == 0))
            _descend(own, past, [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], y, rows, np.random.default_rng([5, epoch]), share)
            table = np.concatenate([own.tables - sent.value[0].tables, (past.past - sent.value[1].past)[:, :, None]], axis=2).reshape(-1, DIMS + 1)
            touched = np.flatnonzero(table.any(1))
            dense = past.dense(own) - sent.value[1].dense(sent.value[0])
            dense = np.concatenate([dense, np.zeros(-len(dense) % (DIMS + 1))]).reshape(-1, DIMS + 1)
            change = np.rint(np.concatenate([table[touched] * COARSE, dense * UNIT]))
            return np.concatenate([touched, len(table) + np.arange(len(dense))]), np.ones(len(change)), *change.T

        got = _over(blocks, train, ["n", *(f"d{k}" for k in range(DIMS + 1))])
        sent.destroy()
        at, change = _column(got, "at"), np.stack([_column(got, f"d{k}") for k in range(DIMS + 1)], axis=1) / _column(got, "n")[:, None]
        low = at < net.tables[:, :, 0].size
        change /= np.where(low, COARSE, UNIT)[:, None]
        net.tables.reshape(-1, DIMS)[at[low]] += change[low, :DIMS].astype(np.float32)
        state.past.reshape(-1)[at[low]] += change[low, DIMS].astype(np.float32)
        state.put(net, state.dense(net) + change[~low][np.argsort(at[~low])].ravel()[: len(state.dense(net))])
    _calibrate(net, blocks, both)
    return net


def _calibrate(net: ConvNet, blocks: DataFrame, both: bool) -> None:
    """Thresholds and temperature from the logits of all documents to calibrate on."""
    sent, wide = blocks.sparkSession.sparkContext.broadcast(net), 1 << 32

    def measure(ids: np.ndarray, offsets: np.ndarray, y: np.ndarray, fold: np.ndarray, langs: list) -> tuple[np.ndarray, ...]:
        use = both | (fold == 1)
        z = np.rint(np.clip(sent.value.logits(ids, offsets), -64, 64) * FINE).astype(np.int64)
        at, back = np.unique((sent.value.languages(ids, offsets) * wide + z + (wide >> 1))[use], return_inverse=True)
        return at, np.bincount(back, 1 - y[use], len(at)), np.bincount(back, y[use], len(at))

    got = _over(blocks, measure, ["clean", "toxic"])
    at, clean, toxic = (_column(got, c) for c in ("at", "clean", "toxic"))
    lang, logit = at // wide, (at % wide - (wide >> 1)) / FINE
    net.default = _threshold(*_by_logit(logit, clean, toxic))
    for k in range(len(net.langs)):
        own = lang == k
        if min(clean[own].sum(), toxic[own].sum()) >= 10:
            net.thresholds[k] = _threshold(*_by_logit(logit[own], clean[own], toxic[own]))
    limit = np.array([*(net.thresholds.get(k, net.default) for k in range(len(net.langs))), net.default])
    z = logit - limit[lang]
    net.t = temperature(np.concatenate([z, z]), np.repeat([0, 1], len(z)), np.concatenate([clean, toxic]))


def _by_logit(logit: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct logits, the largest first, and how many of each label have them."""
    z, back = np.unique(-logit, return_inverse=True)
    return -z, np.bincount(back, clean, len(z)), np.bincount(back, toxic, len(z))


def _threshold(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The logit with the largest F1; midway between it and the next below, if no label contradicts."""
    if not len(z):
        return 0.0
    hit = np.cumsum(toxic)
    at = int((2 * hit / (np.cumsum(clean + toxic) + hit[-1])).argmax()) if hit[-1] else 0
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at])


class State:
    """What training keeps beside the network: moments, squares of past gradients, and steps."""

    def __init__(self, net: ConvNet) -> None:
        self.m, self.v = ([np.zeros_like(a) for a in self.parts(net)] for _ in "mv")
        self.past, self.bias, self.step = np.full(net.tables.shape[:2], 1e-2, np.float32), 0.0, 0.0

    @staticmethod
    def parts(net: ConvNet) -> list[np.ndarray]:
        return [*net.filters, *net.bias, net.out]

    def dense(self, net: ConvNet) -> np.ndarray:
        """Everything but the tables and their past, in one row; second moments as their roots, which are not lost in whole numbers."""
        return np.concatenate([*(a.ravel() for a in (*self.parts(net), *self.m, *map(np.sqrt, self.v))), [net.out_bias, self.bias, self.step]]).astype(np.float64)

    def put(self, net: ConvNet, row: np.ndarray) -> None:
        at = 0
        for a in (*self.parts(net), *self.m, *self.v):
            a[...] = row[at : at + a.size].reshape(a.shape)
            at += a.size
        for a in self.v:
            np.square(np.maximum(a, 0), out=a)
        net.out_bias, self.bias, self.step = map(float, row[at:])


def _descend(net: ConvNet, state: State, docs: list[np.ndarray], y: np.ndarray, train: np.ndarray, rng: np.random.Generator, share: np.ndarray) -> None:
    """An epoch of Adam for filters and output, Adagrad for embeddings; gradients flow to the words where a filter is largest."""
    size, dense, m, v, past = PARTS * DIMS, state.parts(net), state.m, state.v, state.past
    rng.shuffle(train)
    for at in range(0, len(train), 64):
        rows = train[at : at + 64]
        ids, offsets = _gather(docs, rows)
        top, place = net.maxima(ids, offsets, where=True)
        error = (sigmoid(top @ net.out + net.out_bias) - y[rows]) * (0.5 / share[y[rows]]) / len(rows)
        back = (error[:, None] * net.out * (place >= 0)).astype(np.float32)
        grads = []
        for k, width in enumerate(WIDTHS):
            g = np.zeros_like(net.filters[k])
            r, f = np.nonzero(place[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            first, pull = place[r, k * FILTERS + f], back[r, k * FILTERS + f]
            for s in range(width):
                inside = first + s < offsets[r + 1]
                word, own, flt = ids[first[inside] + s], pull[inside], f[inside]
                g[s * size : (s + 1) * size] = net.embed(word).T @ ((flt[:, None] == np.arange(FILTERS)) * own[:, None])
                down = own[:, None] * net.filters[k][s * size : (s + 1) * size].T[flt]
                for p in range(PARTS):
                    gp = down[:, p * DIMS : (p + 1) * DIMS]
                    np.add.at(past[p], word[:, p], (gp**2).mean(1, dtype=np.float32))
                    # flat and of one type, as numpy adds such fast
                    places = word[:, p, None].astype(np.int64) * DIMS + np.arange(DIMS)
                    np.add.at(net.tables[p].reshape(-1), places.ravel(), (-0.05 * gp / np.sqrt(past[p, word[:, p]])[:, None]).ravel())
            grads.append(g)
        grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [top.T @ error]
        state.step += 1
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            dense[k] -= (5e-3 * (m[k] / (1 - 0.9**state.step)) / (np.sqrt(v[k] / (1 - 0.999**state.step)) + 1e-8)).astype(np.float32)
        state.bias = 0.9 * state.bias + 0.1 * error.sum()
        net.out_bias -= 0.05 * state.bias


def train(docs: DataFrame, labels: DataFrame, label: str, held: Column) -> ConvNet:
    """A network from all labelled documents that are not ``held``."""
    bounded_batches(docs.sparkSession)
    known = known_labels(labels, label, held)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    blocks = _blocks(docs, known, total)
    t0, t1, c0, c1 = (x or 0 for x in blocks.agg(*[F.sum(c) for c in ("t0", "t1", "c0", "c1")]).first())
    if min(t0 + c0, t1 + c1) == 0:
        return ConvNet(counts.get(1, 0) / total if total else 0.0)
    both = min(t0 + c0, t1 + c1) < 5 or min(t0, t1, c0, c1) == 0
    return fit(blocks, both, np.array([t0 + c0, t1 + c1] if both else [t0, t1]))


def score(docs: DataFrame, labels: DataFrame, label: str, held: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document; ``held`` is a condition on ``doc_id``."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, held))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.scores(*word_parts(b.column("text"))).astype(np.float64))], names=["doc_id", "score"])

    made = texts(docs).mapInArrow(released(run), "doc_id long, score double")
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, label: str, held: Column) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic, all rows if nothing could be learned; no shuffle."""
    bounded_batches(docs.sparkSession)
    net = train(docs, labels, label, held)
    if net.constant is not None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(sent.value.scores(*word_parts(b.column("text").fill_null(""))) < 0.5))

    return docs.mapInArrow(released(run), docs.schema)
