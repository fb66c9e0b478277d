"""Document scores under a hierarchical Pitman-Yor language model, with seating sampled by Gibbs sweeps.

Every token (a word, or the end of a text) is a customer of the restaurant of its context, the word before it. A
context is a word's ending (a class of its last three bytes, ``1 << CLASS_BITS`` of them) and ``WORD_BITS`` of the
word's hash, so that frequent words have a restaurant of their own, but for a rare word or two that they share it with.
Restaurants of the same ending send one customer for each of their tables to a parent that they share, and the parents
to a common root, whose base is uniform over the vocabulary and one unknown word. A sweep takes the customers of a dish
from their tables and seats them again one by one, given the tables of the other dishes and restaurants. After
``BURN`` sweeps, each of ``SAMPLES`` further ones gives a predictive probability, and their mean is the model's.

How it is spread: words are counted first. Dishes are dealt by hash into buckets, and a bucket's dishes in all
restaurants are sampled in one task; a dish with more than a share of ``1 / HOT`` of all tokens is dealt by the class of
its contexts besides, so no bucket holds it whole. As in other distributed samplers, tasks sweep side by side: what a
task doesn't hold of a restaurant's tables is estimated from its own part while sampling. The totals by which
probabilities are divided are exact sums over all buckets, so probabilities of all words sum to one. Documents are
gathered in blocks of bounded size, by ranges of ids. A block sends the distinct words and contexts that it holds, once
each, to the buckets, and gets back their counts in the same order, so neither the vocabulary nor the tables are ever in
one place, and what moves grows with the input. Nothing is pruned.

Base score: sum over tokens of log10((c + 1) / (N + V + 1)). Words are compared by 56-bit hashes.

Defined cases: null text is empty and consists of its end alone; with no documents to learn from, N and V are 0;
repeated rows score alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added_up, bounded_batches, narrow, packed, released, slices, stored, texts, unpacked
from .words import mix, seeded, span_hashes, word_spans

CLASS_BITS, WORD_BITS = 8, 12
DISCOUNT, STRENGTH = 0.8, 1.0
BURN, SAMPLES = 3, 2
#: ids that share all but their last bits are a block, or several of about so many tokens
BLOCK_BITS, BLOCK_TOKENS = 12, 1 << 21
BUCKET_TOKENS = 1 << 20
#: a word with one in so many of all tokens is dealt by class of context, too
HOT = 2048
#: distinct words that a task holds before it passes their counts on, and tokens before it sends a block's requests
HELD, FLUSH = 400_000, 3_000_000
#: customers that a bucket's own share of a restaurant is weighed against
PRIOR = 8.0
#: contexts whose tables are added up together
RANGE_BITS = 14
_EDGES = mix(np.array([0x5EED, 0xE0F], np.uint64))
_HASH = np.uint64(8)


def context_bits() -> int:
    return CLASS_BITS + WORD_BITS


def _context(hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
    """The number of each word's restaurant: its class first."""
    return ((endings & np.uint64((1 << CLASS_BITS) - 1)) << np.uint64(WORD_BITS) | hashes >> np.uint64(30) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, own, contexts, offsets) of all tokens: 56-bit hashes, the restaurants that they open and that they sit in.

    The last token of a text is its end, which opens the restaurant of the text's beginning: there are as many of both.
    """
    data, starts, ends, hashes, offsets = word_spans(column)
    endings = span_hashes(data, np.maximum(starts, ends - 3), [ends])[0] if len(starts) else hashes
    n = np.diff(offsets)
    out_offsets = np.concatenate([[0], np.cumsum(n + 1)])
    last = out_offsets[1:] - 1
    is_word = np.ones(out_offsets[-1], bool)
    is_word[last] = False
    words, own = np.full(out_offsets[-1], _EDGES[1]), np.full(out_offsets[-1], _context(_EDGES[:1], _EDGES[:1])[0])
    words[is_word], own[is_word] = hashes, _context(hashes, endings)
    before = np.concatenate([own[:1], own[:-1]])
    # the text before has its end there, so its first token already sits in the restaurant of the beginning
    before[out_offsets[:-1]] = own[last]
    return words >> _HASH, own, before, out_offsets


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, a, b, n): words to learn from (0) with their restaurants, and tokens by range of ids (1)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sizes: dict[int, int] = {}

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, own, n = (np.concatenate(x) for x in zip(*held, strict=True))
        words, first, place = np.unique(words, return_index=True, return_inverse=True)
        return words, own[first], np.bincount(place, n, len(words)).astype(np.int64)

    def batch(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b), pa.array(n)], names=["kind", "a", "b", "n"])

    for b in slices(batches):
        words, own, _, offsets = tokens(b.column("text"))
        for k, size in zip(b.column("range").to_pylist(), np.diff(offsets).tolist(), strict=True):
            sizes[k] = sizes.get(k, 0) + size
        learn = np.repeat(b.column("learn").to_numpy(zero_copy_only=False), np.diff(offsets))
        distinct, first, n = np.unique(words[learn], return_index=True, return_counts=True)
        held.append((distinct, own[learn][first], n))
        if sum(len(x[0]) for x in held[1:]) > max(100_000, len(held[0][0])):
            held = [merged()]
            if len(held[0][0]) > HELD:
                yield batch(0, *held[0])
                held = []
    if held:
        yield batch(0, *merged())
    if sizes:
        yield batch(1, np.array(list(sizes)), np.zeros(len(sizes), np.int64), np.array(list(sizes.values())))


class Deal:
    """How dishes are dealt into buckets."""

    def __init__(self, bits: int, hot: np.ndarray) -> None:
        self.bits, self.hot = bits, hot

    def hot_of(self, words: np.ndarray) -> np.ndarray:
        """The number of each hot word, -1 for others."""
        if not len(self.hot):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, at, -1)

    def buckets(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Of each word in each context; words in order have buckets in order, but for the hot ones."""
        out = words >> np.uint64(56 - self.bits)
        split = self.hot_of(words) >= 0
        out[split] = seeded(words[split] * np.uint64(1 << CLASS_BITS) + (contexts[split] >> WORD_BITS).astype(np.uint64), 3) >> np.uint64(64 - self.bits)
        return out.astype(np.int64)


class Layout:
    """The distinct (word, context) pairs of some tokens, by bucket, word and context, and which of them each token is."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, deal: Deal) -> None:
        self.words, rank = np.unique(words, return_inverse=True)
        keys, place = np.unique(rank << context_bits() | contexts, return_inverse=True)
        bucket = deal.buckets(self.words[keys >> context_bits()], keys & ((1 << context_bits()) - 1))
        order = np.argsort(bucket, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        self.keys, self.bucket, self.place = keys[order], bucket[order], moved[place]
        self.context = self.keys & ((1 << context_bits()) - 1)
        new = lambda x: np.concatenate([[True], (x[1:] != x[:-1]) | (self.bucket[1:] != self.bucket[:-1])]) if len(x) else np.zeros(0, bool)
        self.new_word, self.new_parent = new(self.keys >> context_bits()), new(self.keys >> WORD_BITS)
        self.word_of, self.parent_of = np.cumsum(self.new_word) - 1, np.cumsum(self.new_parent) - 1


_REQUEST = "bucket int, block long, data binary"


def _requests(deal: Deal):
    """Tasks over documents: for each block and bucket, the distinct words and contexts, with counts of tokens to learn from."""

    def made(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for block, parts in held.items():
            words, contexts, learn = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = Layout(words, contexts, deal)
            count = np.bincount(own.place[learn], minlength=len(own.keys))
            rows = []
            for bucket, low, high in zip(*_runs(own.bucket), strict=True):
                first = np.flatnonzero(own.new_word[low:high])
                some, context = own.words[own.keys[low:high][first] >> context_bits()], own.context[low:high]
                arrays = narrow(np.diff(some, prepend=np.uint64(0))), narrow(np.diff(np.append(first, high - low))), narrow(context >> WORD_BITS), (context & ((1 << WORD_BITS) - 1)).astype("<u2"), narrow(count[low:high])
                rows.append((int(bucket), block, packed(*arrays)))
            yield _batch(rows, _REQUEST)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for b in batches:
            words, _, contexts, offsets = tokens(b.column("text"))
            learn = np.repeat(b.column("learn").to_numpy(zero_copy_only=False), np.diff(offsets))
            whose = np.repeat(b.column("block").to_numpy(zero_copy_only=False), np.diff(offsets))
            for k in np.unique(whose):
                own = whose == k
                held.setdefault(int(k), []).append((words[own], contexts[own], learn[own]))
            size += len(words)
            if size > FLUSH:
                yield from made(held)
                held, size = {}, 0
        yield from made(held)

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, end) of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], first, np.append(first[1:], len(values))


def seat(customers: np.ndarray, others: np.ndarray, dish: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers one by one, given ``others``, the restaurant's tables with other dishes.

    With i customers at t tables, the next opens a table with weight (b + d (others + t)) times ``dish``, the dish's
    probability above, against i - d t for a table that is there. Beyond 256 customers they come in groups that grow by a
    sixteenth, at the probability of the group's middle.
    """
    tables = (customers > 0).astype(np.int64)
    order = np.argsort(-customers, kind="stable")
    sorted_ = -customers[order]
    done = 1
    while True:
        n = int(np.searchsorted(sorted_, -done, "left"))  # dishes with more customers than are seated
        if not n:
            return tables
        at = order[:n]
        step = 1 if done < 256 else done // 16
        group = np.minimum(customers[at] - done, step)
        fresh = (STRENGTH + DISCOUNT * (others[at] + tables[at])) * dish[at]
        p = fresh / (done + (group - 1) / 2 - DISCOUNT * tables[at] + fresh)
        tables[at] += rng.random(n) < p if step == 1 else rng.binomial(group, np.clip(p, 0, 1))
        done += step


class Seating:
    """The dishes of one bucket in all restaurants: pairs of dish and context, of dish and class, and dishes.

    ``scale``: how many times its part here a hot dish has of customers in all.
    """

    def __init__(self, word_of: np.ndarray, context: np.ndarray, count: np.ndarray, totals: np.ndarray, base: float, scale: np.ndarray, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.word_of, self.context, self.count, self.totals, self.base, self.scale = word_of, context, count, totals, base, scale
        both = word_of << CLASS_BITS | context >> WORD_BITS
        pairs, self.parent_of = np.unique(both, return_inverse=True)
        self.parent, self.parent_word = pairs & ((1 << CLASS_BITS) - 1), pairs >> CLASS_BITS
        # contexts that are here, numbered, and their customers here and in all
        self.here, self.context_of = np.unique(context, return_inverse=True)
        self.own = np.bincount(self.context_of, count, len(self.here))
        self.t = (count > 0).astype(np.int64)
        self._sent()
        self.pt = (self.pc > 0).astype(np.int64)
        self.rc = np.bincount(self.parent_word, self.pt, len(scale)).astype(np.int64)
        self.rt = (self.rc > 0).astype(np.int64)

    def _sent(self) -> None:
        self.pc = np.bincount(self.parent_of, self.t, len(self.parent)).astype(np.int64)

    def totals_by_estimate(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Tables of the contexts here, customers and tables of the classes, customers and tables of the root, in all."""
        tables = np.bincount(self.context_of, self.t, len(self.here))
        mean = tables.sum() / max(self.own.sum(), 1)
        t_ctx = self.totals[self.here] * (tables + PRIOR * mean) / (self.own + PRIOR)
        # of the contexts that are not here, tables by the mean
        c_par = np.bincount(np.arange(len(self.totals)) >> WORD_BITS, self.totals, 1 << CLASS_BITS) * mean
        c_par += np.bincount(self.here >> WORD_BITS, t_ctx - self.totals[self.here] * mean, 1 << CLASS_BITS)
        own, tables = np.bincount(self.parent, self.pc, 1 << CLASS_BITS), np.bincount(self.parent, self.pt, 1 << CLASS_BITS)
        t_par = c_par * (tables + PRIOR * tables.sum() / max(own.sum(), 1)) / (own + PRIOR)
        c_root = float(t_par.sum())
        return t_ctx, c_par, t_par, c_root, c_root * float(self.rt.sum() / max(self.rc.sum(), 1))

    def sweep(self) -> None:
        t_ctx, c_par, t_par, c_root, t_root = self.totals_by_estimate()
        new = (STRENGTH + DISCOUNT * t_root) * self.base
        root = (self.scale * (self.rc - DISCOUNT * self.rt) + new) / (STRENGTH + c_root)
        above = (STRENGTH + DISCOUNT * t_par)[self.parent] * root[self.parent_word]
        # the dish's probability above, without the customers that these tables send there
        sent, there = self.pc[self.parent_of] - self.t, np.minimum(self.pt[self.parent_of], self.pc[self.parent_of] - self.t)
        dish = (sent - DISCOUNT * there + above[self.parent_of]) / (STRENGTH + np.maximum(c_par[self.parent[self.parent_of]] - self.t, 0))
        self.t = seat(self.count, np.maximum(t_ctx[self.context_of] - self.t, 0), dish, self.rng)
        self._sent()
        sent = self.rc[self.parent_word] - self.pt
        dish = (self.scale[self.parent_word] * (sent - DISCOUNT * np.minimum(self.rt[self.parent_word], sent)) + new) / (STRENGTH + np.maximum(c_root - self.pt, 0))
        self.pt = seat(self.pc, np.maximum(t_par[self.parent] - self.pt, 0), dish, self.rng)
        self.rc = np.bincount(self.parent_word, self.pt, len(self.scale)).astype(np.int64)
        self.rt = seat(self.rc, np.maximum(t_root - self.rt, 0), np.full(len(self.rc), self.base), self.rng)


_REPLY = "bucket int, block long, range int, data binary, keys array<int>, sums array<double>"
#: numbers of sums: tables of classes, of the root, then customers and tables of hot words at the root
_PER = (1 << CLASS_BITS) + 1


def _sample(deal: Deal, hot_counts: np.ndarray, totals: np.ndarray, vocabulary: int):
    """A bucket's requests to its replies and totals."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        words, contexts, counts, blocks = [], [], [], []
        for block, data in zip(rows.column("block").to_pylist(), rows.column("data"), strict=True):
            word, n, high, low, count = unpacked(data.as_py())
            words.append(np.repeat(np.cumsum(word, dtype=np.uint64), n))
            contexts.append(high.astype(np.int64) << WORD_BITS | low)
            counts.append(count.astype(np.int64))
            blocks.append(block)
        size = list(map(len, words))
        distinct, rank = np.unique(np.concatenate(words), return_inverse=True)
        keys, place = np.unique(rank << context_bits() | np.concatenate(contexts), return_inverse=True)
        count = np.bincount(place, np.concatenate(counts), len(keys)).astype(np.int64)
        by_block: dict[int, list[np.ndarray]] = {}
        for block, own in zip(blocks, np.split(place, np.cumsum(size)[:-1]), strict=True):
            by_block.setdefault(block, []).append(own)
        word_of = keys >> context_bits()
        word_count = np.bincount(word_of, count, len(distinct)).astype(np.int64)
        hot = deal.hot_of(distinct)
        scale = np.where(hot >= 0, np.append(hot_counts, 0)[hot] / np.maximum(word_count, 1), 1.0)
        s = Seating(word_of, keys & ((1 << context_bits()) - 1), count, totals, 1.0 / (vocabulary + 1), scale, bucket)
        samples, at, sums, tables = [], [], [], []
        for k in range(BURN + SAMPLES):
            s.sweep()
            if k >= BURN:
                first = (k - BURN) * _PER
                at += [*range(first, first + _PER)]
                sums += [*np.bincount(s.parent, s.pt, 1 << CLASS_BITS), s.rt.sum()]
                first = SAMPLES * _PER + (k - BURN) * 2 * len(hot_counts)
                for x in (s.rc, s.rt):
                    at += (first + hot[hot >= 0]).tolist()
                    sums += x[hot >= 0].tolist()
                    first += len(hot_counts)
                samples.append((s.t, s.pc, s.pt, s.rc, s.rt))
                tables.append(np.bincount(s.context_of, s.t, len(s.here)).astype(np.int64))
        out = [(bucket, None, None, None, at, [float(x) for x in sums])]
        for r, low, high in zip(*_runs(s.here >> RANGE_BITS), strict=True):
            out.append((bucket, None, int(r), packed(narrow(s.here[low:high] & ((1 << RANGE_BITS) - 1)), *(narrow(t[low:high]) for t in tables)), None, None))
        for block, parts in by_block.items():
            mine = np.unique(np.concatenate(parts))
            word, parent = np.unique(s.word_of[mine]), np.unique(s.parent_of[mine])
            arrays = [word_count[word], count[mine]]
            for t, pc, pt, rc, rt in samples:
                arrays += [t[mine], pc[parent], pt[parent], rc[word], rt[word]]
            out.append((bucket, block, None, packed(*map(narrow, arrays)), None, None))
        return pa.Table.from_batches([_batch(out, _REPLY)])

    return run


def _dense(data: bytes) -> np.ndarray:
    """Tables of a range's contexts, one row per sample."""
    at, *tables = unpacked(data)
    out = np.zeros((SAMPLES, 1 << RANGE_BITS), np.int64)
    out[:, at] = tables
    return out


def _add_tables(rows: pa.Table) -> pa.Table:
    total = sum(_dense(x.as_py()) for x in rows.column("data"))
    at = np.flatnonzero(total.any(0))
    return pa.table({"range": rows.column("range")[:1], "source": rows.column("source")[:1], "data": pa.array([packed(narrow(at), *(narrow(t[at]) for t in total))])})


_OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


class Totals:
    """What all of a model's probabilities are divided by, and what is known of hot words in all."""

    def __init__(self, train: int, vocabulary: int, deal: Deal, hot_counts: np.ndarray, customers: np.ndarray, tables: np.ndarray, sums: np.ndarray) -> None:
        self.train, self.vocabulary, self.deal, self.hot_counts = train, vocabulary, deal, hot_counts
        self.customers, self.tables, self.sums = customers.astype(np.float32), tables.astype(np.float32), sums
        self.parents = [np.bincount(np.arange(t.shape[0]) >> WORD_BITS, t, 1 << CLASS_BITS) for t in tables]

    def probabilities(self, own: Layout, replies: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of words, probabilities of pairs) of a layout, from its buckets' replies in order."""
        columns = [np.concatenate(x).astype(np.float64) for x in zip(*replies, strict=True)]
        if len(columns[0]) != own.new_word.sum() or len(columns[1]) != len(own.keys):
            raise ValueError("the replies do not fit the block's documents")
        hot = self.deal.hot_of(own.words[own.keys[own.new_word] >> context_bits()])
        known, n_hot = hot >= 0, len(self.hot_counts)
        count = columns[0]
        count[known] = self.hot_counts[hot[known]]
        parent = own.context[own.new_parent] >> WORD_BITS
        p = np.zeros(len(own.keys))
        for k in range(SAMPLES):
            t, pc, pt, rc, rt = columns[2 + 5 * k : 7 + 5 * k]
            t_par, t_root = self.sums[k * _PER : (k + 1) * _PER - 1], self.sums[(k + 1) * _PER - 1]
            at_root = self.sums[SAMPLES * _PER + 2 * k * n_hot :]
            rc[known], rt[known] = at_root[hot[known]], at_root[n_hot + hot[known]]
            root = (rc - DISCOUNT * rt + (STRENGTH + DISCOUNT * t_root) / (self.vocabulary + 1)) / (STRENGTH + t_par.sum())
            middle = (pc - DISCOUNT * pt + (STRENGTH + DISCOUNT * t_par)[parent] * root[own.word_of[own.new_parent]]) / (STRENGTH + self.parents[k])[parent]
            p += (columns[1] - DISCOUNT * t + (STRENGTH + DISCOUNT * self.tables[k][own.context]) * middle[own.parent_of]) / (STRENGTH + self.customers[own.context]) / SAMPLES
        return count, p


def _score(sent):
    """A block's documents and the replies to it, to scores."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        totals: Totals = sent.value
        ids = docs.column("doc_id").to_pylist()
        text = docs.column("text").combine_chunks()
        words, _, contexts, offsets = tokens(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks))
        own = Layout(words, contexts, totals.deal)
        got = sorted(zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), strict=True))
        count, p = totals.probabilities(own, [unpacked(data) for _, data in got])
        word = own.word_of[own.place]
        base = np.log10((count + 1) / (totals.train + totals.vocabulary + 1))
        add = lambda x: np.add.reduceat(x, offsets[:-1])
        columns = [pa.array(ids, pa.int64()), pa.array(np.diff(offsets)), pa.array(add((count[word] > 0).astype(np.int64))), pa.array(add(base[word])), pa.array(add(np.log10(p)[own.place]))]
        return pa.table(dict(zip([x.split(" ")[0] for x in _OUT.split(", ")], columns, strict=True)))

    return run


def _blocks(rows: DataFrame, ranges: DataFrame, total: int) -> DataFrame:
    """``rows`` with a block: a range of ids, wider if texts are short; what is above twice the size is dealt by hash."""
    many = ranges.count()
    wider = max(0, int(np.log2(max(1.0, BLOCK_TOKENS * many / max(total, 1)))))
    sizes = ranges.groupBy(F.shiftright("a", wider).alias("a")).agg(F.sum("n").alias("n"))
    # one entry for every two blocks' tokens at most
    large = {r.a: -(-r.n // BLOCK_TOKENS) for r in sizes.where(F.col("n") > 2 * BLOCK_TOKENS).collect()}
    block = F.shiftright("range", wider)
    if large:
        spark = rows.sparkSession
        parts = spark.createDataFrame(list(large.items()), "_range long, _parts long")
        rows = rows.join(F.broadcast(parts), block == F.col("_range"), "left")
        share = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "text"), F.col("_parts"))).otherwise(0)
    else:
        share = F.lit(0)
    return rows.select("doc_id", "text", "learn", F.xxhash64(block, share.cast("long")).alias("block"))


def score(docs: DataFrame, held: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``held`` is a condition on ``doc_id``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    near = F.shiftright(F.coalesce("doc_id", F.xxhash64("text")), BLOCK_BITS)
    rows = texts(docs).select("doc_id", "text", (~held).alias("learn"), near.alias("range"))
    counted = rows.select("text", "learn", "range").mapInArrow(released(_counts), "kind int, a long, b long, n long")
    counted = stored(counted.groupBy("kind", "a").agg(F.min("b").alias("b"), F.sum("n").alias("n")), "words")
    words, ranges = counted.where("kind = 0"), counted.where("kind = 1")
    sizes = {r.kind: (r.n, r.total) for r in counted.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n").alias("total")).collect()}
    (vocabulary, train), total = sizes.get(0, (0, 0)), sizes.get(1, (0, 0))[1]
    hot = sorted((r.a, r.n) for r in words.where(F.col("n") * HOT >= max(train, 1)).select("a", "n").collect())
    deal = Deal(min(24, max(1, (total // BUCKET_TOKENS).bit_length())), np.array([w for w, _ in hot], np.uint64))
    hot_counts = np.array([n for _, n in hot], np.float64)
    customers = np.zeros(1 << context_bits())
    per = words.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    customers[per.column("b").to_numpy()] = per.column("n").to_numpy()
    rows = _blocks(rows, ranges, total)
    asked = rows.mapInArrow(released(_requests(deal)), _REQUEST)
    totals = spark.sparkContext.broadcast(customers.astype(np.float32))
    sample = lambda some: _sample(deal, hot_counts, totals.value, vocabulary)(some)
    replies = stored(asked.groupBy("bucket").applyInArrow(sample, _REPLY), "seating")
    sums = np.zeros(SAMPLES * (_PER + 2 * len(hot)))
    pairs = replies.where("keys is not null").select(F.explode(F.arrays_zip("keys", "sums")).alias("x"))
    for r in pairs.groupBy("x.keys").agg(F.sum("x.sums").alias("x")).collect():
        sums[r[0]] = r.x
    tables = np.zeros((SAMPLES, 1 << context_bits()))
    parts = replies.where("range is not null").select("range", F.col("bucket").alias("source"), "data")
    for r in added_up(parts, "range", _add_tables, "range int, source int, data binary", "tables").select("range", "data").collect():
        tables[:, r.range << RANGE_BITS : (r.range + 1) << RANGE_BITS] = _dense(bytes(r.data))
    sent = spark.sparkContext.broadcast(Totals(train, vocabulary, deal, hot_counts, customers, tables, sums))
    answered = replies.where("block is not null").select("bucket", "block", "data")
    made = rows.select("doc_id", "text", "block").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(sent), _OUT)
    return made.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(train)).cast("long").alias("train_tokens"), "base_score", "score")
