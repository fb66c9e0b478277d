"""Language identification by interpolated Kneser-Ney character models.

A text is reduced to its letters, in words. One model per language gives the probability of each character after up
to three others of its word, a space standing before and after; the language with the lowest cross-entropy per
character is chosen. Counts are taken over all documents to learn from, in Spark: n-grams are counted per task,
summed by language and n-gram, and continuation counts, context totals and discounts are aggregates of that table.
The finished model is one sorted array of n-gram hashes with, for each language, the discounted share of the n-gram
and the weight that it leaves to shorter contexts. Every n-gram is kept. A model of more than ``BLOCK`` numbers is
sent as parts of about that size, ranges of the hashes of one order's weights or shares, and a task goes through them
one after another for each lot of words, with one part in memory at a time; probabilities are the same either way.

The score is the posterior of the chosen language at a temperature fitted on all documents to learn from. They also
set, for each language, the cross-entropy above which a text is marked ``rejected`` (the ``REJECT`` quantile, in steps of
1 / ``STEPS``). Every text is gone through once: its cross-entropies are kept, from which both are aggregates.

Defined cases: null text, and text without a letter, is ``und`` with score 0; documents without ``lang`` are not
learned from; with nothing to learn from, every text is ``und``; ties go to the first language by name; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, released, slices, stored
from .words import mix, word_spans

ORDER = 4
#: numbers of the model that a task holds at once
BLOCK = 12_000_000
#: probabilities (characters of distinct words times languages) that a task holds at once
LOT = 16_000_000
#: bytes of text that go through the parts of a large model together
TOGETHER = 8 << 20
REJECT = 0.995
#: steps of a cross-entropy of 1 by which documents are counted for :data:`REJECT`
STEPS = 10_000
#: distinct n-grams of a language and order that a task holds before it passes them on
HELD = 200_000
_STEP = 0x9E3779B97F4A7C15 | 1
_COUNTS = "lang string, n int, gram long, ctx long, suffix long, begins boolean, n_seen long"


def letters(text: Column) -> Column:
    """Lower-case words of letters and the marks on them, one space between; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+\p{M}*|^\p{M}+", " "))


def _stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, word numbers): the words one after another, a space before the first and after each."""
    length = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(total[-1]) - np.repeat(total[:-1], length) + np.repeat(starts, length)
    flat = data[np.minimum(at, len(data) - 1)].copy()
    flat[total[1:] - 1] = 32
    code = np.frombuffer(b" \0\0\0" + flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    return code, np.cumsum(np.concatenate([[0], code[:-1] == 32])) - 1


def _grams(code: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` code points that end at each place; places before ``n`` hold nothing of use."""
    out, power = np.zeros(len(code), np.uint64), 1
    for k in range(n):
        out[k:] += code[: len(code) - k] * np.uint64(power)
        power = power * _STEP & 0xFFFFFFFFFFFFFFFF
    return mix(out + np.uint64(n * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))


def _depth(code: np.ndarray) -> np.ndarray:
    """How many code points before each place belong to its word, the space before it included."""
    at = np.arange(len(code))
    space = np.where(code == 32, at, 0)
    before = np.concatenate([[0], np.maximum.accumulate(space)[:-1]])
    return at - before


def _merged(parts: list[tuple]) -> tuple:
    gram, ctx, suffix, begins, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    kept, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
    return kept, ctx[first], suffix[first], begins[first], np.bincount(inverse, n, len(kept)).astype(np.int64)


def _counted(lang: str, n: int, merged: tuple) -> pa.RecordBatch:
    gram, ctx, suffix, begins, seen = merged
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (gram, ctx, suffix)), pa.array(begins), pa.array(seen)],
        names=[x.split(" ")[0] for x in _COUNTS.split(", ")],
    )


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a task's documents by language; what has grown large is passed on and begun anew."""
    held: dict[tuple[str, int], list] = {}
    for b in slices(batches):
        langs = np.array(b.column("lang").to_pylist())
        for lang in map(str, np.unique(langs)):
            data, starts, ends, hashes, _ = word_spans(b.column("text").filter(pa.array(langs == lang)), lower=False)
            if not len(hashes):
                continue
            _, first, times = np.unique(hashes, return_index=True, return_counts=True)
            code, word = _stream(data, starts[first], ends[first])
            depth, weight = _depth(code), times[np.maximum(word, 0)]
            before = np.zeros(len(code), np.uint64)
            for n in range(1, ORDER + 1):
                grams = _grams(code, n)
                at = np.flatnonzero(depth >= max(n - 1, 1))
                one = (grams[at], before[at - 1], before[at], depth[at] == n - 1, weight[at])
                before = grams
                # distinct n-grams of these texts first, so that little is held
                mine = held.setdefault((lang, n), [])
                mine.append(_merged([one]))
                if sum(len(x[0]) for x in mine[1:]) > max(100_000, len(mine[0][0])):
                    held[lang, n] = mine = [_merged(mine)]
                    if len(mine[0][0]) > HELD:
                        yield _counted(lang, n, mine[0])
                        held[lang, n] = []
    for (lang, n), parts in held.items():
        if parts:
            yield _counted(lang, n, _merged(parts))


def _lots(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they hold ``size`` bytes; as they come with 0."""
    held, n = [], 0
    for b in slices(batches):
        if not size:
            yield b
            continue
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Part:
    """Values of n-grams whose hashes lie in one range, by language: shares of order ``n``, or weights of its contexts."""

    def __init__(self, n: int, shares: bool, gram: np.ndarray, lang: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(gram, kind="stable")
        self.n, self.shares, self.lang, self.value = n, shares, lang[order].astype(np.int32), value[order]
        self.keys, self.start = np.unique(gram[order], return_index=True)
        self.start = np.append(self.start, len(order))

    def apply(self, p: np.ndarray, at: np.ndarray, gram: np.ndarray) -> None:
        """Put the values of ``gram`` to the rows ``at`` of ``p``: weights multiply, shares are added."""
        place = np.minimum(np.searchsorted(self.keys, gram), len(self.keys) - 1)
        there = np.flatnonzero(self.keys[place] == gram)
        most = max(1, LOT // 8)
        first, many = self.start[place[there]], np.diff(self.start)[place[there]]
        lot = (np.cumsum(many) - 1) // most
        for k in range(int(lot[-1]) + 1 if len(lot) else 0):
            mine = slice(*np.searchsorted(lot, [k, k + 1]))
            n, total = many[mine], int(many[mine].sum())
            cell = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[mine], n)
            row = np.repeat(at[there[mine]], n)
            if self.shares:
                p[row, self.lang[cell]] += self.value[cell]
            else:
                p[row, self.lang[cell]] *= self.value[cell]


class Model:
    """Shares and leftover weights of all n-grams and languages, in order of the n-grams' hashes.

    ``parts`` are broadcasts of a large model's parts in the order in which they apply; the arrays are then empty. They
    do not go with the model to tasks, which are handed them beside it.
    """

    def __init__(self, langs: list[str], keys: np.ndarray, share: np.ndarray, rest: np.ndarray, first: np.ndarray) -> None:
        self.langs, self.keys, self.share, self.rest, self.first = langs, keys, share, rest, first
        self.temperature, self.reject = 1.0, np.full(len(langs), np.inf)
        self.index: np.ndarray | None = None
        self.parts: list = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": []}

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Rows of n-grams, the last row (all zero, leftover 1) for those not there."""
        if self.index is None:
            self.bits = max(1, int(len(self.keys)).bit_length())
            self.index = np.searchsorted(self.keys, np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits))
            self.longest = int(np.diff(self.index).max(initial=0))
        top = (gram >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.index[top], self.index[top + 1]
        out = np.full(len(gram), len(self.keys))
        open_ = np.arange(len(gram))
        for _ in range(self.longest):
            open_ = open_[at[open_] < stop[open_]]
            if not len(open_):
                break
            same = self.keys[at[open_]] == gram[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return out

    def _probabilities(self, code: np.ndarray, depth: np.ndarray, parts: list) -> np.ndarray:
        """The probability of each code point by language."""
        p = np.zeros((len(code), len(self.langs)), np.float32)
        if parts:
            p += self.first
            last = None
            for sent in parts:
                # not .value, which would keep every part in memory
                part = sent.value if hasattr(sent, "_value") else sent.load_from_path(sent._path)
                if last is None or last[:2] != (part.n, part.shares):
                    at = np.flatnonzero(depth >= max(part.n - 1, 1))
                    grams = _grams(code, part.n)[at] if part.shares else _grams(code, part.n - 1)[at - 1]
                    last = part.n, part.shares
                part.apply(p, at, grams)
                del part
            return p
        before = None
        for n in range(1, ORDER + 1):
            row = self.find(_grams(code, n))
            if n == 1:
                p = self.share[row] + self.first
            else:
                at = np.flatnonzero(depth >= n - 1)
                p[at] = self.share[row[at]] + self.rest[before[at - 1]] * p[at]
            before = row
        return p

    def entropies(self, column: pa.Array, parts: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character by language, characters) of each text of words."""
        data, starts, ends, hashes, offsets = word_spans(column, lower=False)
        n_docs, n_langs = len(column), len(self.langs)
        if not len(hashes) or not n_langs:
            return np.zeros((n_docs, n_langs)), np.zeros(n_docs, np.int64)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        by_word, chars = np.zeros((len(first), n_langs), np.float32), np.zeros(len(first), np.int64)
        lot = (np.cumsum(ends[first] - starts[first] + 1) - 1) * n_langs // LOT
        for k in np.unique(lot):
            mine = slice(*np.searchsorted(lot, [k, k + 1]))
            code, word = _stream(data, starts[first[mine]], ends[first[mine]])
            bits = -np.log(np.maximum(self._probabilities(code, _depth(code), parts or []), 1e-30))
            edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]) & (word >= 0))
            by_word[mine] = np.add.reduceat(bits, edges, axis=0)
            chars[mine] = np.diff(np.append(edges, len(word)))
        count = np.concatenate([[0], np.cumsum(chars[inverse])])
        size = count[offsets[1:]] - count[offsets[:-1]]
        out = np.zeros((n_docs, n_langs))
        lot = offsets[:-1] * n_langs // LOT
        for k in np.unique(lot):
            low, high = np.searchsorted(lot, [k, k + 1])
            own = offsets[low : high + 1]
            sums = np.concatenate([np.zeros((1, n_langs)), np.cumsum(by_word[inverse[own[0] : own[-1]]], axis=0, dtype=np.float64)])
            out[low:high] = sums[own[1:] - own[0]] - sums[own[:-1] - own[0]]
        return out / np.maximum(size, 1)[:, None], size


def _in_parts(model: DataFrame, langs: list[str]) -> Model:
    """A model too large for one array: its parts, each collected and broadcast on its own."""
    spark = model.sparkSession
    rest = (F.col("d") * F.col("types") / F.col("total")).cast("float")
    share = (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).cast("float")
    # weights of an order's contexts come before its shares
    rows = model.select("lang", "n", F.lit(1).alias("shares"), "gram", share.alias("value"))
    rows = rows.unionByName(model.where("n > 1").groupBy("lang", "n", F.col("ctx").alias("gram")).agg(F.first(rest).alias("value")).withColumn("shares", F.lit(0)))
    rows = stored(rows, "values")
    counts = {(r.n, r.shares): r["count"] for r in rows.groupBy("n", "shares").count().collect()}
    # a row is a hash, a language and a value: four numbers of four bytes
    cuts = {k: -(-n * 4 // BLOCK) for k, n in counts.items()}
    many = F.element_at(F.create_map(*[F.lit(x) for (n, shares), k in cuts.items() for x in (2 * n + shares, k)]), 2 * F.col("n") + F.col("shares"))
    part = F.floor(F.shiftrightunsigned("gram", 32) * many / F.lit(float(1 << 32))).cast("int")
    rows = stored(rows.withColumn("part", part).repartitionByRange("n", "shares", "part", "gram").sortWithinPartitions("n", "shares", "part"), "parts")
    firsts = {r.lang: r["first"] for r in model.where("n = 1").groupBy("lang").agg((F.first(rest).cast("double") / (F.count("*") + 1)).alias("first")).collect()}
    out = Model(langs, np.zeros(0, np.uint64), np.zeros((1, len(langs)), np.float32), np.ones((1, len(langs)), np.float32), np.array([firsts.get(x, 0.0) for x in langs], np.float32))
    number = {x: k for k, x in enumerate(langs)}
    for n, shares in sorted(cuts):
        for k in range(cuts[n, shares]):
            got = rows.where((F.col("n") == n) & (F.col("shares") == shares) & (F.col("part") == k)).select("lang", "gram", "value").toArrow()
            if got.num_rows:
                lang = got.column("lang").combine_chunks().dictionary_encode()
                lang = np.array([number[x] for x in lang.dictionary.to_pylist()], np.int32)[lang.indices.to_numpy()]
                gram, value = (got.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("gram", "value"))
                out.parts.append(spark.sparkContext.broadcast(Part(n, bool(shares), gram.view(np.uint64), lang, value)))
    return out


def learn(docs: DataFrame) -> Model:
    """A model of the languages in ``docs`` (doc_id, text, lang; the last two not null)."""
    bounded_batches(docs.sparkSession)
    words = docs.select(letters(docs["text"]).alias("text"), docs["lang"].alias("lang"))
    grams = words.mapInArrow(released(_count), _COUNTS).groupBy("lang", "n", "gram").agg(F.min("ctx").alias("ctx"), F.min("suffix").alias("suffix"), F.max("begins").alias("begins"), F.sum("n_seen").alias("n_seen"))
    grams = stored(grams, "grams")
    before = grams.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(F.count("*").alias("before"))
    c = F.when((F.col("n") == ORDER) | F.col("begins") | F.col("before").isNull(), F.col("n_seen")).otherwise(F.col("before"))
    counts = stored(grams.join(before, ["lang", "n", "gram"], "left").select("lang", "n", "gram", "ctx", c.alias("c")), "counts")
    n1, n2 = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    # a table of languages times orders
    discount = counts.groupBy("lang", "n").agg(F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5).alias("d"))
    contexts = counts.groupBy("lang", "n", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
    model = stored(counts.join(contexts, ["lang", "n", "ctx"]).join(discount, ["lang", "n"]), "shares")
    langs = [r.lang for r in model.select("lang").distinct().orderBy("lang").collect()]
    if model.count() * len(langs) > BLOCK:
        return _in_parts(model, langs)
    got = model.select("lang", "n", "gram", "ctx", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).cast("float").alias("share"), (F.col("d") * F.col("types") / F.col("total")).cast("float").alias("rest")).toArrow()
    number = {x: k for k, x in enumerate(langs)}
    column = lambda name: got.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    lang = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    n, gram, ctx = column("n"), column("gram").view(np.uint64), column("ctx").view(np.uint64)
    keys = np.unique(np.concatenate([gram, ctx[n > 1]])) if len(gram) else np.zeros(0, np.uint64)
    share, rest = np.zeros((len(keys) + 1, len(langs)), np.float32), np.ones((len(keys) + 1, len(langs)), np.float32)
    share[np.searchsorted(keys, gram), lang] = column("share")
    longer = n > 1
    rest[np.searchsorted(keys, ctx[longer]), lang[longer]] = column("rest")[longer]
    first = np.zeros(len(langs), np.float32)
    first[lang[~longer]] = column("rest")[~longer] / (np.bincount(lang[~longer], minlength=len(langs))[lang[~longer]] + 1)
    return Model(langs, keys, share, rest, first)


def entropies(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, known, h, size): the cross-entropy of every document by language, and its characters, kept in the shared folder.

    ``docs`` has (doc_id, text, known); ``known``, the language of those to learn from, is only passed on.
    """
    bounded_batches(docs.sparkSession)
    sent, parts, lot = docs.sparkSession.sparkContext.broadcast(model), model.parts, TOGETHER if model.parts else 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches, lot):
            h, size = sent.value.entropies(b.column("text"), parts)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32()), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("known"), each, pa.array(size, pa.int64())], names=["doc_id", "known", "h", "size"])

    words = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(letters(docs["text"]), F.lit("")).alias("text"), docs["known"].cast("string").alias("known"))
    return stored(words.mapInArrow(released(run), "doc_id long, known string, h array<double>, size long"), "entropies")


def calibrate(model: Model, measured: DataFrame) -> None:
    """Fit temperature and rejection on all documents of :func:`entropies` that have a ``known`` language and letters.

    Sums of losses by temperature, and documents by language and cross-entropy in steps of ``1 / STEPS``, are aggregates;
    the steps of a language are some hundred thousand at most, however many documents there are.
    """
    if not model.langs:
        return
    number = F.create_map(*[x for k, lang in enumerate(model.langs) for x in (F.lit(lang), F.lit(k))])
    own = measured.where("known IS NOT NULL AND size > 0").select("h", "size", number[F.col("known")].alias("k")).where("k IS NOT NULL").select("h", "size", "k", F.get("h", F.col("k")).alias("own"))
    low = F.array_min("h")
    grid = [2.0**k for k in range(-4, 9)]

    def loss(t: float) -> Column:
        scaled = F.transform("h", lambda x: F.exp(-(x - low) * F.sqrt("size") / t))
        return F.log(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)) + (F.col("own") - low) * F.sqrt("size") / t

    sums = own.agg(F.count("*").alias("n"), *[F.sum(loss(t)).alias(f"t{k}") for k, t in enumerate(grid)]).first()
    if not sums.n:
        return
    model.temperature = grid[min(range(len(grid)), key=lambda k: sums[f"t{k}"])]
    per = own.groupBy("k", F.ceil(F.col("own") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("k").orderBy("step"))
    ranked = per.select("k", "step", so_far.alias("so_far"), F.sum("n").over(Window.partitionBy("k")).alias("total"))
    for r in ranked.where(F.col("so_far") >= F.col("total") * REJECT).groupBy("k").agg(F.min("step").alias("step"), F.first("total").alias("total")).collect():
        if r.total >= 20:
            model.reject[r.k] = r.step / STEPS


def predict(model: Model, measured: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, entropy) of every document of :func:`entropies`."""
    if not model.langs:
        return measured.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(0.0).alias("entropy"))
    low = F.array_min("h")
    best = (F.array_position("h", low) - 1).cast("int")
    total = F.aggregate(F.transform("h", lambda x: F.exp(-(x - low) * F.sqrt("size") / model.temperature)), F.lit(0.0), lambda a, x: a + x)
    at = lambda values: F.get(F.array(*map(F.lit, values)), best)
    known = F.col("size") > 0
    return measured.select(
        "doc_id",
        F.when(known, at(model.langs)).otherwise("und").alias("lang_pred"),
        F.when(known, 1 / total).otherwise(0.0).alias("score"),
        (~known | (low > at([float(x) for x in model.reject]))).alias("rejected"),
        F.when(known, low).otherwise(0.0).alias("entropy"),
    )


def identify(docs: DataFrame, held: Column) -> DataFrame:
    """Learn from the documents for which ``held`` is false, predict all: (doc_id, lang_pred, score, rejected, entropy)."""
    learned = ~held & docs["lang"].isNotNull() & docs["text"].isNotNull()
    model = learn(docs.where(learned).select("doc_id", "text", "lang"))
    measured = entropies(model, docs.select("doc_id", "text", F.when(learned, docs["lang"]).alias("known")))
    calibrate(model, measured)
    return predict(model, measured)
