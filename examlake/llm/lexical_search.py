"""Ranked lexical search over a quantised index in two levels.

Documents stay where they are: each task cuts its documents into blocks of bounded size and writes a row per block. Its
first level has, for each term, the documents that hold it and their impacts in one byte, rounded upward; the second has the exact
counts. A search goes through the blocks once for each part of the items. For an item it sums the bytes into an upper bound for each document (and, a step lower
for each term, into a lower bound), keeps the k highest lower bounds that its task has seen, and scores exactly, in whole
numbers, every document of the block whose upper bound reaches the k-th of them. That is never above the k-th lower bound of all documents, so none that belongs into the
result goes unscored. Each task hands on k documents for an item at most; they are ranked among groups of tasks, then at last.

The items go to the tasks in parts of :data:`PART_TERMS` terms, so what is broadcast has a fixed size; each part is one pass over the index.

Terms are runs of letters and digits, A-Z lower-cased, kept as 64-bit hashes: among n terms of the documents and q of the items two
share a hash with probability below n q / 2^64.

Defined cases: a null text has no terms; documents and items without terms get no rows; a term that no document holds adds nothing; rows with the
same id are documents (or items) each; equal scores are ranked by ``doc_id``, null last; empty tables give an empty result; columns other
than ``doc_id``, ``item_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, narrow, packed, released, stored, texts, unpacked
from .words import flat_bytes, span_hashes

#: bytes of text, or documents, that end a block
BLOCK_BYTES, BLOCK_DOCS = 6 << 20, 4096
#: terms of items in one part
PART_TERMS = 1 << 18
#: an impact is a part of 1000000; a byte holds it in steps of this
STEP = -(-1_000_000 // 255)
#: groups of tasks among which an item's documents are ranked first
GROUPS = 256
_LONG = np.iinfo(np.int64).max

_PART = np.zeros(256, bool)
_PART[48:58] = _PART[65:91] = _PART[97:123] = _PART[128:] = True

INDEX = "ids binary, terms binary, docs binary, impacts binary, counts binary, sizes binary"


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the terms of all texts in order, and where each text's begin; the last offset is their number."""
    data, offsets = flat_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _PART[data]
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | bound[1:-1]
    ends[:-1] &= ~inside[1:] | bound[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return span_hashes(data, starts, [ends])[0], np.searchsorted(starts, offsets)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth in a document, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_part(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m: how long documents of ``n`` terms are beside the mean."""
    return 100 - 75 + (75 * n * docs) // max(terms, 1)


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for b in batches:
        for at in range(0, b.num_rows, 64):
            n = np.diff(term_hashes(b.column("text").slice(at, 64))[1])
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


def _block(rows: list[tuple[np.ndarray, np.ndarray, list]], docs: int, terms: int) -> pa.RecordBatch:
    """One row of the index from (hashes, lengths, ids) of successive texts."""
    hashes, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.int64)
    ids = [i for r in rows for i in r[2]]
    doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf, doc, term = np.diff(np.append(first, len(hashes))), doc[first], hashes[first]
    quantised = -(-impact(tf, length_part(n, docs, terms)[doc]) // STEP)
    head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    known = np.array([i is not None for i in ids], bool)
    columns = [
        packed(np.array([i or 0 for i in ids], np.int64), known.view(np.uint8)),
        packed(term[head], narrow(np.diff(np.append(head, len(term))))),
        packed(narrow(doc)),
        packed(quantised.astype(np.uint8)),
        packed(narrow(tf)),
        packed(narrow(n)),
    ]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=[c.split()[0] for c in INDEX.split(", ")])


def _blocks(batches: Iterable[pa.RecordBatch], docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    held, size, count = [], 0, 0
    for b in batches:
        for at in range(0, b.num_rows, 64):
            text, ids = b.column("text").slice(at, 64), b.column("doc_id").slice(at, 64).to_pylist()
            hashes, offsets = term_hashes(text)
            held.append((hashes, np.diff(offsets), ids))
            size, count = size + text.nbytes, count + len(ids)
            if size > BLOCK_BYTES or count >= BLOCK_DOCS:
                yield _block(held, docs, terms)
                held, size, count = [], 0, 0
    if held:
        yield _block(held, docs, terms)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    bounded_batches(docs.sparkSession)
    r = texts(docs).mapInArrow(released(_lengths), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def build_index(docs: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The index over ``docs``, a row per block, written in the shared folder. ``size`` is :func:`corpus_size` of them."""
    bounded_batches(docs.sparkSession)
    return stored(texts(docs).mapInArrow(released(partial(_blocks, docs=size[0], terms=size[1])), INDEX), "lexical-index")


def _counted(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """In how many documents of the task's blocks each of the asked terms is."""
    asked, total = shared.value, np.zeros(len(shared.value), np.int64)
    for b in batches:
        for data in b.column("terms"):
            term, held_by = unpacked(data.as_py())
            at = np.searchsorted(term, asked)
            at[at == len(term)] = 0
            if len(term):
                total += np.where(term[at] == asked, held_by[at], 0)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"place": pa.array(there, pa.int64()), "df": pa.array(total[there], pa.int64())})


def bounds(wanted: Iterable[tuple[int, int]], spans: np.ndarray, doc: np.ndarray, level: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) bounds of ``n`` documents' scores; ``wanted`` has (place of the term in the block, weight times occurrences)."""
    upper, slack = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t, w in wanted:
        at = slice(spans[t], spans[t + 1])
        upper[doc[at]] += w * STEP * level[at]
        slack[doc[at]] += w * STEP * (level[at] > 0)
    return upper, upper - slack


def _found(batches: Iterable[pa.RecordBatch], shared, k: int, size: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The task's ``k`` best documents for each item, as (item, doc_id, score)."""
    terms, items = shared.value
    lowest = [np.zeros(0, np.int64) for _ in items]
    best: list[list[tuple[int, bool, int]]] = [[] for _ in items]
    for b in batches:
        for row in range(b.num_rows):
            at = {c: unpacked(b.column(c)[row].as_py()) for c in b.schema.names}
            (ids, known), (term, held_by), (doc,), (level,), (tf,), (n,) = (at[c] for c in ("ids", "terms", "docs", "impacts", "counts", "sizes"))
            if not len(term):
                continue
            level, spans = level.astype(np.int64), np.concatenate([[0], np.cumsum(held_by, dtype=np.int64)])
            place = np.searchsorted(term, terms)
            place[place == len(term)] = 0
            place[term[place] != terms] = -1
            m = length_part(n.astype(np.int64), *size)
            for i, (asked, weight) in enumerate(items):
                here = place[asked]
                wanted = [(int(t), int(w)) for t, w in zip(here[here >= 0], weight[here >= 0], strict=True)]
                if not wanted:
                    continue
                upper, lower = bounds(wanted, spans, doc, level, len(n))
                lowest[i] = np.sort(np.concatenate([lowest[i], np.sort(lower)[-k:]]))[-k:]
                reach = lowest[i][0] if len(lowest[i]) == k else 0
                some = np.flatnonzero((upper >= reach) & (upper > 0))
                score = np.zeros(len(some), np.int64)
                for t, w in wanted:
                    own = doc[spans[t] : spans[t + 1]]
                    p = np.searchsorted(own, some)
                    p[p == len(own)] = 0
                    hit = own[p] == some
                    score[hit] += w * impact(tf[spans[t] : spans[t + 1]][p[hit]].astype(np.int64), m[some[hit]])
                some, score = some[score > 0], score[score > 0]
                best[i] = sorted(best[i] + [(-int(s), not known[d], int(ids[d])) for d, s in zip(some, score, strict=True)])[:k]
    rows = [(i, None if none else d, -s) for i, own in enumerate(best) for s, none, d in own]
    for at in range(0, len(rows), 8192):
        item, doc_id, score = zip(*rows[at : at + 8192], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, offsets = term_hashes(b.column("text"))
        own = [sorted(Counter(hashes[low:high].view(np.int64).tolist()).items()) for low, high in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([[t for t, _ in x] for x in own], pa.list_(pa.int64())), pa.array([[c for _, c in x] for x in own], pa.list_(pa.int64()))], names=["item_id", "terms", "times"])


def item_parts(items: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray, np.ndarray]]]:
    """Items as (item_id, distinct term hashes, occurrences), in parts of at most :data:`PART_TERMS` terms; one item at least."""
    bounded_batches(items.sparkSession)
    own = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text"))
    part, size = [], 0
    for r in stored(own.mapInArrow(_asked, "item_id long, terms array<long>, times array<long>"), "lexical-items").toLocalIterator():
        if part and size + len(r.terms) > PART_TERMS:
            yield part
            part, size = [], 0
        if r.terms:
            part.append((r.item_id, np.array(r.terms, np.int64).view(np.uint64), np.array(r.times, np.int64)))
            size += len(r.terms)
    if part:
        yield part


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents among all, with a score above 0."""
    spark = docs.sparkSession
    size = corpus_size(docs)
    index = build_index(docs, size)
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in item_parts(items):
        terms = np.unique(np.concatenate([t for _, t, _ in part]))
        shared = spark.sparkContext.broadcast(terms)
        df = np.zeros(len(terms), np.int64)
        for r in index.select("terms").mapInArrow(partial(_counted, shared=shared), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():
            df[r.place] = r.df
        weight = weights(df, size[0])
        places = [np.searchsorted(terms, t) for _, t, _ in part]
        asked = spark.sparkContext.broadcast((terms, [(p[weight[p] > 0], (weight[p] * c)[weight[p] > 0]) for p, (_, _, c) in zip(places, part, strict=True)]))
        found = index.mapInArrow(released(partial(_found, shared=asked, k=k, size=size)), "item int, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for group in ([F.pmod(F.spark_partition_id(), F.lit(GROUPS))], []):
            found = found.withColumn("group", *group) if group else found
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", *(["group"] if group else [])).orderBy(*order))).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _, _) in enumerate(part)], "item int, item_id long")
        result = result.union(stored(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "lexical-part"))
    return result
