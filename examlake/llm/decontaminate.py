"""Benchmark passages in documents, by pigeonhole pieces and bit-parallel edit distance.

Texts and items are reduced to their words: A-Z lower-cased, every run of other ASCII than digits and letters one
space, and a space before and after, so that an item is not found within longer words. An item of m bytes may differ
by ``rate`` times m edits. It is cut into one piece more than that, so a passage within the budget holds one piece at
least unchanged. All pieces of all items go into one Aho-Corasick automaton, which each task runs over its documents.
Where an item stands unchanged, that is a place; the other finds of its pieces are put together to regions, and Myers'
bit-parallel algorithm gives the nearest stretch of a region, then those before and after it.

Items are sent to the tasks in blocks of bounded size, one pass over the documents for each block, so nothing that
is broadcast grows with either table. A benchmark below ``BLOCK_BYTES`` takes one pass without a shuffle.

Defined cases: null or wordless items match nothing; null text has no matches; an item that stands in a document
several times gives one row, with the number of places; repeated items or documents give repeated rows only if both
their id and text repeat; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, released, stored, texts

RATE = 0.07
BLOCK_BYTES = 4 << 20

_TO_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_SCHEMA = "doc_id long, item_id long, distance int, budget int, places int, norm_start int, norm_end int"

Item = tuple[int | None, bytes]


def words_only(text: str | bytes) -> bytes:
    """The normal form that is matched."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return b" ".join(data.translate(_TO_WORDS).split())


def edit_search(pattern: bytes, text: bytes, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` nearest to ``pattern``, the first such end; None if beyond the budget.

    Myers: the vertical differences of a column of the edit matrix are two bit vectors, moved on by one character of
    text with a handful of operations. ``anchored``: the stretch begins where the text does.
    """
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score, best = mask, 0, m, None
    if anchored and m <= budget:
        best = (m, 0)
    for at, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & mask
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & mask
        mh = mh << 1 & mask
        plus = mh | ~(xv | ph) & mask
        minus = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """An automaton of the pieces of some items."""

    def __init__(self, items: list[Item], rate: float) -> None:
        import ahocorasick

        self.items = [(i, b" " + p + b" ", int(len(p) * rate)) for i, p in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, p, budget) in enumerate(self.items):
            cuts = [len(p) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(p[a:b].decode("latin-1"), []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: bytes) -> Iterator[tuple[int | None, int, int, int, int, int]]:
        """(item, distance, budget, places, start, end) of each item in a normal form; the nearest place, then the first."""
        if not self.items or not text:
            return
        spaced = b" " + text + b" "
        tried: dict[int, set[int]] = {}
        for last, places in self.automaton.iter(spaced.decode("latin-1")):
            for n, piece_end in places:
                tried.setdefault(n, set()).add(last + 1 - piece_end)
        for n, starts in tried.items():
            item, pattern, budget = self.items[n]
            found = self._places(pattern, budget, spaced, sorted(starts))
            if found:
                distance, start, end = min(found)
                # back to the text without the added spaces, and to the stretch without those at its ends
                start += spaced[start : start + 1] == b" "
                end -= spaced[end - 1 : end] == b" "
                yield item, distance, budget, len(found), start - 1, max(end, start) - 1

    @staticmethod
    def _places(pattern: bytes, budget: int, text: bytes, starts: list[int]) -> list[tuple[int, int, int]]:
        """(distance, start, end) of all places that do not overlap, the unchanged ones first."""
        m, found, past = len(pattern), [], 0
        for start in starts:
            if start >= past and text.startswith(pattern, start):
                # the space at the end may be that at the beginning of the next place
                found.append((0, start, start + m))
                past = start + m - 1
        taken, regions = found[:], []
        for start in starts:
            low, high = max(0, start - budget), min(len(text), start + m + budget)
            if regions and low <= regions[-1][1]:
                regions[-1][1] = high
            else:
                regions.append([low, high])
        at = 0
        for low, high in regions:
            # what unchanged places leave of the region
            while at < len(taken) and taken[at][2] <= low:
                at += 1
            k = at
            while k < len(taken) and taken[k][1] < high:
                found += _nearest(pattern, budget, text, low, taken[k][1] + 1)
                low = taken[k][2] - 1
                k += 1
            found += _nearest(pattern, budget, text, low, high)
        return found


def _nearest(pattern: bytes, budget: int, text: bytes, low: int, high: int) -> list[tuple[int, int, int]]:
    """The nearest stretch within ``text[low:high]`` and those on both sides of it, as far as they are within the budget."""
    out, open_ = [], [(low, high)]
    while open_:
        low, high = open_.pop()
        if high - low < len(pattern) - budget:
            continue
        window = text[low:high]
        hit = edit_search(pattern, window, budget)
        if hit:
            distance, end = hit
            begin = max(0, end - len(pattern) - budget)
            back = edit_search(pattern[::-1], window[begin:end][::-1], distance, anchored=True)
            start = end - back[1]
            out.append((distance, low + start, low + end))
            open_ += [(low, low + start + 1), (low + end - 1, high)] if start and end < high - low else [(low, low + start + 1)] if start else [(low + end - 1, high)] if end < high - low else []
    return out


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: list[Item], rate: float, key: tuple) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate)
    return _MATCHERS[key]


def _blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """Items in blocks of at most ``BLOCK_BYTES`` (or one larger item), one block in memory at a time."""
    block, held = [], 0
    for row in benchmark.select(benchmark["item_id"].cast("long").alias("i"), benchmark["text"].cast("string").alias("t")).where("t is not null").toLocalIterator():
        p = words_only(row.t)
        if p:
            if held + len(p) > BLOCK_BYTES and block:
                yield block
                block, held = [], 0
            block.append((row.i, p))
            held += len(p)
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget, places, norm_start, norm_end): one row per document and item found in it."""
    bounded_batches(docs.sparkSession)
    types = [pa.int64(), pa.int64()] + [pa.int32()] * 5
    names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]

    def over(block: list[Item]) -> DataFrame:
        matcher = _shared(docs, block, rate)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = matcher().find
            for b in batches:
                rows = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    rows += [(doc, *x) for x in find(words_only(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        return texts(docs).mapInArrow(released(run), _SCHEMA)

    blocks = _blocks(benchmark)
    out, following = over(next(blocks)), next(blocks, None)
    if following is None:
        return out
    # each block's matches are written once, and put together at the end
    parts = [stored(out, "matches")]
    while following is not None:
        parts.append(stored(over(following), "matches"))
        following = next(blocks, None)
    return reduce(DataFrame.union, parts)


def _shared(docs: DataFrame, block: list[Item], rate: float):
    """A function that gives a task the matcher of a block, built once in each Python worker."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    key = (docs.sparkSession.sparkContext.applicationId, uuid.uuid4().hex)
    return lambda: _matcher(sent.value, rate, key)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found; no shuffle."""
    bounded_batches(docs.sparkSession)
    schema = docs.schema

    def without(some: DataFrame, block: list[Item]) -> DataFrame:
        matcher = _shared(docs, block, rate)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = matcher().find
            for b in batches:
                yield b.filter(pa.array([x is None or next(find(words_only(x)), None) is None for x in b.column("text").cast(pa.binary()).to_pylist()], pa.bool_()))

        return some.mapInArrow(released(run), schema)

    blocks = _blocks(benchmark)
    out, following = without(docs, next(blocks)), next(blocks, None)
    while following is not None:
        out = without(stored(out, "clean"), following)
        following = next(blocks, None)
    return out
