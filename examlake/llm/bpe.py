"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece starts as one token per byte. Leaf ``i`` of the tree holds the rank of the pair that the token starting at
byte ``i`` forms with the next live token; the root is the leftmost smallest one. A merge removes the right token and
updates three leaves: the merged token's, its neighbour's to the left, and the removed one's. Pieces of up to 64
bytes are merged many at a time, one tree per row of a numpy array; longer ones each have a tree of their own.

Texts are cut at single spaces that follow other characters. No match of a pattern like those of the public
tokenizers, in which a space begins a match or stands in a run of white space, crosses such a place, so a part's ids
depend on the part alone and are remembered between documents, in a cache of bounded size. Patterns for which that
does not hold on probes (``cuts_at_spaces``) are applied to whole texts.

Defined cases: null text is the empty text, with no ids; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are not looked at. The vocabulary file is a parameter; it is read on the driver and sent to
the tasks as rank bytes, whose size is that of the file (below 1 MB) and does not depend on the data.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, released, texts

#: White_Space of Unicode, which is what \s means in the pattern; Python's own \s has four more.
_WHITE = r"\t-\r \x85\xa0  -     　"
_MIXED = re.compile(f"[{_WHITE}][{_WHITE}]")
_PARTS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_NONE = np.int64(1) << 40
#: entries in a worker's cache of parts and of pieces; beyond that the older half goes.
CACHE = 300_000
_LONG_PART = 200


def cuts_at_spaces(find) -> bool:
    """Whether a pattern's matches stay the same when probes are cut before single spaces that follow other characters."""
    words = ["a", "Ab", "12", "1234", "don't", ",", "...", "x\n", "é", "漢字", "_", "'s", "-1", "a.b", "$5"]
    probes = [f"{x} {y} {z}" for x in words for y in words for z in ("b", "7", "!")]
    return all([m for p in ((first, *(" " + x for x in rest)),) for part in p for m in find(part)] == find(t) for t in probes for first, *rest in [t.split(" ")] if not _MIXED.search(t))


class Codec:
    """Ranks of byte strings, and what is derived from them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.cuts = cuts_at_spaces(self.find)
        self.table = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to cut a known string into two known ones, as a sorted array of left * 2^20 + right
        keys, values = [], []
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left = ranks.get(whole[:cut])
                right = ranks.get(whole[cut:]) if left is not None else None
                if right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62)
        self.pair_ranks = np.append(np.array(values, np.int64)[order], _NONE)
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, ``_NONE`` for those that don't merge or have no right token (-1)."""
        key = left << 20 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], _NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian bytes, of pieces of 2 to ``width`` bytes; width is a power of two."""
        n, size = len(pieces), np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        at = np.arange(width)
        live = at < size[:, None]
        token = np.where(live, self.byte_ids[flat], -1)
        after = np.minimum(at + 1, width) + np.zeros((n, 1), np.int64)
        before = (at - 1) + np.zeros((n, 1), np.int64)
        # a leaf is rank * width + position, so that of equal ranks the leftmost is the smallest
        tree = np.full((n, 2 * width), _NONE * width, np.int64)
        rank = self.pair_rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width : 2 * width - 1] = np.where(live[:, 1:], rank, _NONE) * width + at[:-1]
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        active = np.flatnonzero(tree[:, 1] < _NONE * width)
        while len(active):
            top = tree[active, 1]
            pos, merged = top % width, top // width
            gone = after[active, pos]
            nxt = after[active, gone]
            prev = before[active, pos]
            token[active, pos], token[active, gone] = merged, -1
            after[active, pos] = nxt
            has_next = (nxt < width) & (nxt < size[active])
            before[active[has_next], nxt[has_next]] = pos[has_next]
            right = np.where(has_next, token[active, np.minimum(nxt, width - 1)], -1)
            self._update(tree, active, pos, self.pair_rank(merged, right), width)
            self._update(tree, active, gone, np.full(len(active), _NONE), width)
            left = prev >= 0
            rows, prev = active[left], prev[left]
            self._update(tree, rows, prev, self.pair_rank(token[rows, prev], merged[left]), width)
            active = active[tree[active, 1] < _NONE * width]
        keep = token >= 0
        ids, counts = token[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)).tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *counts[:-1]], counts, strict=True)]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, pos: np.ndarray, rank: np.ndarray, width: int) -> None:
        node = pos + width
        tree[rows, node] = np.where(rank < _NONE, rank * width + pos, _NONE * width)
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def merge_one(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, by the same tree over Python lists."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none = (1 << 40) * width
        ranks, end = self.ranks, list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def leaf(i: int) -> int:
            stop = end[i]
            rank = ranks.get(piece[i : end[stop]]) if stop < n else None
            return none if rank is None else rank * width + i

        tree = [none] * (2 * width)
        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] < none:
            pos = tree[1] % width
            gone = end[pos]
            end[pos] = end[gone]
            if end[pos] < n:
                before[end[pos]] = pos
            put(gone, none)
            put(pos, leaf(pos))
            if before[pos] >= 0:
                put(before[pos], leaf(before[pos]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return np.array(ids, "<u4").tobytes()

    def learn_pieces(self, pieces: Iterable[str]) -> None:
        """Encode pieces into the cache, the short ones together by width."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            if whole is not None:
                self.pieces[p] = whole.to_bytes(4, "little")
            elif len(b) > 64:
                self.pieces[p] = self.merge_one(b)
            else:
                by_width.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for width, some in by_width.items():
            for at in range(0, len(some), 16384):
                block = some[at : at + 16384]
                for (p, _), ids in zip(block, self.merge_many([b for _, b in block], width), strict=True):
                    self.pieces[p] = ids

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in batch:
            if not self.cuts:
                split.append([text] if text else [])
            elif _MIXED.search(text) or text[:1] == " ":
                # after a match of white space and other characters, the next match starts at white space again
                split.append(_PARTS.findall(text))
            elif not text:
                split.append([])
            else:
                first, *rest = text.split(" ")
                if rest and not rest[-1]:
                    split.append([first, *(" " + x for x in rest[:-1]), " "])
                else:
                    split.append([first, *(" " + x for x in rest)])
        for kept in (self.parts, self.pieces):
            if len(kept) > CACHE:
                for k in list(kept)[: len(kept) // 2]:
                    del kept[k]
        parts = self.parts
        new = {p for each in split for p in each if p not in parts}
        cut = {p: self.find(p) for p in new}
        self.learn_pieces({x for pieces in cut.values() for x in pieces if x not in self.pieces})
        known, long = self.pieces, {}
        for p, pieces in cut.items():
            (parts if len(p) <= _LONG_PART else long)[p] = b"".join([known[x] for x in pieces])
        for pieces in cut.values():
            for x in pieces:
                if len(x) > _LONG_PART:
                    known.pop(x, None)
        if long:
            return [b"".join([parts[p] if p in parts else long[p] for p in each]) for each in split]
        return [b"".join([parts[p] for p in each]) for each in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[bytes, Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: lines of base64 text and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _codec(ranks: dict[bytes, int], pattern: str, key: bytes) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _forget() -> None:
    """Drop what codecs remember between texts."""
    for codec in _CODECS.values():
        codec.parts.clear()
        codec.pieces.clear()


def _coder(docs: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).digest()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    return lambda: _codec(sent.value, pattern, key)


def _by_size(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """(ids, texts) of a batch in blocks of about ``most`` characters."""
    ids, rows, held = [], [], 0
    for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        ids.append(i)
        rows.append(t)
        held += len(t)
        if held > most:
            yield ids, rows
            ids, rows, held = [], [], 0
    if ids:
        yield ids, rows


def _lists(made: list[bytes]) -> pa.ListArray:
    """Ids as little-endian bytes to lists of integers."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids of every whole text, as array<int>; no shuffle."""
    bounded_batches(docs.sparkSession)
    coder = _coder(docs, path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = coder()
        for b in batches:
            for ids, rows in _by_size(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(codec.encode_batch(rows))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(released(run, _forget), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes that ``ids`` stand for; null ids decode to no bytes."""
    bounded_batches(encoded.sparkSession)
    coder = _coder(encoded, path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = coder()
        for b in batches:
            out = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run, _forget), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them; and the ids."""
    bounded_batches(docs.sparkSession)
    coder = _coder(docs, path, pattern)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = coder()
        for b in batches:
            for ids, rows in _by_size(b):
                made = codec.encode_batch(rows)
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) // 4 for x in made], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in made]),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in made]),
                ]
                yield pa.RecordBatch.from_arrays(columns + [_lists(made)] * with_ids, names=names)

    return texts(docs).mapInArrow(released(run, _forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
