"""Exact duplicates by Patricia-trie owners.

Texts are equal when they are the same after every ASCII white-space character is deleted. Each input task
inserts its normalised texts into a compressed radix trie, whose terminal nodes hold the owner so far and the
number of rows; so a text that a third of all rows share leaves each task once. The distinct texts are then
partitioned by length and content hash, and a second trie in each partition settles owner and group size.
A trie that outgrows its memory allowance moves whole subtrees to a temporary file, which is closed and removed
when the task ends; later keys that lead into such a subtree follow it there.

Defined cases: null text is the empty text; all empty texts are one group; an empty table gives an empty result;
of equal texts the longest original stays, then the smallest ``doc_id`` (null last); rows repeated whole share
one decision; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, bounded_batches, released, texts

TRIE_BYTES = 96 << 20
#: bytes of rows that a task holds before it settles them
HELD_BYTES = 24 << 20
_SPACES = ASCII_SPACE.encode()
_NO_ID = 1 << 63

#: owner of a text: (minus code points of the original, doc_id, place), the smallest wins; and the number of rows.
Owner = tuple[int, int, int, int]


def _better(a: Owner, b: Owner) -> Owner:
    return (*min(a[:3], b[:3]), a[3] + b[3])


class _Node:
    __slots__ = ("children", "label", "owner", "spill")

    def __init__(self, label: bytes, owner: Owner | None = None) -> None:
        self.label, self.owner, self.children, self.spill = label, owner, None, None


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the prefix that ``a`` shares with ``b[start:]``, by halving."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[start + low : start + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie from byte strings to owners, with subtrees spilled beyond ``limit`` bytes of labels."""

    def __init__(self, limit: int = TRIE_BYTES) -> None:
        self.root, self.limit, self.held, self.spills = _Node(b""), limit, 0, []

    def insert(self, key: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], owner), node.spill[0])
                return
            if at == len(key):
                node.owner = owner if node.owner is None else _better(node.owner, owner)
                return
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = _Node(key[at:], owner)
                self.held += len(key) - at + 200
                if self.held > self.limit:
                    self._spill_heaviest()
                return
            if not key.startswith(child.label, at):
                n = _common(child.label, key, at)
                upper = _Node(child.label[:n])
                upper.children = {child.label[n]: child}
                child.label = child.label[n:]
                node.children[key[at]] = child = upper
                self.held += 200
            at += len(child.label)
            node = child

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.owner is not None:
                yield prefix, node.owner
            for child in (node.children or {}).values():
                if child.spill is None:
                    stack.append((child, prefix + child.label))

    def _weight(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            stack.extend(c for c in (x.children or {}).values() if c.spill is None)
        return total

    def _spill_heaviest(self) -> None:
        """Move the heaviest subtrees below the first branching to files until half of the allowance is free."""
        top, prefix = self.root, b""
        while top.owner is None and top.children and len(top.children) == 1 and next(iter(top.children.values())).children:
            child = next(iter(top.children.values()))
            if child.spill is not None:
                break
            top, prefix = child, prefix + child.label
        below = sorted(((self._weight(c), k) for k, c in (top.children or {}).items() if c.spill is None), reverse=True)
        for weight, k in below:
            if self.held <= self.limit // 2:
                break
            node = top.children[k]
            out = tempfile.TemporaryFile(prefix="trie-")  # noqa: SIM115
            for key, owner in self._walk(node, b""):
                pickle.dump((key, owner), out)
            node.owner, node.children = None, None
            node.spill = (out, prefix + node.label)
            self.spills.append(node.spill)
            self.held -= weight - len(node.label) - 200

    def items(self) -> Iterator[tuple[bytes, Owner]]:
        """All keys with their owners; spilled subtrees follow one at a time, each in a trie of its own."""
        yield from self._walk(self.root, b"")
        self.root = _Node(b"")
        for out, prefix in self.spills:
            with out:
                out.seek(0)
                # keys lose the prefix that they share, a byte at least, so a subtree that is itself too large ends, too
                below = PatriciaTrie(self.limit)
                try:
                    while True:
                        below.insert(*pickle.load(out))
                except EOFError:
                    pass
            for key, owner in below.items():
                yield prefix + key, owner
        self.spills = []


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, Owner]]:
    for b in batches:
        text = b.column("norm").cast(pa.binary()).to_pylist()
        n, ids, rows = (b.column(c).to_pylist() for c in ("n_points", "doc_id", "n_rows"))
        for t, k, i, r in zip(text, n, ids, rows, strict=True):
            yield t, (-k, _NO_ID if i is None else i, 0, r)


def _owners(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, Owner]]:
    trie = PatriciaTrie()
    for key, owner in _rows(batches):
        trie.insert(key, owner)
    yield from trie.items()


def _flush(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["norm", "n_points", "doc_id", "n_rows"], [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    rows, held = [], 0
    for key, (n, i, _, r) in _owners(batches):
        rows.append((key, -n, None if i == _NO_ID else i, r))
        held += len(key)
        if held > 8 << 20 or len(rows) >= 1024:
            yield _flush(rows, names, types)
            rows, held = [], 0
    if rows:
        yield _flush(rows, names, types)


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names, types = ["text_sha256", "keep_id", "group_size"], [pa.string(), pa.int64(), pa.int64()]
    rows = []
    for key, (_, i, _, r) in _owners(batches):
        rows.append((hashlib.sha256(key).hexdigest(), None if i == _NO_ID else i, r))
        if len(rows) >= 8192:
            yield _flush(rows, names, types)
            rows = []
    if rows:
        yield _flush(rows, names, types)


def owners(docs: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size): one row per distinct normalised text."""
    bounded_batches(docs.sparkSession)
    norm = texts(docs).select(F.translate("text", ASCII_SPACE, "").alias("norm"), F.char_length("text").cast("long").alias("n_points"), "doc_id", F.lit(1).cast("long").alias("n_rows"))
    combined = norm.mapInArrow(released(_combine), "norm binary, n_points long, doc_id long, n_rows long")
    dealt = combined.repartition(F.octet_length("norm"), F.xxhash64("norm"))
    return dealt.mapInArrow(released(_settle), "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document.

    The join back is on the digest; a digest that very many documents share makes a skewed partition, which adaptive
    execution splits, as the owners' side has one row for it.
    """
    found = owners(docs)
    each = texts(docs).select("doc_id", F.sha2(F.translate("text", ASCII_SPACE, "").cast("binary"), 256).alias("text_sha256"))
    return each.join(found, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _rows_of_owners(batches: list[pa.RecordBatch]) -> tuple[pa.Table, list[bytes]]:
    """Of some rows, those that own their text among them, and the normalised texts."""
    rows, trie, place = pa.Table.from_batches(batches), PatriciaTrie(), 0
    for b in batches:
        text = b.column("text").fill_null("")
        points, ids = pc.utf8_length(text).to_pylist(), b.column("doc_id").to_pylist()
        for t, n, i in zip(text.cast(pa.binary()).to_pylist(), points, ids, strict=True):
            trie.insert(t.translate(None, _SPACES), (-n, _NO_ID if i is None else i, place, 1))
            place += 1
    found = [(owner[2], key) for key, owner in trie.items()]
    return rows.take(pa.array([at for at, _ in found], pa.int64())), [key for _, key in found]


def _keep_here(batches: Iterable[pa.RecordBatch], added: tuple[str, str] = ("_length", "_hash")) -> Iterator[pa.RecordBatch]:
    """Drop rows that another row of the task beats, and add length and content hash; large tasks are taken in parts."""
    import hashlib

    def part(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys = _rows_of_owners(held)
        hashes = pa.array([int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in keys], pa.int64())
        yield from rows.append_column(added[0], pa.array([len(k) for k in keys], pa.int64())).append_column(added[1], hashes).to_batches(max_chunksize=512)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > HELD_BYTES:
            yield from part(held)
            held, size = [], 0
    if held:
        yield from part(held)


def _keep_each(batches: Iterable[pa.RecordBatch], added: tuple[str, str] = ("_length", "_hash")) -> Iterator[pa.RecordBatch]:
    """Owners among rows that come in order of length and hash; what is held is settled where a new hash begins."""
    held, size, last = [], 0, None
    for b in batches:
        if size > HELD_BYTES:
            h = b.column(added[1]).to_numpy()
            begins = 0 if h[0] != last else int((h != last).argmax()) or (len(h) if (h == last).all() else 0)
            if begins < b.num_rows:
                if begins:
                    held.append(b.slice(0, begins))
                yield from _rows_of_owners(held)[0].drop_columns([*added]).to_batches(max_chunksize=512)
                held, size, b = [], 0, b.slice(begins)
        held.append(b)
        size += b.nbytes
        last = b.column(added[1])[b.num_rows - 1].as_py()
    if held:
        yield from _rows_of_owners(held)[0].drop_columns([*added]).to_batches(max_chunksize=512)


def keep_owners(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that own their text; of rows repeated whole, one.

    Rows that lose within their task go at once; the others are dealt, whole, by length and content hash, once.
    """
    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    there = {c.lower() for c in docs.columns}
    added = tuple(next(n for n in (f"_{name}{k or ''}" for k in range(len(there) + 1)) if n not in there) for name in ("length", "hash"))
    here = docs.mapInArrow(released(partial(_keep_here, added=added)), f"{schema}, {added[0]} long, {added[1]} long")
    dealt = here.repartition(*added).sortWithinPartitions(*added)
    return dealt.mapInArrow(released(partial(_keep_each, added=added)), docs.schema)
