"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is the multiset of its lower-cased word shingles. Each element's weight range is cut into regions [0,1),
[1,2), [2,4), ...; darts fall on a region at random ranks, at a rate equal to its width, all from hashes of element,
region and number, so that two documents that share an element see the same darts. A dart counts if it lies below
the element's weight; darts are thrown up to the rank at which k ln k + 2k of them are expected, and for the few
documents with a coordinate still empty, up to twice that, and so on. Each dart belongs to one of k coordinates; the
earliest of each is the signature. Two signatures agree at a coordinate with probability equal to the weighted
Jaccard similarity.

Bands of the signature are joined by hash. A bucket first links every member to one pivot; pairs are tested on their
signatures and then exactly, on the texts. Where a bucket's members are still in different components, those that no
other can be similar to are set aside, and the rest are compared across components, too, so that no candidate link is
lost to the choice of pivot: pair by pair in small buckets, by tiles in large ones.
With 32 bands of 6, a pair of similarity 0.8 becomes a candidate with probability 0.99994, and more above.

Defined cases: null text is empty; texts with the same shingle multiset, empty texts among them, are copies and
share a class; a text of one to four words is one shingle; the class id is the smallest ``doc_id`` of the class (null
only if all are null); repeated rows share a class; an empty table gives an empty result; other columns are not
looked at. Shingles are compared by 44-bit hashes within a pair of documents, shingle multisets by 64-bit ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, stored, texts
from .graph import components
from .words import mix, seeded, shingle_hashes, unit, word_hashes

BANDS, ROWS = 32, 6
SIMILARITY = 0.8
PRUNING_ROUNDS = 2
#: buckets up to this size are compared by joined pairs, larger ones by tiles of about so many nodes
PAIRED, TILE = 8, 512
#: parts of a band's or class's members in joins
SALTS = 8
#: a signature of 192 agrees below this share with probability under 1e-6 at similarity 0.8
_LOWEST_AGREEMENT = 0.66


def weighted_elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, document, offsets): distinct shingles of each text with their numbers, by document and element."""
    shingles, offsets = shingle_hashes(*word_hashes(column))
    docs = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(offsets))
    key = np.sort(docs << np.uint64(44) | shingles >> np.uint64(20))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    doc = (key >> np.uint64(44)).astype(np.int64)
    return key & np.uint64((1 << 44) - 1), weight, doc, np.searchsorted(doc, np.arange(len(column) + 1))


def dart_signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures, one row of ``k`` 32-bit values per document; rows of documents without elements are zero."""
    total = np.bincount(doc, weight, n_docs)
    out = np.zeros((n_docs, k), np.uint32)
    todo = total > 0
    darts = k * math.log(k) + 2 * k
    while todo.any():
        keep = todo[doc]
        best, value = _throw(element[keep], weight[keep], doc[keep], darts / np.maximum(total, 1), n_docs, k)
        done = todo & np.isfinite(best).all(1)
        out[done] = value[done]
        todo &= ~done
        darts *= 2
    return out


def _throw(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, limit: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest rank and dart of each coordinate, of darts whose rank is at most the document's ``limit``."""
    best, value = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint32)
    region, low, width = 0, 0, 1
    at = np.arange(len(element))
    while len(at):
        key = seeded(element[at], region)
        active, rank, begun, some = at, np.zeros(len(at)), 0, 1
        while len(active):
            dart = mix(key[:, None] + (np.arange(begun, begun + some, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
            ranks = rank[:, None] + np.cumsum(-np.log(unit(dart)) / width, axis=1)
            inside = ranks <= limit[doc[active]][:, None]
            row, col = np.nonzero(inside)
            found, when, whose = mix(dart[row, col] + np.uint64(0xA0761D6478BD642F)), ranks[row, col], active[row]
            if region:
                hit = low + width * unit(seeded(found, 7)) <= weight[whose]
                found, when, whose = found[hit], when[hit], whose[hit]
            slot = doc[whose] * k + (found % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, when)
            won = best[slot] == when
            value[slot[won]] = (found[won] >> np.uint64(32)).astype(np.uint32)
            more = inside[:, -1]
            active, key, rank = active[more], key[more], ranks[more, -1]
            begun, some = begun + some, min(2 * some, 64)
        region, low, width = region + 1, 2 ** region, 2 ** region
        at = at[weight[at] > low]
    return best.reshape(n_docs, k), value.reshape(n_docs, k)


def profiles(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """A hash of each document's shingle multiset."""
    out = np.zeros(n_docs, np.uint64)
    np.add.at(out, doc, mix(seeded(element, 11) * weight.astype(np.uint64) + weight.astype(np.uint64)))
    return mix(out + np.uint64(1))


def _blocks(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in _blocks(big):
            element, weight, doc, _ = weighted_elements(b.column("text"))
            made = dart_signatures(element, weight, doc, b.num_rows, BANDS * ROWS)
            bands = made.reshape(-1, ROWS).astype(np.uint64)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), b.num_rows)
            for k in range(ROWS):
                key = mix(key * np.uint64(0x2545F4914F6CDD1D) + bands[:, k])
            offsets = np.arange(0, (b.num_rows + 1) * BANDS, BANDS, dtype=np.int32)
            short = made.astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(profiles(element, weight, doc, b.num_rows).view(np.int64)),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64))),
                    pa.array(np.bincount(doc, minlength=b.num_rows) > 0),
                ],
                names=["doc_id", "node", "signature", "bands", "has_words"],
            )


def _with_node(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in _blocks(big):
            element, weight, doc, _ = weighted_elements(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(profiles(element, weight, doc, b.num_rows).view(np.int64)), b.column("text")], names=["node", "text"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, signature, bands, has_words): ``node`` is the hash of the shingle multiset."""
    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(released(_sketch), "doc_id long, node long, signature binary, bands array<long>, has_words boolean")


def _agreement(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            near = (x == y).mean(1) >= _LOWEST_AGREEMENT
            yield b.select(["a", "b"]).filter(pa.array(near))


def weighted_jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of two columns of texts, row by row; two empty texts have 1."""
    ex, wx, dx, _ = weighted_elements(left)
    ey, wy, dy, _ = weighted_elements(right)
    n = len(left)
    x, y = dx.astype(np.uint64) << np.uint64(44) | ex, dy.astype(np.uint64) << np.uint64(44) | ey
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    both = y[at] == x if len(y) else np.zeros(len(x), bool)
    common = np.bincount(dx[both], np.minimum(wx[both], wy[at[both]]), n)
    total = np.bincount(dx, wx, n) + np.bincount(dy, wy, n) - common
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def _exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in _blocks(big, 128):
            near = weighted_jaccard(b.column("text_a"), b.column("text_b")) >= SIMILARITY
            yield b.select(["a", "b"]).filter(pa.array(near))


def _shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in _blocks(big):
            element, weight, doc, _ = weighted_elements(b.column("text"))
            node = b.column("node").to_numpy(zero_copy_only=False)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(element.view(np.int64)), pa.array(weight.astype(np.int64))], names=["node", "shingle", "w"])


def _linked(pairs: DataFrame, reps: DataFrame, text: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar: first by signature, then by text."""
    side = lambda s: reps.select(F.col("node").alias(s), F.col("signature").alias(f"sig_{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(released(_agreement), "a long, b long")
    one = lambda s: text.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
    joined = stored(near, "near").join(one("a"), "a").join(one("b"), "b")
    return stored(joined.select("a", "b", "text_a", "text_b").mapInArrow(released(_exact), "a long, b long"), "linked").distinct()


def _by_band(left: DataFrame, bands: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` (band, node, ...) joined with one row per band, which is there once for each of ``SALTS`` parts of the nodes, so
    that the members of a hot band are dealt to as many tasks."""
    spread = bands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(spread, ["band", "salt"], how).drop("salt")


def _split_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """(band, node, pivot, comp) of the buckets whose members are in several components."""
    member = members.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = member.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
    return _by_band(member, split, "left_semi").select("band", "node", "pivot", "comp")


def _can_link(members: DataFrame, text: DataFrame) -> DataFrame:
    """``members`` without nodes that cannot be similar to another of them.

    A node whose shingles that no other node has weigh more than 1 - ``SIMILARITY`` of its own total is similar to none,
    as its overlap with any other is at most the rest. Without it, shingles of others become unique in turn.
    """
    nodes = members.select("node").distinct()
    shingles = stored(text.join(nodes, "node", "left_semi").mapInArrow(released(_shingles), "node long, shingle long, w long"), "shingles")
    for _ in range(PRUNING_ROUNDS):
        single = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.sum("w").alias("own")).where("n = 1")
        own = single.groupBy("node").agg(F.sum("own").alias("own"))
        total = shingles.groupBy("node").agg(F.sum("w").alias("total"))
        out = stored(total.join(own, "node").where(F.col("own") > (1 - SIMILARITY) * F.col("total") + 1e-9).select("node"), "unlike")
        members = members.join(out, "node", "left_anti")
        shingles = shingles.join(out, "node", "left_anti")
    return members


def tile_links(rows: pa.Table) -> pa.Table:
    """Similar pairs that join the components of some texts: overlaps are products of a matrix of texts by shared shingles.

    A shingle of weight c counts as c columns, so that overlaps are those of the weighted sets.
    """
    rows = rows.combine_chunks()
    node, comp = (rows.column(c).to_numpy() for c in ("node", "comp"))
    element, weight, doc, _ = weighted_elements(pa.concat_arrays(rows.column("text").chunks))
    total = np.bincount(doc, weight, len(node))
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    doc = np.repeat(doc, weight)
    _, column, times = np.unique(seeded(np.repeat(element, weight), 3) + copy.astype(np.uint64), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    column, doc = number[column[shared]], doc[shared]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    common = np.zeros((len(node), len(node)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        dense = np.zeros((len(node), int(column[b - 1]) - low + 1), np.float32)
        dense[doc[a:b], column[a:b] - low] = 1
        common += dense @ dense.T
    near = common >= SIMILARITY * (total[:, None] + total[None, :] - common) - 1e-3
    a, b = np.nonzero(np.triu(near & (comp[:, None] != comp[None, :]), 1))
    # as many links as join the components that are similar here, no more
    kind = np.unique(comp, return_inverse=True)[1]
    both = np.sort(np.stack([kind[a], kind[b]]), axis=0)
    one = np.unique(both[0] * len(node) + both[1], return_index=True)[1]
    owner, kept = list(range(len(node))), []

    def top(k: int) -> int:
        while owner[k] != k:
            owner[k] = k = owner[owner[k]]
        return k

    for i in one.tolist():
        x, y = top(int(both[0, i])), top(int(both[1, i]))
        if x != y:
            owner[y] = x
            kept.append(i)
    a, b = a[kept], b[kept]
    return pa.table({"a": pa.array(np.minimum(node[a], node[b])), "b": pa.array(np.maximum(node[a], node[b]))})


def _linked_in_tiles(members: DataFrame, text: DataFrame) -> DataFrame:
    """Similar pairs of nodes of large buckets, (band, node, comp, n): every two tiles of a bucket meet in one task.

    A tile has about ``TILE`` nodes whatever the bucket's size; fewer links than nodes leave a task.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    dealt = members.select("band", "node", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    dealt = dealt.select("band", "node", "comp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return stored(dealt.join(text, "node").groupBy("band", "low", "high").applyInArrow(tile_links, "a long, b long"), "tile-links").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, kept): one row per document."""
    made = stored(sketches(docs), "sketches")
    # one representative of each shingle multiset; only distinct ones are compared
    reps = stored(made.where("has_words").groupBy("node").agg(F.min_by(F.struct("doc_id", "signature", "bands"), F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("r")).select("node", "r.*"), "representatives")
    bands = reps.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(_by_band(bands, shared), "members")
    # ids may repeat or be null: a text counts for the node that its own shingles have; a merge join at every size
    wanted = reps.join(members.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    text = texts(docs).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").mapInArrow(released(_with_node), "node long, text string")
    text = stored(text, "candidate-texts")
    star = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = _linked(star, reps, text)
    # what shares a bucket but no component yet
    left = stored(_split_buckets(members, components(links)), "unlinked")
    left = stored(_can_link(left, text), "unlinked")
    sized = stored(_by_band(left, left.groupBy("band").agg(F.count("*").alias("n"))), "unlinked")
    few = sized.where(F.col("n") <= PAIRED)
    x, y = few.select("band", F.col("node").alias("a"), F.col("comp").alias("ca"), "pivot"), few.select("band", F.col("node").alias("b"), F.col("comp").alias("cb"))
    across = x.join(y, "band").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & (F.col("a") != F.col("pivot"))).select("a", "b").distinct()
    label = components(links.union(_linked(across, reps, text)).union(_linked_in_tiles(sized.where(F.col("n") > PAIRED), text)).distinct())
    node = made.select("doc_id", "node").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # only classes of several rows are joined back, salted; a document alone is its own class
    classes = node.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = node.withColumn("salt", F.pmod(F.xxhash64("doc_id", "node"), F.lit(SALTS)).cast("int")).join(classes, ["comp", "salt"], "left")
    alone = F.col("class_size").isNull()
    both = both.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_own"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_own"]), "left_semi")
