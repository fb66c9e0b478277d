"""Bounded samples of labelled documents, and what classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def hashed_sample(rows: DataFrame, key: list[str], count: int, most: int) -> DataFrame:
    """At most ``most`` rows of ``count``, those with the smallest hashes of their key.

    A threshold lets through about half as many again as are wanted, so the task that puts them in order gets no more,
    however many partitions there are.
    """
    share = min(1.0, (1.5 * most + 50) / max(count, 1))
    h = F.xxhash64(*key)
    return rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.pmod(h, F.lit(1 << 30)), h, *key).limit(most)


def known_labels(labels: DataFrame, label: str, held: Column) -> DataFrame:
    """(doc_id, y): the label, 0 or 1, of each id that is not ``held``; 1 where an id has both."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


#: bytes of text that a sample holds at most
SAMPLE_BYTES = 96 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, lang, y) of at most ``per_class`` documents of each label, by hash of the id; and all labels' counts.

    ``held`` is a condition on ``doc_id``; documents that meet it are never in the sample. The ids, at most twice
    ``per_class``, are broadcast. However many rows have an id, one of them is taken, by hash of the text; and, in order of the ids' hashes, as many rows
    as :data:`SAMPLE_BYTES` of whole texts hold.
    """
    known = known_labels(labels, label, held)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    some = [hashed_sample(known.where(F.col("y") == y), ["doc_id"], counts.get(y, 0), per_class) for y in (0, 1)]
    chosen = some[0].union(some[1])
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), lang.alias("lang"))
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text", "lang").alias("hash"), "text", "lang")).alias("row"))
    rows = stored(rows.select("doc_id", "y", "row.text", "row.lang"), "labelled")
    h = F.xxhash64("doc_id")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.pmod(h, F.lit(1 << 30)), h, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = rows.select("doc_id", so_far.alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES).select("doc_id")
    return rows.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "lang", "y"), counts


def fifths(y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(calibrate, train): a fifth of each label's rows calibrates; where a label has under five, all rows do both."""
    own = [rng.permutation(np.flatnonzero(y == k)) for k in (0, 1)]
    if min(map(len, own)) < 5:
        return np.arange(len(y)), rng.permutation(len(y))
    return np.sort(np.concatenate([x[: len(x) // 5] for x in own])), rng.permutation(np.concatenate([x[len(x) // 5 :] for x in own]))


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a sample the class shares of all labels."""
    out = np.ones(len(y))
    for k in (0, 1):
        if (y == k).any():
            out[y == k] = counts.get(k, 0) / (y == k).sum()
    return out / max(out.mean(), 1e-12)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least weighted log loss on a calibration set."""
    if not len(y):
        return 1.0
    grid = 2.0 ** np.arange(-3, 4.01, 0.25)
    loss = [np.sum(weight * np.logaddexp(0, -(2 * y - 1) * logit / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])
