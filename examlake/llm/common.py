"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words or are deleted by normalisation.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor and the driver see; a temporary one only on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="examlake-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/examlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    A page holds a hundred rows at least, and codecs keep buffers of the largest page outside the heap; so wide rows that are
    :func:`packed` should be ``uncompressed``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Keep Arrow batches small, in rows and in bytes, as single texts can be very long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 384) -> Iterator[pa.RecordBatch]:
    """Batches cut smaller, for work that takes tens of bytes for each character."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def released(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """``run`` over a task's batches, after which the Python worker hands back what it no longer needs.

    Workers are kept for later tasks, of other stages too; what one leaves would count against them.
    """

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, their bytes by significance, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""]
    data = b"".join(out)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    """What :func:`packed` was given."""
    data, at, out = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), 0, []
    while at < len(data):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 12 + n * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds all, unsigned if none is negative."""
    low, high = int(a.min(initial=0)), int(a.max(initial=0))
    for kind in ("u1", "u2", "u4", "u8") if low >= 0 else ("i1", "i2", "i4", "i8"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return a.astype("<" + kind if kind[1] != "1" else "|" + kind)
    return a


#: partial sums of one key that meet in one group
FAN = 64


def added_up(parts: DataFrame, key: str, add: Callable[[pa.Table], pa.Table], schema: str, name: str) -> DataFrame:
    """One row per ``key`` (and ``source``, 0): partial sums are added at most :data:`FAN` at a time, level by level.

    ``parts`` has one row per key and ``source``, a number from 0 of what made it; ``add`` adds the rows of a group, and
    so bears a fixed number of rows however many tasks there are. Each level is written.
    """
    while True:
        parts = parts.withColumn("source", F.floor(F.col("source") / FAN).cast("int"))
        parts = stored(parts.groupBy(key, "source").applyInArrow(add, schema), name)
        if not parts.where("source > 0").limit(1).count():
            return parts


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row; null text is empty; other columns, whatever their names, are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo: the fold a document belongs to. A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
