"""Several tables as one version: data first, then a manifest, which is put in place in one step and only if no one else has.

Below a path, ``data/<id>`` has what a commit wrote and ``manifests/<version>.json`` names, for each table, where its rows are. A version is there once its manifest is;
what a writer left that was stopped before is read by no one and can be swept. A commit names the version it was made from; if another has come since, it fails
with :class:`Conflict` and nothing has changed. Paths are Spark paths; manifests have a line for each table and are read by the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import publishing


class Conflict(RuntimeError):
    """Another commit was made from the same version."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, in order."""
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """What a version holds: {"base": version, "tables": {name: folder below the path}}."""
    if not version:
        return {"base": None, "tables": {}}
    return json.loads(spark.read.text(f"{path}/manifests/{version:012d}.json", wholetext=True).first()[0])


def head(spark: SparkSession, path: str) -> int:
    """The newest version, 0 before any."""
    return max(versions(spark, path), default=0)


def read(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, of the newest if none is named."""
    tables = manifest(spark, path, head(spark, path) if version is None else version)["tables"]
    return {name: spark.read.parquet(f"{path}/{folder}") for name, folder in tables.items()}


def _put_in_place(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file; fails if there is one of that name."""
    fs = spark._jvm.org.apache.hadoop.fs
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    at = fs.Path(target)
    context = fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.Path(source), at, how)
    except Py4JJavaError as failed:
        if failed.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise Conflict(target) from failed
        raise


def commit(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], base: int) -> int:
    """Write tables and make them the version after ``base``; tables that are not given are those of ``base``."""
    folder = f"data/{uuid.uuid4().hex}"
    named = dict(manifest(spark, path, base)["tables"])
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{folder}/{name}")
        named[name] = f"{folder}/{name}"
    draft = f"{path}/{folder}/manifest.json"
    at, fs = _files(spark, draft)
    out = fs.create(at)
    out.write(bytearray(json.dumps({"base": base, "tables": named}).encode()))
    out.close()
    fs.mkdirs(_files(spark, f"{path}/manifests")[0])
    _put_in_place(spark, draft, f"{path}/manifests/{base + 1:012d}.json")
    return base + 1


def left_over(spark: SparkSession, path: str) -> list[str]:
    """Folders of data that no version names: those of writers that were stopped or lost, or are at work."""
    known = {folder.split("/")[1] for v in versions(spark, path) for folder in manifest(spark, path, v)["tables"].values()}
    return [n for n in _names(spark, f"{path}/data") if n not in known]


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove what is left over; to be run while no one writes."""
    gone = left_over(spark, path)
    for n in gone:
        at, fs = _files(spark, f"{path}/data/{n}")
        fs.delete(at, True)
    return gone


def publish(spark: SparkSession, path: str, new: Mapping[str, DataFrame], content: Sequence[str], as_of: Column, owner: Column, children: Sequence[str] = (), satellites: Sequence[str] = ()) -> int:
    """Publish papers with their questions, children and assets as one version; the store must have been made by :func:`commit` before.

    Papers of the other mode are refused, with nothing written.
    """
    base = head(spark, path)
    old = read(spark, path, base)
    other = [r.name for r in publishing.refused(old["papers"], new["papers"]).orderBy("name").limit(5).collect()]
    if other:
        raise ValueError(f"papers with reference answers alone: {', '.join(other)}")
    return commit(spark, path, publishing.next_state(old, new, content, as_of, owner, children, satellites), base)
