"""Keyed stores as Parquet: assets by content, a cache by digest, and published snapshots.

A snapshot is written under a new version and read by the highest one, so readers never see half of it. Paths are
Spark paths throughout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..operators import merge
from ..operators.windows import natural_key


def object_key(sha: Column, name: Column) -> Column:
    """Where content lies: sharded by the first digits of its digest, with the name's extension, at most 12 long."""
    extension = F.lower(F.left(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1), F.lit(12)))
    return F.concat(F.lit("papers/"), F.substring(sha, 1, 2), F.lit("/"), sha, extension)


def put_assets(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """One object per different content: (sha256, object_key, bytes, mime, names)."""
    sha = F.sha2(content, 256)
    kind = F.lower(F.regexp_extract(F.col(name), r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(kind == "png", "image/png").when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind == "pdf", "application/pdf").when(kind == "json", "application/json").otherwise("application/octet-stream")
    rows = files.select(sha.alias("sha256"), F.col(name).alias("_name"), F.octet_length(content).alias("bytes"), mime.alias("mime"))
    return rows.groupBy("sha256").agg(F.min("_name").alias("_first"), F.first("bytes").alias("bytes"), F.min("mime").alias("mime"), F.count("*").alias("names")).select("sha256", object_key(F.col("sha256"), F.col("_first")).alias("object_key"), "bytes", "mime", "names")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path as pages in natural order of their names within each folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    named = files.select(folder.alias("folder"), name.alias("name"), "length", "content")
    page = F.row_number().over(Window.partitionBy("folder").orderBy(natural_key(F.col("name")), "name"))
    return named.withColumn("page", page).withColumn("sha256", F.sha2("content", 256)).withColumn("safe_name", safe_name(F.col("name")))


def doc_text(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """A document's text, its pages' texts in order on lines of their own."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text]), "\n")
    return pages.groupBy(doc).agg(joined.alias("text"))


def cache_get(wanted: DataFrame, cache: DataFrame, key: str = "sha256") -> DataFrame:
    """Each wanted digest with its payload, null if there is none."""
    return wanted.join(cache, key, "left")


def cache_put(cache: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """The cache with rows for digests that it lacks."""
    return merge.insert_absent(cache, new, key)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions below a path, none if the path is not there; a version counts once its write has ended.

    Only folder names are looked at, so no data is read.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    ended = [x.getPath() for x in fs.listStatus(folder) if x.isDirectory() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return sorted(int(x.getName().removeprefix("version=")) for x in ended if x.getName().startswith("version="))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete snapshot, or None."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def publish(spark: SparkSession, path: str, new: DataFrame, key: str, content: Sequence[str], kept: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Merge new content into the newest snapshot, keep what was learned about rows, and write the next version.

    ``kept`` may give the types of its columns, which count where the first snapshot lacks them; without one they are strings. Two writers
    of one version: the second fails, as its folder is there. Several tables at once: :mod:`commits`.
    """
    kinds = dict(kept) if isinstance(kept, Mapping) else dict.fromkeys(kept, "string")
    found = versions(spark, path)
    if found:
        old = spark.read.parquet(f"{path}/version={found[-1]}")
        merged = merge.snapshot(old, new, key, content, list(kinds)).drop("action")
    else:
        types = dict(new.dtypes)
        merged = new.select(key, *content, *[(F.col(c) if c in types else F.lit(None).cast(kinds[c])).alias(c) for c in kinds])
    to = f"{path}/version={found[-1] + 1 if found else 1}"
    merged.write.parquet(to)
    return spark.read.parquet(to)


def stash(rows: DataFrame, path: str, kind: str = "kind") -> None:
    """Write rows by kind; a kind that is written again replaces what it had, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(kind).parquet(path)


#: schema of a verification log: one JSON object a line
LOG_SCHEMA = "round int, ts string, scene string, verdict string, n_fail int, fails array<struct<layer:string,code:string,msg:string>>, sha_fig string, sha_js string, bytes_js long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of verification logs; a broken line is a row of nulls."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def migrated(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with the columns of a schema: missing ones null, others cast, unknown ones dropped."""
    from pyspark.sql.types import _parse_datatype_string

    want = _parse_datatype_string(schema)
    there = {c.lower() for c in rows.columns}
    return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name.lower() in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
