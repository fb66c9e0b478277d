"""URL rules by host and path in sorted digest arrays.

A rule (host, path, verdict) fits its host and all subdomains of it where the URL's path begins with the rule's; the longest
fitting rule decides, by code points of host and path together. An index file has two arrays of 64-bit xxhash digests in
ascending order, each with its full strings: of the rules' hosts, with the lengths of path that go with them, and of
the rules. Tasks map the file into memory, probe it with whole batches by binary search and compare the stored string of every hit
with the key, so equal digests of different strings do no harm.

The driver writes that file only if the rules take :data:`INDEX_BYTES` at most; Spark hands it to each executor once. Longer
lists are dealt by digest: the distinct keys of the pages' URLs meet each range of digests in a task of its own, whose rules are the
same arrays in a mapped file of that task. Both ways give the same rows.

Defined cases: a URL without ``://``, or null, has an empty host and path; the host keeps port and user, if there are any; a URL
that no rule fits gets the method's verdict, allow; of rules alike in length the one with the longer host decides; of rules that have the
same host and path, block does; rules with a null in host or path are left out, any verdict but block allows; pages
repeated whole, or without an id, give a row each; without rules everything is allowed; empty tables give empty results; columns other than
``page_id`` and ``url`` are not looked at.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, scratch, stored

#: bytes of rules, with what the arrays add to each, that the driver puts into one file
INDEX_BYTES = 64 << 20
#: bytes of rules or of keys that meet in one task beyond that
SHARD_BYTES = 16 << 20
_EACH = 48
DEFAULT = "allow"

Entry = tuple[str, int]


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def packed_arrays(*sections: list[Entry]) -> bytes:
    """The bytes of an index file: for each section its size, digests in order, values, offsets and strings."""
    out = []
    for entries in sections:
        keys = [k.encode() for k, _ in entries]
        digests = _digests(keys)
        order = np.argsort(digests, kind="stable")
        text = b"".join(keys[i] for i in order)
        offsets = np.concatenate([[0], np.cumsum([len(keys[i]) for i in order])]).astype(np.int64)
        values = np.array([v for _, v in entries], np.int64)[order]
        out += [np.array([len(keys), len(text)], np.int64).tobytes(), digests[order].tobytes(), values.tobytes(), offsets.tobytes(), text, b"\0" * (-len(text) % 8)]
    return b"".join(out)


class DigestArray:
    """One section of a mapped index file; nothing is read but what a probe touches."""

    def __init__(self, mapped: np.ndarray, at: int) -> None:
        n, size = (int(x) for x in mapped[at : at + 16].view(np.int64))
        part = lambda start, count, kind: mapped[start : start + 8 * count].view(kind)
        at += 16
        self.digests, self.values, self.offsets = part(at, n, np.uint64), part(at + 8 * n, n, np.int64), part(at + 16 * n, n + 1, np.int64)
        at += 8 * (3 * n + 1)
        self.text, self.end = mapped[at : at + size], at + size + -size % 8

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``keys``, values): a pair for every entry whose full string is the key."""
        raw = [k.encode() for k in keys]
        wanted = _digests(raw)
        low, high = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        hits = high - low
        place = np.repeat(np.arange(len(raw)), hits)
        entry = np.arange(len(place)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        same = np.fromiter((self.text[self.offsets[e] : self.offsets[e + 1]].tobytes() == raw[p] for p, e in zip(place, entry, strict=True)), bool, len(place))
        return place[same], np.asarray(self.values)[entry[same]]


def opened(buffer: mmap.mmap) -> list[DigestArray]:
    """The sections of an index in a mapped file."""
    mapped, at, out = np.frombuffer(buffer, np.uint8), 0, []
    while at < len(mapped):
        out.append(DigestArray(mapped, at))
        at = out[-1].end
    return out


def map_file(path: str) -> list[DigestArray]:
    with open(path, "rb") as f:
        return opened(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def suffixes(host: str, most: int) -> list[str]:
    """A host and the domains above it, those of at most ``most`` labels."""
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in range(min(most, len(labels)), 0, -1)]


def _best(hosts: pa.Array, paths: list[str], domains: DigestArray, rules: DigestArray, most: int) -> tuple[list[str | None], list[str]]:
    """(rule, verdict) of each URL of a batch."""
    coded = hosts.dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    above = [(i, s) for i, h in enumerate(distinct) for s in suffixes(h, most)]
    fits: list[list[tuple[str, int]]] = [[] for _ in distinct]
    for at, length in zip(*domains.find([s for _, s in above]), strict=True):
        fits[above[at][0]].append((above[at][1], int(length)))
    keys, row, size, host_size = [], [], [], []
    for r, (c, path) in enumerate(zip(code.tolist(), paths, strict=True)):
        for domain, length in fits[c]:
            if length <= len(path):
                keys.append(domain + path[:length])
                row.append(r)
                size.append(len(domain) + length)
                host_size.append(len(domain))
    at, block = rules.find(keys)
    rule: list[str | None] = [None] * len(paths)
    verdict = [DEFAULT] * len(paths)
    order = np.lexsort((np.array(host_size, np.int64)[at], np.array(size, np.int64)[at]))  # the longest last, so that it stays
    for k in order.tolist():
        rule[row[at[k]]], verdict[row[at[k]]] = keys[at[k]], "block" if block[k] else "allow"
    return rule, verdict


def _judged(batches: Iterable[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    domains, rules = map_file(SparkFiles.get(name))
    for b in batches:
        rule, verdict = _best(b.column("host"), b.column("path").to_pylist(), domains, rules, most)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*b.schema.names, "rule", "verdict"])


def _in_shard(keys: pa.Table, rules: pa.Table) -> pa.Table:
    """(rule, block) of the keys that are rules; both sides have digests of one range."""
    wanted = keys.column("key").to_pylist()
    with tempfile.TemporaryFile(prefix="rules-") as f:
        f.write(packed_arrays(list(zip(rules.column("key").to_pylist(), rules.column("block").to_pylist(), strict=True))))
        f.flush()
        at, block = opened(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))[0].find(wanted)
    return pa.table({"rule": pa.array([wanted[i] for i in at], pa.string()), "block": pa.array(block, pa.int64())})


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: what is between ``://`` and the next of ``/?#``, A-Z lower-cased; then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _clean_rules(rules: DataFrame) -> DataFrame:
    """(host, path, block): one row per host and path."""
    own = rules.select(ascii_lower(rules["host"].cast("string")).alias("host"), rules["path"].cast("string").alias("path"), F.coalesce(rules["verdict"] == "block", F.lit(False)).cast("long").alias("block"))
    return own.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("block").alias("block"))


def _handed_out(spark: SparkSession, data: bytes) -> str:
    """Write a file in the shared folder and have Spark bring it to every executor; its name there."""
    path = scratch(spark, "url-rules")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = parts(F.coalesce(pages["url"].cast("string"), F.lit("")))
    urls = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rules = stored(_clean_rules(rules), "url-rules")
    whole = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + _EACH).alias("size"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    if (whole.size or 0) > INDEX_BYTES:
        return _judge_dealt(urls, rules, whole.size, whole.labels)
    listed = [(r.host, r.path, r.block) for r in rules.collect()]
    domains = sorted({(h, len(p)) for h, p, _ in listed})
    name = _handed_out(spark, packed_arrays(domains, [(h + p, b) for h, p, b in listed]))
    return urls.mapInArrow(partial(_judged, name=name, most=whole.labels or 0), "page_id long, host string, path string, rule string, verdict string")


def _judge_dealt(urls: DataFrame, rules: DataFrame, size: int, labels: int) -> DataFrame:
    """The same for rules beyond one file: distinct keys meet the rules by range of digest."""
    above = F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {labels})), k -> substring_index(host, '.', -k))")
    lengths = rules.groupBy(F.col("host").alias("domain")).agg(F.collect_set(F.char_length("path")).alias("lengths"))
    fits = urls.select("host", "path").distinct().withColumn("domain", F.explode(above)).join(lengths, "domain")
    fits = fits.withColumn("length", F.explode("lengths")).where(F.col("length") <= F.char_length("path"))
    fits = fits.select("host", "path", F.char_length("domain").alias("n_host"), F.concat("domain", F.substring("path", F.lit(1), F.col("length"))).alias("key"))
    keys = stored(fits.select("key").distinct(), "url-keys")
    asked = keys.agg(F.sum(F.octet_length("key") + _EACH).alias("size")).first().size or 0
    shards = 1 + max(size, asked) // SHARD_BYTES
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    known = rules.select(F.concat("host", "path").alias("key"), "block").select("key", "block", shard)
    found = keys.select("key", shard).groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_in_shard, "rule string, block long")
    longest = F.max_by(F.struct("rule", "block"), F.struct(F.char_length("rule"), "n_host"))
    best = fits.join(found, F.col("key") == F.col("rule")).groupBy("host", "path").agg(longest.alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.block") == 1, "block").otherwise(DEFAULT).alias("verdict"))
