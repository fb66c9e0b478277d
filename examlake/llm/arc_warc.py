"""Legacy archive converter: ARC files of version 1 and 2 to WARC, and back to rows.

Pages are written as ARC archives, whose records are a header line, laid out by the version that the archive's first
block names, and a body of declared length. The converter reads whole archives, follows the declared lengths, and
synthesises for each record what WARC wants: an identifier (from its archive and place, address, date and payload
digest, so that rows repeated whole have identifiers of their own), a timestamp in ISO form, a type, and block and
payload digests. Of records with equal payloads the one with the smallest
``page_id`` is a response, and the others are revisits that name it. Archives are text files written and read by
Spark itself, in the shared folder; each begins anew after ``RECORDS`` records, so none grows with the data.

Defined cases: null html is an empty payload; null or blank addresses become ``unknown:``; a null ``page_id`` is
never an original unless all equal payloads lack one; rows repeated whole have one type; an empty table gives an
empty result; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, released, scratch

RECORDS = 1024
_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_WRITE = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": str(RECORDS)}
_PAGE, _LENGTH = b"x-page-id", b"content-length"


def _version_block(version: int) -> str:
    body = f"{version} 0 examlake\n{_V1 if version == 1 else _V2}\n"
    tail = " 200 - - 0 pages.arc" if version == 2 else ""
    return f"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain{tail} {len(body)}\n{body}\n"


def write_arc(pages: DataFrame, path: str, version: int) -> None:
    """One ARC record per row of ``pages`` (page_id, url, html)."""
    page = pages.select(pages["page_id"].cast("long").alias("id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    number = F.coalesce(F.col("id").cast("string"), F.lit(""))
    body = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), number,
        F.lit("\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), F.col("html"),
    )
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(31536000))), "yyyyMMddHHmmss")
    fields = [F.when(url == "", "unknown:").otherwise(url), F.lit("192.0.2.1"), date, F.lit("text/html")]
    if version == 2:
        fields += [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc")]
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % RECORDS == 0
    record = F.concat(F.concat_ws(" ", *fields, F.octet_length("body").cast("string")), F.lit("\n"), F.col("body"))
    page.withColumn("body", body).withColumn("first", first).select(F.concat(F.when(F.col("first"), _version_block(version)).otherwise(""), record).alias("value")).write.options(**_WRITE).text(path)


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, bytes, int]]:
    """(url, date, content type, body, place) of each record of an archive of either version.

    The version is the first line of the first block's body; its second line names the fields of the header lines.
    Body lengths are as declared, so a body may hold anything, header lines included.
    """
    at, names = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = data[at:end].decode("utf-8", "replace")
        if not line.strip():
            at = end + 1
            continue
        fields = line.split(" ")
        length = int(fields[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError("an ARC body is shorter than declared")
        place, at = at, end + 1 + length
        if line.startswith("filedesc://"):
            version, layout = body.decode().split("\n")[:2]
            if version.split(" ")[0] not in ("1", "2"):
                raise ValueError(f"unknown ARC version {version!r}")
            names = layout.split(" ")
            continue
        if names is None or len(fields) != len(names):
            raise ValueError("an ARC header line does not fit the version block")
        row = dict(zip(names, fields, strict=True))
        yield row["URL"], row["Archive-date"], row["Content-type"], body, place


def _headers(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}, payload


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


_ARC_SCHEMA = "page_id long, url string, date string, type string, block binary, header_bytes int, payload_digest string, block_digest string, place string"


def _arc_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _ARC_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows = []
            for url, date, kind, body, at in parse_arc(_plain(content.as_py())):
                headers, payload = _headers(body)
                page = headers.get(_PAGE)
                rows.append((int(page) if page else None, url, date, kind, body, len(body) - len(payload), _sha1(payload), _sha1(body), f"{file.rsplit('/', 1)[-1]}:{at}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all ARC archives below ``path``."""
    return _archives(spark, path).mapInArrow(released(_arc_rows), _ARC_SCHEMA)


def _record_id(*parts: Column) -> Column:
    """A name-based identifier: the same record of the same archive always gets the same one."""
    h = F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC records of what :func:`read_arc` gives.

    The first record of each digest is found from the digests alone, with a partial aggregate before the shuffle;
    only records that revisit another are then joined to by identifier, and adaptive execution splits a hot key.
    """
    records = records.withColumn("record_id", _record_id(F.col("place"), F.col("url"), F.col("date"), F.col("payload_digest"), F.col("page_id")))
    slim = records.select("payload_digest", "page_id", "record_id")
    first = slim.groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id")).alias("o"), F.count("*").alias("n")).where("n > 1")
    original = first.select("payload_digest", F.col("o.page_id").alias("first_page"), F.col("o.record_id").alias("first_id"))
    revisits = records.join(original, "payload_digest", "left").withColumn("again", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    again = F.col("again")
    block = F.when(again, F.substring(F.col("block"), 1, F.col("header_bytes"))).otherwise(F.col("block"))
    date = F.date_format(F.to_timestamp("date", "yyyyMMddHHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.coalesce(date, F.lit("1970-01-01T00:00:00Z"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, "").otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_digest")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.col("first_id")), line("X-Refers-To-Page", F.coalesce(F.col("first_page").cast("string"), F.lit(""))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("kept").cast("string")),
        F.lit("\r\n"),
    )
    # the writer ends each line with a line feed, the last byte of what ends a record
    revisits.withColumn("kept", block).select(F.concat(head, F.col("kept").cast("string"), F.lit("\r\n\r")).alias("value")).write.options(**_WRITE).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, block) of each record, by declared length."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        end = data.index(b"\r\n\r\n", at)
        headers, _ = _headers(data[at : end + 4])
        length = int(headers[_LENGTH])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def _warc_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        for content in b.column("content"):
            rows = []
            for headers, block in parse_warc(_plain(content.as_py())):
                http, payload = _headers(block)
                page, kind = http.get(_PAGE), headers[b"warc-type"].decode()
                if kind == "response":
                    size, digest, to = len(payload), _sha1(payload), None
                else:
                    size, digest = int(http[_LENGTH]), headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    to = headers.get(b"x-refers-to-page")
                rows.append((int(page) if page else None, size, digest, kind, int(to) if to else None, headers[b"warc-target-uri"].decode("utf-8", "replace"), headers[b"warc-record-id"].decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id) of all archives below ``path``."""
    return _archives(spark, path).mapInArrow(released(_warc_rows), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def convert(spark: SparkSession, arc_paths: list[str], warc_path: str) -> None:
    """Convert ARC archives to WARC archives."""
    records = read_arc(spark, arc_paths[0])
    for path in arc_paths[1:]:
        records = records.union(read_arc(spark, path))
    write_warc(records, warc_path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as ARC (odd ids in version 1, others in version 2), convert, and read the WARC archives back."""
    spark = pages.sparkSession
    odd = F.coalesce(F.pmod(pages["page_id"].cast("long"), F.lit(2)) == 1, F.lit(False))
    arc = [scratch(spark, "arc1"), scratch(spark, "arc2")]
    warc = scratch(spark, "warc")
    write_arc(pages.where(odd), arc[0], 1)
    write_arc(pages.where(~odd), arc[1], 2)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
