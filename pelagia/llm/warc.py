"""WARC archives: written by Spark, read back by a reader that salvages what damage leaves.

**Writing.** One record per page, as text rows that Spark's writer ends with the two empty lines that end a record,
so that its commit protocol covers the files. Of payloads with equal SHA-1 the largest page_id is a response and
the others are revisits of it, without payload (from ``least`` bytes on; smaller ones are all responses).

**Reading.** Files are plain or gzip members, one after another. A record must have a version line, headers, its whole
block, the empty lines and, where it names one, the right payload digest. After a failed check the reader looks
for the next version line or gzip member that passes, goes on there, and logs the bytes between as quarantined.

Null html is an empty payload; a null url leaves out its header; a null page_id has an empty name and reads back as
null, and is never the largest unless all are null. Pages that repeat the largest page_id are all responses. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.cluster import scratch_path
from pelagia.llm.tables import arrow, small_side, stored

FILE_BYTES = 24 << 20
END = "\r\n\r\n"
NAME = "urn:x-page:"
# --- fixed values: names of the format --------------------------------------------------------
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# --- end of fixed values ----------------------------------------------------------------------


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hex digits: five of them make four letters."""
    parts = [F.lpad(F.conv(F.substring(digest, i * 5 + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, record): the text of each page's record without its last empty lines."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").select(F.col("digest").alias("_digest"), "largest"), "equal-payloads")
    rows = rows.join(small_side(groups, 56), rows["digest"] == groups["_digest"], "left")
    revisit = F.col("_digest").isNotNull() & (F.col("size") >= least) & F.coalesce(F.col("page_id") < F.col("largest"), F.col("largest").isNotNull())
    name = F.concat(F.lit(f"<{NAME}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    # Control characters and blanks would end a header, so they are escaped.
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{NAME}"), F.col("largest").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return rows.select("page_id", F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    size = pages.agg(F.avg(F.octet_length("html") + 600)).first()[0] or 1
    rows = records(pages, least).select(F.col("record").alias("value"))
    rows.write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(FILE_BYTES // size))).text(path)


@dataclass
class Record:
    offset: int  # of the member, for a compressed record
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


@dataclass
class Gap:
    offset: int
    end: int
    reason: str


#: Bytes that are inflated at a time.
PIECE = 1 << 14
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"(?<![^\n])WARC/1\.[01]\r\n|\x1f\x8b\x08")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record at a place and where it ends, or what is wrong with it."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    head = data.find(b"\r\n\r\n", version.end() - 2)
    if head < 0:
        return "headers without end"
    headers = {}
    for line in data[version.end():head].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return "a header without name"
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length) or not {"warc-type", "warc-record-id"} <= headers.keys():
        return "a needed header is missing"
    begin, end = head + 4, head + 4 + int(length)
    if end > len(data):
        return "block cut short"
    if data[end:end + 4] != b"\r\n\r\n":
        return "no end after the block"
    record = Record(at, headers, data[begin:end])
    told = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and told.startswith("sha1:") and told[5:] != digest_of(record.payload):
        return "wrong payload digest"
    return record, end + 4


def parse_member(data: bytes, at: int) -> tuple[list[Record | Gap], int] | str:
    """The records of the gzip member at a place and where it ends, or what is wrong with it."""
    unpack, view, end, plain = zlib.decompressobj(31), memoryview(data), at, []
    try:
        while not unpack.eof and end < len(data):  # what follows the member is looked at in pieces, not as a whole
            piece = view[end:end + PIECE]
            plain.append(unpack.decompress(piece))
            end += len(piece)
    except zlib.error:
        return "damaged member"
    if not unpack.eof:
        return "member cut short"
    end -= len(unpack.unused_data)
    found: list[Record | Gap] = []
    for item in salvage(b"".join(plain), members=False):
        if isinstance(item, Gap):
            found.append(Gap(at, end, f"in member: {item.reason}"))
        else:
            item.offset = at
            found.append(item)
    return found, end


def salvage(data: bytes, members: bool = True) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of a file, in order; together they cover every byte."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        packed = members and data[at:at + 3] == b"\x1f\x8b\x08"
        found = parse_member(data, at) if packed else parse_record(data, at)
        if isinstance(found, str):
            if gap is None:
                gap, reason = at, found
            later = _CANDIDATE.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        item, at = found
        yield from item if isinstance(item, list) else [item]
    if gap is not None:
        yield Gap(gap, len(data), reason)


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{NAME}(-?[0-9]+)>", name or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and, with ``quarantined`` set, the gaps between them, of all files below a path."""
    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for item in salvage(content.as_py()):
                    if isinstance(item, Gap):
                        rows.append({"file": name, "offset": item.offset, "bytes": item.end - item.offset, "quarantined": item.reason})
                        continue
                    kind, http = item.headers["warc-type"], item.block.partition(b"\r\n\r\n")[0]
                    told = re.search(rb"(?mi)^content-length: *([0-9]+)", http)
                    rows.append({
                        "file": name, "offset": item.offset, "bytes": len(item.block), "record_type": kind, "page_id": page_of(item.headers["warc-record-id"]),
                        "payload_bytes": int(told[1]) if kind == "revisit" and told else len(item.payload),
                        "payload_digest": item.headers.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else digest_of(item.payload),
                        "refers_to": page_of(item.headers.get("warc-refers-to")), "payload": None if kind == "revisit" else item.payload})
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("quarantined", pa.string()), ("record_type", pa.string()),
                        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return arrow(files, work, "file string, offset long, bytes long, quarantined string, record_type string, page_id long, "
                              "payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
