"""Token ids in files of fixed-width bit-packed blocks, written in id order and read back.

A file is a run of blocks and a footer, each ended by a byte 0x0A. A block: magic ``PTB1``; five
unsigned little-endian 64-bit numbers (bits per id, documents, ids, whether the block goes on with the document of the
block before, whether its last document goes on in the next); then for every document its id, a flag
(1: the id is null) and its number of ids here, as arrays of 64-bit numbers; then the ids, ``bits``
bits each, lowest bit first, filled up to a whole number of 64-bit words. The footer: magic ``PTF1``, number of blocks, and for
each block its byte offset, its first id's place in the file and its first document's place; then the file's
place among the files; last, the footer's own size. With fixed widths, the id at any place is found by its offset
alone, and a block unpacks without a loop over ids.

Spark's text writer stores the bytes as they are, one block a row, so that its commit protocol
covers them and any file system that Spark knows can hold them.

Null or empty texts have their end id alone. Null ids come first. Rows that repeat an id stay apart, ordered by their
ids' checksum. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagia.cluster import scratch_path
from pelagia.llm.tables import arrow, stored
from pelagia.llm.tokens import encoder
from pelagia.llm.words import texts_of

BLOCK, FOOTER = b"PTB1", b"PTF1"
BLOCK_IDS = 1 << 18
#: Bytes of text whose ids a file holds, on average.
FILE_TEXT_BYTES = 16 << 20


def width(vocabulary_size: int) -> int:
    """The fewest bits that hold every id."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        out = np.ascontiguousarray(ids, "<u2").tobytes()
        return out + bytes(-len(out) % 8)
    planes = (ids.astype("<u8")[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
    out = np.packbits(planes.reshape(-1), bitorder="little").tobytes()
    return out + bytes(-len(out) % 8)


def unpack_bits(data: bytes, first: int, count: int, bits: int) -> np.ndarray:
    """``count`` ids from place ``first`` on, at any place: two shifted words hold each id."""
    if not count:
        return np.zeros(0, np.uint32)
    if bits == 16:
        return np.frombuffer(data, "<u2", count, 2 * first).astype(np.uint32)
    words = np.concatenate([np.frombuffer(data, "<u8"), np.zeros(1, np.uint64)])
    at = (np.arange(first, first + count, dtype=np.uint64)) * np.uint64(bits)
    word, shift = at >> np.uint64(6), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift == 0, np.uint64(0), words[word + np.uint64(1)] << (np.uint64(64) - np.maximum(shift, np.uint64(1))))
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def block_bytes(names: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int, goes_on: int, open_end: int) -> bytes:
    head = BLOCK + struct.pack("<5Q", bits, len(names), len(ids), goes_on, open_end)
    return b"".join([head, names.astype("<i8").tobytes(), nulls.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), pack_bits(ids, bits), b"\n"])


class File:
    """A file's bytes, read by its footer."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<Q", data, len(data) - 9)[0]
        at = len(data) - 9 - size
        if data[at:at + 4] != FOOTER:
            raise ValueError("no token file: its footer is missing")
        blocks, = struct.unpack_from("<Q", data, at + 4)
        index = np.frombuffer(data, "<i8", 3 * blocks + 3, at + 12)
        self.data, self.part, self.ids, self.documents = data, int(index[-3]), int(index[-2]), int(index[-1])
        self.offsets, self.places, self.firsts = index[:-3].reshape(blocks, 3).T

    def block(self, i: int):
        at = int(self.offsets[i])
        if self.data[at:at + 4] != BLOCK:
            raise ValueError("no block at this offset")
        bits, documents, ids, goes_on, open_end = struct.unpack_from("<5Q", self.data, at + 4)
        columns = np.frombuffer(self.data, "<i8", 3 * documents, at + 44).reshape(3, documents)
        begin = at + 44 + 24 * documents
        return bits, columns, ids, bool(goes_on), bool(open_end), self.data[begin:begin + -(-ids * bits // 64) * 8]

    def ids_at(self, first: int, count: int) -> np.ndarray:
        """Any ids of the file by their places, from the blocks that hold them alone."""
        out, i = [], int(np.searchsorted(self.places, first, side="right")) - 1
        while count > 0:
            bits, _, ids, _, _, packed = self.block(i)
            low = first - int(self.places[i])
            here = min(count, ids - low)
            out.append(unpack_bits(packed, low, here, bits))
            first, count, i = first + here, count - here, i + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encoded(docs: DataFrame, vocabulary: str, end: int, bits: int) -> DataFrame:
    """Whole texts as packed ids with the end id, deflated for the way to their files."""
    def work(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            names = batch.column("doc_id")
            for texts in texts_of(batch.column("text")):
                ids, begin = encode(texts)
                rows, sizes, crcs = [], [], []
                for i in range(len(texts)):
                    own = np.append(ids[begin[i]:begin[i + 1]], end).astype("<u4")
                    rows.append(zlib.compress(pack_bits(own, bits), 1))
                    sizes.append(len(own))
                    crcs.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([names.slice(texts.first, len(texts)), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(rows, pa.binary())],
                                                 names=["doc_id", "n", "crc", "packed"])
    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n long, crc long, packed binary", tidy=True, encodes=True)


def bucket_of(value: Column, limits: Column) -> Column:
    """How many of the ascending limits are at or below the value, by halving."""
    step = F.struct(F.lit(0).alias("low"), F.size(limits).alias("high"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(limits, middle) <= value
        done = s["low"] >= s["high"]
        return F.struct(F.when(done | ~below, s["low"]).otherwise(middle + 1).alias("low"),
                        F.when(done | below, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), step, halve)["low"]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, vocabulary_size: int, end: int,
                      file_text: int = FILE_TEXT_BYTES) -> None:
    """The ids of all documents in ascending order of doc_id, in files of about equal numbers of documents."""
    bits = width(max(vocabulary_size, end + 1))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = int(size // file_text) + 1
    # Bounds of equal shares of the ids, so that the ids' own bytes are moved once and not stored besides.
    shares = [i / files for i in range(1, files)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, max(10_000, 20 * files))).first()[0] if shares else []
    rows = encoded(docs, vocabulary, end, bits)

    def work(batches):
        from pyspark import TaskContext
        index, at, place, first = [], 0, 0, 0
        names, nulls, sizes, parts, held, goes_on = [], [], [], [], 0, 0

        def block(open_end):
            nonlocal at, place, first, names, nulls, sizes, parts, held, goes_on
            data = block_bytes(np.array(names, np.int64), np.array(nulls, np.int64), np.array(sizes, np.int64), np.concatenate(parts), bits, goes_on, open_end)
            index.extend((at, place, first))
            at, place, first = at + len(data), place + held, first + len(names) - open_end
            names, nulls, sizes, parts, held, goes_on = [], [], [], [], 0, open_end
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for name, n, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "packed"))):
                done, packed = 0, zlib.decompress(packed)
                while done < n:
                    here = min(n - done, BLOCK_IDS - held)
                    names.append(name or 0)
                    nulls.append(int(name is None))
                    sizes.append(here)
                    parts.append(unpack_bits(packed, done, here, bits))
                    done, held = done + here, held + here
                    if held == BLOCK_IDS:
                        yield block(int(done < n))
        if names:
            yield block(0)
        if index:
            tail = FOOTER + struct.pack("<Q", len(index) // 3) + np.array([*index, TaskContext.get().partitionId(), place, first], "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([tail + struct.pack("<Q", len(tail))], pa.binary())], names=["value"])

    limits = F.array(*map(F.lit, bounds or [])).cast("array<bigint>")
    file = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket_of(F.col("doc_id"), limits))
    dealt = rows.repartitionById(files, file).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc")
    arrow(dealt.select("doc_id", "n", "packed"), work, "value binary").select(F.col("value").cast("string").alias("value")) \
        .write.option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (if wanted), ids_crc32; start counts the ids before it."""
    def work(batches):
        for batch in batches:
            for content in batch.column("content"):
                file = File(content.as_py())
                place, held, name = 0, [], None
                for i in range(len(file.offsets)):
                    bits, (ids, nulls, counts), n, goes_on, open_end, packed = file.block(i)
                    tokens = unpack_bits(packed, 0, n, bits).astype("<u4")
                    cuts = np.split(tokens, np.cumsum(counts)[:-1])
                    named = [None if null else int(x) for x, null in zip(ids, nulls)]
                    if goes_on:
                        cuts[0] = np.concatenate([*held, cuts[0]])
                        named[0] = name
                    held = [cuts.pop()] if open_end else []
                    name = named.pop() if open_end else None
                    sizes = np.array([len(c) for c in cuts], np.int64)
                    ends = np.cumsum(sizes)
                    columns = [pa.array(np.full(len(cuts), file.part, np.int32)), pa.array(named, pa.int64()), pa.array(place + ends - sizes),
                               pa.array(sizes), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                    if with_ids:
                        flat = np.concatenate([*cuts, np.zeros(0, "<u4")])
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32))))
                    place += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "inner", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = arrow(files.select("content"), work, "part int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)

    def totals(batches):
        for batch in batches:
            for content in batch.column("content"):
                file = File(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([file.part], pa.int32()), pa.array([file.ids], pa.int64())], names=["part", "total"])

    sums = stored(arrow(files.select("content"), totals, "part int, total long"), "file-totals")
    shift = sums.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(shift), "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, vocabulary_size: int, end: int, with_ids: bool = True,
               file_text: int = FILE_TEXT_BYTES) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, vocabulary_size, end, file_text)
    return read_token_files(docs.sparkSession, path, with_ids)
