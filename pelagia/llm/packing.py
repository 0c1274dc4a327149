"""Best-fit packing of token sequences, planned over the histogram of their lengths.

Large-item matching: pieces above a third of the capacity come at most two to a sequence. From the
longest down, each is paired with the longest other large piece that still fits. Smaller
pieces, from the longest down, go into the smallest gap that holds them; what fits nowhere opens new
sequences. A length has at most ``capacity`` values, so that the plan works on counts per length
and treats equal sequences together: its size depends on the capacity, not on the rows. Rows are then
numbered within their length (by task and place in the task), and a row's number names its sequence.

A null or empty text still has its end id. Only documents longer than the capacity are cut. Repeated
rows are packed like any others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagia.llm.tables import arrow, forget_encoders, stored
from pelagia.llm.tokens import encoder
from pelagia.llm.words import texts_of

PIECES = ("doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, "
          "part int, nth long")


def tokenised_pieces(docs: DataFrame, vocabulary: str, end: int, capacity: int) -> DataFrame:
    """Whole texts as ids with an end id, cut at multiples of the capacity where they are longer.

    ``nth`` counts the pieces of that length in the task ``part``.
    """
    def work(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary).encode
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names = batch.column("doc_id")
            for texts in texts_of(batch.column("text")):
                ids, begin = encode(texts)
                sizes = np.diff(begin) + 1
                tokens = np.empty(int(sizes.sum()), "<u4")
                ends = np.cumsum(sizes)
                tokens[ends - 1] = end
                inner = np.ones(len(tokens), bool)
                inner[ends - 1] = False
                tokens[inner] = ids
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                at = (ends - sizes)[owner] + start
                crc = np.fromiter((zlib.crc32(tokens[a:a + n]) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(at))
                order = np.argsort(length, kind="stable")
                run = np.arange(len(order)) - np.searchsorted(length[order], length[order])
                nth = np.empty(len(order), np.int64)
                nth[order] = run
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tokens.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(owner + texts.first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), lists,
                     pa.array(crc), pa.array(np.full(len(owner), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"])
    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), work, PIECES, tidy=True, encodes=True)


@dataclass
class Plan:
    """Slots by length: numbers from ``first`` on, ``count`` of them, in sequences from ``sequence`` on."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.length, self.first, self.sequence, self.offset


def place(plan: tuple[np.ndarray, ...], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these numbers within their lengths."""
    lengths, first, sequence, offset = plan
    at = np.empty(len(length), np.int64)
    for value in np.unique(length):
        low, high = np.searchsorted(lengths, [value, value + 1])
        mine = length == value
        at[mine] = low + np.searchsorted(first[low:high], number[mine], side="right") - 1
    return sequence[at] + number - first[at], offset[at]


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Which lengths share a sequence, from the number of pieces of each length."""
    large = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    groups: list[tuple[tuple[int, ...], int]] = []  # (lengths in a sequence, how many such)
    lengths = sorted(large)
    while lengths:
        n = lengths[-1]
        fit = bisect_left(lengths, capacity - n + 1) - 1
        if fit < 0:
            groups.append(((n,), large.pop(n)))
            lengths.pop()
            continue
        m = lengths[fit]
        many = large[n] // 2 if m == n else min(large[n], large[m])
        if not many:  # one of this length is left, and only shorter ones can join it
            if fit == 0:
                groups.append(((n,), large.pop(n)))
                lengths.pop()
                continue
            m, many = lengths[fit - 1], 1
        groups.append(((n, m), many))
        for x in (n, m):
            large[x] -= many
        for x in {n, m}:
            if not large[x]:
                del large[x]
                lengths.remove(x)

    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(content: tuple[int, ...], many: int) -> None:
        gap = capacity - sum(content)
        if gap not in open_at:
            open_at[gap] = []
            insort(gaps, gap)
        open_at[gap].append((content, many))

    for content, many in groups:
        put(content, many)
    for n in sorted((n for n, c in counts.items() if 3 * n <= capacity and c), reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                if left >= each:
                    put((n,) * each, left // each)
                if left % each:
                    put((n,) * (left % each), 1)
                break
            gap = gaps[at]
            content, many = open_at[gap].pop()
            each = gap // n  # a gap stays the smallest that fits until it no longer fits
            full = min(many, left // each)
            if full:
                put(content + (n,) * each, full)
            rest = left - full * each
            if full < many and rest:
                put(content + (n,) * rest, 1)
                rest, full = 0, full + 1
            if full < many:
                open_at[gap].append((content, many - full))
            if not open_at[gap]:
                del open_at[gap]
                gaps.remove(gap)
            left = rest
    slots: dict[int, list[tuple[int, int, int]]] = {}
    total = 0
    for content, many in (x for gap in gaps for x in open_at[gap]):
        offset = 0
        for n in content:
            slots.setdefault(n, []).append((many, total, offset))
            offset += n
        total += many
    rows, length = [], []
    for n in sorted(slots):
        first = 0
        for many, sequence, offset in slots[n]:
            rows.append((first, sequence, offset))
            length.append(n)
            first += many
    first, sequence, offset = np.array(rows, np.int64).reshape(-1, 3).T
    return Plan(np.array(length, np.int64), first, sequence, offset, total)


def pack(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    pieces = stored(tokenised_pieces(docs, vocabulary, end, capacity), "pieces")
    by_task = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "length-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    plan = docs.sparkSession.sparkContext.broadcast(plan_packing(counts, capacity).arrays())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(shift, ["length", "part"])

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def placed(length: pa.Array, number: pa.Array) -> pa.Array:
        forget_encoders()  # of the step that made the pieces
        sequence, offset = place(plan.value, length.to_numpy(), number.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    found = numbered.withColumn("_place", placed("length", F.col("before") + F.col("nth")))
    return found.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "_place.sequence_id", "_place.offset")
