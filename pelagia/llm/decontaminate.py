"""Benchmark passages in documents by winnowing.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``window``
(10) consecutive words of an item; an item of fewer words, but not none, is one window. Of every
``window - k + 1`` consecutive k-grams the one with the least hash is a fingerprint, so that a
shared run of ``window`` words always holds a shared fingerprint. Where a document's fingerprint is
one of the benchmark's, the match is extended: every window around it is looked up among the benchmark's
windows, and its words are compared. Windows of short items are their own k-gram.

The benchmark is a stated query set. It is measured, and dealt into blocks of bounded size that are broadcast one at a
time; documents never meet each other. Null texts have no words. A null item_id marks words but isn't listed.
Repeated items count once; repeated documents are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.llm.tables import give_back, stored
from pelagia.llm.words import ALNUM, Texts, Words, find_words, grams, texts_of

WINDOW, GRAM = 10, 5
#: Characters of benchmark text in a block; its tables take about ten times as many bytes at most.
BLOCK_CHARS = 4_000_000
SCAN = "struct<n_words: bigint, starts: array<int>, ends: array<int>, items: array<string>>"


def starts_of_runs(words: Words, n: int) -> np.ndarray:
    """Places where a run of n words lies within one text."""
    ok = np.zeros(len(words.starts), dtype=bool)
    counts = words.counts()
    long_enough = counts >= n
    first = words.pointer[:-1][long_enough]
    last = first + counts[long_enough] - n + 1
    steps = np.zeros(len(ok) + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    np.cumsum(steps[:-1], out=steps[:-1])
    ok[:] = steps[:-1] > 0
    return ok


def winnowed(hashes: np.ndarray, runs: np.ndarray, width: int) -> np.ndarray:
    """Places of the last least hash of each ``width`` hashes that begin where ``runs`` holds."""
    if width == 1:
        return np.flatnonzero(runs[:len(hashes)])
    begins = np.flatnonzero(runs[:max(0, len(hashes) - width + 1)])
    if not len(begins):
        return begins
    best, at = hashes[begins].copy(), begins.copy()
    for i in range(1, width):
        other = hashes[begins + i]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = begins[lower] + i
    keep = np.zeros(len(hashes), dtype=bool)
    keep[at] = True
    return np.flatnonzero(keep)


def run_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``grams`` at some places only."""
    return grams(hashes[(at[:, None] + np.arange(n)).reshape(-1)], n)[::n] if len(at) else np.zeros(0, np.uint64)


def index_items(names: list[str | None], texts: list[str | None], window: int = WINDOW, k: int = GRAM) -> tuple[list, list[tuple]]:
    """Fingerprints and windows of some items, by window length, as plain arrays."""
    found: dict[int, list] = {}
    column = pa.array([t or "" for t in texts], pa.large_string())
    words_of, base = [], 0
    for part in texts_of(column):
        words = find_words(part, ALNUM)
        hashes = words.hashes()
        words_of.append(hashes)
        for i, count in enumerate(words.counts().tolist()):
            if count:
                n = min(window, count)
                first = base + int(words.pointer[i])
                found.setdefault(n, []).append((part.first + i, first, count))
        base += len(hashes)
    hashes = np.concatenate([*words_of, np.zeros(0, np.uint64)])
    out = []
    for n, items in sorted(found.items()):
        gram = k if n == window else n
        width = n - gram + 1
        at = np.concatenate([np.arange(first, first + count - n + 1) for _, first, count in items])
        owner = np.concatenate([np.full(count - n + 1, i) for i, _, count in items])
        runs = np.zeros(len(hashes) + 1, dtype=bool)
        runs[at] = True
        prints = grams(hashes, gram)
        fingerprints = np.unique(prints[winnowed(prints, runs, width)])
        keys, first, back = np.unique(run_hashes(hashes, at, n), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([back, owner], axis=1), axis=0)
        pointer = np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1))
        sample = hashes[at[first][:, None] + np.arange(n)]
        out.append((n, gram, fingerprints, keys, sample, pointer, pairs[:, 1].astype(np.int64)))
    return names, out


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def scan(texts: Texts, index: tuple) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Words of each text, its hit runs of words, and the items whose windows occur."""
    names, tables = index
    words = find_words(texts, ALNUM)
    hashes = words.hashes()
    steps = np.zeros(len(hashes) + 1, np.int64)
    item_rows = []
    for n, gram, fingerprints, keys, sample, pointer, items in tables:
        if len(hashes) < n:
            continue
        runs = starts_of_runs(words, n)
        prints = grams(hashes, gram)
        at = winnowed(prints, runs, n - gram + 1)
        at = at[member(prints[at], fingerprints)[0]]
        if not len(at):
            continue
        around = (at[:, None] - np.arange(n - gram + 1)).reshape(-1)
        around = np.unique(around[around >= 0])
        around = around[runs[around]]
        ok, place = member(run_hashes(hashes, around, n), keys)
        around, place = around[ok], place[ok]
        same = (hashes[around[:, None] + np.arange(n)] == sample[place]).all(axis=1) if len(around) else np.zeros(0, bool)
        around, place = around[same], place[same]
        np.add.at(steps, around, 1)
        np.add.at(steps, around + n, -1)
        text = np.searchsorted(words.pointer, around, side="right") - 1
        pairs = np.unique(np.stack([text, place], axis=1), axis=0)
        sizes = pointer[pairs[:, 1] + 1] - pointer[pairs[:, 1]]
        first = np.repeat(pointer[pairs[:, 1]] - (np.cumsum(sizes) - sizes), sizes)
        item_rows.append(np.stack([np.repeat(pairs[:, 0], sizes), items[first + np.arange(int(sizes.sum()))]], axis=1))
    hit = np.cumsum(steps)[:-1] > 0
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    listed: list[list[str]] = [[] for _ in range(len(texts))]
    if item_rows:
        for i, j in np.unique(np.concatenate(item_rows), axis=0).tolist():
            if names[j] is not None:
                listed[i].append(names[j])
        for i in {i for i in np.unique(np.searchsorted(words.pointer, np.flatnonzero(hit), side="right") - 1).tolist()}:
            own = np.concatenate([[False], hit[words.pointer[i]:words.pointer[i + 1]], [False]])
            edges = np.flatnonzero(own[1:] != own[:-1])
            spans[i] = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    return words.counts(), spans, [sorted(set(x)) for x in listed]


def blocks_of(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The items in parts of about that many characters."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    many = total // chars + 1
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == i) for i in range(many)]


def scanner(block: DataFrame):
    """A column function over texts for one block of items."""
    rows = block.collect()  # bounded by BLOCK_CHARS
    index = block.sparkSession.sparkContext.broadcast(index_items([r.item_id for r in rows], [r.text for r in rows]))

    @F.arrow_udf(SCAN)
    def found(column: pa.Array) -> pa.Array:
        counts, starts, ends, items = [], [], [], []
        for texts in texts_of(column):
            n, spans, listed = scan(texts, index.value)
            counts += n.tolist()
            starts += [[a for a, _ in s] for s in spans]
            ends += [[b for _, b in s] for s in spans]
            items += listed
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
            names=["n_words", "starts", "ends", "items"])
    return found


def hit_words(starts: Column, ends: Column) -> Column:
    return F.aggregate(F.zip_with(starts, ends, lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


@F.arrow_udf(T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]))
def united(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Runs that overlap or touch, joined."""
    out = []
    for a, b in zip(starts.to_pylist(), ends.to_pylist()):
        runs: list[list[int]] = []
        for low, high in sorted(zip(a, b)):
            if runs and low <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], high)
            else:
                runs.append([low, high])
        out.append({"starts": [r[0] for r in runs], "ends": [r[1] for r in runs]})
    return pa.array(out, pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))


def contamination(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, starts and ends of hit runs (places of words), items."""
    blocks = blocks_of(benchmark, chars)
    bare = docs.select("doc_id", "text")
    first = bare.withColumn("_scan", scanner(blocks[0])("text"))
    if len(blocks) == 1:
        return first.select("doc_id", "_scan.n_words", "_scan.starts", "_scan.ends", "_scan.items")
    text = F.xxhash64("text").alias("_text")
    parts = []
    for block in blocks[1:]:  # rows with hits only; copies of a row under one id give the same
        part = bare.withColumn("_scan", scanner(block)("text")).where("size(_scan.starts) > 0")
        parts.append(stored(part.select("doc_id", text, "_scan.starts", "_scan.ends", "_scan.items").distinct(), "hits"))
    more = parts[0]
    for part in parts[1:]:
        more = more.unionByName(part)
    more = more.groupBy(F.col("doc_id").alias("_id"), "_text").agg(*[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("starts", "ends", "items")])
    base = first.select("doc_id", text.alias("_key"), "_scan.*")
    joined = base.join(more, base["doc_id"].eqNullSafe(more["_id"]) & (base["_key"] == more["_text"]), "left")
    for c in ("starts", "ends", "items"):
        joined = joined.withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"_{c}")))
    joined = joined.withColumn("_runs", united("starts", "ends"))
    return joined.select("doc_id", "n_words", "_runs.starts", "_runs.ends", F.array_sort(F.array_distinct("items")).alias("items"))


def without_hits(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, in which no window of the benchmark occurs."""
    blocks = blocks_of(benchmark, chars)
    for i, block in enumerate(blocks):
        docs = docs.where(F.size(scanner(block)("text")["starts"]) == 0)
        if i + 1 < len(blocks):
            docs = stored(docs, "decontaminated")
    return docs
