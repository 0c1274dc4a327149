"""Similarity join of documents on word n-grams by parity sketches.

A document's set: the distinct runs of ``n`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), as 64-bit hashes; of a
shorter text the whole sequence; of a text without words nothing, and it links with nothing.

**Sketch.** Tokens are dealt over ``k`` blocks of 65,536 bits by their hash, and each flips one bit of its block. The
sketches of two sets differ in at most as many bits as the symmetric difference has tokens. A
similarity of at least p/100 bounds that difference by ``(100 - p) * (|A| + |B|) / (100 + p)``, so with more blocks than
that some block agrees whole (pigeonhole). k depends on the size band: bands grow by half, and a document is also
dealt into the next band if a partner there could be similar. Two sets may agree in blocks that are empty, which tell nothing: ``k`` has a
few blocks to spare, and a document with more empty blocks than that is dealt again by further seeds. One that still has too many after ``SEEDS``
deals, and every document of a band whose blocks would mostly be empty (at low similarities), gives the tokens of its prefix by hash order
instead: similar sets share one of the least ``size - ceil(size * p / 100) + 1`` tokens.

**Join.** Documents with equal sets are one class. Blocks are stored as 64-bit hashes of their bits and grouped;
blocks with one class fall away. In a star round (the first on one block in eight, the others on the blocks that still hold several labels), each block's class that shares most of its blocks is verified against the
block's other classes (for each class only its nearest such centre by the folded sketch), and what is similar gets one label. Stars leave pairs of different labels: in the last
round these are compared by folded parity sketches (1,024 bits), in chunks of bounded size, never within the block's largest label, and only pairs that pass are verified
on their sets. A block with more than ``WIDE`` such classes is cut first: its classes meet only where they share a token of their prefixes, in
an order that puts the tokens of many texts last (counted in a table of fixed size), so that a passage of many texts brings nobody together. Pairs within one label need no look for the components, and all others are looked at, so that no link
between different labels is lost.

Null ids count like other rows but name no component unless nothing else is there. Repeated rows are copies. An empty table gives no rows; extra
columns are ignored. ``keep_one`` keeps one row of each component, whatever their ids: that with the least id (null ids come last), of equal ids that
with the least text hash, of equal rows any. Rows without words are in no component and stay.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.components import components
from pelagia.llm.tables import KEY_BYTES, PAYLOAD_BYTES, arrow, discard, fits, give_back, passing, small_side, stored
from pelagia.llm.words import BASE_2, NOT_WHITE, SLICE_BYTES, Texts, find_words, grams, mixed, texts_of

GROWTH = 1.5
FOLD_BITS = 1024
CHUNK = 256
STARS = 1
FEW = 8
#: Slices of keys, of blocks with their sketches, and of pairs with their texts, that are worked on one after another: the shuffle of one alone lies on disk, and its
#: open keys alone are broadcast.
SLICES = 8
SEEDS = 4
#: Classes of different labels beyond which a block is cut by prefix tokens.
WIDE = 2048
#: Cells of the token counts that order the prefixes of wide blocks.
CELL_BITS = 20


def shingles(texts: Texts, n: int) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes."""
    words = find_words(texts, NOT_WHITE)
    hashes = words.hashes()
    runs = grams(hashes, n)
    out = []
    for a, b in zip(words.pointer[:-1].tolist(), words.pointer[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a:b - n + 1]))
        else:
            out.append(grams(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def differences(size: int, percent: int) -> int:
    """The most tokens in the symmetric difference of similar sets with that sum of sizes."""
    return (100 - percent) * size // (100 + percent)


def spare_blocks(blocks: int, least: int) -> int | None:
    """Blocks beyond the pigeonhole's, so that a set of the band's least size rarely has more empty ones.

    None if more blocks than the pigeonhole's own would have to be spare.
    """
    for spare in range(blocks + 1):
        empty = (blocks + spare) * math.exp(-least / (blocks + spare))
        if empty < 0.3 or spare >= 1.5 * empty:
            return spare
    return None


@lru_cache(maxsize=1 << 16)
def bands(size: int, percent: int) -> list[tuple[int, int, int | None]]:
    """The size bands of a set, as (band, blocks, spare ones among them); bands without differences need none.

    Spare blocks of None say that the band is joined by prefix tokens.
    """
    found, low, band = [], 1, 0
    most = size * 100 // percent  # the largest similar set
    while low <= most:
        high = max(low + 1, int(low * GROWTH))
        if low <= size < high or size < low <= most:
            blocks = differences(2 * (high - 1), percent) + 1
            if blocks > 1:
                spare = spare_blocks(blocks, -(-low * percent // 100))
                found.append((band, blocks + (spare or 0), spare))
        low, band = high, band + 1
    return found


def prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Of tokens in any order common to all sets, the first ones: similar sets share one of them."""
    return tokens[:len(tokens) + percent * len(tokens) // -100 + 1]


def block_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """A hash of every block that isn't empty, or of the prefix tokens where blocks don't serve."""
    out = []
    for band, blocks, spare in bands(len(tokens), percent):
        for seed in range(SEEDS) if spare is not None else ():
            dealt = mixed(tokens ^ np.uint64((band * 64 + seed + 1) * BASE_2 & (1 << 64) - 1))
            block = (dealt >> np.uint64(16)) % np.uint64(blocks)
            salt = (block + np.uint64(blocks << 20)) * np.uint64(BASE_2) + np.uint64(band * 64 + seed)
            bit = mixed((dealt & np.uint64(0xFFFF)) + (salt << np.uint64(16)))
            order = np.argsort(block, kind="stable")
            heads = np.flatnonzero(np.diff(block[order], prepend=np.uint64(1 << 63)))
            out.append(mixed(np.bitwise_xor.reduceat(bit[order], heads) ^ mixed(salt[order[heads]])))
            if blocks - len(heads) <= spare:
                break
        else:  # sets are in hash order
            out.append(mixed(prefix(tokens, percent) + np.uint64(band * BASE_2 + 1 & (1 << 64) - 1)))
    return np.concatenate(out) if out else tokens[:0]


def folded(tokens: np.ndarray) -> bytes:
    """All parities in one sketch of FOLD_BITS."""
    bits = np.bincount((mixed(tokens) % np.uint64(FOLD_BITS)).astype(np.int64), minlength=FOLD_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def sketched(docs: DataFrame, n: int, seed: int, keys_of: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """One row per document: doc_id, hash of the text, size, the set's two fingerprints, its join keys and folded sketch."""
    def work(batches):
        for batch in batches:
            names, hashes = batch.column("doc_id"), batch.column("text_hash")
            for texts in texts_of(batch.column("text")):
                sets = shingles(texts, n)
                a, b = fingerprints(sets, seed)
                keys = keys_of(sets)
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(texts.first, len(texts)), hashes.slice(texts.first, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)),
                     pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                     pa.array([folded(s) for s in sets], pa.binary())],
                    names=["doc_id", "text_hash", "size", "a", "b", "keys", "fold"])
    schema = "doc_id long, text_hash long, size long, a long, b long, keys array<long>, fold binary"
    return arrow(docs.select("doc_id", "text", text_hash("text").alias("text_hash")), work, schema, tidy=True)


def text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def fingerprints(sets: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    turn = np.uint64(mixed(np.array([seed + 1], np.uint64))[0])
    a = np.array([np.bitwise_xor.reduce(mixed(s + turn)) for s in sets], np.uint64)
    b = np.array([mixed(s ^ turn).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mixed(a ^ b * np.uint64(BASE_2)), b


def texts_for(docs: DataFrame, wanted: DataFrame, n: int, seed: int) -> DataFrame:
    """(a, packed): the deflated texts, which are smaller than their sets, of the documents whose ids are wanted."""
    def work(batches):
        for batch in batches:
            for texts in texts_of(batch.column("text")):
                a, _ = fingerprints(shingles(texts, n), seed)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array([zlib.compress(texts.text(i), 1) for i in range(len(texts))], pa.binary())], names=["a", "packed"])
    bare = docs.select("doc_id", "text")
    few = small_side(wanted.select(F.col("first").alias("_id")), 16)
    return arrow(bare.join(few, bare["doc_id"].eqNullSafe(few["_id"]), "left_semi"), work, "a long, packed binary", tidy=True)


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def sizes_and_folds_allow(size_a, fold_a, size_b, fold_b, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and folded parities leave room for similarity, for pairs of rows, and the bits that differ."""
    ok = (100 * size_a >= percent * size_b) & (100 * size_b >= percent * size_a)
    apart = np.bitwise_count(fold_a ^ fold_b).sum(axis=-1, dtype=np.int64)
    return ok & ((100 + percent) * apart <= (100 - percent) * (size_a + size_b)), apart


def fold_rows(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(len(column), FOLD_BITS // 64)


def sketch_sides(vertices: DataFrame, limit: int = PAYLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Ids, sizes and folded sketches for both ends of pairs. All columns of both are renamed alike, so that one exchange serves both joins."""
    one, two = (vertices.select(*[F.col(c).alias(f"{name}_{end}") for c, name in (("a", "id"), ("size", "size"), ("fold", "fold"))]) for end in "ab")
    light = fits(vertices, FOLD_BITS // 8 + 48, limit)
    return (F.broadcast(one), F.broadcast(two)) if light else (one, two)


def verified(pairs: DataFrame, vertices: DataFrame, texts: DataFrame, n: int, percent: int, best: bool, payload: int = PAYLOAD_BYTES) -> DataFrame:
    """The similar pairs (a, b): first by size and folded sketch, then on the sets themselves.

    With ``best``, only the pair with the fewest differing bits is verified for each a.
    """
    @F.arrow_udf("bigint")
    def apart(size_a: pa.Array, fold_a: pa.Array, size_b: pa.Array, fold_b: pa.Array) -> pa.Array:
        ok, bits = sizes_and_folds_allow(size_a.to_numpy(), fold_rows(fold_a), size_b.to_numpy(), fold_rows(fold_b), percent)
        return pa.array(bits, mask=~ok)

    @F.arrow_udf("boolean")
    def are(left: pa.Array, right: pa.Array) -> pa.Array:
        @lru_cache(maxsize=64)
        def tokens(packed: bytes) -> np.ndarray:
            return unpacked(packed, n)
        out = pa.array([similar(tokens(x), tokens(y), percent) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.bool_())
        give_back()
        return out

    one, two = sketch_sides(vertices, payload)
    near = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b")) \
        .withColumn("apart", apart("size_a", "fold_a", "size_b", "fold_b")).where("apart is not null")
    if best:
        near = near.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    near = stored(near.select("a", "b"), "near-pairs")
    centres = near.select("b").distinct()
    right = stored(texts.select(F.col("a").alias("b"), F.col("packed").alias("right")).join(small_side(centres, 16), "b", "left_semi"), "centre-texts")
    size = right.agg(F.sum(F.octet_length("right") + 32)).first()[0] or 0

    def confirmed(near: DataFrame, right: DataFrame) -> DataFrame:
        left = texts.withColumnRenamed("packed", "left").join(small_side(near, 24), "a")
        return left.join(right, "b").where(are("left", "right")).select("a", "b")

    if size <= payload:
        return confirmed(near, F.broadcast(right))
    # The texts meet by a shuffle, with as many copies as pairs; one slice of the pairs after another.
    slices = [F.pmod("b", F.lit(SLICES)) == i for i in range(SLICES)]
    return reduce(DataFrame.unionByName, [stored(confirmed(near.where(mine), right.where(mine)), "links") for mine in slices])


def star_pairs(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Each block's most shared class with the block's classes of other labels.

    After the first round the centre is taken from the classes outside the block's first centre's label.
    """
    best = F.max(F.struct("share", "a"))
    if labels is None:
        centre = members.groupBy("key").agg(best["a"].alias("b"))
        return members.join(centre, "key").where("a != b").select("a", "b").distinct()
    named = labelled(members, labels)
    first = named.groupBy("key").agg(F.max(F.struct("share", "a", "label"))["label"].alias("main"), F.min("label").alias("low"), F.max("label").alias("high"))
    others = named.join(first.where("low != high"), "key").where("label != main")
    centre = others.groupBy("key").agg(F.max(F.struct("share", "a", "label")).alias("centre")).select("key", F.col("centre.a").alias("b"), F.col("centre.label").alias("other"))
    return named.join(centre, "key").where("label != other").select("a", "b").distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of keys that still hold several labels; labels only grow together, so the others stay done."""
    named = members.join(small_side(labels.withColumnRenamed("node", "a"), 16), "a", "left").withColumn("label", F.coalesce("label", "a"))
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    return members.join(small_side(stored(several, "open-keys"), 16), "key", "left_semi")


def open_in_slices(members: DataFrame, labels: DataFrame, slices: int = SLICES) -> DataFrame:
    """The different rows of ``open_members``, stored slice by slice."""
    def of(mine: DataFrame) -> DataFrame:
        with passing(mine.sparkSession) as keep:
            return keep(stored(open_members(mine, labels).distinct(), "open-members"))
    return reduce(DataFrame.unionByName, [of(members.where(in_slice("key", i, slices))) for i in range(slices)])


def in_slice(key: str, i: int, slices: int) -> Column:
    return F.pmod(F.shiftright(key, 8), F.lit(slices)) == i


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.withColumnRenamed("node", "a")
    return members.join(known, "a", "left").withColumn("label", F.coalesce("label", "a"))


def token_cells(texts: DataFrame, n: int) -> np.ndarray:
    """How often the tokens of the given texts fall into each cell of a table of fixed size."""
    def work(batches):
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                total += np.bincount(cell_of(unpacked(packed, n)), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])
    rows = arrow(texts.select("packed"), work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** CELL_BITS rows
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)


def unpacked(packed: bytes, n: int) -> np.ndarray:
    return shingles(next(texts_of(pa.array([zlib.decompress(packed)], pa.binary()))), n)[0]


def cut_by_prefix(open_: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of wide blocks once for each token of their prefixes that another row of the block has too."""
    shared = open_.sparkSession.sparkContext.broadcast(token_cells(texts, n))

    @F.arrow_udf("array<bigint>")
    def first_tokens(column: pa.Array) -> pa.Array:
        out = []
        for packed in column.to_pylist():
            tokens = unpacked(packed, n)
            ranked = tokens[np.lexsort((tokens, shared.value[cell_of(tokens)]))]
            out.append(prefix(ranked, percent).view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    members = open_.select("a").distinct()
    tokens = stored(texts.join(members, "a", "left_semi").select("a", F.explode(first_tokens("packed")).alias("token")), "prefix-tokens")
    cut = open_.join(tokens, "a").withColumn("key", F.xxhash64("key", "token")).drop("token")
    again = cut.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low != high")
    return cut.join(again.select("key", "m"), "key").withColumn("n", F.col("m")).drop("m")


def first_common(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each row of ``others`` the place of the first pair of keys, one of each half, that it shares with ``one`` place by place."""
    half = len(one) // 2
    same = others == one
    return same[:, :half].argmax(axis=1) * half + same[:, half:].argmax(axis=1)


def cross_pairs(members: DataFrame, labels: DataFrame, vertices: DataFrame, texts: DataFrame, n: int, percent: int, wide: int = WIDE, limit: int = KEY_BYTES) -> DataFrame:
    """Pairs of one block but two labels that sizes and folded sketches allow.

    Where ``members`` tell the ``place`` of their keys among all pairs of the two halves of ``vertices.short``, a
    pair of classes comes from the first such place alone, although it meets in many blocks.
    """
    placed = "place" in members.columns
    if not placed:
        members, vertices = members.withColumn("place", F.lit(-1)), vertices.withColumn("short", F.lit(None).cast("array<int>"))
    named = stored(labelled(members, labels), "named-members")
    by_label = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    blocks = by_label.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.min("label").alias("low"), F.max("label").alias("high"),
                                         F.sum("n").alias("n"), F.max("n").alias("most"))
    open_ = stored(named.join(blocks.where("low != high").select("key", "main", "n", "most"), "key").select("key", "place", "a", "label", "main", "n", "most"), "open-members")
    too_wide = open_.where(F.col("n") - F.col("most") > wide)
    if not too_wide.isEmpty():
        cut = stored(cut_by_prefix(too_wide, texts, n, percent).withColumn("place", F.lit(-1)), "cut-blocks")
        open_ = open_.where(F.col("n") - F.col("most") <= wide).unionByName(cut)
    open_ = open_.drop("most")
    row = F.struct("a", "label", "size", "fold", "short")
    pair = "array<struct<a: bigint, b: bigint>>"

    def between(x: pa.Array, y: pa.Array, at: int, same: bool) -> list[dict]:
        """The pairs of different labels that may be similar, one row of each list; of one list, each pair once."""
        a, b = x.field("a").to_numpy(), y.field("a").to_numpy()
        la, lb = x.field("label").to_numpy(), y.field("label").to_numpy()
        sa, sb = x.field("size").to_numpy(), y.field("size").to_numpy()
        fa, fb = fold_rows(x.field("fold")), fold_rows(y.field("fold"))
        if at >= 0:
            xs, ys = (rows.field("short").flatten().to_numpy().reshape(len(rows), -1) for rows in (x, y))
        found = []
        for r in range(len(a)):
            ok = lb != la[r]
            if same:
                ok[:r] = False
            if ok.any():
                ok[ok] = sizes_and_folds_allow(sa[r], fa[r], sb[ok], fb[ok], percent)[0]
            if at >= 0 and ok.any():
                ok[ok] = first_common(xs[r], ys[ok]) == at
            found += [{"a": min(int(a[r]), z), "b": max(int(a[r]), z)} for z in b[ok].tolist()]
        return found

    arrow_pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    @F.arrow_udf(pair)
    def within(place: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array([between(rows[i].values, rows[i].values, at, True) for i, at in enumerate(place.to_pylist())], arrow_pairs)

    @F.arrow_udf(pair)
    def passing_pairs(place: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([between(left[i].values, right[i].values, at, False) for i, at in enumerate(place.to_pylist())], arrow_pairs)

    def met_in(open_: DataFrame) -> DataFrame:
        open_ = open_.join(vertices.select("a", "size", "fold", "short"), "a")
        # Most blocks fit one list. The others are cut into lists of about CHUNK rows, which meet two by two.
        whole = open_.where(F.col("n") <= CHUNK).groupBy("key").agg(F.first("place").alias("place"), F.collect_list(row).alias("rows"))
        found = whole.select(F.explode(within("place", "rows")).alias("pair"))
        large = open_.where(F.col("n") > CHUNK)
        group = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / CHUNK)).cast("int")
        chunks = large.groupBy("key", (F.col("label") != F.col("main")).alias("query"), group.alias("chunk")) \
            .agg(F.first("place").alias("place"), F.collect_list(row).alias("rows"))
        chunks = stored(chunks, "chunks")
        left = chunks.where("query").select("key", "place", F.col("chunk").alias("i"), F.col("rows").alias("left"))
        right = chunks.select("key", "query", F.col("chunk").alias("j"), F.col("rows").alias("right"))
        met = left.join(right, "key").where("not query or i <= j")
        found = found.unionByName(met.select(F.explode(passing_pairs("place", "left", "right")).alias("pair")))
        return found.select("pair.a", "pair.b").distinct()

    def of(mine: DataFrame) -> DataFrame:
        with passing(mine.sparkSession) as keep:
            return keep(stored(met_in(mine), "block-pairs"))

    # Each row carries its sketch, so that blocks beyond the limit meet in one slice after another.
    if fits(open_, FOLD_BITS // 8 + 64, limit):
        return met_in(open_)
    return reduce(DataFrame.unionByName, [of(open_.where(in_slice("key", i, SLICES))) for i in range(SLICES)]).distinct()


def set_classes(docs: DataFrame, n: int, keys_of: Callable[[list[np.ndarray]], list[np.ndarray]]) -> tuple[DataFrame, DataFrame, int]:
    """``sketched`` rows, one row for each different set (a, first id, size), and the seed that tells the sets apart."""
    seed = 0
    while True:
        rows = stored(sketched(docs, n, seed, keys_of), "sketches")
        classes = rows.where("size > 0").groupBy("a").agg(F.min("doc_id").alias("first"), F.min("b").alias("b"), F.max("b").alias("other"), F.min("size").alias("size"))
        classes = stored(classes, "classes")
        if classes.where("b != other").isEmpty():
            return rows, classes, seed
        discard(rows, classes)
        seed += 1  # two different sets share the first fingerprint


def shared_keys(keys: DataFrame, label: str) -> DataFrame:
    """The (key, a) of keys that more than one class has."""
    shared = keys.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low != high").select("key")
    with passing(keys.sparkSession) as keep:
        shared = stored(shared, "shared-keys")
        return keep(stored(keys.join(small_side(shared, 16), "key").distinct(), label))


def candidates(docs: DataFrame, rows: DataFrame, classes: DataFrame, members: DataFrame, n: int, seed: int, before: tuple | None = None):
    """Members with the share of their keys, and sizes, sketches and texts of their classes; those of ``before`` aren't made again."""
    placed = ["place"] if "place" in members.columns else []
    share = members.groupBy("a").agg(F.count("*").alias("hits"))
    sketches = rows.groupBy("a").agg(F.min("size").alias("size"), F.min("fold").alias("fold"), F.min(F.size("keys")).alias("blocks"),
                                     *[F.min("keys").alias("short") for _ in placed])
    if placed:  # 31 bits of each tell two classes' keys apart well enough
        sketches = sketches.withColumn("short", F.transform("short", lambda k: k.bitwiseAND((1 << 31) - 1).cast("int")))
    vertices = stored(sketches.join(small_side(share, 24), "a").join(classes.select("a", "first"), "a")
                      .select("a", "first", "size", "fold", *["short" for _ in placed], (F.col("hits") / F.col("blocks")).alias("share")), "vertices")
    members = stored(members.join(vertices.select("a", "share"), "a").select("key", *placed, "a", "share"), "members")
    new = vertices.select("a", "first")
    if before is not None:
        new = new.join(small_side(before[0].select("a"), 16), "a", "left_anti")
    texts = stored(texts_for(docs, new, n, seed).join(small_side(new.select("a"), 16), "a", "left_semi"), "texts")
    return members, vertices, texts if before is None else texts.unionByName(before[1])


def with_components(docs: DataFrame, rows: DataFrame, classes: DataFrame, keys: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """The rows of ``rows`` with n_shingles and component_id; ``keys`` (key, a) are the join keys of the classes.

    One key in FEW is looked at first: what is alike shares many, so most links are found there. All keys are then grouped
    once, slice by slice, by the labels that this gave, and only those with several labels go on. ``keys`` may have the place
    of the keys (``cross_pairs``); those of ``rows`` are then the keys of the two halves. Inside a ``passing`` block each step goes as soon
    as nothing reads it any more, the steps given first.
    """
    spark = docs.sparkSession

    def linked_by(pairs: Callable[[], DataFrame], best: bool) -> DataFrame:
        with passing(spark) as keep:
            return keep(stored(verified(pairs(), vertices, texts, n, percent, best=best), "links"))

    bare = stored(rows.select("doc_id", "text_hash", "size", "a"), "rows")  # all that is used of them when their keys are done
    first = shared_keys(keys.where(F.pmod("key", F.lit(FEW)) == 0), "few-members")
    few, vertices, texts = candidates(docs, rows, classes, first, n, seed)
    discard(first)
    links = linked_by(lambda: star_pairs(few, None), True)
    labels = components(links)
    before, first = vertices, open_in_slices(keys, labels)
    members, vertices, texts = candidates(docs, rows, classes, first, n, seed, (vertices, texts))
    discard(first, few, before, rows, keys)
    for _ in range(STARS):
        links = links.unionByName(linked_by(lambda: star_pairs(members, labels), True))
        old, labels = labels, components(links)
        shut, members = members, open_in_slices(members, labels)
        discard(old, shut)
    last = linked_by(lambda: cross_pairs(members, labels, vertices, texts, n, percent), False)
    discard(members, vertices, texts, labels)
    labels = components(links.unionByName(last))

    named = classes.select("a", "first").join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = stored(named.join(smallest, "label").select("a", "label", "component_id"), "components")
    discard(labels, links, last, classes)
    linked = bare.where("size > 0").join(ids, "a").select("doc_id", "text_hash", F.col("size").alias("n_shingles"), "component_id", "label")
    alone = bare.where("size = 0").select("doc_id", "text_hash", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return linked.unionByName(alone)


def labelled_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with passing(docs.sparkSession) as keep:
        rows, classes, seed = set_classes(docs, n, lambda sets: [block_keys(s, percent) for s in sets])
        keys = rows.where("size > 0").select("a", F.explode("keys").alias("key"))
        return keep(with_components(docs, rows, classes, keys, n, percent, seed))


def similarity_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id reachable by links, itself included)."""
    return labelled_rows(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays."""
    with passing(docs.sparkSession) as keep:
        kinds = keep(row_kinds(docs, n, percent))
    mine = docs.select(*docs.columns)

    def of(kind: DataFrame, how: str) -> DataFrame:
        return mine.join(small_side(kind, 24), [mine["doc_id"].cast("long").eqNullSafe(kind["_id"]), text_hash("text") == kind["_hash"]], how)
    kept = of(kinds.where("not kept or times > 1"), "left_anti")
    again = kinds.where("kept and times > 1")
    if again.isEmpty():
        return kept
    one = of(again, "left_semi").groupBy(F.col("doc_id").cast("long").alias("_id"), text_hash("text").alias("_hash")) \
        .agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return kept.unionByName(one.select("_row.*"))


def row_kinds(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The ids and text hashes of the rows in components, how often each comes, and whether it is the one that stays."""
    found = stored(labelled_rows(docs, n, percent).where("label is not null").select("doc_id", "text_hash", "label"), "labelled-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("label").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("doc_id"), F.col("best.text_hash").alias("text_hash"))
    best = best.withColumn("kept", F.lit(True))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    same = [rows["doc_id"].eqNullSafe(best["doc_id"]), rows["text_hash"] == best["text_hash"]]
    return stored(rows.join(best, same, "left").select(rows["doc_id"].alias("_id"), rows["text_hash"].alias("_hash"), "times", F.coalesce("kept", F.lit(False)).alias("kept")), "row-kinds")
