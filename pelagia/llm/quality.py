"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

**Tokens.** Runs of letters and digits, and runs of other signs, as written (case counts). A token falls into one of
2 ** BUCKET_BITS buckets by its hash; tokens without a small letter carry a mark of their shape
besides, so that shouted words share a bucket.

**Random indexing.** Every bucket has a fixed sparse index vector (two signs at hashed places of DIMENSIONS). A bucket's word vector is the sum of
the index vectors of its neighbours within two tokens, over all documents, scaled to length 1. Tasks add up counts for
their own rows, and Spark sums them by bucket: the table has a fixed size, whatever the corpus.

**Pooling.** The mean of a document's word vectors and, next to it, the mean of its tokens' own index vectors, the share
of tokens that repeat the token before, and of distinct buckets.

**Network.** Two dense layers in numpy, trained on at most ``sample`` labelled rows (those with the least hash of their id), with a
part kept back for the temperature that calibrates the probabilities.

Null and empty texts have the zero vector and a score like any other. Rows without label or with a null label aren't
learnt from; repeated labels count once each. With labels of one kind only, that kind's share is every score. An empty table gives no rows; extra columns are
ignored, and no column but the text is ever an input of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.tables import arrow, give_back, stored
from pelagia.llm.words import Texts, byte_class, find_words, mixed, texts_of

BUCKET_BITS = 14
DIMENSIONS = 64
SAMPLE = 20_000
HIDDEN = 48
NEAR = (1, 2)
_LETTERS = byte_class(ranges=((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
_SIGNS = byte_class(ranges=((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))
_SMALL = byte_class(ranges=((0x61, 0x7A), (0x80, 0xFF)))


def buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all tokens in order, and where each text's begin."""
    parts = [find_words(texts, table, lower=False) for table in (_LETTERS, _SIGNS)]
    starts = np.concatenate([p.starts for p in parts])
    order = np.argsort(starts, kind="stable")
    hashes = np.concatenate([p.hashes() for p in parts])
    small = np.concatenate([[0], np.cumsum(_SMALL[texts.data])])
    word = parts[0]
    loud = (small[word.ends] - small[word.starts] == 0) & (word.ends - word.starts > 1)
    hashes[:len(loud)][loud] = np.uint64(1)
    return (mixed(hashes)[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(starts[order], texts.offsets)


def index_places() -> list[tuple[np.ndarray, np.ndarray]]:
    """Two places with a sign for each bucket, given by its number."""
    rows = np.arange(1 << BUCKET_BITS, dtype=np.uint64)
    hashes = [mixed(rows + np.uint64((turn + 1) << 32)) for turn in range(2)]
    return [((h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)) for h in hashes]


def index_vectors() -> np.ndarray:
    vectors = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.float32)
    for place, sign in index_places():
        vectors[np.arange(len(vectors)), place] += sign
    return vectors


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A word vector for every bucket, from the neighbourhoods of all documents."""
    def work(batches):
        places = index_places()
        total = np.zeros((1 << BUCKET_BITS) * DIMENSIONS)
        for batch in batches:
            for texts in texts_of(batch.column("text")):
                found, pointer = buckets(texts)
                text = np.repeat(np.arange(len(texts)), np.diff(pointer))
                for step in NEAR:
                    same = text[step:] == text[:-step]
                    a, b = found[step:][same], found[:-step][same]
                    for word, near in ((a, b), (b, a)):
                        for place, sign in places:
                            total += np.bincount(word * DIMENSIONS + place[near], weights=sign[near], minlength=len(total))
        total = total.reshape(-1, DIMENSIONS)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        flat = pa.array(total[used].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.FixedSizeListArray.from_arrays(flat, DIMENSIONS).cast(pa.list_(pa.float64()))], names=["bucket", "vector"])

    partial = arrow(docs.select("text"), work, "bucket long, vector array<double>", tidy=True)
    sums = partial.groupBy("bucket").agg(*[F.sum(F.col("vector")[i]).alias(f"v{i}") for i in range(DIMENSIONS)])
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.float32)
    rows = sums.select("bucket", F.array(*[f"v{i}" for i in range(DIMENSIONS)]).alias("vector")).toArrow()  # at most 2 ** BUCKET_BITS rows
    if rows.num_rows:
        out[rows["bucket"].to_numpy()] = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: Texts, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    found, pointer = buckets(texts)
    n = len(texts)
    sizes = np.diff(pointer)
    text = np.repeat(np.arange(n), sizes)
    pair, count = np.unique(text << BUCKET_BITS | found, return_counts=True)
    owner, bucket = pair >> BUCKET_BITS, pair & (1 << BUCKET_BITS) - 1
    out = np.zeros((n, 2 * DIMENSIONS + 2), np.float32)
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(heads):
        weight = (count / sizes[owner])[:, None].astype(np.float32)
        out[owner[heads], :DIMENSIONS] = np.add.reduceat(vectors[bucket] * weight, heads, axis=0)
        out[owner[heads], DIMENSIONS:2 * DIMENSIONS] = np.add.reduceat(index[bucket] * weight, heads, axis=0)
        again = np.bincount(text[1:], weights=(found[1:] == found[:-1]) & (text[1:] == text[:-1]), minlength=n)
        out[:, -2] = again / np.maximum(sizes, 1)
        out[:, -1] = np.bincount(owner, minlength=n) / np.maximum(sizes, 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logits(model: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    hidden = np.maximum((rows - model["mean"]) / model["scale"] @ model["w1"] + model["b1"], 0)
    return hidden @ model["w2"] + model["b2"]


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = 40, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the log loss with weight decay; the temperature is fitted on a fifth of the rows that is kept back."""
    random = np.random.default_rng(seed)
    width = rows.shape[1]
    model = {"mean": rows.mean(axis=0) if len(rows) else np.zeros(width), "scale": rows.std(axis=0) + 1e-3 if len(rows) else np.ones(width),
             "w1": random.normal(0, np.sqrt(2 / width), (width, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.zeros(1), "temperature": np.ones(1)}
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or len(labels) < 20:
        model["b2"] += np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1))
        return model
    model["b2"] += np.log(share / (1 - share))
    model["w2"] = random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    kept_back = np.arange(len(labels)) % 5 == 4
    x, y = ((rows - model["mean"]) / model["scale"])[~kept_back], labels[~kept_back].astype(float)
    names = ("w1", "b1", "w2", "b2")
    first, second = ({n: np.zeros_like(model[n]) for n in names} for _ in range(2))
    step = 0
    for _ in range(rounds):
        order = random.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // 128)):
            step += 1
            hidden = np.maximum(x[at] @ model["w1"] + model["b1"], 0)
            error = (sigmoid(hidden @ model["w2"] + model["b2"]) - y[at]) / len(at)
            back = error[:, None] * model["w2"] * (hidden > 0)
            slopes = {"w1": x[at].T @ back + 1e-4 * model["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ error + 1e-4 * model["w2"], "b2": error.sum(keepdims=True)}
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * slopes[n]
                second[n] = 0.999 * second[n] + 0.001 * slopes[n] ** 2
                model[n] = model[n] - 2e-3 * first[n] / (1 - 0.9 ** step) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
    z, truth = logits(model, rows[kept_back]), labels[kept_back]
    temperatures = np.geomspace(0.25, 8, 120)
    losses = [-np.mean(np.log(np.where(truth == 1, sigmoid(z / t), sigmoid(-z / t)))) for t in temperatures]
    model["temperature"] = temperatures[[int(np.argmin(losses))]]
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Word vectors of all documents, and a network learnt from labelled rows: (doc_id, label)."""
    vectors = word_vectors(docs)
    known = labels.where("label in (0, 1)").groupBy("doc_id", "label").agg(F.lit(1).alias("one")).drop("one")
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most ``sample`` ids
    ids = texts.select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("label").cast("string")).alias("_pair"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def work(batches):
        index = index_vectors()
        for batch in batches:
            for part in texts_of(batch.column("text")):
                rows = pooled(part, sent.value, index)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("_pair").slice(part.first, len(part)), lists], names=["pair", "features"])

    found = arrow(ids, work, "pair string, features array<float>").orderBy(F.xxhash64("pair"), "pair", "features").limit(sample).toArrow()
    width = 2 * DIMENSIONS + 2
    rows = found["features"].combine_chunks().flatten().to_numpy().reshape(-1, width).astype(float) if found.num_rows else np.zeros((0, width))
    truth = np.array([int(p.rsplit(" ", 1)[1]) for p in found["pair"].to_pylist()], int)
    model = train(rows, truth)
    del found, rows
    give_back()  # the driver's own Python goes on through all later steps
    return vectors, model


def scorer(docs: DataFrame, vectors: np.ndarray, model: dict[str, np.ndarray]):
    """A column function: the probability of label 1 for a text."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, model))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        words, network = sent.value
        index = index_vectors()
        parts = [sigmoid(logits(network, pooled(texts, words, index).astype(float)) / network["temperature"]) for texts in texts_of(column)]
        give_back()
        return pa.array(np.concatenate([*parts, np.zeros(0)]))
    return score
