"""The two models: held-out accuracy, exact base scores, and batched scores against one id at a time."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.llm import lm, quality
from pelagia.llm.queries import BYTE_IDS, BYTE_VOCABULARY, QUERIES
from pelagia.llm.tables import held_out

MIDDLE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, label int, digest string, score int"


def test_quality_separates_held_out_rows(spark):
    found = QUERIES["op1_quality_classifier"](spark, MIDDLE)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    known = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good, bad = [r.score for r, q in known if q == 1], [r.score for r, q in known if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_quality_of_odd_rows(spark):
    rows = [(i, f"plain words about thing {i} and more", 1, "x", 1) for i in range(40)] + [(50 + i, f"Ugh!! {i} %%% %%% ###", 0, "x", 1) for i in range(20)]
    odd = [(100, None, None, "x", 1), (101, "", None, "x", 1), (None, "a", None, "x", 1), (102, "w " * 40_000, None, "x", 1), (0, rows[0][1], 1, "x", 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    fitted = quality.fit(docs.drop("label"), docs.select("doc_id", "label"))
    scores = [(r.doc_id, r.p) for r in docs.select("doc_id", quality.scorer(docs, *fitted)("text").alias("p")).collect()]
    assert len(scores) == len(rows) + len(odd) and all(0 <= p <= 1 for _, p in scores)
    assert max(p for d, p in scores if d and 50 <= d < 70) < min(p for d, p in scores if d is not None and d < 40)
    one_kind = quality.fit(docs.drop("label"), docs.where("label = 1").select("doc_id", "label"))
    assert docs.select(quality.scorer(docs, *one_kind)("text").alias("p")).where("p < 0.9").isEmpty()
    none = docs.limit(0)
    assert none.select(quality.scorer(none, *quality.fit(none.drop("label"), none.select("doc_id", "label")))("text").alias("p")).count() == 0


def test_temperature_calibrates():
    random = np.random.default_rng(1)
    rows = random.normal(0, 1, (3000, 6))
    labels = (random.random(3000) < quality.sigmoid(2 * rows[:, 0])).astype(int)
    model = quality.train(rows, labels)
    p = quality.sigmoid(quality.logits(model, rows) / model["temperature"])
    assert abs(p.mean() - labels.mean()) < 0.03 and np.mean(np.abs(p - quality.sigmoid(2 * rows[:, 0]))) < 0.1


# -- language model ----------------------------------------------------------------------------

def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 20])
def test_base_scores(spark, frequent):
    rows = [(i, f"The cat {i % 7} sat on the Mat {i}", 1, "x", 1) for i in range(60)] + [(100, None, 1, "x", 1), (101, "", 1, "x", 1), (None, "the unseen", 1, "x", 1), (3, "The cat 3 sat on the Mat 3", 1, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
    counts = collections.Counter(w for d, t, *_ in rows if not out[d] for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("digest"), held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    found = lm.base_scores(bare, frequent).collect()
    assert len(found) == len(rows) - 1  # repeated rows have one score
    texts = {d: t for d, t, *_ in rows}
    for r in found:
        own = words(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)


def tiny(seed=0):
    random = np.random.default_rng(seed)
    counts = random.integers(0, 50, 300)
    klass, shares = lm.class_ids(counts, random.integers(0, 3, 300))
    direct = tuple(random.normal(0, 1, s).astype(np.float32) for s in ((lm.BUCKETS, lm.GROUPS), (lm.BUCKETS * lm.GROUPS, lm.MEMBERS)))
    model = {n: p + random.normal(0, 0.1, p.shape).astype(np.float32) for n, p in lm.initial().items()}
    return model, direct, klass, shares


def test_batched_scores_equal_one_id_at_a_time_and_sum_to_one():
    model, direct, klass, shares = tiny()
    random = np.random.default_rng(2)
    texts = [random.integers(0, 300, n) for n in (1, 15, 16, 17, 70)]
    found = lm.log10_probabilities(model, direct, klass, shares, texts, end=299, batch=3)
    for ids, scores in zip(texts, found):
        assert len(scores) == len(ids)
        for t in {0, len(ids) // 2, len(ids) - 1}:
            begin = t // lm.STEP * lm.STEP - lm.STEP
            before = [ids[i - 1] if i else 299 for i in range(max(0, begin), t + 1)]
            x = model["embed"][lm.bucket(np.array(before))] + model["place"][max(0, -begin):][:len(before)]
            q, k, v = x[-1] @ model["q"], x @ model["k"], x @ model["v"]
            weights = np.exp(k @ q / np.sqrt(lm.WIDTH))
            mid = x[-1] + weights / weights.sum() @ v @ model["o"]
            top = mid + np.maximum(mid @ model["w1"] + model["c1"], 0) @ model["w2"]
            row = lm.bucket(np.array(before[-1:]))[0]
            one = lm.log_classes(top @ model["out"] + model["bias"] + direct[0][row])
            two = np.stack([lm.log_classes(top @ model["inner"][g] + direct[1][row * lm.GROUPS + g]) for g in range(lm.GROUPS)])
            every = (one[klass // lm.MEMBERS] + two[klass // lm.MEMBERS, klass % lm.MEMBERS]) / np.log(10) + shares
            assert math.isclose(every[ids[t]], scores[t], abs_tol=1e-4)
    # Classes without ids hold the rest of the mass; with ids in all of them it is one.
    full = np.arange(lm.CLASSES)
    every = [lm.log10_probabilities(model, direct, full, np.zeros(lm.CLASSES), [np.array([5, i])], end=3)[0][1] for i in full]
    assert math.isclose(sum(10 ** np.array(every)), 1, abs_tol=1e-4)


def test_slopes_are_the_loss_slopes():
    model, direct, klass, _ = tiny(4)
    inputs, targets, valid = lm.windows(np.random.default_rng(3).integers(0, 300, 45), 299)
    wanted = klass[np.maximum(targets, 0)]
    wide = {n: p.astype(float) for n, p in model.items()}

    def loss():
        found = lm.forward(wide, direct, inputs, wanted // lm.MEMBERS)
        pick = lambda logits, at: np.take_along_axis(lm.log_classes(logits), at[:, :, None], axis=2)[:, :, 0]
        return -((pick(found["logits"], wanted // lm.MEMBERS) + pick(found["inner"], wanted % lm.MEMBERS)) * valid).sum() / valid.sum()

    g = lm.slopes(wide, direct, inputs, wanted, valid)
    for name, p in wide.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), p.shape)
        kept = p[at]
        p[at] = kept + 1e-3
        high = loss()
        p[at] = kept - 1e-3
        low = loss()
        p[at] = kept
        assert math.isclose((high - low) / 2e-3, g[name][at], rel_tol=0.05, abs_tol=1e-4), name


def test_training_helps_and_odd_rows_have_scores(spark):
    rows = [(i, " ".join(f"red green blue {'one two' if k % 2 else 'two one'}" for k in range(12)), 1, "x", 1) for i in range(60)]
    rows += [(100, None, 1, "x", 1), (101, "", 1, "x", 1), (None, "red", 1, "x", 1), (3, rows[3][1], 1, "x", 1), (102, "red " * 9_000, 1, "x", 1)]
    found = lm.scores(spark.createDataFrame(rows, SCHEMA), held_out(F.col("doc_id"), 7, 2), BYTE_VOCABULARY, BYTE_IDS, BYTE_IDS - 1).collect()
    assert len(found) == len(rows) and all(r.score < 0 and r.n_tokens >= 1 for r in found)
    assert np.mean([r.score > r.base_score for r in found if r.held_out]) > 0.8
    none = lm.scores(spark.createDataFrame([], SCHEMA), held_out(F.col("doc_id"), 7, 2), BYTE_VOCABULARY, BYTE_IDS, BYTE_IDS - 1)
    assert none.count() == 0


def test_every_window_of_every_text_trains(spark):
    size, end = 2_000, 1_999
    random = np.random.default_rng(11)
    texts = [np.arange(0, 1_500), np.arange(1_500, 1_540), np.array([end])]  # 94 windows, 3 and 1
    rows = spark.createDataFrame([(i, False, t.astype("<u4").tobytes()) for i, t in enumerate(texts)], "doc_id long, held_out boolean, ids binary").coalesce(1)
    model = {n: p + random.normal(0, 0.1, p.shape).astype(np.float32) for n, p in lm.initial().items()}
    klass = random.integers(0, lm.CLASSES, size)
    direct = np.zeros((lm.BUCKETS, lm.GROUPS), np.float32), np.zeros((lm.BUCKETS * lm.GROUPS, lm.MEMBERS), np.float32)
    found = lm.averaged(rows, model, direct, klass, end)
    before = np.array([end, *range(1_499), *range(1_500, 1_539)])  # the last id of a text stands before none
    moved = (found["embed"] != model["embed"]).any(axis=1)
    assert moved[lm.bucket(before)].all() and moved.sum() == len(np.unique(lm.bucket(before)))
    assert np.unique(lm.bucket(np.arange(4_096))).size == 4_096
