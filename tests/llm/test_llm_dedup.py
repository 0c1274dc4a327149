"""Exact groups, similarity classes and decontamination against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.llm import decontaminate, exact_dedup, minhash, parity_join, tables
from pelagia.llm.components import components
from pelagia.sources.storage import exists
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, digest string, key long, first int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def with_odd_rows(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "x", 1, 2) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "a b"), (9005, "A  B"), (9005, "A  B"), (None, "a b"), (9006, "word " * 30_000)]


# -- exact -------------------------------------------------------------------------------------

def exact_brute(rows, longest):
    groups = collections.defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    out = []
    for bare, members in groups.items():
        order = sorted(members, key=lambda i: (-len(rows[i][1] or "") if longest else 0, rows[i][0] is None, rows[i][0] or 0))
        for i in members:
            out.append((rows[i][0], rows[order[0]][0], len(members), i == order[0], hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, documents, longest, weak):
    rows = documents[:60] + ODD
    digest = (lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)) if weak else exact_dedup.content_hash
    found = exact_dedup.exact_groups(with_odd_rows(spark, rows), longest, digest).drop("chars").collect()
    assert sorted(map(tuple, found), key=repr) == exact_brute(rows, longest)


def test_keep_one_keeps_all_columns_and_one_row_a_group(spark, documents):
    rows = documents + ODD
    kept = exact_dedup.keep_one(with_odd_rows(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "digest", "key", "first"]
    bare = [re.sub(r"\s", "", r.text or "") for r in kept.collect()]
    assert sorted(bare) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})


def test_empty_tables(spark):
    none = with_odd_rows(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.keep_one(none).count() == 0
    assert parity_join.similarity_classes(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    one = with_odd_rows(spark, [(1, "a b c")])
    assert [r.items for r in decontaminate.contamination(one, items).collect()] == [[]]


# -- similarity --------------------------------------------------------------------------------

def similar_brute(rows, n, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)] += [d] if d is not None else []
    return sorted(((d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def chain(base, steps, change):
    """Texts of which each is like the next, but the ends aren't like each other."""
    words = [f"w{base}x{i}" for i in range(120)]
    out = []
    for i in range(steps):
        words = words.copy()
        for j in range(change):
            words[(i * change + j) * 7 % len(words)] = f"new{base}x{i}x{j}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 70), (3, 60), (1, 50)])
def test_similarity_classes(spark, documents, n, percent):
    rows = documents[:80] + ODD[:6] + [(100 + i, t) for i, t in enumerate(chain(1, 12, 1) + chain(2, 12, 2) + chain(3, 5, 3))]
    rows += [(300 + i, " ".join(f"s{k}" for k in range(i))) for i in range(8, 24)]  # sizes around a band's end
    found = parity_join.similarity_classes(with_odd_rows(spark, rows), n, percent).collect()
    wanted = similar_brute(rows, n, percent)
    assert sorted(map(tuple, found), key=repr) == wanted
    assert len({w[2] for w in wanted}) < len(rows)


def test_bands_share_enough_blocks():
    for percent in (80, 90):
        for a in range(1, 400):
            for b in range(a, a * 100 // percent + 1):
                most = parity_join.differences(a + b, percent)
                shared = set(parity_join.bands(a, percent)) & set(parity_join.bands(b, percent))
                assert not most or any(spare is None or blocks - spare > most for _, blocks, spare in shared), (a, b)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_block_and_few_seeds_are_needed(percent):
    random = np.random.default_rng(percent)
    for size in (9, 12, 40, 150, 700, 3000):
        made = planned = 0
        for _ in range(20):
            tokens = np.unique(random.integers(0, 1 << 63, size).astype(np.uint64))
            changed = parity_join.differences(2 * size, percent) // 2
            other = np.unique(np.concatenate([tokens[changed:], random.integers(0, 1 << 63, changed).astype(np.uint64)]))
            one, two = (parity_join.block_keys(t, percent) for t in (tokens, other))
            assert set(one.tolist()) & set(two.tolist()) or np.array_equal(tokens, other)
            made += len(one)
            planned += sum(blocks for _, blocks, _ in parity_join.bands(len(tokens), percent))
        assert made <= 1.5 * planned  # over 20 sets of a size


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, documents, n, percent):
    rows = documents[:120] + ODD + [(100_000 + i, t) for i, t in enumerate(chain(1, 12, 1) + chain(2, 12, 2) + chain(3, 5, 3))]
    rows += [(300_000 + i, " ".join(f"s{k}" for k in range(i))) for i in range(1, 24)]
    found = minhash.near_duplicates(with_odd_rows(spark, rows), n, percent).collect()
    wanted = similar_brute(rows, n, percent)
    assert sorted((tuple(r)[:3] for r in found), key=repr) == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert minhash.near_duplicates(with_odd_rows(spark, [])).count() == 0


def test_short_keys_collide_as_often_as_sets_are_similar():
    random = np.random.default_rng(3)
    sets = []
    for _ in range(300):  # pairs of similarity one half
        tokens = random.integers(0, 1 << 63, 150).astype(np.uint64)
        sets += [np.sort(tokens[:100]), np.sort(tokens[50:])]
    keys = np.array(minhash.short_keys(sets, 8, 1))
    assert keys.shape == (600, 16)
    assert abs((keys[::2] == keys[1::2]).mean() - 1 / 3) < 0.03
    pairs = (keys[::2, :8] == keys[1::2, :8]).any(axis=1) & (keys[::2, 8:] == keys[1::2, 8:]).any(axis=1)
    assert abs(pairs.mean() - (1 - (2 / 3) ** 8) ** 2) < 0.06
    assert (keys[0, None] != keys[0][:, None]).sum() == 16 * 15


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 90])
def test_similar_sets_of_every_small_size_share_a_key(percent):
    random = np.random.default_rng(percent)
    for size in range(1, 31):
        for _ in range(40):
            tokens = np.unique(random.integers(0, 1 << 63, size).astype(np.uint64))
            gone, new = random.integers(0, size), random.integers(0, size + 1)
            other = np.unique(np.concatenate([tokens[gone:], random.integers(0, 1 << 63, new).astype(np.uint64)]))
            if parity_join.similar(tokens, other, percent) and not np.array_equal(tokens, other):
                one, two = (parity_join.block_keys(t, percent) for t in (tokens, other))
                assert set(one.tolist()) & set(two.tolist()), (size, gone, new)


def test_wide_blocks_are_cut_and_lose_no_link(spark):
    """Two hundred texts share a passage and nothing else; a few pairs among them are alike."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + f" more{i}") for i in range(0, 200, 20)]
    docs = with_odd_rows(spark, rows).select("doc_id", "text")
    sets, classes, seed = parity_join.set_classes(docs, 1, lambda found: [parity_join.block_keys(s, 90) for s in found])
    one_block = sets.select(F.lit(1).cast("long").alias("key"), "a").distinct()
    vertices = sets.select("a", F.col("doc_id").alias("first"), "size", "fold")
    texts = parity_join.texts_for(docs, vertices, 1, seed)
    nothing = spark.createDataFrame([], "node long, label long")
    ids = {r.a: r.doc_id for r in sets.collect()}
    for wide in (10, 10_000):
        pairs = parity_join.cross_pairs(one_block, nothing, vertices, texts, 1, 90, wide)
        found = parity_join.verified(pairs, vertices, texts, 1, 90, best=False).collect()
        assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in found} == {(i, 1000 + i) for i in range(0, 200, 20)}
    assert parity_join.cut_by_prefix(one_block.withColumn("label", F.col("a")).withColumn("n", F.lit(210)), texts, 1, 90).select("a").distinct().count() < 60


def test_keys_are_grouped_in_slices(spark, monkeypatch):
    """No grouping shuffles all keys at once, and what it leaves open to send is a part of the keys."""
    rows = spark.range(4000).select(F.xxhash64(F.col("id") % 1000).alias("key"), F.col("id").alias("a"))
    labels = spark.range(0, 4000, 2).select(F.col("id").alias("node"), (F.col("id") % 1000).alias("label"))
    sizes = []

    def noted(frame, label):
        if label == "open-keys":
            sizes.append(frame.count())
        return frame.localCheckpoint()
    monkeypatch.setattr(parity_join, "stored", noted)
    found = parity_join.open_in_slices(rows.unionByName(rows), labels)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, parity_join.open_members(rows, labels).collect()))
    assert len(sizes[:-1]) == parity_join.SLICES and max(sizes[:-1]) < 0.4 * sizes[-1]


def test_large_sketches_and_texts_are_not_broadcast(spark):
    rows = [(i, " ".join(f"t{i // 2}x{j}" for j in range(60)) + i % 2 * " more") for i in range(60)]
    docs = with_odd_rows(spark, rows).select("doc_id", "text")
    sets, _, seed = parity_join.set_classes(docs, 1, lambda found: [parity_join.block_keys(s, 90) for s in found])
    vertices = sets.select("a", F.col("doc_id").alias("first"), "size", "fold")
    texts = parity_join.texts_for(docs, vertices, 1, seed)
    ids = {r.a: r.doc_id for r in sets.collect()}
    pairs = vertices.select("a").crossJoin(vertices.select(F.col("a").alias("b"))).where("a < b")
    for payload in (0, parity_join.PAYLOAD_BYTES):
        one, two = parity_join.sketch_sides(vertices, payload)
        plan = one.join(two, F.col("id_a") == F.col("id_b"))._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (payload > 0)
        found = parity_join.verified(pairs, vertices, texts, 1, 90, best=False, payload=payload).collect()
        assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in found} == {(i, i + 1) for i in range(0, 60, 2)}
        best = parity_join.verified(pairs, vertices, texts, 1, 90, best=True, payload=payload).collect()
        assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in best} == {(i, i + 1) for i in range(0, 60, 2)}


def test_one_row_of_each_component_stays(spark):
    """Ids that are null, repeated, or of two different texts."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (2, "something else that is long enough to have its own shingles"), (None, base + " y"), (None, "null id alone with seven words here"),
            (3, "twice the same row of six words"), (3, "twice the same row of six words"), (4, None), (4, ""), (4, "")]
    kept = parity_join.keep_one(with_odd_rows(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "digest", "key", "first"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5], *rows[7:]], key=repr)
    assert parity_join.keep_one(with_odd_rows(spark, [])).count() == 0
    alone = parity_join.keep_one(with_odd_rows(spark, [(None, base), (None, base + " z")]))
    assert alone.count() == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 199: 199, 200: 199}


# -- decontamination ---------------------------------------------------------------------------

def hits_brute(documents, items):
    def cut(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = collections.defaultdict(set)
    for name, text in items:
        words = cut(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i:i + n])].add(str(name))
    out = []
    for d, text in documents:
        words, hit, names = cut(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(words[i:i + n])]
        out.append((d, len(words), len(hit), sorted(names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars", [4_000_000, 3_000])
def test_contamination(spark, documents, chars):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(1000, "In In"), (1001, "the"), (1002, None), (1003, "a b c d e f g h i j a b c d e f g h i j k"), (1004, "x " * 16), items[7]]
    rows = documents[:120] + ODD + [(5000, "z A b c d e f g h i j a l"), (5001, "x " * 40), (5003, f"and {items[3][1]}, so"), (5003, f"and {items[3][1]}, so")]
    docs, bench = with_odd_rows(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench, chars).withColumn("n", decontaminate.hit_words(F.col("starts"), F.col("ends")))
    assert sorted(((r.doc_id, r.n_words, r.n, list(r["items"])) for r in found.collect()), key=repr) == hits_brute(rows, items)
    clean = decontaminate.without_hits(docs, bench, chars)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((w[0] for w in hits_brute(rows, items) if not w[2]), key=repr)


def test_the_join_leaves_no_steps_behind(spark, monkeypatch):
    """What nothing reads any more is removed, and what the result reads stays."""
    rows = [(i, " ".join(f"t{i // 3}x{j}" for j in range(60)) + i % 3 * " more") for i in range(60)]
    written, path = [], tables.scratch_path
    monkeypatch.setattr(tables, "scratch_path", lambda spark, label: (written.append(path(spark, label)), written[-1])[1])
    kept = parity_join.keep_one(with_odd_rows(spark, rows))
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in written if exists(spark, p)]
    assert len(written) > 20 and left == ["row-kinds"]
    assert {r.doc_id for r in kept.collect()} == set(range(0, 60, 3))


def test_blocks_meet_in_slices(spark, monkeypatch):
    """Blocks beyond the limit are worked on in slices, which give the pairs that all at once give."""
    rows = [(i, " ".join(f"t{i % 40}x{j}" for j in range(60)) + " one two"[:i // 40 * 4]) for i in range(120)]
    docs = with_odd_rows(spark, rows).select("doc_id", "text")
    sets, _, seed = parity_join.set_classes(docs, 1, lambda found: [parity_join.block_keys(s, 90) for s in found])
    vertices = sets.select("a", F.col("doc_id").alias("first"), "size", "fold")
    texts = parity_join.texts_for(docs, vertices, 1, seed)
    members = sets.select(F.explode("keys").alias("key"), "a").distinct()
    nothing = spark.createDataFrame([], "node long, label long")
    labels, stored = [], parity_join.stored
    monkeypatch.setattr(parity_join, "stored", lambda frame, label: (labels.append(label), stored(frame, label))[1])
    one, many = (sorted(map(tuple, parity_join.cross_pairs(members, nothing, vertices, texts, 1, 90, limit=limit).collect())) for limit in (1 << 30, 0))
    assert one == many and len(one) >= 120
    assert labels.count("block-pairs") == parity_join.SLICES
