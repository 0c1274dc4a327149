"""Packing and token files: exact round trips and plans against plain counting."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pelagia.cluster import scratch_path
from pelagia.llm import lm, packing, token_files, tokens, words
from pelagia.llm.queries import BYTE_IDS, BYTE_VOCABULARY, WORD_VOCABULARY
from pelagia.llm.tables import arrow
from pelagia.llm.words import texts_of
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, length string, part long, ids string"
ODD = [(9001, None), (9002, ""), (9003, " \n"), (9003, " \n"), (None, "a b"), (9004, "word and word " * 3_000), (-5, "first")]


def rows_of(spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(80).collect()] + ODD
    return found, spark.createDataFrame([(d, t, "x", 1, "y") for d, t in found], SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packed_pieces(spark):
    rows, docs = rows_of(spark)
    library = Tokenizer.from_file(WORD_VOCABULARY)
    wanted = []
    for d, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        wanted += [(d, i // 512, i, len(ids[i:i + 512]), crc(ids[i:i + 512])) for i in range(0, len(ids), 512)]
    found = packing.pack(docs, WORD_VOCABULARY, end=1, capacity=512).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(wanted, key=repr)
    assert all(crc(r.ids) == r.ids_crc32 for r in found)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(sequences) <= 1.05 * -(-sum(r.length for r in found) // 512) + 1


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    choose = random.Random(seed)
    capacity = choose.choice([1, 2, 7, 30, 100])
    counts = {n: choose.choice([1, 2, 3, 50]) for n in choose.sample(range(1, capacity + 1), choose.randint(1, min(12, capacity)))}
    plan = packing.plan_packing(dict(counts), capacity)
    used = collections.defaultdict(list)
    for n, many in counts.items():
        sequence, offset = packing.place(plan.arrays(), np.full(many, n), np.arange(many))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            used[s].append((o, n))
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        place = 0
        for o, n in sorted(parts):
            assert o == place
            place += n
        assert place <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2


def test_large_pieces_are_matched():
    plan = packing.plan_packing({60: 2, 50: 2, 45: 1, 40: 3, 20: 1, 5: 2}, 100)
    assert plan.sequences == 5  # 60+40, 60+40, 50+50, 45+40 with both 5 in its gap, and 20 (415 in all)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bits_at_any_place(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 500).astype(np.uint32)
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == -(-500 * bits // 64) * 8
    for first, count in ((0, 500), (3, 17), (499, 1), (64, 0)):
        assert np.array_equal(token_files.unpack_bits(packed, first, count, bits), ids[first:first + count])


@pytest.mark.parametrize("file_text, block", [(1 << 24, 1 << 18), (40_000, 700)])
def test_token_files_round_trip(spark, monkeypatch, file_text, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    rows, docs = rows_of(spark)
    library = Tokenizer.from_file(BYTE_VOCABULARY)
    texts = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]
    texts.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    wanted, start = [], 0
    for d, ids in texts:
        wanted.append((d, start, len(ids), crc(ids), ids))
        start += len(ids)
    path = scratch_path(spark, "token-files-test")
    token_files.write_token_files(docs, path, BYTE_VOCABULARY, BYTE_IDS, 2, file_text)
    found = token_files.read_token_files(spark, path).collect()
    assert sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, list(r.ids)) for r in found), key=repr) == sorted(((s, d, n, c, i) for d, s, n, c, i in wanted), key=repr)
    files = [token_files.File(bytes(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect() if r.length]
    ids = np.concatenate([x[4] for x in wanted])
    place = 0
    for file in sorted(files, key=lambda f: f.part):
        for first, count in ((0, 1), (file.ids // 2, min(900, file.ids - file.ids // 2)), (file.ids - 1, 1)):
            assert np.array_equal(file.ids_at(first, count), ids[place + first:place + first + count])
        place += file.ids
    assert place == len(ids)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, WORD_VOCABULARY).count() == 0
    assert token_files.round_trip(none, BYTE_VOCABULARY, BYTE_IDS, 2).count() == 0


@pytest.mark.parametrize("vocabulary", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_added_tokens_have_their_own_ids(spark, vocabulary):
    texts = ["one <|endoftext|> two", "<|startoftext|>a<|endoftext|>", "<|endoftext|>", "no <|endof", "text|> either", "<|endoftext|><|endoftext|>b", None]
    library = Tokenizer.from_file(vocabulary)
    wanted = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    packed = packing.pack(docs, vocabulary, end=1, capacity=512).collect()
    assert {r.doc_id: list(r.ids) for r in packed} == dict(enumerate(wanted))
    if vocabulary == BYTE_VOCABULARY:
        found = token_files.round_trip(docs, vocabulary, BYTE_IDS, end=1, with_ids=False).collect()
        starts = np.cumsum([0, *map(len, wanted)])
        assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == [(i, starts[i], len(w), crc(w)) for i, w in enumerate(wanted)]


def encoders_held(rows, **how):
    """Whether a worker comes to a step with encoders of earlier ones."""
    def work(batches):
        import sys
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["_pelagia_encoders" in sys.modules] * len(batch))], names=["held"])

    return any(arrow(rows.select("text"), work, "held boolean", **how).collect()[0].held for _ in range(12))  # idle workers take turns


def test_encoders_stay_for_steps_that_encode_only(spark):
    """A worker that encoded for one step doesn't carry its tables through the others."""
    rows = spark.createDataFrame([(1, "some words", 1, False)], "doc_id long, text string, digest long, held_out boolean").coalesce(1)

    def after_encoding(**how):
        lm.id_rows(rows, BYTE_VOCABULARY, BYTE_IDS - 1).collect()
        return encoders_held(rows, **how)

    assert after_encoding(encodes=True)
    assert not after_encoding()
    assert not after_encoding(tidy=True)


def test_placing_drops_the_encoders_of_the_pieces(spark):
    rows = spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1)
    packed = packing.pack(rows, WORD_VOCABULARY)
    assert [len(packed.collect()) for _ in range(12)] == [1] * 12
    assert not encoders_held(rows, encodes=True)


@pytest.mark.parametrize("vocabulary", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_the_library_gets_few_pieces_at_a_time(monkeypatch, vocabulary):
    found = ["Many words, 7 and 77;\nit's 3 %% signs " + " ".join(f"w{i}x{i * i}" for i in range(k, k + 60)) for k in range(0, 90, 30)] + ["", "7 7\n7"]
    library, sizes = Tokenizer.from_file(vocabulary), []
    whole = tokens.Encoder.whole
    monkeypatch.setattr(tokens, "PIECES", 8)
    encoder = tokens.Encoder(vocabulary, bits=12)
    monkeypatch.setattr(tokens.Encoder, "whole", lambda self, texts: sizes.append(max(len(t) for t in texts) if texts else 0) or whole(self, texts))
    for _ in range(2):
        for texts in texts_of(pa.array(found)):
            ids, begin = encoder.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [library.encode(t, add_special_tokens=False).ids for t in found]
    assert max(sizes) < 100  # eight short pieces; all of them have over a thousand characters


def test_long_texts_are_hashed_with_short_tables(monkeypatch):
    monkeypatch.setattr(words, "_POWERS", {})
    texts = next(texts_of(pa.array([" ".join(f"word{i}" for i in range(80_000))])))
    found = words.find_words(texts, words.NOT_WHITE)
    hashes = found.hashes()
    assert max(len(up) for up, _ in words._POWERS.values()) <= 1 << 18 < len(texts.data)
    assert np.array_equal(hashes, words.hash_spans(found.data, found.starts, found.ends, limit=len(texts.data)))
