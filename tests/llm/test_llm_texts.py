"""Words, hashes and token ids against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pelagia.llm import words as w
from pelagia.llm.tokens import Encoder

PIECES = ["the", " cat", "'s", "é", "ñandú", "  ", "\n", "!!", "12", "…", "　", "\x1c", "'LL", "é", "<|endoftext|>", "日本", "\t\t", "x" * 50, "¼", "µ."]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@given(st.lists(st.text(st.sampled_from("aB é\t\n\x0b.1-日\xa0"), max_size=12), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_and_slices(texts):
    for table, pattern in ((w.NOT_WHITE, r"[^\x20\x09-\x0D]+"), (w.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = []
        for part in w.texts_of(pa.array(texts, pa.string()), limit=10):
            words = w.find_words(part, table)
            cut = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
            found += [cut[a:b] for a, b in zip(words.pointer[:-1], words.pointer[1:])]
        assert found == [re.findall(pattern, lower(t)) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    column = pa.array(["alpha beta alpha", None, "", "x " * 5000 + "beta"])
    hashes = {}
    for part in w.texts_of(column, limit=64):
        words = w.find_words(part, w.NOT_WHITE)
        for a, b, h in zip(words.starts, words.ends, w.hash_spans(words.data, words.starts, words.ends, limit=100)):
            hashes.setdefault(words.data[a:b].tobytes(), set()).add(int(h))
    assert {k: len(v) for k, v in hashes.items()} == {b"alpha": 1, b"beta": 1, b"x": 1}
    assert len(set.union(*hashes.values())) == 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("bits", [4, 21])
def test_encoder_equals_the_library(name, bits):
    encoder = Encoder(public_tokenizers.path(name), bits)  # few places: pieces replace each other, and the table starts anew
    choose = random.Random(5)
    texts = ["", " ", *("".join(choose.choices(PIECES, k=choose.randint(1, 40))) for _ in range(300))]
    found = []
    for part in w.texts_of(pa.array([*texts, None]), limit=500):
        ids, begin = encoder.encode(part)
        found += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
    assert found == [x.ids for x in encoder.library.encode_batch([*texts, ""], add_special_tokens=False)]
