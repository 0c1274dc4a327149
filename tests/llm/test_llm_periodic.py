"""Periodic runs against the definition, on made-up and on given texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pelagia.llm import periodic
from pelagia.llm.queries import op11_periodic_runs
from tests.conftest import SMALL


def runs_brute(words, least=6, power=4):
    """(start, end, period) by comparing every word with the one a period on."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)  # smaller periods come first
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def made_up(rng):
    words = []
    for _ in range(rng.randint(0, 8)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 9))]
        words += unit * rng.randint(1, 9) + unit[:rng.randint(0, len(unit))]
    return words


@pytest.mark.parametrize("least, power", [(6, 4), (7, 4), (9, 5)])
def test_word_runs(least, power):
    rng = random.Random(least)
    for _ in range(400):
        texts = [made_up(rng) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            texts.append(texts[0])
        ids = np.array([w for t in texts for w in t], np.int64)
        pointer = np.cumsum([0, *map(len, texts)])
        text, start, end, period = periodic.word_runs(ids, pointer, 50, least, power)
        found = list(zip(text.tolist(), (start - pointer[text]).tolist(), (end - pointer[text]).tolist(), period.tolist()))
        assert sorted(found) == sorted((i, *r) for i, t in enumerate(texts) for r in runs_brute(t, least, power))


@pytest.mark.parametrize("words", [[0] * 5000, [0, 1, 2] * 3000, [*range(1000)] * 6, [*range(5000)]])
def test_grammars_derive_their_texts_and_are_small_where_texts_repeat(words):
    ids = np.array(words + words[:777], np.int64)
    owner = np.repeat([0, 1], [len(words), 777])
    grammar = periodic.grammar_of(ids, owner, 5000)

    def derived(symbol):
        stack, out = [symbol], []
        while stack:
            s = stack.pop()
            if s < 5000:
                out.append(s)
            else:
                stack += [grammar.right[s], grammar.left[s]]
        return out

    assert [derived(r) for r in grammar.roots] == [words, words[:777]]
    for s in range(5000, len(grammar.left)):
        at, n = grammar.first[s], grammar.length[s]
        assert derived(s) == ids[at:at + n].tolist()
    if len(set(words)) <= 3:
        assert len(grammar.left) - 5000 < 80


def test_a_collision_of_fingerprints_is_seen(monkeypatch):
    """Fingerprints that take everything for equal in the first turn don't change the runs."""
    real = periodic.Fingerprints.repeats
    monkeypatch.setattr(periodic.Fingerprints, "__init__", lambda self, ids, turn, init=periodic.Fingerprints.__init__: (setattr(self, "turn", turn), init(self, ids, turn))[1])
    monkeypatch.setattr(periodic.Fingerprints, "repeats", lambda self, at, period, length: real(self, at, period, length) | (self.turn == 0))
    ids = np.array([1, 2, 1, 2, 1, 2, 1, 2, 3, 4, 1, 2, 5, 1, 2, 6, 1, 2, 1], np.int64)
    text, start, end, period = periodic.word_runs(ids, np.array([0, len(ids)]), 10)
    assert list(zip(start, end, period)) == runs_brute(ids.tolist())


def test_texts_of_all_kinds(spark):
    long = "tick tock " * 150_000  # longer than a slice
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "x x x x x x y"), (5, "x x x x x x y"), (None, "Go go go go go go go\x0bend"),
            (6, long), (7, "é " * 6 + "  z")]
    docs = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, runs string, n_words int")
    found = {(r.doc_id, i): r for i, r in enumerate(sorted(periodic.periodic_runs(docs).collect(), key=repr))}
    by_id = {k[0]: v for k, v in found.items()}
    assert len(found) == len(rows)
    assert (by_id[1].n_words, by_id[1].runs, by_id[1].collapsed) == (0, [], "") == (by_id[3].n_words, by_id[3].runs, by_id[3].collapsed)
    assert by_id[4].collapsed == "a b c"
    assert [tuple(r) for r in by_id[5].runs] == [(0, 6, 1)] and by_id[5].collapsed == "x y"
    assert [tuple(r) for r in by_id[None].runs] == [(1, 6, 1)] and by_id[None].collapsed == "Go go end"
    assert [tuple(r) for r in by_id[6].runs] == [(0, 300_000, 2)] and by_id[6].collapsed == "tick tock"
    assert by_id[7].collapsed == "é   z"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.word_runs(np.arange(9), np.array([0, 9]), 9, power=3)
    with pytest.raises(ValueError):
        periodic.word_runs(np.arange(9), np.array([0, 9]), 9, least=5)


def test_query_against_its_definition(spark):
    for row in op11_periodic_runs(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", row.text or "") if w]
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_brute(words)
        drop = {i for s, e, q in runs for i in range(s + q, e)}
        best = max(((e - s, -s, -q) for s, e, q in runs), default=None)
        assert row.n_runs == len(runs)
        assert (row.length, row.start, row.period, row.exponent_milli) == ((best[0], -best[1], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
