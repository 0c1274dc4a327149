"""Periodic runs of words, found on a grammar of the texts.

Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch with smallest period q, of at least
``max(least, power * q)`` words (``power`` is 4 at least, ``least`` 6), that no neighbouring word extends keeping period q.

**Re-Pair.** The texts of a slice share one grammar. In rounds, pairs of neighbouring symbols of one text are counted without
overlaps; every occurrence whose pair is more frequent than both pairs that overlap it becomes a new nonterminal, until no
pair repeats. A pair that is alone stays alone until a symbol beside it changes, so later rounds count only what can still
repeat. What is left of each text is paired up in halves, so that one symbol derives it.

**Boundaries.** A run lies across the boundary of exactly one nonterminal of the derivation that holds it whole. For each
nonterminal X = AB, once, at the place of its first occurrence: one side holds two periods or more, so the two words
beside the boundary come again one period away. These places are the candidates, at most |X| / ``power`` away; those whose period repeats
(by fingerprints) are extended both ways inside X. Long repetitive texts have few nonterminals, others few candidates.

**Translation.** From the root of each text downwards, nonterminals that hold runs are followed to all their places, and the
runs are moved there. Pieces of one period that overlap by a period or more are one run: they were cut by the ends of a smaller nonterminal.

Fingerprints are modulo two primes. Every interval found is compared on the word ids themselves; a collision would be seen there, and the slice
is done again with other bases. Different words are told apart by 64-bit hashes.

Null and empty texts have no words, no runs, and an empty collapsed text. Repeated rows and null ids are scanned like
others, an empty table gives no rows, extra columns are ignored. Memory follows one slice, or one longer text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.tables import arrow
from pelagia.llm.words import NOT_WHITE, Texts, Words, find_words, mixed, texts_of

#: Candidates looked at together.
CHUNK = 1 << 20
PRIMES = (np.uint64(2**31 - 1), np.uint64(2**31 - 19))


@dataclass
class Grammar:
    """Symbols below ``words`` are words; the others derive ``left`` and ``right`` (both indexed by symbol)."""

    words: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    first: np.ndarray  # where a symbol's first occurrence begins
    rounds: list[tuple[int, int]]  # symbols made together; their parts come from earlier rounds
    roots: np.ndarray  # one symbol for each text with words


class _Builder:
    def __init__(self, ids: np.ndarray, owner: np.ndarray, words: int) -> None:
        self.seq, self.owner, self.at = ids.astype(np.int64), owner, np.arange(len(ids))
        self.words, self.made = words, words
        size = words + 2 * len(ids)
        self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.length, self.first = np.ones(size, np.int64), np.zeros(size, np.int64)
        self.rounds: list[tuple[int, int]] = []

    def replace(self, places: np.ndarray, heads: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Make one symbol for each of ``heads``; the pairs at ``places`` become the symbol of their group."""
        low, high = self.made, self.made + len(heads)
        self.left[low:high], self.right[low:high] = self.seq[heads], self.seq[heads + 1]
        self.length[low:high] = self.length[self.seq[heads]] + self.length[self.seq[heads + 1]]
        self.first[low:high] = self.at[heads]
        self.rounds.append((low, high))
        self.made = high
        self.seq[places] = low + group
        stay = np.ones(len(self.seq), bool)
        stay[places + 1] = False
        self.seq, self.at, self.owner = self.seq[stay], self.at[stay], self.owner[stay]
        return stay

    def repair(self) -> None:
        live = np.ones(len(self.seq), bool)
        span = np.int64(len(self.left))
        while len(self.seq) > 1:
            seq, n = self.seq, len(self.seq)
            pair = np.flatnonzero(live[:-1] & (self.owner[:-1] == self.owner[1:]))
            a, b = seq[pair], seq[pair + 1]
            twin = a == b
            if twin.any():  # in a stretch of one symbol, every second pair
                starts = np.flatnonzero(np.concatenate([[True], (seq[1:] != seq[:-1]) | (self.owner[1:] != self.owner[:-1])]))
                inside = pair - starts[np.searchsorted(starts, pair, side="right") - 1]
                keep = ~twin | (inside % 2 == 0)
                pair, a, b = pair[keep], a[keep], b[keep]
            key = a * span + b
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.diff(key[order], prepend=np.int64(-1)))
            counts = np.diff(np.append(heads, len(order)))
            often = counts > 1
            if not often.any():
                break
            rank_of = np.full(len(counts), -1, np.int64)
            rank_of[np.argsort(counts, kind="stable")] = np.arange(len(counts))
            rank_of[~often] = -1
            group = np.empty(len(order), np.int64)
            group[order] = np.repeat(np.arange(len(counts)), counts)
            rank = np.full(n + 1, -1, np.int64)
            rank[pair] = rank_of[group]
            live[:] = False
            live[pair[often[group]]] = True
            mine = rank[pair]
            best = (mine > rank[pair - 1]) & (mine > rank[pair + 1])  # rank[-1] is the spare entry
            taken = np.bincount(group[best], minlength=len(counts)) > 1
            chosen = best & taken[group]
            places = pair[chosen]
            names = np.cumsum(taken) - 1
            of_place = names[group[chosen]]
            first = np.full(int(taken.sum()), n, np.int64)
            np.minimum.at(first, of_place, places)
            live[places] = True
            live[places[places > 0] - 1] = True
            live = live[self.replace(places, first, of_place)]

    def halve(self) -> np.ndarray:
        """Pair up what is left of each text until one symbol derives it."""
        while True:
            starts = np.flatnonzero(np.diff(self.owner, prepend=-1))
            inside = np.arange(len(self.seq)) - np.repeat(starts, np.diff(np.append(starts, len(self.seq))))
            places = np.flatnonzero((inside[:-1] % 2 == 0) & (self.owner[:-1] == self.owner[1:]))
            if not len(places):
                return self.seq
            self.replace(places, places, np.arange(len(places)))


def grammar_of(ids: np.ndarray, owner: np.ndarray, words: int) -> Grammar:
    """A grammar of several texts: ``ids`` end to end, ``owner`` the text of each, in order."""
    make = _Builder(ids, owner, words)
    make.repair()
    roots = make.halve()
    n = make.made
    return Grammar(words, make.left[:n], make.right[:n], make.length[:n], make.first[:n], make.rounds, roots)


class Fingerprints:
    """Tells whether stretches of word ids are equal, by two prefix sums modulo primes."""

    def __init__(self, ids: np.ndarray, turn: int) -> None:
        self.sums, self.powers = [], []
        for k, p in enumerate(PRIMES):
            base = mixed(np.array([2 * turn + k + 1], np.uint64))[0] % (p - np.uint64(1000)) + np.uint64(500)
            power = np.ones(len(ids) + 1, np.uint64)
            done = 1
            while done < len(power):
                more = min(done, len(power) - done)
                power[done:done + more] = power[:more] * (power[done - 1] * base % p) % p
                done += more
            value = mixed(ids.astype(np.uint64) + np.uint64(turn << 40)) % p
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(value * power[:-1] % p, out=sums[1:])
            self.sums.append(sums % p)
            self.powers.append(power)

    def repeats(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words at ``at`` come again ``period`` words on."""
        same = np.ones(len(at), bool)
        for p, sums, powers in zip(PRIMES, self.sums, self.powers):
            one = (sums[at + length] + p - sums[at]) % p * powers[period] % p
            same &= one == (sums[at + period + length] + p - sums[at + period]) % p
        return same

    def forward(self, at: np.ndarray, period: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The greatest length up to ``most`` for which ``repeats`` holds."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.repeats(at, period, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def backward(self, at: np.ndarray, period: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before ``at``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.repeats(at - middle, period, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every unit of ``counts``: its row, and its number within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def boundary_runs(grammar: Grammar, ids: np.ndarray, prints: Fingerprints, least: int, power: int):
    """(symbol, start, end, period) of the runs across each nonterminal's boundary, at its first occurrence."""
    none = np.zeros(0, np.int64)
    symbol = np.flatnonzero(grammar.length >= least)
    if not len(symbol):
        return none, none, none, none
    low = grammar.first[symbol]
    middle, high = low + grammar.length[grammar.left[symbol]], low + grammar.length[symbol]
    n = len(ids)
    pairs = ids[:-1].astype(np.int64) * grammar.words + ids[1:]
    order = np.argsort(pairs, kind="stable")
    group = np.empty(n - 1, np.int64)
    group[order] = np.cumsum(np.diff(pairs[order], prepend=np.int64(-1)) != 0)
    place = np.empty(n - 1, np.int64)
    place[order] = np.arange(n - 1)
    listed = group[order] * (n + 1) + order  # ascending

    out = []
    for side in ("right", "left"):
        room = high - middle if side == "right" else middle - low
        use = np.flatnonzero((room >= 2) & (middle < n) & (high - low >= power))
        most = np.minimum((high - low)[use] // power, room[use] // 2)
        at = middle[use] if side == "right" else middle[use] - 2
        use, most, at = use[at < n - 1], most[at < n - 1], at[at < n - 1]
        if side == "right":
            begin, end = place[at] + 1, np.searchsorted(listed, group[at] * (n + 1) + at + most, side="right")
        else:
            begin, end = np.searchsorted(listed, group[at] * (n + 1) + np.maximum(at - most, 0), side="left"), place[at]
        counts = end - begin
        some = np.flatnonzero(counts > 0)
        use, at, begin, counts = use[some], at[some], begin[some], counts[some]
        cuts = np.searchsorted(np.cumsum(counts), np.arange(CHUNK, int(counts.sum()) + CHUNK, CHUNK), side="left") + 1
        for a, b in itertools.pairwise([0, *np.unique(np.minimum(cuts, len(counts))).tolist()]):
            row, step = _spread(counts[a:b])
            x = use[a:b][row]
            period = np.abs(order[begin[a:b][row] + step] - at[a:b][row])
            square = middle[x] if side == "right" else middle[x] - 2 * period
            fits = prints.repeats(square, period, period)
            x, period = x[fits], period[fits]
            centre = middle[x] if side == "right" else middle[x] - period
            end_ = centre + period + prints.forward(centre, period, high[x] - period - centre)
            start = centre - prints.backward(centre, period, centre - low[x])
            whole = (end_ - start >= np.maximum(least, power * period)) & (start < middle[x]) & (end_ > middle[x])
            out.append((symbol[x[whole]], start[whole], end_[whole], period[whole]))
    found = [np.concatenate(c) for c in zip(*out)] if out else [none] * 4
    # One interval found with several periods has the smallest; it was also found from both sides.
    order = np.lexsort((found[3], found[2], found[1], found[0]))
    found = [c[order] for c in found]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(found[0]) != 0) | (np.diff(found[1]) != 0) | (np.diff(found[2]) != 0)
    return tuple(c[new] for c in found)


def translated(grammar: Grammar, starts: np.ndarray, found):
    """(text, start, end, period) of the runs at all places where the derivations have their nonterminals."""
    symbol, low, high, period = found
    own = np.bincount(symbol, minlength=len(grammar.left))
    own_first = np.cumsum(own) - own
    holds = own > 0
    for a, b in grammar.rounds:
        holds[a:b] |= holds[grammar.left[a:b]] | holds[grammar.right[a:b]]
    text = np.flatnonzero(holds[grammar.roots])
    at, node = starts[text], grammar.roots[text].astype(np.int64)
    out = []
    while len(node):
        here = own[node] > 0
        row, step = _spread(own[node[here]])
        run = own_first[node[here]][row] + step
        shift = (at[here] - grammar.first[node[here]])[row]
        out.append((text[here][row], low[run] + shift, high[run] + shift, period[run]))
        left, right = grammar.left[node].astype(np.int64), grammar.right[node].astype(np.int64)
        at = np.concatenate([at, at + grammar.length[left]])
        text, node = np.concatenate([text, text]), np.concatenate([left, right])
        more = holds[node]
        at, text, node = at[more], text[more], node[more]
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def merged(text, start, end, period):
    """Pieces of one text and period that overlap by a period or more become one; in order of text, start and period."""
    order = np.lexsort((-end, start, period, text))
    text, start, end, period = text[order], start[order], end[order], period[order]
    if not len(text):
        return text, start, end, period
    other = np.ones(len(text), bool)
    other[1:] = (np.diff(text) != 0) | (np.diff(period) != 0)
    lift = np.cumsum(other) * (int(end.max()) + 1)  # keeps the running maximum inside its text and period
    reach = np.maximum.accumulate(end + lift) - lift
    new = other.copy()
    new[1:] |= start[1:] + period[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    text, start, period = text[heads], start[heads], period[heads]
    end = reach[np.append(heads[1:], len(new)) - 1]
    order = np.lexsort((period, start, text))
    return text[order], start[order], end[order], period[order]


def word_runs(ids: np.ndarray, pointer: np.ndarray, words: int, least: int = 6, power: int = 4):
    """(text, start, end, period) of all runs of several texts, places counted over all words of the slice."""
    if power < 4 or least < 6:
        raise ValueError("runs of fewer than four periods or six words need not repeat beside a boundary")
    texts = np.flatnonzero(np.diff(pointer))
    if not len(texts) or len(ids) < 2:
        return [np.zeros(0, np.int64)] * 4
    owner = np.repeat(np.arange(len(texts)), np.diff(pointer)[texts])
    grammar = grammar_of(ids, owner, words)
    for turn in itertools.count():
        found = boundary_runs(grammar, ids, Fingerprints(ids, turn), least, power)
        if all(np.array_equal(ids[s:e - q], ids[s + q:e]) for s, e, q in zip(*(c.tolist() for c in found[1:]))):
            break
    text, start, end, period = merged(*translated(grammar, pointer[texts], found))
    return texts[text], start, end, period


def collapsed(texts: Texts, words: Words, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with the words that stay joined by one space, and where each text begins."""
    data = texts.data.copy()
    keep = np.zeros(len(data) + 1, np.int8)
    stay = np.flatnonzero(~drop)
    owner = np.searchsorted(words.pointer, stay, side="right") - 1
    ends = words.ends[stay].copy()
    follow = np.flatnonzero(owner[:-1] == owner[1:]) if len(stay) else stay
    data[ends[follow]] = 0x20
    ends[follow] += 1
    np.add.at(keep, words.starts[stay], 1)
    np.add.at(keep, ends, -1)
    mask = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sizes[1:])
    return data[mask], sizes[texts.offsets]


def periodic_runs(docs: DataFrame, least: int = 6, power: int = 4) -> DataFrame:
    """One row per document: doc_id, n_words, its runs by start and period, and the text without what repeats.

    A word is left out of ``collapsed`` if any run holds it after its first period.
    """
    def work(batches):
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            names = batch.column("doc_id")
            for texts in texts_of(batch.column("text")):
                words = find_words(texts, NOT_WHITE, lower=False)
                known, ids = np.unique(words.hashes(), return_inverse=True)
                text, start, end, period = word_runs(ids, words.pointer, len(known), least, power)
                cover = np.zeros(len(ids) + 1, np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, end, -1)
                data, offsets = collapsed(texts, words, np.cumsum(cover[:-1]) > 0)
                rows = pa.StructArray.from_arrays([pa.array(start - words.pointer[text]), pa.array(end - start), pa.array(period)], fields=list(run))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)), rows)
                kept = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
                yield pa.RecordBatch.from_arrays([names.slice(texts.first, len(texts)), pa.array(words.counts()), lists, kept.cast(pa.string())],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)
