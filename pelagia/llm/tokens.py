"""Token ids of whole texts by the tokenizers library, with repeated pieces of text encoded once.

Both vocabularies split a text before white space that follows other characters, and between
letters, digits and signs (but for an apostrophe before letters), whatever stands around, so that
the ids of a text are those of its pieces one after another. Texts with white space outside ASCII, which the split patterns join to its neighbours, or
with the control characters U+001C to U+001F go through the library whole, and so do texts that hold the literal of an added token such as
``<|endoftext|>``, which the library gives an id of its own.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
from tokenizers import Tokenizer

from pelagia.llm.tables import ENCODERS
from pelagia.llm.words import BASE_2, WHITE, Texts, byte_class, hash_spans

#: Pieces that the library gets at once; its encodings take some hundred bytes for each byte of text.
PIECES = 1 << 14

_MAYBE_ODD = byte_class(*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3)

# Kinds of bytes, and between which two kinds a piece ends. Bytes of other than these characters
# (OTHER) never end or begin a piece, except that white space begins one.
OTHER, LETTER, DIGIT, SIGN, APOSTROPHE, SPACE = range(6)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[0x27] = APOSTROPHE
KIND[WHITE] = SPACE
CUTS = np.zeros(64, dtype=bool)
for _left in (LETTER, DIGIT, SIGN):
    for _right in (LETTER, DIGIT, SIGN, APOSTROPHE):
        CUTS[_left * 8 + _right] = _left != _right and (_left, _right) != (SIGN, APOSTROPHE)
for _left in (OTHER, LETTER, DIGIT, SIGN, APOSTROPHE):
    CUTS[_left * 8 + SPACE] = True


def with_odd_white(texts: Texts) -> np.ndarray:
    """Which texts hold white space that isn't ASCII, or U+001C to U+001F."""
    at = np.flatnonzero(_MAYBE_ODD[texts.data])
    odd = np.zeros(len(texts), dtype=bool)
    if len(at):
        padded = np.concatenate([texts.data, np.zeros(2, np.uint8)])
        a, b, c = padded[at], padded[at + 1], padded[at + 2]
        found = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        found |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        found |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd[np.searchsorted(texts.offsets, at[found], side="right") - 1] = True
    return odd


class Encoder:
    """Encodes slices of texts. Ids of pieces are remembered in a table of 2 ** ``bits`` places, where
    a newer piece replaces an older one; pieces are told apart by two hashes."""

    def __init__(self, path: str, bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.literals = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.shift = np.uint64(64 - bits)
        self.mark = self._mark()
        self._forget()

    def _forget(self) -> None:
        places = 1 << (64 - int(self.shift))
        self.keys, self.checks = np.zeros(places, np.uint64), np.zeros(places, np.uint64)
        self.starts, self.sizes = np.zeros(places, np.int32), np.zeros(places, np.int32)
        self.flat, self.used = np.zeros(places * 4, np.uint32), 0

    def _mark(self) -> tuple[str, int] | None:
        """A character that stands for itself between any two pieces without it, and its id."""
        for sign in ("\n", "7"):
            alone = self.whole([sign])[0]
            if len(alone) == 1 and all(np.array_equal(self.whole([f"{a}{sign}{b}"])[0],
                                                      np.concatenate([*self.whole([a]), alone, *self.whole([b])]))
                                       for a in (" a", "b", ".") for b in (" a", "b", ".", " (")):
                return sign, int(alone[0])
        return None

    def with_literals(self, texts: Texts) -> np.ndarray:
        """Which texts hold the literal of an added token."""
        found = np.zeros(len(texts), dtype=bool)
        raw = texts.data.tobytes()
        for literal in self.literals:
            at = raw.find(literal)
            while at >= 0:
                found[np.searchsorted(texts.offsets, at, side="right") - 1] = True
                at = raw.find(literal, at + 1)
        return found

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and each piece's number of ids; the library works on a few pieces at a time."""
        found = [self._together(pieces[i:i + PIECES]) for i in range(0, len(pieces), PIECES)]
        return tuple(np.concatenate(part) for part in zip(*found))

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None:
            return self._apart(pieces)
        sign, mark = self.mark
        plain = np.fromiter((sign not in p for p in pieces), bool, len(pieces))
        joined = self.whole([sign.join([p for p, ok in zip(pieces, plain) if ok])])[0] if plain.any() else np.zeros(0, np.uint32)
        at = np.flatnonzero(joined == mark)
        if len(at) != max(0, int(plain.sum()) - 1):
            return self._apart(pieces)
        inner = np.diff(np.concatenate([[-1], at, [len(joined)]])) - 1 if plain.any() else np.zeros(0, np.int64)
        joined = joined[joined != mark]
        if plain.all():
            return joined, inner
        rest, rest_sizes = self._apart([p for p, ok in zip(pieces, plain) if not ok])
        sizes = np.empty(len(pieces), np.int64)
        sizes[plain], sizes[~plain] = inner, rest_sizes
        ids, of_plain = np.empty(int(sizes.sum()), np.uint32), np.repeat(plain, sizes)
        ids[of_plain], ids[~of_plain] = joined, rest
        return ids, sizes

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.uint32), sizes

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the place of each text's first id (one entry more than texts)."""
        odd = with_odd_white(texts) | self.with_literals(texts)
        n, data = len(texts), texts.data
        starts, ends, owner = self._pieces(texts)
        first, second = hash_spans(data, starts, ends), hash_spans(data, starts, ends, BASE_2)
        place = first >> self.shift
        known = (self.keys[place] == first) & (self.checks[place] == second) & (self.sizes[place] >= 0)
        known &= self.keys[place] != 0
        begin, size = self.starts[place].astype(np.int64), self.sizes[place].astype(np.int64)
        missed = np.flatnonzero(~known)
        if len(missed):
            keys, at, back = np.unique(first[missed], return_index=True, return_inverse=True)
            at = missed[at]
            unlike = missed[second[at][back] != second[missed]]
            odd[owner[unlike]] = True  # two pieces share a hash
            ids, sizes = self._encode([data[a:b].tobytes().decode("utf-8", "replace")
                                       for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            if self.used + len(ids) > len(self.flat):
                begin, size, known = self._restart(first, second, starts, ends, data, begin, size, known, ids)
            where = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            begin[missed], size[missed] = where[back], sizes[back]
            spot = keys >> self.shift
            self.keys[spot], self.checks[spot] = keys, second[at]
            self.starts[spot], self.sizes[spot] = where, sizes
        if odd.any():
            size = np.where(odd[owner], 0, size)
        total = int(size.sum())
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(begin - before, size) + np.arange(total)]
        per_text = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
        if odd.any():
            return self._with_whole(texts, odd, ids, per_text)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def _restart(self, first, second, starts, ends, data, begin, size, known, ids):
        """An empty table when the ids are full; those that this slice has found already go over."""
        kept = self.flat[:self.used]
        held = np.flatnonzero(known)
        keys, at, back = np.unique(first[held], return_index=True, return_inverse=True)
        at = held[at]
        sizes = size[at]
        before = np.cumsum(sizes) - sizes
        moved = kept[np.repeat(begin[at] - before, sizes) + np.arange(int(sizes.sum()))]
        self._forget()
        if len(moved) + len(ids) > len(self.flat):
            self.flat = np.zeros(2 * (len(moved) + len(ids)), np.uint32)
        self.flat[:len(moved)], self.used = moved, len(moved)
        spot = keys >> self.shift
        self.keys[spot], self.checks[spot] = keys, second[at]
        self.starts[spot], self.sizes[spot] = before, sizes
        begin[held] = before[back]
        return begin, size, known

    @staticmethod
    def _pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = texts.data
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none
        kind = KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
        letter = (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = CUTS[kind[:-1] * np.uint8(8) + kind[1:]]
        cut[texts.offsets] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        owner = np.searchsorted(texts.offsets, starts, side="right") - 1
        return starts, ends, owner

    def _with_whole(self, texts: Texts, odd: np.ndarray, ids: np.ndarray, per_text: np.ndarray):
        whole = dict(zip(np.flatnonzero(odd).tolist(),
                         self.whole([texts.text(i).decode("utf-8", "replace") for i in np.flatnonzero(odd)])))
        parts = np.split(ids, np.cumsum(per_text)[:-1])
        parts = [whole.get(i, p) for i, p in enumerate(parts)]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return np.concatenate(parts).astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary: later tasks of the worker that encode go on with its table (``tables.arrow``)."""
    held = sys.modules.setdefault(ENCODERS, types.ModuleType(ENCODERS)).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
