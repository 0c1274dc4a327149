"""Words and hashes of Arrow text columns, found with numpy over the UTF-8 bytes.

Every separator that the operators use is an ASCII character, and no byte of a longer UTF-8
sequence is below 128, so that words can be cut on bytes. All hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes hashed at once: a worker keeps two tables of that many powers for each base.
HASHED_BYTES = 1 << 17
_WHITE = (0x20, *range(0x09, 0x0E))
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xD1342543DE82EF95


def byte_class(*singles: int, ranges: tuple[tuple[int, int], ...] = (), inverse: bool = False) -> np.ndarray:
    """A table over the 256 byte values; ranges include both ends."""
    table = np.zeros(256, dtype=bool)
    table[list(singles)] = True
    for low, high in ranges:
        table[low:high + 1] = True
    return ~table if inverse else table


WHITE = byte_class(*_WHITE)
#: `[^\x20\x09-\x0D]+`
NOT_WHITE = ~WHITE
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters, and all that isn't ASCII.
ALNUM = byte_class(ranges=((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Texts:
    """A few whole texts: their bytes end to end, and where each begins (one entry more than texts)."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # place of the first text in its batch

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """A text or binary column in slices of about ``limit`` bytes, a longer text alone; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, side="right")) - 1)
        yield Texts(data[ends[low]:ends[high]], ends[low:high + 1] - ends[low], low)
        low = high


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS.get(base, (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    if len(up) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        _POWERS[base] = up, down
    return up, down


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE,
               limit: int = HASHED_BYTES) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and don't overlap. Long data goes piece by piece."""
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + limit, side="right")))
        begin = int(starts[low])
        piece = data[begin:int(ends[high - 1])]
        up, down = _powers(base, len(piece) + 1)
        sums = np.empty(len(piece) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:len(piece)], out=sums[1:])
        a, b = starts[low:high] - begin, ends[low:high] - begin
        out[low:high] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(BASE_2)
        low = high
    return mixed(out)


@dataclass
class Words:
    """Words of some texts in order; text i has those from ``pointer[i]`` to ``pointer[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    pointer: np.ndarray
    data: np.ndarray

    def hashes(self, base: int = BASE) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, base)

    def counts(self) -> np.ndarray:
        return np.diff(self.pointer)


def find_words(texts: Texts, table: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of the table's bytes inside each text; ``lower`` maps A-Z to a-z first."""
    data = LOWER[texts.data] if lower else texts.data
    inside = table[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts) + 1, np.int64), data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[texts.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside
    stops[:-1] &= ~stops[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets), data)


_ODD = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n; the caller leaves out those that cross a text's end."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        out += hashes[i:i + count] * _ODD[i]
    return mixed(out)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's LongType."""
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))
