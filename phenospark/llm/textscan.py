"""Words of Arrow text columns as arrays: where they stand, and 64-bit hashes of words and word spans.

Everything works on the bytes of a chunk of rows at once. A span's hash is a polynomial in 64-bit
arithmetic taken from prefix sums and then mixed; two independent families give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Family:
    """One polynomial hash: powers of an odd base, their inverses, and a random value per byte."""

    def __init__(self, seed: int):
        rows = mix(np.arange(1, 259, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.table = rows[:256]
        self.base = int(rows[256]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power = self.back = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            factor = np.full(n, self.base, np.uint64)
            factor[0] = 1
            self.power = np.multiply.accumulate(factor)
            factor[1:] = np.uint64(self.inverse)
            self.back = np.multiply.accumulate(factor)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums of ``values[i] * base**i`` before each index; its length is one more."""
        self.upto(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the values in [start, end), wherever they stand."""
        h = (prefix[end] - prefix[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


FAMILIES = (Family(11), Family(23))


@dataclass
class Words:
    """Words of the rows ``first`` to ``last`` of a batch; ``bounds[i]`` is row i's first word."""

    first: int
    last: int
    bounds: np.ndarray
    row: np.ndarray
    hashes: tuple[np.ndarray, ...]

    def room(self) -> np.ndarray:
        """For each word, how many words of its row begin at it or after it."""
        return self.bounds[self.row + 1] - np.arange(len(self.row))


def scan(text: pa.Array, lower: bool = False, families: int = 2) -> Iterator[Words]:
    """Cut a text column into chunks of about a megabyte (a longer row is a chunk by itself)."""
    text = text.cast(pa.large_string()).fill_null("")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(text):
        last = max(int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1, first + 1)
        last = min(last, len(text))
        raw = data[offsets[first] : offsets[last]]
        yield _words(raw, offsets[first : last + 1] - offsets[first], first, last, lower, families)
        first = last


def _words(raw: np.ndarray, at: np.ndarray, first: int, last: int, lower: bool, families: int) -> Words:
    n = len(raw)
    inside = ~IS_SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    bounds = np.searchsorted(start, at)
    row = np.repeat(np.arange(last - first), np.diff(bounds))
    letters = LOWER[raw] if lower else raw
    hashes = tuple(f.spans(f.prefix(f.table[letters]), start, end) for f in FAMILIES[:families])
    return Words(first, last, bounds, row, hashes)


def grams(words: Words, k: int, family: int = 0) -> np.ndarray:
    """Hash of the k words from each position on; meaningless where the row has fewer left."""
    f, values = FAMILIES[family], words.hashes[family]
    n = len(values)
    start = np.arange(n)
    return f.spans(f.prefix(values), start, np.minimum(start + k, n))
