"""Vectorised word splitting and hashing over the bytes of many texts at once.

A word's hash adds up its 8-byte blocks, each mixed with a key of its place in the word, so no arithmetic relation
between blocks carries over to words; two such hashes with different keys are independent. A window's hash is a
polynomial over the hashes of its words with an odd base modulo 2^64, so that of any stretch is a difference of
prefix sums times an inverse power. Windows are compared by two polynomials of different bases over different word
hashes. Polynomials modulo 2^64 are never taken over bytes: strings of a few hundred letters can be made to collide
under every base.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np

U = np.uint64
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
WORD_KEYS = (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)

#: The separators of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def power_table(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1; tables are kept by rounded-up size."""
    return powers(base, max(1 << 12, 1 << max(0, n - 1).bit_length()))[:n]


@cache
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = WORD_KEYS[0]) -> np.ndarray:
    """Keyed hash of each data[start:end], none of them empty."""
    if not len(starts):
        return np.zeros(0, U)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the 8 bytes from each place on
    lengths = ends - starts
    blocks = (lengths + 7) >> 3
    first = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    bits = np.minimum(np.repeat(lengths, blocks) - 8 * number, 8).astype(U) * U(8)
    values = eight[np.repeat(starts, blocks) + 8 * number] & (~U(0) >> (U(64) - bits))
    mixed = mix(values ^ mix((number + 1).astype(U) * U(key)))
    return mix(np.add.reduceat(mixed, first) + lengths.astype(U) * U(0x632BE59BD9B4E019) + U(key))


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each values[start:end], for values that are hashes themselves."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * power_table(base, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * power_table(inverse(base), len(values) + 1)[starts]


@dataclass
class Words:
    """Words of a run of texts. first[d]:first[d + 1] are the words of text d; starts and ends are byte places."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    data: np.ndarray

    @cached_property
    def others(self) -> np.ndarray:
        """Hashes of the words under the second key."""
        return byte_hashes(self.data, self.starts, self.ends, WORD_KEYS[1])

    def window_keys(self, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that start at ``places``."""
        return window_hashes(self.hashes, places, size, WINDOW_BASES[0]), window_hashes(self.others, places, size, WINDOW_BASES[1])

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray | None = None, hashed: bool = True) -> Words:
    """Words of the texts data[offsets[d]:offsets[d + 1]]; word_byte marks the bytes of words (default: no separator).

    Callers that need no hashes leave them out (``hashed``)."""
    inside = (~SPACE if word_byte is None else word_byte)[data]
    change = np.zeros(len(data) + 1, bool)
    change[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        change[0], change[-1] = inside[0], inside[-1]
    opens = change[:-1] & inside
    closes = change[1:] & inside
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts[inside[cuts]]] = True
    closes[cuts[inside[cuts - 1]] - 1] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, first, byte_hashes(data, starts, ends) if hashed else np.zeros(0, U), data)


def window_places(first: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the words at which a window of ``size`` words of one text starts."""
    total = int(first[-1])
    ok = np.zeros(total + 1, np.int64)
    lengths = np.diff(first)
    has = lengths >= size
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[1:][has] - size + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def window_hashes(hashes: np.ndarray, places: np.ndarray, size: int, base: int) -> np.ndarray:
    return mix(stretch_hashes(hashes, places, places + size, base))
