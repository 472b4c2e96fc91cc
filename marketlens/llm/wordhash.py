"""Words of a batch of texts and their 64-bit hashes, computed on whole byte buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. It has two hashes, each the sum of
one pseudo-random number per (place in the word, byte): tabulation, which no structure of the bytes can defeat, as it defeats polynomials modulo
2**64. A window of few words hashes as a polynomial of word hashes, from running sums; a whole text, however long, again by
tabulation of its words. Work goes in blocks of texts, so that memory is bounded by the block or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomials over words, one for each of the two word hashes.
WORD_BASE, WORD_BASE_2 = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Seeds of the two tabulations, and the places of a word whose numbers are kept in a table.
SEEDS, TABLE_PLACES = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F), 64
#: Words of the longest window: beyond it polynomials of two alternating word hashes lose too many bits.
LONGEST_WINDOW = 128
BLOCK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """base**i and base**-i modulo 2**64 for i < n, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def table(b: int) -> np.ndarray:
                steps = np.full(n, b, U)
                steps[0] = 1
                return np.cumprod(steps)

            self.up, self.down = table(self.base), table(self.inverse)
        return self.up[:n], self.down[:n]


_WORDS, _WORDS_2 = Powers(WORD_BASE), Powers(WORD_BASE_2)


def _number(place: np.ndarray, value: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random number for each (place, value)."""
    return mix(mix(value + U(seed)) + place.astype(U) * U(0xD1B54A32D192ED03))


_TABLES = [_number(np.arange(TABLE_PLACES * 256) // 256, (np.arange(TABLE_PLACES * 256) % 256).astype(U), seed) for seed in SEEDS]


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of each run of ``count`` values; 0 for an empty run."""
    out = np.zeros(len(count), U)
    some = count > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(count) - count)[some])
    return out


def _running(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers, out=sums[1:])
    return sums


@dataclass
class Words:
    """Byte ranges [start, end) and two hashes of each word, and the range of words of each text: first[t] to first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    h2: np.ndarray
    first: np.ndarray

    def names(self) -> np.ndarray:
        """Two hashes of the word sequence of each text, one row a text."""
        count = np.diff(self.first)
        place = np.arange(len(self.h)) - np.repeat(self.first[:-1], count)
        return np.stack([mix(_sums(_number(place, h, seed), count) + count.astype(U)) for h, seed in zip((self.h, self.h2), SEEDS, strict=True)], axis=1)

    def windows(self, at: np.ndarray, length: np.ndarray | int, second: bool = False) -> np.ndarray:
        """Hash of the ``length`` words (at most LONGEST_WINDOW) from word ``at`` on; equal word sequences have equal hashes."""
        up, down = (_WORDS_2 if second else _WORDS).upto(len(self.h) + 1)
        key = "_sums2" if second else "_sums"
        if not hasattr(self, key):
            setattr(self, key, _running(self.h2 if second else self.h, up[: len(self.h)]))
        sums = getattr(self, key)
        return mix((sums[at + length] - sums[at]) * down[at] + U(1))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or one text that is longer."""
    _, offsets = buffers(texts)
    begin = 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield begin, stop
        begin = stop


def words_of(texts: pa.Array, fold_case: bool = False) -> Words:
    """Words of one block. ``fold_case`` hashes A-Z as a-z."""
    data, offsets = buffers(texts)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~gap
    begins, ends = word.copy(), word.copy()
    begins[1:] &= gap[:-1] | edge[1:-1]
    ends[:-1] &= gap[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    shown = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32) if fold_case else data
    inside, size = shown[word], end - start
    place = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    at = np.minimum(place, TABLE_PLACES - 1) * 256 + inside
    beyond = np.flatnonzero(place >= TABLE_PLACES)
    hashes = []
    for table, seed in zip(_TABLES, SEEDS, strict=True):
        number = table[at]
        number[beyond] = _number(place[beyond], inside[beyond].astype(U), seed)
        hashes.append(mix(_sums(number, size) + size.astype(U)))
    return Words(data, start, end, *hashes, np.searchsorted(start, offsets))
