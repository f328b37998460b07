"""Words, word hashes and n-gram hashes of Arrow text batches, vectorised with numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Every hash is 64 bits wide and depends on
the bytes of its words alone, never on the position, the batch or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer document makes one longer piece.
PIECE = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0x9E3779B97F4A7C15)
_powers, _unpowers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2**64."""
    global _powers, _unpowers
    if len(_powers) < n:
        made = []
        for base in (_BASE, _UNBASE):
            p = np.full(max(n, PIECE + 1), base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers, _unpowers = made
    return _powers[:n], _unpowers[:n]


@dataclass
class Words:
    """The words of some consecutive rows of a batch."""

    first: int  # number of the first row in the batch
    data: np.ndarray  # bytes of the rows' texts, one behind the other
    begin: np.ndarray  # of each row and, last, of the end: place in data
    start: np.ndarray  # of each word: place in data
    end: np.ndarray
    off: np.ndarray  # of each row and, last, of the end: number of its first word

    def hashes(self, lower: bool = False, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Sums of the bytes' values times powers of the base, as differences of running sums, shifted to the power 0.

        ``start`` and ``end`` take parts of the words instead of whole ones.
        """
        if not len(self.start):
            return np.zeros(0, np.uint64)
        start, end = (self.start, self.end) if start is None else (start, end)
        up, down = _powers_to(len(self.data) + 1)
        value = (_BYTE[LOWER] if lower else _BYTE)[self.data]
        value *= up[:-1]
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        return mix((total[end] - total[start]) * down[start])

    def joined(self) -> tuple[bytes, list[int]]:
        """The words of all rows, each row's joined by single blanks, and where each row begins (one more for the end)."""
        size = self.end - self.start
        last = np.zeros(len(size), bool)
        last[self.off[1:][np.diff(self.off) > 0] - 1] = True
        solid = ~SPACE[self.data]
        solid[self.end[~last]] = True  # the blank behind each word but a row's last
        out = self.data[solid]
        out[SPACE[out]] = 0x20
        at = np.r_[0, np.cumsum(size + ~last)]
        return out.tobytes(), at[self.off].tolist()

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each n consecutive words of one row."""
        if len(words) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = gram_hashes(words, n)
        row = self.row_of_word()
        at = np.flatnonzero(row[: len(h)] == row[n - 1 :])
        return h[at], at


_TO_BLANK = {c: 32 for c in range(0x09, 0x0E)}


def split_words(text: str | None) -> list[str]:
    """The words of one text; ``str.split`` would also split at other Unicode white space."""
    return [w for w in text.translate(_TO_BLANK).split(" ") if w] if text else []


def hashes_of(words: list[str]) -> np.ndarray:
    """The hashes of words without blanks, none of them empty."""
    return np.concatenate([w.hashes() for w in pieces(pa.array([" ".join(words)]))]) if words else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for i in range(1, n):
        h *= _GRAM
        h += words[i : i + m]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pieces(texts: pa.Array | pa.ChunkedArray, most: int = PIECE) -> Iterator[Words]:
    """Words of all rows, null taken as empty, in pieces of about ``most`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        begin = offsets[i : j + 1] - offsets[i]
        data = raw[offsets[i] : offsets[j]]
        solid = ~SPACE[data]
        before, after = np.zeros(len(solid) + 1, bool), np.zeros(len(solid) + 1, bool)
        before[1:], after[:-1] = solid, solid
        before[begin] = False
        after[begin] = False
        start = np.flatnonzero(solid & ~before[:-1])
        end = np.flatnonzero(solid & ~after[1:]) + 1
        yield Words(i, data, begin, start, end, np.searchsorted(start, begin))
        i = j
