"""Words of many texts as arrays, by array operations over their bytes.

Words are runs of bytes that are no separator, A-Z in lower case. A word's
hash is a polynomial of its bytes modulo 2**64, mixed; equal words have equal
hashes in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WHITE = bytes([0x20, *range(0x09, 0x0E)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table_for(separators: bytes) -> np.ndarray:
    """Byte -> lower-case byte, 0 for separators (and for the byte 0, which joins texts, see ``split``)."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[list(separators)] = 0
    return table


#: Only white space separates words. A byte 0 inside a text is kept as a byte of its word.
BY_WHITE_SPACE = table_for(WHITE)
#: Every ASCII byte but letters and digits separates words.
BY_PUNCTUATION = table_for(bytes(b for b in range(128) if not chr(b).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _FIRST
    x ^= x >> np.uint64(27)
    x *= _SECOND
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), _STEP | np.uint64(1), dtype=np.uint64))


@dataclass
class Words:
    """Words of a run of texts. Text i has words bounds[i] to bounds[i + 1]."""

    bounds: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    prefixes: np.ndarray | None = None

    def texts(self) -> np.ndarray:
        """The number of the text each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split(texts: list[bytes], table: np.ndarray = BY_WHITE_SPACE, prefix: int = 0) -> Words:
    """All words of all texts; with ``prefix``, also the hash of each word's first bytes."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    low = table[data]
    inside = low != 0
    if table is BY_WHITE_SPACE:
        inside |= data == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    lengths = ends - starts
    if not len(starts):
        none = np.zeros(0, dtype=np.uint64)
        return Words(bounds, lengths, none, none if prefix else None)
    letters = low[inside].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(len(letters)) - np.repeat(first, lengths)
    letters *= powers(int(lengths.max()))[at]
    hashes = mix(np.add.reduceat(letters, first) ^ lengths.astype(np.uint64))
    heads = None
    if prefix:
        letters[at >= prefix] = 0
        heads = mix(np.add.reduceat(letters, first) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return Words(bounds, lengths, hashes, heads)
