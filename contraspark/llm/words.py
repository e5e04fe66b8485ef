"""Words of many texts at once: their places and 64-bit hashes, computed on the raw UTF-8 bytes.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one running sum over the whole
slice: (sum up to its end - sum up to its start) times the inverse power of its start. No Python
object is made for any word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from contraspark.llm.common import text_bytes

#: Two hash functions of words, with bases and byte codes of their own.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CODES = tuple(np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (20240229, 20240301))
#: ASCII space and \t \n \v \f \r separate words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither letter nor digit separates words as well.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept up to the longest asked for."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    raw: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word, in raw
    end: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i
    hash: np.ndarray  # uint64, mixed
    second: np.ndarray | None = None  # another hash, independent of the first

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    base, sums = _BASES[which], np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_CODES[which][body] * _power(base, len(body)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(pow(base, -1, 1 << 64), len(body) + 1)[start] + (end - start).astype(np.uint64))


def split_words(column: pa.Array, lower: bool = False, separators: np.ndarray = SPACE, two: bool = False) -> Words:
    """The words of all texts; with ``two`` also their second hashes."""
    raw, offsets = text_bytes(column)
    body = LOWER[raw] if lower else raw
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~separators[raw]
    is_start = inside[1:] & ~inside[:-1]
    is_end = ~inside[1:] & inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    touching = edges[inside[edges] & inside[edges + 1]]  # a text that starts in a word while the one before ends in one
    is_start[touching] = True
    is_end[touching] = True
    start, end = np.flatnonzero(is_start), np.flatnonzero(is_end)
    return Words(raw, start, end, np.searchsorted(start, offsets), _hashes(body, start, end, 0), _hashes(body, start, end, 1) if two else None)


def runs(hashes: np.ndarray, n: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of each n consecutive entries (over the borders of texts too; the caller leaves those out)."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, seed, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count]
    return mix(out)


def run_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of n words that stay in one text, and the offsets of each text's starts among them."""
    count = np.maximum(0, np.diff(first) - n + 1)
    offsets = np.concatenate([[0], np.cumsum(count)])
    starts = np.repeat(first[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    return starts, offsets
