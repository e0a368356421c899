"""Words of texts as 64-bit hashes, found and hashed for a whole batch at once.

A word is a run of letters, digits and marks of the lower-cased text. Its hash is a polynomial of its bytes with a final mix.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def word_chars() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for m in regex.finditer(r"[\p{L}\p{N}\p{M}]+", text):
        a, b = m.span()
        for lo, hi, shift in ((0, 0xD800, 0), (0xD800, len(text), 0x800)):
            if max(a, lo) < min(b, hi):
                table[max(a, lo) + shift:min(b, hi) + shift] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    up, down = np.full(n, MULTIPLIER), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def prefix_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value times power up to every place, and the powers that move a difference of two to the origin."""
    n = len(values) + 1
    up, down = _powers(1 << (n - 1).bit_length())
    sums = np.zeros(n, np.uint64)
    np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * up[:n - 1], out=sums[1:])
    return sums, down


def slices_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many slices, whatever stands around them."""
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """All words of a batch of texts: ``hashes`` in order, and ``at``, where each text's words start (one more at the end).

    ``start`` and ``end`` are places in ``joined``, the lower-cased texts with line feeds between them.
    """

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        self.joined = "\n".join(low) + "\n"
        points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        inside = word_chars()[points]
        edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums, down = prefix_hashes(points)
        self.hashes = slices_hash(sums, down, self.start, self.end)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
        self.offsets = offsets
        self.at = np.searchsorted(self.start, offsets)

    def text(self, k: int) -> str:
        return self.joined[self.start[k]:self.end[k]]


def shingles(hashes: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, text by text, and where each text's start.

    A text with fewer words, but at least one, has one shingle of all its words.
    """
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - at[:-1], count)
    short = np.repeat(np.where(n < size, n, size), count)
    h = np.zeros(len(place), np.uint64)
    for k in range(size):
        word = hashes[np.minimum(place + k, max(len(hashes) - 1, 0))] if len(hashes) else h
        h = np.where(k < short, mix(h * MULTIPLIER + word + np.uint64(k)), h)
    return h, out_at
