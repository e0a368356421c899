"""Byte strings of a batch in an open-addressed table of NumPy arrays.

The key of a string is its xxhash64; before two occurrences share a slot their bytes are compared, so equal keys of different strings do
no harm. All occurrences are probed together, round by round: those that meet a free slot claim it, those that meet their own string stay,
the others go on to the next slot. Equal strings have equal probe paths and so end in one slot.
"""
from __future__ import annotations

import numpy as np
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SHORT = 32  # shorter strings are hashed together, eight bytes at a time; longer ones one by one


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def padded(raw: bytes) -> np.ndarray:
    """The bytes with eight more, so that eight can be read from any place."""
    return np.frombuffer(raw + bytes(8), np.uint8)


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """Numbers that start at every byte."""
    return np.ndarray((len(data) - 7,), kind, buffer=data, strides=(1,))


def xxhash64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 with seed 0 of many slices of ``padded`` data."""
    out = np.empty(len(start), np.uint64)
    eight, four = _words(data, "<u8"), _words(data, "<u4")
    by = np.argsort(np.minimum(length, SHORT).astype(np.int8), kind="stable")
    edges = np.searchsorted(length[by], np.arange(SHORT + 1))
    for n in range(SHORT):
        mine = by[edges[n]:edges[n + 1]]
        if not len(mine):
            continue
        at = start[mine]
        h = np.full(len(mine), P5 + np.uint64(n))
        k = 0
        while k + 8 <= n:
            h = _left(h ^ (_left(eight[at + k] * P2, 31) * P1), 27) * P1 + P4
            k += 8
        if k + 4 <= n:
            h = _left(h ^ (four[at + k].astype(np.uint64) * P1), 23) * P2 + P3
            k += 4
        for j in range(k, n):
            h = _left(h ^ (data[at + j].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[mine] = h ^ (h >> np.uint64(32))
    long = by[edges[SHORT]:]
    if len(long):
        view = memoryview(data)
        out[long] = [xxhash.xxh64_intdigest(view[a:a + n]) for a, n in zip(start[long].tolist(), length[long].tolist())]
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the slices from ``a`` and from ``b``, each of ``length``, hold the same bytes."""
    out = np.ones(len(a), bool)
    eight = _words(data, "<u8")
    k = 0
    left = np.flatnonzero(length < 2 * SHORT)
    while len(left):
        rest = length[left] - k
        apart = eight[a[left] + k] ^ eight[b[left] + k]
        # Of the last eight bytes only those that belong to the string count.
        apart <<= (np.uint64(8) * np.maximum(8 - rest, 0).astype(np.uint64))
        out[left[apart != 0]] = False
        k += 8
        left = left[(rest > 8) & (apart == 0)]
    view = memoryview(data)
    for j in np.flatnonzero(length >= 2 * SHORT).tolist():
        n = int(length[j])
        out[j] = view[a[j]:a[j] + n] == view[b[j]:b[j] + n]
    return out


class Interned:
    """``slot`` of every occurrence, numbered from 0 without gaps; ``count`` of every slot; ``owner``, an occurrence of every slot's string, and its key in ``keys``."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        n = len(start)
        size = 1 << max(4, (2 * n - 1).bit_length())
        keys = xxhash64(data, start, length)
        table = np.full(size, -1, np.int64)
        place = (keys & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            at = place[todo]
            free = table[at] < 0
            table[at[free]] = todo[free]
            held = table[at]
            fits = held == todo
            other = np.flatnonzero(~fits)
            a, b = todo[other], held[other]
            alike = (keys[a] == keys[b]) & (length[a] == length[b])
            c = np.flatnonzero(alike)
            alike[c] = _same(data, start[a[c]], start[b[c]], length[a[c]])
            fits[other[alike]] = True
            todo = todo[~fits]
            place[todo] = (place[todo] + 1) & (size - 1)
        used = np.flatnonzero(table >= 0)
        number = np.zeros(size, np.int64)
        number[used] = np.arange(len(used))
        self.slot, self.owner = number[place], table[used]
        self.keys = keys[self.owner]
        self.count = np.bincount(self.slot, minlength=len(used))

    def strings(self, slots: np.ndarray | slice = slice(None)) -> list[bytes]:
        """The strings of all slots, or of some."""
        view = memoryview(self.data)
        own = self.owner[slots]
        a = self.start[own]
        return [bytes(view[x:y]) for x, y in zip(a.tolist(), (a + self.length[own]).tolist())]
