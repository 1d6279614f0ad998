"""Vectorised words and word shingles of Arrow text columns (numpy inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
#: Bytes hashed at once; a longer text is cut at white space, so memory does not follow its length.
SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base & _MASK, np.uint64)]))


class _Tables:
    size = 0

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(n, SLICE + 4096)
            cls.pow, cls.inv = _powers(_BASE, cls.size), _powers(pow(_BASE, -1, 1 << 64), cls.size)
        return cls.pow, cls.inv


def _spans(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SLICE bytes that end where a document or, in long ones, a word ends."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = int(offsets[np.searchsorted(offsets, at + SLICE, side="right") - 1])
        if stop <= at:
            here, stop = at + SLICE, int(offsets[np.searchsorted(offsets, at, side="right")])
            while here < stop and not _SPACE[data[here]]:
                here += 1
            stop = min(here, stop)
        yield at, stop
        at = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all ASCII-lower-cased words of a text column, first word number of every text and the total)."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    hashes, starts_at = [], []
    for a, b in _spans(offsets, data):
        piece = _LOWER[data[a:b]]
        space = _SPACE[piece]
        edge = offsets[(offsets >= a) & (offsets < b)] - a
        before = np.empty(b - a, bool)
        before[0], before[1:] = True, space[:-1]
        before[edge] = True
        after = np.empty(b - a, bool)
        after[-1], after[:-1] = True, space[1:]
        after[edge[edge > 0] - 1] = True
        word = ~space
        first, last = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        power, inverse = _Tables.upto(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[piece] * power[: b - a], out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        starts_at.append(first + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts = np.concatenate(starts_at)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of whole texts of about SLICE bytes (a longer text alone), so memory does not follow the batch."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; fewer words make one shingle, none make none."""
    for run in _runs(texts.fill_null("")):
        yield from _shingle_sets(run, k)


def _shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    words, first = word_hashes(texts)
    odd = [np.uint64((0xD6E8FEB86659FD93 * (2 * i + 1) | 1) & _MASK) for i in range(k)]
    if len(words) >= k:
        n = len(words) - k + 1
        rolled = words[:n] * odd[0]
        for i in range(1, k):
            rolled = mixed(rolled) + words[i : n + i] * odd[i]
        rolled = mixed(rolled + np.uint64(k))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            x = words[a : a + 1] * odd[0]
            for i in range(1, b - a):
                x = mixed(x) + words[a + i : a + i + 1] * odd[i]
            yield mixed(x + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
