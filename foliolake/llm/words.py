"""Words of whole texts, hashed with numpy over the bytes of many texts at once.

Words are runs of characters other than space and \\t \\n \\v \\f \\r, after A-Z
became lower case. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text makes a chunk of its own, whose words are hashed piece by piece.
CHUNK = 1 << 18
#: Bytes of texts that are read as strings, word by word.
STRINGS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


class Words(NamedTuple):
    first: np.ndarray  # first[i]:first[i+1] are the words of text i
    start: np.ndarray  # byte offsets in data
    end: np.ndarray
    hash: np.ndarray


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with (offsets, bytes) of their texts; a null text is empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(texts))
        own = offsets[at : to + 1]
        yield batch.slice(at, to - at), own - own[0], data[own[0] : own[-1]]
        at = to


def _pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about CHUNK bytes, each up to a space or a text's end; a longer word stays whole."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        edge = int(offsets[np.searchsorted(offsets, to)])
        while to < edge:
            space = np.flatnonzero(SPACE[data[to : min(to + CHUNK, edge)]])
            if len(space):
                to += int(space[0])
                break
            to = min(to + CHUNK, edge)
        yield at, to
        at = to


def words(offsets: np.ndarray, data: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]; hashes do not depend on where a word stands."""
    if len(data) <= 2 * CHUNK:
        return _words(offsets, data)
    found = []
    for at, to in _pieces(offsets, data):
        own = np.concatenate([[0], offsets[(offsets > at) & (offsets < to)] - at, [to - at]])
        w = _words(own, data[at:to])
        found.append((w.start + at, w.end + at, w.hash))
    start, end, hashes = (np.concatenate(x) for x in zip(*found))
    return Words(np.searchsorted(start, offsets), start, end, hashes)


def _words(offsets: np.ndarray, data: np.ndarray) -> Words:
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), empty, empty, np.zeros(0, np.uint64))
    low = LOWER[data]
    inside = ~SPACE[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[low] * _power(_BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power(_INVERSE, n)[start] + (end - start).astype(np.uint64))
    return Words(np.searchsorted(start, offsets), start, end, hashes)


def shingles(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its set of k-word shingles as sorted distinct hashes; of fewer words, the whole sequence; of none, empty."""
    n = len(w.hash)
    runs = np.zeros(n, np.uint64)
    place = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)  # no sums of places are alike
    for j in range(min(k, n)):
        runs[: n - j] += w.hash[j:] * place[j]
    runs = mix(runs)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            own = w.hash[a:b] * place[: b - a]
            yield mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
