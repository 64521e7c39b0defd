"""Vectorised hashing of the words of many texts at once.

Words are runs of bytes outside space and \\x09-\\x0d; A-Z count as a-z. A hash is the sum of one fixed random 64-bit
value for each (position, byte), then mixed: equal words have equal hashes in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, for arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


_AT = randoms(64 * 256, 1)


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and the offsets of its texts (null: empty)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[offsets[0] : offsets[-1]] if len(offsets) else np.empty(0, np.uint8), offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def _word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many begin before each of cuts."""
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    inside = ~_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = cuts[(cuts > 0) & (cuts < len(raw))]
    start[edges] |= inside[edges]
    at = np.flatnonzero(inside).astype(np.int32)
    begin = start[at]
    first = np.flatnonzero(begin)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    value = _AT[((place & 63) << 8) | _LOWER[raw[at]]]
    if lengths.max() > 64:
        far = place > 63
        value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, first)), np.searchsorted(at[first], cuts)


def hashed(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of the words of some texts, offsets into them by text), chunk by chunk of whole texts."""
    raw, offsets = spans(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1)
        words, ends = _word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, words, ends
        i = j
