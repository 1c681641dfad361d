"""Words of UTF-8 texts as arrays: A-Z lower-cased; letters, digits and all bytes from 0x80 on make words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE = 5
_SEGMENT = 1 << 20  # bytes hashed at a time
_LOWER = np.zeros(256, np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def word_list(data: bytes) -> list[bytes]:
    return [w.lower() for w in _WORD.findall(data)]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        steps = np.full(max(n, _SEGMENT + 4096), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash and the first byte of every word, computed segment by segment."""
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        low = _LOWER[np.frombuffer(data, np.uint8, end - at, at)]
        inside = np.zeros(len(low) + 2, np.int8)
        inside[1:-1] = low != 0
        turns = np.flatnonzero(np.diff(inside))
        start, stop = turns[::2], turns[1::2]
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low * _power(_BASE, len(low)), out=total[1:])
        hashes.append(mix((total[stop] - total[start]) * _power(_INVERSE, len(low) + 1)[start] + (stop - start).astype(np.uint64)))
        firsts.append(start + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def hashed_texts(texts: Sequence[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about a segment together: first, end, word hashes, number of words of each text."""
    first = 0
    while first < len(texts):
        size, end = 0, first
        while end < len(texts) and (end == first or size + len(texts[end]) < _SEGMENT):
            size += len(texts[end]) + 1
            end += 1
        hashes, starts = hash_words(b"\n".join(texts[first:end]))
        edges = np.cumsum([0] + [len(t) + 1 for t in texts[first:end]])
        yield first, end, hashes, np.diff(np.searchsorted(starts, edges))
        first = end


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text; a shorter text that has words is one shingle.

    Returns the hashes, text after text, and their number for each text.
    """
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    starts = np.cumsum(counts) - counts
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    value = np.zeros(len(hashes), np.uint64)
    left = np.repeat(starts + counts, counts) - np.arange(len(hashes))  # words from here to the end of the text
    for k in range(size):
        word = padded[k : k + len(hashes)]
        value += np.where(left > k, word, np.uint64(0)) * np.uint64((_BASE * (2 * k + 3)) & _MASK)
    keep = (np.arange(len(hashes)) - np.repeat(starts, counts)) < np.repeat(number, counts)
    return mix(value[keep]), number
