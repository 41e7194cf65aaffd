"""Words and word shingles of whole texts as 64-bit numbers, computed on the bytes of a batch.

A word is a maximal run of characters other than space and U+0009 to U+000D, with A to Z
in lower case. All of these are single bytes of UTF-8 that occur in no other character, so
the work is done on bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes handled at once; a longer text goes through in several slices
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of an odd base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and ends in them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Ends of slices of about SLICE bytes, none of them inside a word."""
    cuts, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):
            ahead = data[end : end + SLICE]
            space = np.flatnonzero(_SPACE[ahead])
            border = offsets[np.searchsorted(offsets, end)]
            stop = end + int(space[0]) if len(space) else end + len(ahead)
            if border <= stop:
                end = int(border)
                break
            end = stop
            if len(space):
                break
        cuts.append(end)
        at = end
    return cuts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the offsets of each text's words in them."""
    data, offsets = text_bytes(texts)
    found, starts, at = [], [], 0
    for end in _cuts(data, offsets):
        part = data[at:end]
        word = ~_SPACE[part]
        borders = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before[borders] = False
        first = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[borders[borders > 0] - 1] = False
        last = np.flatnonzero(word & ~after) + 1
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LOWER[part] * up[: len(part)], out=sums[1:])
        values = (sums[last] - sums[first]) * down[first]
        found.append(mixed(values + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(first + at)
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(where, offsets)


_PLACES = constants(7, SHINGLE)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the five-word shingles of each text.

    Fewer words give one shingle of the whole sequence, no words the empty set. Texts go
    through in runs of about SLICE bytes, so what is held beside the sets stays small.
    """
    offsets = text_bytes(texts)[1]
    sets, at = [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        sets += _shingle_sets(texts.slice(at, end - at))
        at = end
    return sets


def _shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    words, offsets = word_hashes(texts)
    n = max(0, len(words) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        runs += words[k : k + n] * _PLACES[k]
    runs = mixed(runs)
    sets = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= SHINGLE:
            sets.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            value = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mixed(np.array([value], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
