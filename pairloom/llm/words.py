"""Words of a byte array, and hashes of them, in numpy."""

from __future__ import annotations

import numpy as np

from pairloom.llm.shards import mix

_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text in lower case
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def find_words(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each text the number of the first word from it on.

    ``starts`` are the offsets of the texts and the end of the last; words never cross them.
    """
    own = inside[data]
    begins = own.copy()
    begins[1:] &= ~own[:-1]
    edges = starts[:-1][starts[:-1] < len(data)]
    begins[edges] = own[edges]
    ends = own.copy()
    ends[:-1] &= ~own[1:]
    last = edges[edges > 0] - 1
    ends[last] = own[last]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, starts)


def hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[begin:end], all words at once."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    # Offsets of a shard fit in 32 bits; arrays as long as the text are kept few.
    kind = np.int32 if end[-1] < 2**31 else np.int64
    size = (end - begin).astype(kind)
    power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    first = np.cumsum(size, dtype=kind) - size
    place = np.arange(int(size.sum()), dtype=kind)
    place -= np.repeat(first, size)
    value = power[place]
    place += np.repeat(begin.astype(kind), size)
    value *= _CODES[data[place]]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each text, and where each text's begin.

    A text with fewer words, but at least one, has one run of all its words.
    """
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    ptr = np.concatenate(([0], np.cumsum(runs)))
    at = np.arange(ptr[-1]) - np.repeat(ptr[:-1], runs) + np.repeat(first[:-1], runs)
    size = np.repeat(np.minimum(count, k), runs)
    acc = size.astype(np.uint64)
    for j in range(k):
        word = words[np.minimum(at + j, len(words) - 1)] if len(words) else acc
        acc = np.where(size > j, mix(acc * np.uint64(0x9E3779B97F4A7C15) + word), acc)
    return acc, ptr
