"""Hashes of the words of many texts at once: words are runs of other than space and U+0009 to U+000D, with A-Z taken as a-z."""

from __future__ import annotations

import numpy as np

#: A number for each byte at each of 32 places in a word, A-Z as a-z, and which bytes are white space.
_AT = np.random.default_rng(5).integers(0, 1 << 63, (32, 256), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_AT[:, 65:91] = _AT[:, 97:123]
_AT = _AT.ravel()
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the words of texts that stand one after another in data, the k-th up to ends[k]: the words of
    the k-th text are those from bounds[k] to bounds[k + 1].  Words are taken some hundred thousand at a time."""
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.concatenate(([0], ends[:-1]))
    begins = begins[begins < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    found = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), 400_000):
        own = starts[k : k + 400_000]
        a, b = own[0], starts[k + 400_000] if k + 400_000 < len(starts) else len(data)
        own = own - a
        place = np.arange(b - a) - np.repeat(own, np.diff(own, append=b - a))
        value = _AT[((place & 31) << 8) | data[a:b]]
        if (far := np.flatnonzero((place > 31) & inside[a:b])).size:
            value[far] *= (place[far].astype(np.uint64) >> np.uint64(5)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        value[~inside[a:b]] = 0
        found[k : k + 400_000] = mix(np.add.reduceat(value, own))
    return found, np.concatenate(([0], np.searchsorted(starts, ends)))
