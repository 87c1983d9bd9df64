"""Word shingles of a text as 64-bit hashes, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

from statelog.llm import windows
from statelog.llm.common import BLANKS
from statelog.llm.windows import PIECE

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between blanks."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(text: bytes, powers: windows.Powers, lower: bool = True) -> np.ndarray:
    """A hash for each word, A-Z lower-cased."""
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends = word_bounds(data)
    if len(data) <= PIECE:
        return windows.hashes(windows.prefix(data, powers), starts, ends, powers)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = int(np.searchsorted(ends, starts[at] + PIECE, side="right"))
        if stop == at:
            # A word longer than a piece, in any text that holds it.
            out[at] = xxhash.xxh3_64_intdigest(data[starts[at] : ends[at]].tobytes())
            at += 1
            continue
        sums = windows.prefix(data[starts[at] : ends[stop - 1]], powers)
        base = starts[at]
        out[at:stop] = windows.hashes(sums, starts[at:stop] - base, ends[at:stop] - base, powers)
        at = stop
    return out


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words, sorted; of fewer words, the whole sequence."""
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    value = np.full(count, np.uint64(width))
    for k in range(width):
        value = windows.mixed(value * _FACTOR + words[k : count + k])
    return np.unique(value)
