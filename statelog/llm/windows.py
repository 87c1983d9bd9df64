"""Content-chosen suffixes of byte strings: every 200-byte window owns exactly one of them.

The anchor of a window is its smallest k-byte gram by a hash (the leftmost of equals). The choice
depends on the window's bytes alone, so equal windows, wherever they start, have equal grams at
equal distances. Consecutive windows with the same anchor form a run; a run is judged as a whole
where its bytes repeat as a whole.
"""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW = 200
GRAM = 32

#: Positions handled at a time; their number must fit in the low bits that break ties.
POSITION_BITS = 20
PIECE = 1 << 17
#: Bytes after a piece that its windows and their blocks reach.
REACH = WINDOW + 16

_RANDOM = np.random.default_rng(20_011)
#: A random odd 64-bit number for each byte value, and the base of the polynomial hash.
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Powers:
    """Powers of the base and of its inverse, for texts of up to PIECE + REACH bytes."""

    def __init__(self) -> None:
        self.up = _powers(_BASE, PIECE + 2 * REACH)
        self.down = _powers(_INVERSE, PIECE + 2 * REACH)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def prefix(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of the polynomial hash, modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers.up[: len(data)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, starts, ends, powers: Powers) -> np.ndarray:
    """A hash of the bytes from each start to each end, equal for equal bytes."""
    return mixed((sums[ends] - sums[starts]) * powers.down[starts])


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each segment of data of any length, equal for equal bytes; segments are in order."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        stop = int(np.searchsorted(ends, base + PIECE, side="right"))
        if stop == at:
            # A segment longer than a piece, wherever it stands.
            out[at] = xxhash.xxh3_64_intdigest(data[base : ends[at]].tobytes())
            at += 1
            continue
        sums = prefix(data[base : ends[stop - 1]], powers)
        out[at:stop] = hashes(sums, starts[at:stop] - base, ends[at:stop] - base, powers)
        at = stop
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[: len(values) - reach], values[reach:])
        reach *= 2
    if reach < width:
        step = width - reach
        values = np.minimum(values[: len(values) - step], values[step:])
    return values


def runs(sums: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """First and last window start and anchor of every run, for a text of WINDOW bytes or more."""
    size = len(sums) - 1
    grams = size - GRAM + 1
    gram = mixed((sums[GRAM:] - sums[:grams]) * powers.down[:grams])
    place = np.arange(grams, dtype=np.uint64)
    keep = np.uint64(~((1 << POSITION_BITS) - 1) & (2**64 - 1))
    owner = _least((gram & keep) | place, WINDOW - GRAM + 1)
    owner = (owner & ~keep).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.concatenate((first[1:], [len(owner)])) - 1
    return first, last, owner[first]
