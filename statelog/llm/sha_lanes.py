"""SHA-256 over many short messages at once, with states that can be kept and resumed.

A message is a row of hex digests. Each of them fills one 64-byte block of SHA-256 exactly, so the
state before a child is eight words with nothing left over: it can be stored in a table and resumed
in another task.
"""

from __future__ import annotations

import math

import numpy as np

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]


def _root_bits(prime: int, power: int) -> int:
    """The first 32 bits behind the point of a prime's square or cube root."""
    scaled = prime << (32 * power)
    low, high = 0, 1 << 36
    if power == 2:
        return math.isqrt(scaled) & 0xFFFFFFFF
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle)
    return low & 0xFFFFFFFF


START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_ROUND = [np.uint32(_root_bits(p, 3)) for p in _PRIMES[:64]]
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)
#: Messages worked on at a time, so that their words stay in the cache.
LANES = 8192


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _block(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    w = [words[i] for i in range(16)]
    a, b, c, d, e, f, g, h = (state[i] for i in range(8))
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(
                w[i - 16] + w[i - 7]
                + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3)))
                + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
        t = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + w[i]
        t += _ROUND[i]
        u = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _all(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(n, 8) states after one more block each, of (n, 16) words."""
    out = np.empty_like(states)
    for at in range(0, len(states), LANES):
        part = slice(at, at + LANES)
        out[part] = _block(np.ascontiguousarray(states[part].T), np.ascontiguousarray(words[part].T)).T
    return out


def fresh(count: int) -> np.ndarray:
    """States before anything was read."""
    return np.tile(START, (count, 1))


def resumed(states: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """(n, 8) states after one more digest each, (n, 32) bytes read as hex text."""
    text = np.ascontiguousarray(_HEX[digests].reshape(len(digests), 64))
    return _all(states, text.view(">u4").astype(np.uint32))


def finished(states: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(n, 32) digests of messages of ``counts`` hex digests."""
    words = np.zeros((len(states), 16), np.uint32)
    words[:, 0] = 0x80000000
    words[:, 15] = counts * 512
    return _all(states, words).astype(">u4").view(np.uint8).reshape(len(states), 32)
