"""Token ids of the words of texts, each distinct word tokenised once in a worker."""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from statelog.llm import windows
from statelog.llm.shingles import word_bounds, word_hashes

#: Distinct words that a worker keeps, at most; then it starts anew.
CACHED_WORDS = 400_000


@dataclass(frozen=True)
class Found:
    """Words and tokens of several texts in a row, and where those of each text begin and end."""

    hashes: np.ndarray
    word_at: np.ndarray
    ids: np.ndarray
    token_at: np.ndarray

    def words(self, i: int) -> np.ndarray:
        return self.hashes[self.word_at[i] : self.word_at[i + 1]]

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.token_at[i] : self.token_at[i + 1]]


class WordTable:
    """Words by a 64-bit hash of their bytes, sorted, and their ids in one growing array."""

    #: Whether A-Z are lower-cased before words are told apart and tokenised.
    lower = False

    def __init__(self) -> None:
        self.powers = windows.Powers()
        self._clear()

    def tokenised(self, words: list[bytes]) -> list[Sequence[int]]:
        """The ids of each word."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Grows in place and is read without a copy.
        self.flat = array("I")

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Add words that are not known; ``keys`` are sorted."""
        start = np.empty(len(keys) + 1, np.int64)
        for i, ids in enumerate(self.tokenised(words)):
            start[i] = len(self.flat)
            self.flat.extend(ids)
        start[len(keys)] = len(self.flat)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start, self.count = np.insert(self.start, at, start[:-1]), np.insert(self.count, at, np.diff(start))

    def lookup(self, texts: list[bytes]) -> Found:
        """The words and ids of texts that are looked up together."""
        joined = b"\n".join(texts)
        starts, ends = word_bounds(np.frombuffer(joined, np.uint8))
        hashes = word_hashes(joined, self.powers, self.lower)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = self._known(keys)
        if not known.all():
            if len(self.keys) + len(keys) > CACHED_WORDS:
                self._clear()
                known[:] = False
            new = first[~known]
            words = [joined[a:b] for a, b in zip(starts[new], ends[new])]
            self._learn(keys[~known], [w.lower() for w in words] if self.lower else words)
        at = np.searchsorted(self.keys, keys)
        begin, count = self.start[at][which], self.count[at][which]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        ids = np.frombuffer(self.flat or b"", np.uint32)[np.repeat(begin, count) + step]
        # A text's words begin before the blank that ends it.
        ends_at = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        word_at = np.concatenate(([0], np.searchsorted(starts, ends_at)))
        return Found(hashes, word_at, ids, np.concatenate(([0], np.cumsum(count)))[word_at])
