"""Terms of a text (runs of digits, letters and non-ASCII bytes) and exact comparison of byte ranges."""

from __future__ import annotations

import numpy as np

from . import spans

#: The same terms as ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` over code points.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that are in no term.
APART = spans.PUNCTUATION

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return _FOLD[data]


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., ``length[0]`` of them, then the same of the next range."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - length), length)


def same_bytes(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each range of ``a`` holds the bytes of the range of ``b`` of the same length (1 or more)."""
    if not len(length):
        return np.zeros(0, dtype=bool)
    other = a[ragged(a_first, length)] != b[ragged(b_first, length)]
    return np.add.reduceat(other, np.cumsum(length) - length, dtype=np.int64) == 0


class Vocabulary:
    """A bounded list of terms; finds which of them a word is, byte for byte."""

    def __init__(self, words: list[str]):
        coded = [w.encode() for w in words]
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        length = np.array([len(w) for w in coded], dtype=np.int64)
        first = np.cumsum(length) - length
        hashes = spans.Hashes(data)(first, first + length) if len(coded) else np.zeros(0, dtype=np.uint64)
        self.index = np.argsort(hashes, kind="stable")
        self.hashes, self.first, self.length, self.data = hashes[self.index], first[self.index], length[self.index], data
        #: Most terms that share a hash.
        self.depth = int(np.unique(hashes, return_counts=True)[1].max()) if len(coded) else 0

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Position in the list of each byte range of ``data``, -1 for others; equal hashes are verified."""
        found = np.full(len(first), -1, dtype=np.int64)
        if not len(self) or not len(first):
            return found
        hashes = spans.Hashes(data)(first, last)
        at = np.searchsorted(self.hashes, hashes)
        for step in range(self.depth):
            k = np.minimum(at + step, len(self) - 1)
            hit = np.flatnonzero((found < 0) & (self.hashes[k] == hashes) & (self.length[k] == last - first))
            hit = hit[same_bytes(data, first[hit], self.data, self.first[k[hit]], self.length[k[hit]])]
            found[hit] = self.index[k[hit]]
        return found
