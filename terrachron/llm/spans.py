"""Words, lines and their hashes for a block of texts at once, in numpy over UTF-8 bytes.

Arrow hands a batch of texts over as one byte buffer with offsets, so the helpers work on that
buffer and never loop over characters. Hashes are 64-bit polynomials of a byte range, taken from
prefix sums and mixed with the length; they are the same on every machine and in every batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one pass of the numpy helpers holds (a longer text makes its own block).
BLOCK_BYTES = 1 << 19

#: Rows of a batch that are converted at a time.
SLICE_ROWS = 1024

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Blanks, ASCII punctuation and control characters.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE, _M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.cumprod(have)
    return have[:n]


class Block:
    """Some texts of a batch: bytes, and where each text begins and ends in them."""

    def __init__(self, first: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.first, self.data, self.starts, self.ends = first, data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """Which text each byte position lies in."""
        return np.searchsorted(self.ends, positions, side="right")

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text of a value per byte."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.ends] - total[self.starts]

    def hashed(self, lower: bool = False) -> "Hashes":
        return Hashes(_LOWER[self.data] if lower else self.data)

    def words(self, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and text of each run of bytes not in ``apart``, in order."""
        solid = ~apart[self.data]
        before = np.empty_like(solid)
        before[:1], before[1:] = False, solid[:-1]
        after = np.empty_like(solid)
        after[-1:], after[:-1] = False, solid[1:]
        inner = self.starts[self.starts < len(solid)]
        before[inner] = False
        after[inner[inner > 0] - 1] = False
        first = np.flatnonzero(solid & ~before)
        return first, np.flatnonzero(solid & ~after) + 1, self.doc_of(first)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and text of each line between \\n; empty texts have one."""
        breaks = np.flatnonzero(self.data == 10)
        docs = self.doc_of(breaks)
        first = np.concatenate((self.starts, breaks + 1))
        last = np.concatenate((self.ends, breaks))
        doc = np.concatenate((np.arange(len(self)), docs))
        # Within a text, starts and ends each rise; pair them by rank.
        by_first = np.lexsort((first, doc))
        return first[by_first], last[np.lexsort((last, doc))], doc[by_first]


class Hashes:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        terms = _TABLE[data]
        terms *= powers(_BASE, n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        raw = (self.sums[last] - self.sums[first]) * powers(_INVERSE, len(self.sums))[first]
        return mix(raw ^ ((last - first).astype(np.uint64) * _GOLDEN))


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring values; the i-th starts at i."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out *= _BASE
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def keyed(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The hash together with the text it is in."""
    return mix(hashes ^ mix((docs.astype(np.uint64) + np.uint64(1)) * _GOLDEN))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string column (null: empty) in blocks of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first in range(0, len(column), SLICE_ROWS):  # only a slice is converted at a time
        yield from _slice_blocks(column.slice(first, SLICE_ROWS), first, limit)


def _slice_blocks(column: pa.Array, base: int, limit: int) -> Iterator[Block]:
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Block(base + i, whole[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i])
        i = j
