"""Vectorised word hashing over the UTF-8 buffer of an Arrow string column.

A word is a maximal run of bytes that are not separators, with A-Z lowered.
Its hash is a polynomial over a random byte table modulo 2**64, finished by a
multiply-xorshift mix, so a whole chunk of texts is hashed with a few NumPy
passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _byte_set(predicate) -> np.ndarray:
    return np.array([predicate(i) for i in range(256)], dtype=bool)


#: Separators: ASCII white space only (space, tab, LF, VT, FF, CR).
SPACES = _byte_set(lambda i: i == 32 or 9 <= i <= 13)
#: Separators: every ASCII byte that is no letter or digit.
NON_ALNUM = _byte_set(lambda i: i < 128 and not chr(i).isalnum())
LINE_ENDS = _byte_set(lambda i: i == 10)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Chunk:
    """Consecutive rows of a batch: their bytes and each row's bounds in them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into chunks of about ``limit`` bytes; a longer text makes a chunk of its own."""
    column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Hashes of a chunk's words in order; row ``i`` owns ``hashes[bounds[i]:bounds[i + 1]]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    prefixes: np.ndarray | None = None

    def row(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def rows_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split_words(chunk: Chunk, separators: np.ndarray = SPACES, prefix: int = 0, lower: bool = True) -> Words:
    """Words of a chunk; ``prefix`` > 0 also hashes the first so many bytes of each."""
    data, bounds = chunk.data, chunk.bounds
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64), none, none, np.zeros(0, dtype=np.uint64))
    inside = ~separators[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~inside[:-1] | cut[1:n]
    starts = np.flatnonzero(inside & before)
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~inside[1:] | cut[1:n]
    ends = np.flatnonzero(inside & after) + 1
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[_LOWER[data] if lower else data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    prefixes = mix((sums[np.minimum(ends, starts + prefix)] - sums[starts]) * down[starts] + np.uint64(1)) if prefix else None
    return Words(hashes, np.searchsorted(starts, bounds), starts, ends, prefixes)


def hash_words(text: str, separators: np.ndarray = SPACES) -> np.ndarray:
    """Hashes of one text's words, as ``split_words`` gives them."""
    return split_words(next(chunks(pa.array([text]))), separators).hashes


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling Karp-Rabin hashes of ``width`` words that lie in one row, and the index of each one's first word."""
    n = len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        rolled = rolled * np.uint64(_BASE) + words.hashes[j : j + n]
    row = words.rows_of_words()
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(rolled[at]), at
