"""Vectorised text kernels shared by the Python-side operators.

Everything here works on UTF-8 bytes in numpy, for many texts at once: no
Python object is made per word.  A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; as all of those are single ASCII bytes, splitting the
UTF-8 form equals splitting the characters.

Hashes are 64-bit.  They choose buckets and propose candidates; where an
operator promises exact results it compares the words themselves afterwards
or states the width of the key it relies on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Odd multipliers of the byte polynomial and of the word n-grams, and the
#: finaliser's constants (splitmix64).
_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 with good avalanche (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _PowerTable:
    """Powers of the byte polynomial and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            up, down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
            if size > 1 << 21:  # one enormous word: don't keep its tables
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_TABLE = _PowerTable()


class Words:
    """The words of a batch of texts.

    ``between`` tells for each byte value whether it separates words (line feed
    must).  ``starts``/``ends`` are byte offsets into ``buf``; the words of text ``i``
    are ``first[i]:first[i + 1]``.  ``hashes`` holds a 64-bit hash of each.
    """

    __slots__ = ("buf", "starts", "ends", "first", "hashes")

    def __init__(self, texts: Sequence[bytes], hashes: bool = True, between: np.ndarray = _SPACE) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        space = between[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=offsets[1:])
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(self.buf, self.starts, self.ends) if hashes else None


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each byte span ``buf[start:end]``; starts rise, spans may overlap.

    A span's hash doesn't depend on its place, so the prefix sums are made for a
    chunk of the buffer at a time, which bounds memory and stays in the cache.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + chunk)))
        s, e = starts[i:j] - low, ends[i:j] - low
        part = buf[low : low + int(e.max())]
        up, down = _TABLE.get(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.multiply(part + np.uint64(1), up[: len(part)], out=total[1:])
        np.cumsum(total, out=total)
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items (shorter input: none)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, factor = np.zeros(count, dtype=np.uint64), 1
    for i in range(n):
        out += hashes[i : i + count] * np.uint64(factor)
        factor = factor * _GRAM & _MASK
    return mix64(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """One hash of a whole sequence of any length."""
    return mix64((hashes * _powers(_GRAM, len(hashes))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))[0]


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_runs(texts: Sequence[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into consecutive ranges of at most ``limit`` bytes (one text at least)."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)
