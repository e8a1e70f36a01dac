"""Whole columns of texts as byte arrays: words, lines and their hashes without a Python loop per word.

A word is a run of bytes outside \x20 and \x09-\x0D; these are ASCII, so bytes and code points agree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of text handled at once: what numpy makes of them stays near the processor, and small in a worker's memory.
SLICE = (1 << 19) - 1
#: Powers of a base that are kept; more, for a longer text, are made and forgotten.
KEPT_POWERS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64, and those of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        while len(up) < n:
            k = len(up)
            up = np.concatenate([up, up * np.uint64(pow(self.base, k, 1 << 64))])
            down = np.concatenate([down, down * np.uint64(pow(self.inverse, k, 1 << 64))])
            if len(up) <= KEPT_POWERS:
                self.up, self.down = up, down
        return up, down


class Hasher:
    """Rolling hashes with random byte values; two seeds give independent ones."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = (int(x) for x in rng.integers(1 << 60, 1 << 61, 2))
        self.bytes, self.words = Powers(a * 8 + 5), Powers(b * 8 + 3)

    def spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span of bytes."""
        up, down = self.bytes(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * up[: len(buf)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of each n consecutive hashes; the i-th starts at i."""
        m = len(hashes)
        if m < n:
            return np.zeros(0, np.uint64)
        up, down = self.words(m + 1)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(hashes * up[:m], out=sums[1:])
        return _mix((sums[n:] - sums[:-n]) * down[: m - n + 1])


FIRST, SECOND = Hasher(11), Hasher(12)


@dataclass
class Texts:
    """Texts in one buffer; text i is buf[offs[i]:offs[i + 1]]."""

    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def words(self, sep: np.ndarray = SEPARATOR) -> "Words":
        inside = ~sep[self.buf]
        n = len(inside)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cuts = self.offs[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            first[cuts] = inside[cuts]
            last[cuts - 1] = inside[cuts - 1]
        starts = np.flatnonzero(first)
        return Words(self, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offs))


@dataclass
class Words:
    """Words (or lines) of texts; those of text i are offs[i] to offs[i + 1]."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def hashes(self, hasher: Hasher = FIRST) -> np.ndarray:
        return hasher.spans(self.texts.buf, self.starts, self.ends)

    def window_starts(self, n: int) -> np.ndarray:
        """Places of the words at which n consecutive words of one text start."""
        left = np.repeat(self.offs[1:], self.counts) - np.arange(len(self))
        return np.flatnonzero(left >= n)

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text's kept words, joined by one space."""
        size = np.where(keep, self.ends - self.starts + 1, 0)
        to = np.zeros(len(self) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        offs = to[self.offs]
        out = np.full(to[-1], 0x20, np.uint8)
        mask = np.zeros(len(self.texts.buf) + 1, np.int8)
        k = np.flatnonzero(keep)
        mask[self.starts[k]] += 1
        np.subtract.at(mask, self.ends[k], 1)
        chosen = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
        fill = np.ones(to[-1], bool)
        fill[to[1:][k] - 1] = False
        out[fill] = self.texts.buf[chosen]
        # every text but an empty one ends in a space too many
        lens = np.diff(offs)
        lens = np.maximum(lens - 1, 0)
        drop = np.ones(to[-1], bool)
        drop[offs[1:][np.diff(offs) > 0] - 1] = False
        ends = np.zeros(len(offs), np.int64)
        np.cumsum(lens, out=ends[1:])
        return strings(out[drop], ends)


def strings(buf: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Valid UTF-8 and its offsets as an array of strings."""
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))).cast(pa.string())


def binaries(buf: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Slices of an array of fixed-width values as binaries; offs counts values."""
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64) * buf.itemsize), pa.py_buffer(np.ascontiguousarray(buf).view(np.uint8))]).cast(pa.binary())


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """A column of strings as one buffer; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(buf, offs - offs[0])


def slices(all_: Texts, size: int = SLICE) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive texts of about size bytes together: first, one past the last, and they themselves."""
    i, n = 0, len(all_)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(all_.offs, all_.offs[i] + size, "right")) - 1))
        yield i, j, Texts(all_.buf[all_.offs[i] : all_.offs[j]], all_.offs[i : j + 1] - all_.offs[i])
        i = j


def values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of integers without nulls."""
    return column.cast(pa.int64()).to_numpy() if isinstance(column, pa.ChunkedArray) else column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def packed(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Binaries as one array of fixed-width values, and offsets in values."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (offs - offs[0]) // np.dtype(kind).itemsize
