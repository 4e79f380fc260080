"""Array primitives over UTF-8 text: word spans, hashes and rolling windows, without a Python loop per word."""

from __future__ import annotations

import ctypes
import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space; a word is a run of anything else.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_LONG_SPAN = 2048
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(column: pa.Array, most: int):
    """(first row, number of rows) of runs of a batch's texts with about `most` bytes each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    upto, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield first, last - first
        first = last


def release() -> None:
    """Gives back what a reused worker's earlier tasks, of other operators too, left free in the process's heap."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes don't cancel."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def equal_spans(a: bytes, a_at: np.ndarray, b: bytes, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of two buffers hold the same bytes; each buffer ends in 8 bytes that no span has."""
    x, y = (np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,)) for raw in (a, b))
    out, live, done = np.ones(len(size), bool), np.flatnonzero((size > 0) & (size <= _LONG_SPAN)), 0
    for i in np.flatnonzero(size > _LONG_SPAN):
        out[i] = a[a_at[i] : a_at[i] + size[i]] == b[b_at[i] : b_at[i] + size[i]]
    while len(live):
        left = size[live] - done
        same = (x[a_at[live] + done] ^ y[b_at[live] + done]) & _MASK[np.minimum(left, 8)] == 0
        out[live[~same]] = False
        done += 8
        live = live[same & (left > 8)]
    return out


def pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, the same for equal pairs alone; both count from 0."""
    return np.unique(x.astype(np.int64) * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1]


class Slice:
    """Some texts in one buffer, each followed by a line feed, and 8 bytes of padding."""

    def __init__(self, texts: list[bytes]):
        self.count = len(texts)
        self.raw = b"\n".join(texts) + b"\n" + b"\0" * 8 if texts else b"\0" * 8
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))  # of the texts; each ends one byte before the next
        self.bytes = np.frombuffer(self.raw, np.uint8)[:-8]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
        space = SPACE[self.bytes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans under a seed, eight bytes a step."""
        size = ends - starts
        at = np.ndarray((len(self.raw) - 7,), "<u8", buffer=self.raw, strides=(1,))
        h = size.astype(np.uint64) * np.uint64(BASE) ^ np.uint64(seed)
        h = mix(h ^ (at[starts] & _MASK[np.minimum(size, 8)]))
        for i in np.flatnonzero(size > _LONG_SPAN):
            h[i] = int.from_bytes(hashlib.blake2b(self.raw[starts[i] : ends[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
        more, done = np.flatnonzero((size > 8) & (size <= _LONG_SPAN)), 8
        while len(more):
            left = size[more] - done
            h[more] = mix(h[more] ^ (at[starts[more] + done] & _MASK[np.minimum(left, 8)]))
            done += 8
            more = more[left > 8]
        return h


    def numbers(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the first span of each distinct one, each span's number among those, hashes): told apart by their bytes.

        Hashes group the spans, and each is compared with the first of its group; if one differs, all are told apart anew.
        """
        h, size = self.hashes(starts, ends), ends - starts
        _, first, number = np.unique(h, return_index=True, return_inverse=True)
        like = first[number]
        good = size == size[like]
        if good.all() and equal_spans(self.raw, starts, self.raw, starts[like], size).all():
            return first, number, h
        seen: dict[bytes, int] = {}
        number = np.fromiter((seen.setdefault(self.raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
        return np.unique(number, return_index=True)[1], number, h


def slices(texts: list[bytes], most: int = 1 << 21):
    """(index of the first text, Slice) with about `most` bytes each; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, Slice(texts[first:i])
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, Slice(texts[first:])


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, and each text's first word (one more at the end)."""
    hashes, counts = [], [np.zeros(1, np.int64)]
    for _, s in slices(texts):
        starts, ends, first = s.words()
        hashes.append(s.hashes(starts, ends, seed))
        counts.append(np.diff(first))
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.cumsum(np.concatenate(counts))


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of `width` items that lie within one text: start items, hashes."""
    n = len(hashes)
    ends = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(n) + width <= ends)
    power, inverse = powers(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:n])))
    return starts, mix((total[starts + width] - total[starts]) * inverse[starts])


def tree_hashes(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of another make than a polynomial's: blocks of doubling size, mixed at each step."""
    n, size = len(hashes), 1
    block, at, out = hashes, starts, np.full(len(starts), width, np.uint64)
    while size <= width:
        if width & size:
            out = mix(out * np.uint64(BASE) + block[at])
            at = at + size
        double = np.zeros(n, np.uint64)
        if n > size:
            double[: n - size] = mix(block[: n - size] * np.uint64(BASE) + block[size:])
        block, size = double, 2 * size
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n items lie in [s, s + width) for some s of starts."""
    change = np.zeros(n + 1, np.int64)
    change += np.bincount(starts, minlength=n + 1)
    ends = np.minimum(starts + width, n)
    change -= np.bincount(ends, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[0::2], edge[1::2]
