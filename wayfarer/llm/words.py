"""Words of Arrow string columns, found and hashed with numpy a few MB at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D, or, where a table
of bytes is given, of bytes in it; with all bytes from 0x80 on in it, UTF-8 is never
cut inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first so many bytes of 8, as a little-endian integer.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longer ranges of bytes are hashed one by one, so that no long word costs a round of its own.
LONG = 128


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of several ranges, one after another."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order; of either one a bijection while the other stays."""
    return mix(mix(a + _ODD) ^ (b * _ODD))


class Loads:
    """The 8 bytes from any place of ``data`` on, as integers; zeros stand behind its end."""

    def __init__(self, data: np.ndarray):
        whole = np.zeros(len(data) // 8 + 3, np.uint64)
        whole.view(np.uint8)[: len(data)] = data
        self.whole = whole

    def at(self, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """From each place on, ``most`` bytes if these are fewer than 8."""
        word, shift = place >> 3, ((place & 7) << 3).astype(np.uint64)
        value = self.whole[word] >> shift
        value |= (self.whole[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return value & _MASK[np.minimum(most, 8)]


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for many ranges at once.

    Blocks of 8 bytes are chained by ``mix``, and ranges over ``LONG`` bytes get a
    blake2b digest: unlike a polynomial, neither gives texts of some regular form the
    same hash. Different seeds give hashes that are independent of each other.
    """
    length = end - start
    h = mix(length.astype(np.uint64) + np.uint64(seed) * _ODD + np.uint64(1))
    loads, done = Loads(data), 0
    now = np.flatnonzero((length > 0) & (length <= LONG))
    at, left, x = start[now], length[now], h[now]
    while len(now):
        x = combine(x, loads.at(at, left))
        going = left > 8
        if not going.all():
            h[now[~going]] = x[~going]
            now, at, left, x = now[going], at[going], left[going], x[going]
        at, left, done = at + 8, left - 8, done + 8
    for i in np.flatnonzero(length > LONG):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(16, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[a_start:][:length] and b[b_start:][:length] are equal, for many ranges at once."""
    same = np.ones(len(length), bool)
    x, y = Loads(a), Loads(b)
    now = np.flatnonzero((length > 0) & (length <= LONG))
    at = 0
    while len(now):
        left = length[now] - at
        same[now] &= x.at(a_start[now] + at, left) == y.at(b_start[now] + at, left)
        at += 8
        now = now[(left > 8) & same[now]]
    for i in np.flatnonzero(length > LONG):
        same[i] = np.array_equal(a[a_start[i] : a_start[i] + length[i]], b[b_start[i] : b_start[i] + length[i]])
    return same


def sliding_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, h, 1
    while True:
        if k & size:
            part = power[have : have + n]
            out = part if out is None else combine(out, part)
            have += size
        size *= 2
        if size > k:
            return mix(out + np.uint64(k))
        power = combine(power[: len(power) - size // 2], power[size // 2 :])


def split_rows(lengths: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row gets a range of its own."""
    ends = np.cumsum(lengths)
    i, n = 0, len(lengths)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
        yield i, j
        i = j


class Words:
    """Words of some documents: byte range, hash and document of each.

    ``first`` has, for each document, the number of its first word, and at the end
    the number of all words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray = ~_SPACE):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = inside[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        # A document may begin right after another's last word.
        bounds = offsets[(offsets > 0) & (offsets < len(data))]
        opens[bounds], closes[bounds - 1] = inside[bounds], inside[bounds - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return bytes_hash(self.data, self.start, self.end)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        return b" ".join(self.data[self.start[i] : self.end[j - 1]].tobytes().split()) if j > i else b""

    def list(self, i: int, j: int) -> list[bytes]:
        if j <= i:
            return []
        raw, base = self.data[self.start[i] : self.end[j - 1]].tobytes(), self.start[i]
        return [raw[a:b] for a, b in zip(self.start[i:j] - base, self.end[i:j] - base, strict=True)]


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes in some ranges, ends included, and of all from 0x80 on."""
    table = np.zeros(256, bool)
    for a, b in (*ranges, (0x80, 0xFF)):
        table[a : b + 1] = True
    return table


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of many ranges as a string column."""
    length = end - start
    offsets = np.concatenate([[0], np.cumsum(length)])
    held = np.ascontiguousarray(data[ragged(start, length)])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held))


def numbered(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, first place of each number); words with the same bytes, and no others, share a number."""
    _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    length = words.end - words.start
    same = length == length[first[which]]
    same[same] = same_bytes(words.data, words.start[same], words.data, words.start[first[which[same]]], length[same])
    if not same.all():  # a hash that is another's: those words are told apart one by one
        own: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~same).tolist():
            word = words.data[words.start[i] : words.end[i]].tobytes()
            if word not in own:
                own[word] = len(first) + len(more)
                more.append(i)
            which[i] = own[word]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return which, first


def word_chunks(array: pa.Array, lower: bool = False, most: int = CHUNK_BYTES, inside: np.ndarray = ~_SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, their words) for parts of a column of ``most`` bytes each."""
    data, offsets = column(array)
    for i, j in split_rows(np.diff(offsets), most):
        a, b = offsets[i], offsets[j]
        yield i, j, Words(data[a:b], offsets[i : j + 1] - a, lower, inside)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of all of them as one if there are fewer."""
    return sliding_hash(hashes, min(k, len(hashes))) if len(hashes) else hashes
