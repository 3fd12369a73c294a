"""Vectorised text primitives over Arrow buffers: word spans and rolling hashes in numpy.

A batch of texts is one byte array plus offsets. Words are maximal runs of bytes of a class
(every class used here treats all bytes from 0x80 alike, so UTF-8 needs no decoding). A word's
hash mixes it eight bytes at a time, starting from its length and a key; long words are hashed
by BLAKE2b. Work goes piece by piece of about ``PIECE`` bytes, so memory follows the piece (or
one long text), not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_WORDS = 0xD6E8FEB86659FD93
_U = np.uint64


def byte_class(keep: callable) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: Anything but ASCII white space.
NON_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, lower-case ASCII letters, and all bytes outside ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """Some texts as bytes: ``data`` and ``offsets`` (one more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        return Texts(_LOWER[self.data], self.offsets)


def texts(column: pa.Array) -> Texts:
    """Null texts become empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) else pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(body, at - at[0])


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, Texts]]:
    """(index of the first text, texts) for consecutive runs of about ``limit`` bytes."""
    whole = texts(column)
    at = whole.offsets
    i, n = 0, len(whole)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, Texts(whole.data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


class Words:
    """Word spans of some texts: ``start`` and ``end`` (bytes), and ``first`` (words before each text)."""

    def __init__(self, t: Texts, table: np.ndarray):
        inside = np.empty(len(t.data) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = table[t.data]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cut = t.offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(t.data))])
        if len(cut):
            cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
            if len(cut):
                start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        self.texts, self.start, self.end = t, start, end
        self.first = np.searchsorted(start, t.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, span: int | None = None, key: int = 0) -> np.ndarray:
        """64-bit hash of each word; of its first ``span`` bytes if given, of its last if negative."""
        start, end = self.start, self.end
        if span is not None and span >= 0:
            end = np.minimum(end, start + span)
        elif span is not None:
            start = np.maximum(start, end + span)
        return byte_hashes(self.texts.data, start, end, key)


_LONG = 64
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], _U)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hash of each byte range. Ranges of up to eight bytes and equal length never collide."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix((size.astype(_U) + _U(1)) * _U(_BASE) ^ _U(key))
    rest = np.flatnonzero(size > 0)
    at = 0
    while len(rest):
        left = size[rest] - at
        h[rest] = mix(h[rest] ^ (eight[start[rest] + at] & _FIRST_BYTES[np.minimum(left, 8)]))
        at += 8
        rest = rest[(left > 8) & (size[rest] <= _LONG)]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=int(key).to_bytes(8, "little")).digest(), "little")
    return h


def equal_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each range of ``size`` bytes of ``a`` equals that of ``b``."""
    same = np.ones(len(size), bool)
    each = max(1, PIECE // max(int(size.max(initial=1)), 1))
    for i in range(0, len(size), each):
        own, j = ragged(size[i : i + each])
        off = a[a_start[i : i + each][own] + j] != b[b_start[i : i + each][own] + j]
        same[i + own[off]] = False
    return same


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


def sequences(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, texts' boundaries not looked at."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = words[:n].copy()
    for j in range(1, size):
        total *= _U(_WORDS)
        total += words[j : j + n]
    return mix(total)


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Starts (word indices) of the runs of ``size`` words that stay in one text."""
    n = int(first[-1])
    start = np.arange(max(0, n - size + 1))
    left = np.repeat(first[1:], np.diff(first))
    return start[start + size <= left[: len(start)]]


def covered(n: int, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a run that begins at one of ``start``."""
    step = np.bincount(start, minlength=n + 1)
    step -= np.bincount(start + size, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, counts[i] times i, and beside it 0, 1, ... counts[i] - 1."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def list_array(values: pa.Array, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list array of consecutive runs of ``values``."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), values)
