"""Sorted runs of 64-bit fingerprints, dealt to buckets by their leading bits.

A chunk of documents sends each bucket one blob: its sorted distinct fingerprints there, six bytes
each (the sixteen leading bits follow from the bucket and from a table of counts in front). A
bucket's reducer merges the runs of all chunks and answers each with one bit for each fingerprint,
in the same order; a chunk knows its fingerprints again by computing them again.

An entry may carry a check of two bytes, from a hash of its own: entries are the same only if both
fingerprint and check are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LEAD = 16
_SHIFT = np.uint64(64 - _LEAD)


def bucket_bits(fingerprints: float, each: int = 400_000) -> int:
    """Bits for buckets of about ``each`` fingerprints."""
    return int(min(_LEAD, max(6, np.ceil(np.log2(max(fingerprints, 1) / each)))))


def ordered(fp: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by fingerprint, then check (equal ones as they stand), and which of
    them, in that order, differ from the one before."""
    order = np.argsort(fp, kind="stable")
    f, c = fp[order], check[order]
    if ((f[1:] == f[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((check, fp))
        f, c = fp[order], check[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
    return order, new


def encode(sorted_: np.ndarray, bits: int, check: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """(bucket, blob) for each bucket that has fingerprints."""
    edge = np.searchsorted(sorted_, np.arange(1, 1 << _LEAD, dtype=np.uint64) << _SHIFT)
    edge = np.concatenate([[0], edge, [len(sorted_)]])
    low = np.ascontiguousarray(sorted_, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    each = 1 << (_LEAD - bits)
    out = []
    for b in range(1 << bits):
        at = edge[b * each : (b + 1) * each + 1]
        if at[-1] > at[0]:
            own = slice(at[0], at[-1])
            out.append((b, np.diff(at).astype("<u4").tobytes() + low[own].tobytes() + (check[own].astype("<u2").tobytes() if check is not None else b"")))
    return out


def decode(bucket: int, blob: bytes | memoryview, bits: int) -> np.ndarray:
    return _decode(bucket, blob, bits)[0]


def decode_checked(bucket: int, blob: bytes | memoryview, bits: int) -> tuple[np.ndarray, np.ndarray]:
    fp, at = _decode(bucket, blob, bits)
    return fp, np.frombuffer(blob, "<u2", len(fp), offset=at)


def _decode(bucket: int, blob: bytes | memoryview, bits: int) -> tuple[np.ndarray, int]:
    each = 1 << (_LEAD - bits)
    counts = np.frombuffer(blob, "<u4", each)
    n = int(counts.sum())
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, offset=4 * each).reshape(-1, 6)
    lead = np.repeat(np.arange(each, dtype=np.uint64) + np.uint64(bucket * each), counts)
    return whole.view("<u8").ravel() | (lead << _SHIFT), 4 * each + 6 * n


def bucket_counts(sorted_: np.ndarray, bits: int) -> np.ndarray:
    edge = np.searchsorted(sorted_, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return np.diff(np.concatenate([[0], edge, [len(sorted_)]]))


def blobs(table: pa.Table, bucket: int, bits: int, column: str = "run") -> list[np.ndarray]:
    return [decode(bucket, memoryview(x.as_buffer()), bits) for x in table.column(column)]


def checked_blobs(table: pa.Table, bucket: int, bits: int, column: str = "run") -> list[tuple[np.ndarray, np.ndarray]]:
    return [decode_checked(bucket, memoryview(x.as_buffer()), bits) for x in table.column(column)]


def merged(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints in order, equal ones by run, and where in their concatenation each stood."""
    every = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    return every[order], order


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def answers(table: pa.Table, counts: np.ndarray, column: str = "bits") -> np.ndarray:
    """The bits of all buckets as one array over the chunk's sorted fingerprints."""
    out = np.zeros(int(counts.sum()), bool)
    at = np.cumsum(counts) - counts
    for b, x in zip(table.column("bucket").to_pylist(), table.column(column)):
        n = int(counts[b])
        out[at[b] : at[b] + n] = np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n).astype(bool)
    return out
