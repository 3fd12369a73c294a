"""Repeated byte strings by blockwise suffix bucketing with difference-cover samples.

Only whether suffixes agree in their first ``size`` bytes matters here, so suffixes are ordered by
the 64-bit fingerprint of those bytes, not by the bytes, and two are tied if fingerprint and a
16-bit check of the same bytes are equal. For any two positions a difference cover modulo
``period`` has a common shift below ``period`` that takes both to sampled positions; the strings
of ``size - period + 1`` bytes from there lie within the first ``size``.

1. The samples (a few per cent of all positions) are ranked: each learns whether its string is
   tied with another's. They are dealt to buckets by fingerprint, as sorted runs from each chunk.
2. A suffix can be tied with another only if one of the samples in its first ``period`` positions
   is. The suffixes left are sorted block by block of the fingerprint space, one block of buckets at a time,
   so that the memory and disk in use follow the block and not the text.
3. Each byte in the first ``size`` bytes of a tied suffix is removed.

The cover is a Singer difference set, from a primitive cubic over a prime field: q + 1 residues
modulo q * q + q + 1 that have each difference exactly once. Fingerprint and check are polynomials
of the bytes modulo three primes, at points drawn for each call, so texts can't be made to collide
beforehand.

Texts are dealt to chunks at random, in a table that all passes read, so repeated rows spread out.

Edge cases: null and empty texts are empty; shorter texts than ``size`` stay whole; matches never
cross documents but may overlap in one; repeated rows match one another, and each keeps what is
left; an empty table gives an empty result; other columns are carried in ``doc`` whatever their
names. A very long text is one chunk's, whole: it must fit a task's memory about fortyfold.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.llm import kernel as K
from textloom.llm import runs as R
from textloom.llm import store
from textloom.llm.rows import quoted

CHUNK, BLOCKS = 2 << 20, 3
_FOUND = "bucket int, chunk int, bits binary"


@lru_cache(maxsize=8)
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """(period, residues) for a prime ``q``."""
    period = q * q + q + 1

    def times_x(a, low):
        """x * (a0 + a1 x + a2 x^2) with x^3 = low0 + low1 x + low2 x^2."""
        return tuple((c + a[2] * l) % q for c, l in zip((0, a[0], a[1]), low))

    for low in ((i, j, k) for i in range(1, q) for j in range(q) for k in range(q)):
        a, n, flat = (1, 0, 0), 0, []
        while True:
            if a[2] == 0 and n < period:
                flat.append(n)
            a, n = times_x(a, low), n + 1
            if a == (1, 0, 0) or n > q**3:
                break
        if n == q**3 - 1 and len(flat) == q + 1:
            return period, tuple(flat)
    raise ValueError(q)


def cover_for(size: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose period is at most two thirds of ``size``."""
    fitting = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23) if q * q + q + 1 <= 2 * size // 3]
    return difference_cover(fitting[-1]) if fitting else (1, (0,))


#: The three largest primes below 2 ** 31. Fixed values.
PRIMES = (2147483647, 2147483629, 2147483587)
_U = np.uint64


@lru_cache(maxsize=12)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), prime)) % _U(prime)])
    return out


class Rolling:
    """Polynomials of any byte range modulo each prime."""

    def __init__(self, data: np.ndarray, key: int):
        points = np.random.default_rng(key).integers(1 << 20, min(PRIMES) - 1, len(PRIMES)).tolist()
        room = 1 << max(int(len(data)).bit_length(), 20)
        self.inverse = [_powers(pow(x, -1, p), p, room) for x, p in zip(points, PRIMES)]
        self.sums = []
        for x, p in zip(points, PRIMES):
            terms = (data.astype(_U) + _U(1)) * _powers(x, p, room)[: len(data)]
            if len(data) >> 24:
                terms %= _U(p)
            self.sums.append(np.concatenate([np.zeros(1, _U), np.cumsum(terms)]))

    def __call__(self, at: np.ndarray, size: int, k: int) -> np.ndarray:
        p, sums = _U(PRIMES[k]), self.sums[k]
        return (sums[at + size] - sums[at]) % p * self.inverse[k][at] % p


class Chunk:
    """Some texts, and what pass by pass is known of their suffixes."""

    def __init__(self, table: pa.Table, size: int, key: int, hash_bits: int = 64):
        self.size, self.drop = size, _U(64 - hash_bits)
        self.period, residues = cover_for(size)
        self.texts = K.texts(table.column("text").combine_chunks())
        self.rolling = Rolling(self.texts.data, key)
        lengths = np.diff(self.texts.offsets)
        n = len(self.texts.data)
        self.inside = (np.arange(n) - np.repeat(self.texts.offsets[:-1], lengths)).astype(np.int64)
        self.left = np.repeat(lengths, lengths) - self.inside
        table_ = np.zeros(self.period, bool)
        table_[list(residues)] = True
        self.sample = np.flatnonzero(table_[self.inside % self.period] & (self.left >= size - self.period + 1))

    def fingerprints(self, at: np.ndarray, size: int) -> np.ndarray:
        return K.mix(self.rolling(at, size, 0) << _U(31) | self.rolling(at, size, 1)) >> self.drop << self.drop

    def checks(self, at: np.ndarray) -> np.ndarray:
        return (self.rolling(at, self.size, 2) >> _U(15)).astype(np.uint16)

    def samples(self) -> np.ndarray:
        return self.fingerprints(self.sample, self.size - self.period + 1)

    def open_suffixes(self, tied: np.ndarray) -> np.ndarray:
        """Positions with a tied sample among the next ``period`` positions."""
        before = np.zeros(len(self.texts.data) + 1, np.int32)
        before[self.sample[tied] + 1] = 1
        np.cumsum(before, out=before)
        at = np.flatnonzero(self.left >= self.size)
        return at[before[at + self.period] > before[at]]


def _ties(fp: np.ndarray, check: np.ndarray, found: pa.Table, bits: int) -> np.ndarray:
    """Whether each entry occurs again, in this chunk or by the buckets' answers."""
    order, new = R.ordered(fp, check)
    which = np.empty(len(fp), np.int64)
    which[order] = np.cumsum(new) - 1
    several = np.bincount(which, minlength=int(new.sum())) > 1
    return (several | R.answers(found, R.bucket_counts(fp[order][new], bits)))[which]


def _exchange(sent: DataFrame, bits: int, name: str) -> DataFrame:
    """For each chunk's sorted run in a bucket, which entries other chunks have too."""

    def meet(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        runs = R.checked_blobs(table, b, bits)
        fp, check = (np.concatenate(x) for x in zip(*runs))
        order, new = R.ordered(fp, check)
        same = ~new[1:]
        flags = np.empty(len(fp), bool)
        flags[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        at = np.concatenate([[0], np.cumsum([len(x) for x, _ in runs])])
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "bits": pa.array([R.pack_bits(flags[i:j]) for i, j in zip(at[:-1], at[1:])], pa.binary())})

    return store.written(sent.groupBy("bucket").applyInArrow(meet, _FOUND), name)


def _runs(chunk: int, fp: np.ndarray, check: np.ndarray, bits: int) -> pa.Table:
    order, new = R.ordered(fp, check)
    sent = R.encode(fp[order][new], bits, check[order][new])
    return pa.table({"bucket": pa.array([b for b, _ in sent], pa.int32()), "chunk": pa.array([chunk] * len(sent), pa.int32()), "run": pa.array([x for _, x in sent], pa.binary())})


def repeated_bytes(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, size: int = 200, blocks: int = BLOCKS, hash_bits: int = 64) -> DataFrame:
    """Per document: ``doc`` (its columns ``keep``), ``n_bytes``, ``removed`` (byte ranges, each
    a maximal run) and ``kept`` (the bytes left)."""
    keep = docs.columns if keep is None else keep
    body = F.col(quoted(text)).cast("string")
    volume = docs.select(F.sum(F.octet_length(body))).first()[0] or 0
    each = min(CHUNK, max(1 << 18, volume // 64))
    chunks = 1 + int(volume // each)
    bits = R.bucket_bits(volume / 10)
    key = secrets.randbits(63)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    rows = store.written(docs.select(place.alias("chunk"), F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("doc"), body.alias("text")), "chunks")
    bare = rows.select("chunk", "text")
    schema = T.StructType([rows.schema["doc"], *T.StructType.fromDDL("n_bytes long, removed array<struct<start:long,end:long>>, kept binary").fields])
    empty = to_arrow_schema(schema).empty_table()
    sent_type = "bucket int, chunk int, run binary"

    def chunk_of(table: pa.Table) -> Chunk:
        return Chunk(table, size, key, hash_bits)

    def no_checks(fp: np.ndarray) -> np.ndarray:
        return np.zeros(len(fp), np.uint16)

    def send_samples(table: pa.Table) -> pa.Table:
        fp = chunk_of(table).samples()
        return _runs(table.column("chunk")[0].as_py(), fp, no_checks(fp), bits)

    ranks = _exchange(bare.groupBy("chunk").applyInArrow(send_samples, sent_type), bits, "ranks")

    def open_entries(c: Chunk, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = c.samples()
        at = c.open_suffixes(_ties(fp, no_checks(fp), found, bits))
        return at, c.fingerprints(at, size), c.checks(at)

    def block_sender(low: int, high: int):
        def send_block(table: pa.Table, found: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _runs(0, np.zeros(0, np.uint64), np.zeros(0, np.uint16), bits)
            _, fp, check = open_entries(chunk_of(table), found)
            lead = fp >> np.uint64(48)
            own = (lead >= low) & (lead < high)
            return _runs(table.column("chunk")[0].as_py(), fp[own], check[own], bits)

        return send_block

    ties = None
    for block in range(blocks):
        # Whole buckets, so that a chunk has one answer from each.
        low, high = ((-(-(k << bits) // blocks)) << (16 - bits) for k in (block, block + 1))
        sent = bare.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(block_sender(low, high), sent_type)
        part = _exchange(sent, bits, "ties")
        ties = part if ties is None else ties.unionByName(part)

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        c = chunk_of(table)
        rank = found.column("of").to_numpy() == 0
        at, fp, check = open_entries(c, found.filter(pa.array(rank)))
        gone = K.covered(len(c.texts.data), at[_ties(fp, check, found.filter(pa.array(~rank)), bits)], size)
        offsets, n = c.texts.offsets, len(c.texts.data)
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = np.unique(offsets[1:-1])
        cut = cut[(cut > 0) & (cut < n)]
        cut = cut[gone[cut] & gone[cut - 1]]
        s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
        own = np.searchsorted(offsets, s, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(s - offsets[own]), pa.array(e - offsets[own])], names=["start", "end"])
        left = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(c.texts), [None, pa.py_buffer(left), pa.py_buffer(c.texts.data[~gone].tobytes())])
        return pa.table({"doc": table.column("doc"), "n_bytes": pa.array(np.diff(offsets)), "removed": K.list_array(spans, np.bincount(own, minlength=len(c.texts))), "kept": kept})

    found = ranks.withColumn("of", F.lit(0)).unionByName(ties.withColumn("of", F.lit(1)))
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(remove, schema)
