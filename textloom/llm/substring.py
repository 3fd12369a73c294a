"""Incremental substring deduplication over a log-structured index of window fingerprints.

The index is a list of immutable runs. A run is a table of buckets (leading bits of the
fingerprint), each a sorted blob of the windows of ``size`` words that were new when the run was
made: a 64-bit fingerprint, and a check of 16 bits from a second hash under another key. A batch of
documents is cut into chunks by document id; each chunk sends its sorted distinct entries to the
buckets, where they are merge-joined with the runs there and with each other in chunk order, and
a match of fingerprints is verified by its check. What is found earlier comes back as bits, the
rest becomes the batch's own run. After each batch ``compact`` merges runs while there are
``fan_in`` of one size class, so a fingerprint is rewritten a logarithmic number of times.

Both hashes are keyed; the key is drawn with the index and kept in it, so texts can't be made to
collide beforehand. Within a chunk the earlier document is found by sorting. A chunk is a range of
ids that holds a bounded number of texts; an id that fills several such ranges has chunks of its
own, and chunks of one range never count as earlier than one another.

A word is removed if any window that covers it also begins in a document with a smaller id;
windows are judged on the input. Batches are taken in order of ids, so all that is in the index
has a smaller id.

Edge cases: null and empty texts have no words; a null id counts as smaller than all others; rows
with equal ids (repeated rows among them) never remove one another's words; texts of fewer than
``size`` words stay whole; a very long text is one group's, whole; an empty table gives an empty
result; other columns are carried in ``doc`` whatever their names.
"""

from __future__ import annotations

import secrets
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import kernel as K
from textloom.llm import runs as R
from textloom.llm import store
from textloom.llm.rows import quoted

BATCH_BYTES, BATCHES = 40 << 30, 2
_RUN = "bucket int, chunk int, data binary, n long"


@dataclass
class Index:
    """Runs as (path, fingerprints) in the order in which they were made."""

    size: int
    bits: int
    runs: list[tuple[str, int]] = field(default_factory=list)
    fan_in: int = 4
    key: int = field(default_factory=lambda: secrets.randbits(63))
    hash_bits: int = 64

    def read(self, spark) -> DataFrame | None:
        if not self.runs:
            return None
        return spark.read.schema(_RUN).parquet(*[p for p, _ in self.runs]).where("chunk = -1").select("bucket", F.col("data").alias("run"))

    def add(self, path: str, n: int) -> None:
        self.runs.append((path, n))

    def compact(self, spark) -> None:
        """Merge the newest runs while ``fan_in`` of them have sizes within a factor of ``fan_in``."""
        while len(self.runs) >= self.fan_in:
            last = self.runs[-self.fan_in :]
            if max(n for _, n in last) > self.fan_in * max(1, min(n for _, n in last)):
                return
            bits = self.bits

            def merge(table: pa.Table) -> pa.Table:
                b = table.column("bucket")[0].as_py()
                fp, check = _together(R.checked_blobs(table, b, bits))
                order, new = R.ordered(fp, check)
                fp, check = fp[order][new], check[order][new]
                return pa.table({"bucket": pa.array([b], pa.int32()), "chunk": pa.array([-1], pa.int32()), "data": pa.array([x for _, x in R.encode(fp, bits, check)], pa.binary()), "n": pa.array([len(fp)], pa.int64())})

            part = Index(self.size, bits, last).read(spark).groupBy("bucket").applyInArrow(merge, _RUN)
            path = store.write(part, "run")
            self.runs[-self.fan_in :] = [(path, sum(n for _, n in last))]


def _together(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    fps, checks = zip(*runs) if runs else ((), ())
    return np.concatenate([np.zeros(0, np.uint64), *fps]), np.concatenate([np.zeros(0, np.uint16), *checks])


@dataclass
class Windows:
    """Words, starts of windows, and the sorted distinct entries, with the entry of each window."""

    words: K.Words
    start: np.ndarray
    fp: np.ndarray
    check: np.ndarray
    which: np.ndarray


def _windows(table: pa.Table, index: Index) -> Windows:
    w = K.Words(K.texts(table.column("text").combine_chunks()), K.NON_SPACE)
    start = K.windows(w.first, index.size)
    of = lambda key: K.sequences(w.hashes(key=key), index.size)[start] if len(start) else np.zeros(0, np.uint64)
    fp, check = of(index.key), (of(index.key ^ 0x5DEECE66D) >> np.uint64(48)).astype(np.uint16)
    if index.hash_bits < 64:
        fp = fp >> np.uint64(64 - index.hash_bits) << np.uint64(64 - index.hash_bits)
    order, new = R.ordered(fp, check)
    which = np.empty(len(fp), np.int64)
    which[order] = np.cumsum(new) - 1
    return Windows(w, start, fp[order][new], check[order][new], which)


def _joined(w: K.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces."""
    doc = w.owner()[keep]
    start, length = w.start[keep], (w.end - w.start)[keep]
    lead = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(doc) else np.zeros(0, bool)
    own, j = K.ragged(length + lead)
    j -= lead[own]
    body = w.texts.data[np.maximum(start[own] + j, 0)] if len(own) else np.zeros(0, np.uint8)
    body[j < 0] = 0x20
    sizes = np.bincount(doc, weights=length + lead, minlength=len(w.first) - 1).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body)))


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by binary search."""
    if not bounds:
        return F.lit(0)
    n, every = len(bounds), F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(every, at + step - 1) <= key), at + step).otherwise(at))


SPLIT = 1 << 12


def _chunks(docs: DataFrame, text: str, key: str, keep: list[str], low, high, bounds: list[int], parts: dict[int, int]) -> DataFrame:
    """Rows with their chunk: the range of the id times ``SPLIT``, plus a part of the range for an
    id that has ``parts``."""
    k = F.coalesce(F.col(quoted(key)).cast("long"), F.lit(-(1 << 63)))
    body = F.col(quoted(text)).cast("string")
    part = F.lit(0)
    if parts:
        n = F.try_element_at(F.create_map(*[F.lit(x).cast(t) for i, m in parts.items() for x, t in ((i, "long"), (m, "int"))]), k)
        part = F.coalesce(F.pmod(F.xxhash64(body), n).cast("int"), F.lit(0))
    rows = docs.select((_place(k, bounds) * SPLIT + part).cast("int").alias("chunk"), k.alias("id"), F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("doc"), body.alias("text"))
    if low is not None:
        rows = rows.where(F.col("id") >= low)
    if high is not None:
        rows = rows.where(F.col("id") < high)
    return rows


def _batch(rows: DataFrame, index: Index, run: bool = True) -> tuple[str, int]:
    """Write the batch's bits and, if asked for, its new run; the path, and how many entries are new."""
    size, bits, spark = index.size, index.bits, rows.sparkSession

    def emit(table: pa.Table) -> pa.Table:
        x = _windows(table, index)
        sent = R.encode(x.fp, bits, x.check)
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in sent], pa.int32()), "chunk": pa.array([chunk] * len(sent), pa.int32()), "run": pa.array([x for _, x in sent], pa.binary())})

    def look_up(table: pa.Table, history: pa.Table | None) -> pa.Table:
        b = table.column("bucket")[0].as_py() if table.num_rows else None
        if b is None:
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        table = table.sort_by("chunk")
        old = R.checked_blobs(history, b, bits) if history is not None else []
        new = R.checked_blobs(table, b, bits)
        fp, check = _together([*old, *new])
        sizes = [len(x) for x, _ in new]
        n_old = len(fp) - sum(sizes)
        # The range of ids that each entry is from; those of the index are earlier than all.
        range_ = np.concatenate([np.full(n_old, -1), np.repeat(table.column("chunk").to_numpy() // SPLIT, sizes)])
        order, first = R.ordered(fp, check)
        earliest = range_[order][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else range_
        flags = np.empty(len(fp), bool)
        flags[order] = range_[order] > earliest
        fresh = first & (order >= n_old)
        at = n_old + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = [R.pack_bits(flags[i:j]) for i, j in zip(at[:-1], at[1:])]
        own = [x for _, x in R.encode(fp[order][fresh], bits, check[order][fresh])] if run and fresh.any() else []
        return pa.table({
            "bucket": pa.array([b] * (len(data) + len(own)), pa.int32()),
            "chunk": pa.array(table.column("chunk").to_pylist() + [-1] * len(own), pa.int32()),
            "data": pa.array(data + own, pa.binary()),
            "n": pa.array(sizes + [int(fresh.sum())] * len(own), pa.int64()),
        })

    sent = rows.select("chunk", "id", "text").groupBy("chunk").applyInArrow(emit, "bucket int, chunk int, run binary")
    history = index.read(spark)
    if history is None:
        found = sent.groupBy("bucket").applyInArrow(lambda t: look_up(t, None), _RUN)
    else:
        found = sent.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(look_up, _RUN)
    path = store.write(found, "run")
    n = spark.read.schema(_RUN).parquet(path).where("chunk = -1").agg(F.sum("n")).first()[0] or 0
    return path, n


def _removed(rows: DataFrame, path: str, index: Index) -> DataFrame:
    size, bits, spark = index.size, index.bits, rows.sparkSession
    schema = T.StructType([rows.schema["doc"], *T.StructType.fromDDL("n_words long, removed array<struct<start:long,end:long>>, kept string").fields])
    bitsets = spark.read.schema(_RUN).parquet(path).where("chunk >= 0").select("bucket", "chunk", F.col("data").alias("bits"))

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([], schema=_arrow(schema))
        x = _windows(table, index)
        w, n = x.words, len(x.words)
        texts = len(w.first) - 1
        _, rank = np.unique(table.column("id").to_numpy(), return_inverse=True)
        rank = rank[np.searchsorted(w.first, x.start, side="right") - 1]
        least = np.full(len(x.fp), np.iinfo(np.int64).max)
        np.minimum.at(least, x.which, rank)
        earlier = R.answers(found, R.bucket_counts(x.fp, bits))
        again = earlier[x.which] | (least[x.which] < rank)
        gone = K.covered(n, x.start[again], size)
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = w.first[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < n)])
        cut = cut[gone[cut] & gone[cut - 1]] if len(cut) else cut
        s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
        own = np.searchsorted(w.first, s, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(s - w.first[own]), pa.array(e - w.first[own])], names=["start", "end"])
        return pa.table({
            "doc": table.column("doc"),
            "n_words": pa.array(np.diff(w.first)),
            "removed": K.list_array(spans, np.bincount(own, minlength=texts)),
            "kept": _joined(w, np.flatnonzero(~gone)),
        })

    return rows.groupBy("chunk").cogroup(bitsets.groupBy("chunk")).applyInArrow(remove, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def substring_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, size: int = 13, batches: int = BATCHES, index: Index | None = None) -> DataFrame:
    """Per document: ``doc`` (its columns ``keep``), ``n_words``, ``removed`` (word ranges) and
    ``kept`` (the words left, joined by single spaces).

    With an ``index`` of earlier documents their windows count as earlier too, and the new ones'
    are added to it.
    """
    keep = docs.columns if keep is None else keep
    k = F.coalesce(F.col(quoted(key)).cast("long"), F.lit(-(1 << 63)))
    volume, rows = docs.select(F.sum(F.octet_length(F.col(quoted(text)).cast("string"))), F.count("*")).first()
    volume = volume or 0
    batches, last = max(1, min(batches, rows), int(volume // BATCH_BYTES) + 1), index is None
    index = index or Index(size, R.bucket_bits(volume / 6 / batches))
    each = min(4 << 20, max(1 << 18, volume // (batches * 48)))
    per_batch = max(1, min(10_000, int(volume // (batches * each))))
    steps = batches * per_batch
    found = docs.select(F.percentile_approx(k, [i / steps for i in range(1, steps)] or [0.5], F.lit(10 * steps))).first()[0] or [] if steps > 1 else []
    # An id that is several of the bounds has more rows than a chunk should: it gets a range alone.
    parts = {i: min(SPLIT, n + 1) for i, n in Counter(found).items() if n > 1}
    bounds = sorted({*found, *(i + 1 for i in parts)})
    out = None
    edges = [None, *[bounds[min(len(bounds) - 1, i * len(bounds) // batches)] for i in range(1, batches) if bounds], None]
    for low, high in zip(edges[:-1], edges[1:]):
        inner = [b for b in bounds if (low is None or b > low) and (high is None or b < high)]
        part = _chunks(docs, text, key, keep, low, high, inner, parts)
        # Nobody asks an index of the call's own after its last batch.
        path, n = _batch(part, index, run=not (last and high is None))
        index.add(path, n)
        done = _removed(part, path, index)
        out = done if out is None else out.unionByName(done)
        index.compact(docs.sparkSession)
    return out
