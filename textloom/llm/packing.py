"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Only documents longer than the capacity are cut. The plan needs nothing but how many pieces there
are of each length, at most ``capacity`` numbers however large the corpus, so it is made on the
driver, and in run-length form: a placement run puts a range of equally long pieces at one offset
of a range of sequences.

1. Linear grouping: lengths over a share of the capacity are sorted and split into groups of
   equal cardinality, each rounded up to its longest.
2. The few sizes left make a configuration problem; its linear relaxation is solved to the optimum
   by column generation (simplex on the groups, a knapsack for pricing) and rounded down. Of
   several shares, and portions of the configurations carried out, the best plan is taken.
3. The groups' real pieces are put into the configurations' places, longest first.
4. Pieces left over by rounding, then the small ones, go by decreasing length into the fullest
   sequence that has room (best fit), and only if there is none into a new one.

Pieces with their ids are written to the shared folder as one table; a piece is known by the task
that wrote it, its length and its number there, so its rank among all pieces of its length takes
one join with per-task counts.

Edge cases: null and empty texts are a piece of the end id alone; repeated documents are packed
one by one, pieces of one length in any order (ties don't change the number of sequences); an
empty table makes no sequences; a document of any length becomes as many pieces as it needs; other
columns are carried in ``doc`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import store
from textloom.llm.rows import quoted, small_batches
from textloom.llm.tokens import encoder

SHARES, PORTIONS, GROUPS = (1 / 4, 1 / 3, 1 / 2), (1.0, 1 / 4, 1 / 8), 64


# --- the plan -----------------------------------------------------------------------------------


def group(counts: np.ndarray, groups: int) -> np.ndarray:
    """The rounded-up size of each length: its group's longest. ``counts`` is by length."""
    lengths = np.flatnonzero(counts)
    total = np.cumsum(counts[lengths])
    which = np.minimum((total - 1) * groups // max(int(total[-1]), 1), groups - 1) if len(lengths) else total
    top = np.zeros(len(counts), np.int64)
    for g in np.unique(which):
        top[lengths[which == g]] = lengths[which == g].max()
    return top


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """How many of each size to put together for the greatest value (a knapsack)."""
    best = np.zeros(capacity + 1)
    taken = []
    for s, v in zip(sizes, value):
        if v > 1e-12:
            for _ in range(capacity // s):
                more = np.full(capacity + 1, -1.0)
                more[s:] = best[:-s] + v
                use = more > best + 1e-12
                if not use.any():
                    break
                best = np.where(use, more, best)
                taken.append((s, use))
    room, content = int(np.argmax(best)), np.zeros(len(sizes), np.int64)
    total = float(best[room])
    index = {int(s): i for i, s in enumerate(sizes)}
    for s, use in reversed(taken):
        if use[room]:
            content[index[int(s)]] += 1
            room -= int(s)
    return total, content


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with the number of sequences that get each: the linear optimum, rounded down."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    while True:
        inverse = np.linalg.inv(basis)
        dual = inverse.sum(axis=0)
        value, column = best_configuration(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        x, step = inverse @ demand, inverse @ column
        able = step > 1e-9
        ratio = np.where(able, np.maximum(x, 0) / np.where(able, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, i].astype(np.int64), int(n)) for i, n in enumerate(np.floor(x + 1e-6)) if n > 0]


@dataclass
class Plan:
    """Placement runs sorted by length and first rank, and how many sequences there are."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    configured: int


def plan(counts: np.ndarray, capacity: int, groups: int = GROUPS, shares: tuple[float, ...] = SHARES, portions: tuple[float, ...] = PORTIONS) -> Plan:
    """``counts``: pieces of each length from 0 to ``capacity``.

    The share of the capacity beyond which a piece is large, and the portion of the configurations
    that is carried out, trade their quality against the loss by rounding up: a place is as long
    as its group's longest piece, and what a shorter one leaves must find a small piece. So several
    are tried; the fewest sequences win, and of equal plans the one with the most pieces in
    configurations of several.
    """
    tried = []
    for share in shares:
        for portion in portions:
            tried.append(_plan(counts, capacity, groups, share, portion))
            if not tried[-1].configured:
                break
    return min(tried, key=lambda p: (p.sequences, -p.configured))


def _plan(counts: np.ndarray, capacity: int, groups: int, small: float, portion: float = 1.0) -> Plan:
    runs: list[tuple[int, int, int, int]] = []
    used = np.zeros(capacity + 1, np.int64)
    rest = counts.astype(np.int64).copy()
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    n_sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), sequence, offset))
        used[length] += n
        rest[length] -= n

    def open_room(room: int, sequence: int, n: int) -> None:
        if room and n:
            rooms[room].append((sequence, n))

    large = np.arange(capacity + 1) > capacity * small
    top = group(np.where(large, counts, 0), groups)
    sizes = np.unique(top[top > 0])
    demand = np.array([counts[top == s].sum() for s in sizes])
    queues = {int(s): [int(x) for x in np.flatnonzero(top == s)[::-1]] for s in sizes}
    configured = 0
    for content, n in configurations(sizes, demand, capacity):
        n = int(n * portion)
        configured += n * int(content.sum()) if content.sum() > 1 else 0
        first, n_sequences = n_sequences, n_sequences + n
        parts = [(first, n, 0)]
        for s in np.repeat(sizes, content)[::-1]:
            lengths, after = queues[int(s)], []
            for at, many, offset in parts:
                while many and lengths:
                    take = min(many, int(rest[lengths[0]]))
                    if take:
                        put(lengths[0], take, at, offset)
                        after.append((at, take, offset + lengths[0]))
                        at, many = at + take, many - take
                    if not rest[lengths[0]]:
                        lengths.pop(0)
                if many:
                    after.append((at, many, offset))
            parts = after
        for at, many, offset in parts:
            open_room(capacity - offset, at, many)
    for length in range(capacity, 0, -1):
        room = length
        while rest[length] and room <= capacity:
            if not rooms[room]:
                room += 1
                continue
            at, many = rooms[room].pop()
            _fill(rest, put, open_room, length, at, many, room, capacity)
        if rest[length]:
            each = capacity // length
            many = -(-int(rest[length]) // each)
            first, n_sequences = n_sequences, n_sequences + many
            _fill(rest, put, open_room, length, first, many, capacity, capacity)
    r = np.array(runs, np.int64).reshape(-1, 4)
    r = r[np.lexsort((r[:, 1], r[:, 0]))]
    return Plan(*r.T, n_sequences, configured)


def _fill(rest, put, open_room, length: int, at: int, many: int, room: int, capacity: int) -> None:
    """Put pieces of ``length`` into ``many`` sequences from ``at`` that have ``room`` left each."""
    each, left = room // length, int(rest[length])
    whole = min(many, left // each)
    for k in range(each):
        if whole:
            put(length, whole, at, capacity - room + k * length)
    open_room(room - each * length, at, whole)
    at, many, left = at + whole, many - whole, left - whole * each
    if many and left:
        for k in range(left):
            put(length, 1, at, capacity - room + k * length)
        open_room(room - left * length, at, 1)
        at, many = at + 1, many - 1
    if many:
        open_room(room, at, many)


# --- the corpus ---------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, text: str, keep: list[str], tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``doc``, ``piece``, ``start``, ``length``, ``ids`` (unsigned 32-bit, little-endian), and
    ``part`` and ``nth``: the task, and the number among its pieces of that length."""
    d = small_batches(docs).select(F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("doc"), F.col(quoted(text)).cast("string").alias("text"))
    schema = T.StructType([d.schema["doc"], *T.StructType.fromDDL("piece int, start long, length int, ids binary, part int, nth long").fields])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, added=True), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, piece, start, ids = [], [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                code = (encode(x) if x else b"") + end
                n = len(code) // 4
                a, k = 0, 0
                while a < n:
                    z = a + ((n - a) % capacity or capacity)
                    row.append(i), piece.append(k), start.append(a), ids.append(code[4 * a : 4 * z])
                    a, k = z, k + 1
            if not row:
                continue
            length = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            order = np.argsort(length, kind="stable")
            same = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - (np.cumsum(same) - same)[length[order]] + seen[length[order]]
            seen += same
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length.astype(np.int32)), pa.array(ids, pa.binary()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)], names=schema.names)

    return d.mapInArrow(cut, schema)


@dataclass
class Packing:
    """``pieces``: the written table of pieces and ids; ``counts``: how many of each part and length."""

    pieces: DataFrame
    counts: DataFrame
    plan: Plan

    def placed(self, *columns: Column | str) -> DataFrame:
        """Those columns of the pieces, with ``sequence_id`` and ``offset``."""
        p = self.plan
        own = [F.col(c).alias(c) if isinstance(c, str) else c for c in columns]
        rows = self.pieces.select(*own, F.col("part").alias("_part"), F.col("length").alias("_length"), F.col("nth").alias("_nth"))
        before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        base = self.counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), "n").withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        ranked = rows.join(base.hint("merge"), ["_part", "_length"]).withColumn("_rank", F.col("_nth") + F.col("_base"))
        ranked = ranked.select(*rows.columns[:-3], "_length", "_rank")
        schema = T.StructType([*ranked.schema.fields[:-2], *T.StructType.fromDDL("sequence_id long, offset long").fields])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = np.searchsorted(p.length, np.arange(len(p.length) and int(p.length[-1]) + 2))
            for b in batches:
                if not b.num_rows:
                    continue
                length, rank = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
                run = np.empty(len(length), np.int64)
                for x in np.unique(length):
                    at = length == x
                    run[at] = first[x] + np.searchsorted(p.rank[first[x] : first[x + 1]], rank[at], side="right") - 1
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(p.sequence[run] + rank - p.rank[run]), pa.array(p.offset[run])], names=schema.names)

        return ranked.mapInArrow(place, schema)

    def sequences(self) -> DataFrame:
        """``sequence_id``, ``n_tokens`` and ``ids`` of each sequence, its pieces joined."""
        rows = self.placed("length", "ids").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("all"), F.sum("length").alias("n_tokens"))
        return rows.select("sequence_id", "n_tokens", F.aggregate("all", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack(docs: DataFrame, *, tokenizer: str, text: str = "text", keep: list[str] | None = None, capacity: int = 2048, end_id: int = 0) -> Packing:
    """Pack the documents' ids, each followed by ``end_id``."""
    pieces = store.written(token_pieces(docs, text, docs.columns if keep is None else keep, tokenizer, capacity, end_id), "pieces")
    counts = store.written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    by_length = np.zeros(capacity + 1, np.int64)
    by_length[histogram.column("length").to_numpy()] = histogram.column("n").to_numpy()
    return Packing(pieces, counts, plan(by_length, capacity))
