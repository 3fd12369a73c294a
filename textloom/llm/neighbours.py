"""Approximate nearest neighbours by cosine: a hash-prefix forest.

Each tree gives every vector a long hash string, the signs of its products with random directions,
and keeps the strings as a sorted array, so all vectors that share a prefix with a query are one
range of it. A search descends each tree to the longest prefix that it shares with a query and
ascends all trees together, a bit at a time, until their ranges hold enough candidates; those are
scored exactly on the original vectors.

The arrays are dealt by tree and leading bits of the string, so a query only visits the part of
each tree that it can ascend to. A part with many rows is cut into blocks, which the part's own
queries visit all. How far a search may ascend (``floor``, the leading bits that deal the parts) and
how many candidates are enough (``least``) are measured, not set: for a bounded sample of queries
the true neighbours are found by scoring all rows, and the deepest floor and the fewest
candidates are taken with which the forest holds the wanted share of them. Where prefixes tell
little of nearness, as among unstructured vectors, that means short prefixes and much scoring.

1. Strings of all rows; the sample's true neighbours, and the prefixes shared with them.
2. For each query, tree and prefix length the number of rows, from the strings alone; the
   sums over the trees give each query its level.
3. The ranges at that level are scored; of each part and block the best ``k`` are left.

Of equal vectors only the ``k + 1`` smallest ids, each in at most ``k`` rows, can be among anyone's
nearest, so others are dropped before the exchange. Queries equal in id and vector are one query.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without an id; vectors are compared with those of their own dimension, however long;
repeated ids are rows of their own, and a query is no neighbour of rows with its id; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import store
from textloom.llm.rows import quoted

BLOCK, TREES, BITS = 4096, 12, 32
SAMPLE, RECALL = 64, 0.95


def codes(vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 3) -> np.ndarray:
    """The hash string of each vector in each tree, as a number; the first bit is the highest."""
    directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], trees * bits))
    signs = (vectors @ directions > 0).reshape(len(vectors), trees, bits)
    return (signs * (np.int64(1) << np.arange(bits - 1, -1, -1))).sum(axis=2)


def shared_prefix(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """How many leading bits strings have in common."""
    return bits - np.ceil(np.log2((a ^ b) + 1.0)).astype(np.int64)


def ranges(sorted_: np.ndarray, asked: np.ndarray, level, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Where in a sorted array the strings begin and end that share ``level`` bits with each asked one."""
    rest = (np.int64(1) << (bits - level)) - 1
    return np.searchsorted(sorted_, asked & ~rest, side="left"), np.searchsorted(sorted_, asked | rest, side="right")


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _coded(v: DataFrame) -> DataFrame:
    """The rows with their strings, ``codes``."""

    def run(batches):
        for b in batches:
            size = b.column("dim").to_numpy()
            out = np.zeros((b.num_rows, TREES), np.int64)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                out[at] = codes(_matrix(b.column("v").take(pa.array(at)), len(at)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, TREES, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "codes"])

    return v.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema) + ", codes array<long>")


def _best(at: np.ndarray, near: np.ndarray, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of the rows ``at``, by ``near`` up to its noise, then by the exact cosine."""
    if len(at) > k:
        at = at[near >= np.partition(near, len(near) - k)[-k] - 1e-9 * np.sqrt(query @ query)]
    score = (rows[at] * query).sum(axis=1) / (np.sqrt((rows[at] * rows[at]).sum(axis=1)) * np.sqrt((query * query).sum()))
    best = np.lexsort((ids[at], -score))[:k]
    return at[best], score[best]


def _sample(rows: DataFrame, asked: DataFrame, k: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Some queries, and for each of their true neighbours the query's place in the list and the
    longest prefix shared in any tree."""
    some = asked.orderBy(F.xxhash64("id", F.lit(5)), "ask").limit(SAMPLE).collect()
    queries = [(r.id, r.dim, np.array(r.v, np.float64)) for r in some]

    def run(batches):
        for b in batches:
            ids, size = b.column("id").to_numpy(), b.column("dim").to_numpy()
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                x = _matrix(b.column("v").take(pa.array(own)), len(own))
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                for n, (i, d, q) in enumerate(queries):
                    at = np.flatnonzero(ids[own] != i) if d == dim else []
                    if len(at):
                        best, score = _best(at, unit[at] @ q, x, ids[own], q, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), n)), pa.array(score), b.column("id").take(pa.array(own[best])), b.column("codes").take(pa.array(own[best]))], names=["n", "score", "id", "codes"])

    found = rows.select("id", "dim", "v", "codes").mapInArrow(run, "n long, score double, id long, codes array<long>")
    order = Window.partitionBy("n").orderBy(F.desc("score"), "id")
    true = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("n", "codes").toArrow()
    n = true.column("n").to_numpy()
    own = np.array([r.codes for r in some], np.int64).reshape(-1, TREES)
    near = _matrix(true.column("codes"), len(n)).astype(np.int64) if len(n) else np.zeros((0, TREES), np.int64)
    return [r.ask for r in some], n, shared_prefix(own[n], near).max(axis=1) if len(n) else np.zeros(0, np.int64)


def neighbours(vectors: DataFrame, query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, recall: float = RECALL, report: dict | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` for the rows that satisfy ``query``.

    ``report`` gets the measured ``floor``, ``least``, ``recall`` of the sample and ``share``, the
    mean number of rows scored for a query (with repeats over trees) over all rows.
    """
    v = vectors.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vector)).alias("v"), query.alias("q"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    repeat, twin = Window.partitionBy("v", "id").orderBy("id"), Window.partitionBy("v").orderBy("id")
    rows = v.drop("q").withColumn("nth", F.row_number().over(repeat)).where(F.col("nth") <= k)
    rows = rows.withColumn("nth", F.dense_rank().over(twin)).where(F.col("nth") <= k + 1).drop("nth")
    asked = v.where(F.coalesce("q", F.lit(False))).drop("q").dropDuplicates(["id", "v"])
    rows = store.written(_coded(rows.withColumn("row", F.monotonically_increasing_id())), "rows")
    asked = store.written(_coded(asked.withColumn("ask", F.monotonically_increasing_id())), "asked")
    sample, of, reach = _sample(rows, asked, k)
    total = rows.count()
    floor = max((f for f in range(BITS + 1) if len(reach) and (reach >= f).mean() >= min(1.0, recall + 0.02)), default=0)

    deal = F.shiftright(F.col("code"), BITS - floor)
    in_trees = lambda df, *names: df.select(*names, "dim", F.posexplode("codes").alias("tree", "code")).withColumn("part", deal)
    sizes = in_trees(rows).groupBy("dim", "tree", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = store.written(sizes, "parts")
    by = ["dim", "tree", "part", "block"]
    blocks_of = lambda df: df.join(sizes, ["dim", "tree", "part"])
    left = lambda *names: blocks_of(in_trees(asked, "ask", *names)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = lambda *names: blocks_of(in_trees(rows, "row", *names)).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        asks, levels = a.column("ask").to_numpy() if a.num_rows else np.zeros(0, np.int64), np.arange(floor, BITS + 1)
        n = np.zeros((len(asks), len(levels)), np.int64)
        if a.num_rows and b.num_rows:
            sorted_ = np.sort(b.column("code").to_numpy())
            for i, level in enumerate(levels):
                low, high = ranges(sorted_, a.column("code").to_numpy(), level)
                n[:, i] = high - low
        return pa.table({"ask": pa.array(np.repeat(asks, len(levels)), pa.int64()), "level": pa.array(np.tile(levels, len(asks)), pa.int64()), "n": pa.array(n.ravel(), pa.int64())})

    counts = left().groupBy(*by).cogroup(right().groupBy(*by)).applyInArrow(count, "ask long, level long, n long")
    counts = store.written(counts.groupBy("ask", "level").agg(F.sum("n").alias("n")), "counts")
    seen = {(r.ask, r.level): r.n for r in counts.where(F.col("ask").isin(sample)).collect()} if sample else {}

    def level_of(ask: int, least: int) -> int:
        return max((f for f in range(floor, BITS + 1) if seen.get((ask, f), 0) >= least), default=floor)

    least, got = k, 0.0
    while len(reach):
        got = float(np.mean([r >= level_of(sample[n], least) for n, r in zip(of, reach)]))
        if got >= recall or least > TREES * max(total, 1):
            break
        least = int(least * 1.25) + 1
    levels = counts.groupBy("ask").agg(F.coalesce(F.max(F.when(F.col("n") >= least, F.col("level"))), F.lit(floor)).alias("level"))
    if report is not None:
        scored = counts.join(levels.withColumnRenamed("level", "own"), "ask").where("level = own").agg(F.avg("n")).first()[0] or 0.0
        report |= {"floor": floor, "least": least, "recall": got, "share": scored / max(total, 1)}
    result = "query_id long, ask long, row long, vec_id long, score double"

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            order = np.argsort(b.column("code").to_numpy(), kind="stable")
            ids, row, sorted_ = (b.column(c).to_numpy()[order] for c in ("id", "row", "code"))
            x, q = _matrix(b.column("v"), b.num_rows)[order], _matrix(a.column("v"), a.num_rows)
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            low, high = ranges(sorted_, a.column("code").to_numpy(), a.column("level").to_numpy())
            for n, (i, ask) in enumerate(zip(a.column("id").to_numpy(), a.column("ask").to_numpy())):
                at = np.arange(low[n], high[n])
                own = ids[at] != i
                near, at = (unit[low[n] : high[n]] @ q[n])[own], at[own]
                if len(at):
                    best, score = _best(at, near, x, ids, q[n], k)
                    found.append((np.full(len(best), i), np.full(len(best), ask), row[best], ids[best], score))
        cat = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "ask", "row", "vec_id", "score"), cat, [pa.int64()] * 4 + [pa.float64()])})

    asked_at = left("id", "v").join(levels, "ask")
    best = asked_at.groupBy(*by).cogroup(right("id", "v").groupBy(*by)).applyInArrow(search, result).dropDuplicates(["ask", "row"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
