"""The search index: Parquet tables built from tokenised documents, and lookups in them.

* ``docs(doc_id, tokens, dl)``
* ``postings(term, doc_id, tf, positions)``, positions from 0 and ascending
* ``terms(term, df)``
* ``chargrams(gram, term)``: the 1- to 3-grams of ``$term$`` but ``$``
* ``stats(n, avgdl)``, one row

Longer n-grams aren't stored: phrases are found from positions, and ``grams`` derives their
postings. Everything is keyed by term, so no table depends on collecting a document's or a term's
rows in one place beyond one posting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X

MAX_GRAM = 3
#: Tokens that are grouped at once, and rows of a batch that is sent back.
PIECE, ROWS = 2_000_000, 200_000


def tokenised(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``tokens`` and ``dl`` of a table of texts; of equal ids the least text counts."""
    d = documents.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(F.col(text).cast("string")).alias("text"))
    return d.select("doc_id", X.light_tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))


def of_tokens(documents: DataFrame) -> DataFrame:
    """The same from ``doc_id`` and given ``tokens``; null tokens are left out."""
    tokens = F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda w: w.isNotNull())
    d = documents.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(tokens).alias("tokens"))
    return d.withColumn("dl", F.size("tokens").cast("long"))


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``PIECE`` tokens, or of one document."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield first, last
        first = last


def _found(ids: pa.Array, tokens: pa.ListArray, n: int) -> pa.RecordBatch | None:
    """Every run of ``n`` tokens of each document once, with its ascending places."""
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode(null_encoding="encode")
    code, runs = words.indices.to_numpy().astype(np.int64), np.maximum(lengths - n + 1, 0)
    if not runs.sum():
        return None
    doc = np.repeat(np.arange(len(runs)), runs)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = np.repeat(np.cumsum(lengths) - lengths, runs) + pos
    gram = code[at]
    for k in range(1, n):  # numbered anew for each word, so that a number never overflows
        gram = np.unique(gram * len(words.dictionary) + code[at + k], return_inverse=True)[1]
    key = doc * (gram.max() + 1) + gram
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends, one = np.append(first, len(key)), order[first]
    positions = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(pos[order].astype(np.int32)))
    names = words.dictionary.take(pa.array((code[at[one]] if n == 1 else code[at[one][:, None] + np.arange(n)]).ravel()))
    if n > 1:
        names = pa.ListArray.from_arrays(np.arange(len(one) + 1, dtype=np.int32) * n, names)
    return pa.record_batch([names, ids.take(pa.array(doc[one])), pa.array(np.diff(ends)), positions, pa.array(lengths[doc[one]])], ["term" if n == 1 else "gram", "doc_id", "tf", "positions", "dl"])


def occurrences(docs: DataFrame, n: int = 1) -> DataFrame:
    """``term`` (``gram`` for ``n`` above 1), ``doc_id``, ``tf``, ``positions`` and ``dl`` of documents
    with distinct ids. All of a document's tokens are in its row, so they are grouped there and none moves."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids, tokens = b.column(0), b.column(1)
            for i, j in _pieces(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                if (out := _found(ids.slice(i, j - i), tokens.slice(i, j - i), n)) is not None:
                    yield from (out.slice(k, ROWS) for k in range(0, out.num_rows, ROWS))

    name = T.StructField("term", T.StringType()) if n == 1 else T.StructField("gram", T.ArrayType(T.StringType()))
    return docs.select("doc_id", "tokens").mapInArrow(batches, T.StructType([name, docs.schema["doc_id"], T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("dl", T.LongType())]))


@dataclass
class Index:
    docs: DataFrame

    @cached_property
    def postings(self) -> DataFrame:
        return occurrences(self.docs).drop("dl")

    @cached_property
    def terms(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def words(self) -> DataFrame:
        """``term``, distinct; from the documents unless ``terms`` is there already."""
        return self.terms.select("term") if "terms" in vars(self) else self.docs.select(F.explode("tokens").alias("term")).distinct()

    @cached_property
    def stats(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    @cached_property
    def chargrams(self) -> DataFrame:
        grams = F.array_distinct(F.concat(*[X.char_ngrams(F.col("term"), n) for n in range(1, MAX_GRAM + 1)]))
        return self.terms.select(F.explode(grams).alias("gram"), "term").where(F.col("gram") != "$")

    def grams(self, n: int) -> DataFrame:
        """``gram`` and ``doc_id``, distinct, for runs of ``n`` tokens."""
        return self.gram_positions(n).select("gram", "doc_id")

    def gram_positions(self, n: int) -> DataFrame:
        """``gram``, ``doc_id`` and the ascending ``positions`` of runs of ``n`` tokens."""
        if n < 1:
            raise ValueError("n must be at least 1")
        gram = F.array("term").alias("gram") if n == 1 else "gram"
        return occurrences(self.docs, n).select(gram, "doc_id", "positions")

    def save(self, path: str) -> None:
        """Write all tables; postings and chargrams in ranges of their keys, so lookups read little."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        stored = Index(self.docs.sparkSession.read.parquet(f"{path}/docs"))
        _sorted(stored.postings, "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        stored.postings = self.docs.sparkSession.read.parquet(f"{path}/postings")
        _sorted(stored.terms, "term").write.mode("overwrite").parquet(f"{path}/terms")
        stored.terms = self.docs.sparkSession.read.parquet(f"{path}/terms")
        _sorted(stored.chargrams, "gram", "term").write.mode("overwrite").parquet(f"{path}/chargrams")
        stored.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        out = Index(spark.read.parquet(f"{path}/docs"))
        for name in ("postings", "terms", "chargrams", "stats"):
            setattr(out, name, spark.read.parquet(f"{path}/{name}"))
        return out

    def cached(self) -> Index:
        """Keep the tables that every query reads; ``uncached`` lets them go."""
        for name in ("docs", "postings", "terms"):
            setattr(self, name, getattr(self, name).persist()) if name != "docs" else self.docs.persist()
        return self

    def uncached(self) -> None:
        for name in ("docs", "postings", "terms"):
            getattr(self, name).unpersist()

    def posting_list(self, key: str | tuple[str, ...]) -> DataFrame:
        """Documents with a term, or with a run of 2 or 3 terms; other tuples match nothing."""
        if isinstance(key, str):
            return self.postings.where(F.col("term") == key).select("doc_id")
        if not 2 <= len(key) <= MAX_GRAM:
            return self.docs.where(F.lit(False)).select("doc_id")
        return self.spans([(0, i, w) for i, w in enumerate(key)]).select("doc_id")

    def spans(self, slots: list[tuple[int, int, str]], only: Column | None = None) -> DataFrame:
        """``operand``, ``doc_id`` and ``starts`` of runs of words given as (operand, place, word):
        the postings of those words alone, their positions intersected within a document."""
        words = self.docs.sparkSession.createDataFrame(slots, "operand int, place int, term string")
        size = F.broadcast(words.groupBy("operand").agg(F.count("*").alias("size")))
        rows = self.postings.where(F.col("term").isin(sorted({w for _, _, w in slots})))
        found = (rows if only is None else rows.where(only)).join(F.broadcast(words), "term")
        shifted = F.transform("positions", lambda p: p - F.col("place"))
        per_doc = found.select("operand", "doc_id", shifted.alias("starts")).groupBy("operand", "doc_id").agg(F.collect_list("starts").alias("all"))
        per_doc = per_doc.join(size, "operand").where(F.size("all") == F.col("size"))
        starts = F.array_sort(F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], F.array_intersect))
        return per_doc.select("operand", "doc_id", starts.alias("starts")).where(F.size("starts") > 0)

    def wildcard_terms(self, gram: str) -> DataFrame:
        return self.chargrams.where(F.col("gram") == gram).select("term")

    def positions(self, key: str | tuple[str, ...], doc_id: int) -> Column | DataFrame:
        """``pos`` of a term or of a run of up to 3 terms in one document."""
        if isinstance(key, str):
            found = self.postings.where((F.col("term") == key) & (F.col("doc_id") == doc_id))
            return found.select(F.explode("positions").alias("pos"))
        if not 2 <= len(key) <= MAX_GRAM:
            return self.docs.where(F.lit(False)).select(F.lit(0).alias("pos"))
        return self.spans([(0, i, w) for i, w in enumerate(key)], F.col("doc_id") == doc_id).select(F.explode("starts").alias("pos"))


class Stored(Index):
    """An index whose tables are written under ``path`` when they are first asked for, in ranges
    of their keys, and read from there after that."""

    def __init__(self, documents: DataFrame, path: str):
        self.path, self.spark = path, documents.sparkSession
        super().__init__(self._kept("docs", documents))

    def _kept(self, name: str, df: DataFrame, *keys: str) -> DataFrame:
        (_sorted(df, *keys) if keys else df).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    postings = cached_property(lambda self: self._kept("postings", Index.postings.func(self), "term", "doc_id"))
    terms = cached_property(lambda self: self._kept("terms", Index.terms.func(self), "term"))
    stats = cached_property(lambda self: self._kept("stats", Index.stats.func(self)))
    chargrams = cached_property(lambda self: self._kept("chargrams", Index.chargrams.func(self), "gram", "term"))


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def build(documents: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    return Index(tokenised(documents, text, key))
