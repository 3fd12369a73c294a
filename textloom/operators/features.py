"""TF-IDF features in sparse form: one row for each term of a document; absent is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.index import occurrences

MODES, RANGES = ("raw", "log", "bm25"), 128


def vocabulary(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``term`` and ``column``: places by first occurrence, documents in order of ``order``.

    The place is a count of the first occurrences before it: within a document by a window, and
    over documents by running sums of their numbers of new terms, in ranges of documents that
    hold about as many each, so no task sorts the whole vocabulary, whatever the ids are.
    """
    at = docs.select(F.col(order).alias("doc"), F.posexplode("tokens").alias("pos", "term"))
    first = at.groupBy("term").agg(F.min(F.struct("doc", "pos")).alias("at")).select("term", "at.doc", "at.pos")
    inside = first.withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1)
    new = first.groupBy("doc").agg(F.count("*").alias("n"))
    ends = docs.agg(F.percentile_approx(F.col(order), [i / RANGES for i in range(1, RANGES)], 50 * RANGES)).first()[0] or []
    ends = F.array(*[F.lit(x) for x in sorted(set(ends))]).cast(T.ArrayType(docs.schema[order].dataType))
    new = new.withColumn("range", F.size(F.filter(ends, lambda x: x <= F.col("doc"))))
    before = Window.partitionBy("range").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = new.groupBy("range").agg(F.sum("n").alias("total"))
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
    new = new.join(totals, "range").select("doc", (F.col("base") + F.col("before")).alias("base"))
    return inside.join(new, "doc").select("term", (F.col("base") + F.col("nth")).cast("long").alias("column"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(docs: DataFrame) -> DataFrame:
    """``term``, ``df`` and ``idf`` = ln(N / df), N with empty documents."""
    n = docs.agg(F.count("*").alias("n"))
    return document_frequency(docs).join(F.broadcast(n)).select("term", "df", F.ln(F.col("n") / F.col("df")).cast("float").alias("idf"))


def _tf(mode: str, tf: Column, dl: Column, k: float) -> Column:
    if mode == "raw":
        return tf / dl
    if mode == "log":
        return 1 + F.ln(tf)
    return (k + 1) * tf / (k + tf)


def tfidf(docs: DataFrame, mode: str = "raw", k: float = 1.2) -> DataFrame:
    """``doc_id``, ``term`` and ``weight``."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    counts = occurrences(docs).select("doc_id", "dl", "term", "tf")
    weight = _tf(mode, F.col("tf"), F.col("dl"), k).cast("float") * F.col("idf")
    return counts.join(idf(docs), "term").select("doc_id", "term", weight.cast("float").alias("weight"))


def as_vectors(weights: DataFrame, columns: DataFrame) -> DataFrame:
    """``doc_id`` and a map from column to weight, for use as sparse rows."""
    return weights.join(columns, "term").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "weight")))).alias("features"))
