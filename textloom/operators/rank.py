"""Rankers over candidate documents: BM25 variants, TF-IDF cosine, their blend, and a rerank.

All take ``candidates(qid, doc_id)`` and ``queries(qid, query)`` and give ``(qid, doc_id, score)``
for every candidate, also those without any query term. Frequencies of terms are of the whole
collection, term counts of the candidate. Sums run in the order of the query's terms, so scores
don't depend on how rows arrive.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import light_tokens
from textloom.operators.index import Index

METHODS = ("bm25", "bm25plus", "tfidf", "hybrid", "semantic")
DEFAULT = "hybrid"
BUDGET, DEPTH, DIM = 20, 10, 256
#: Most distinct words of a batch's queries that go to the scan as literals.
LITERALS = 1000
#: Scores that differ by less are equal: the last bits of a sum depend on how it was summed.
NOISE, DIGITS = 1e-12, 10


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid``, ``term``, ``qtf`` and ``ord`` (first place) of the queries' words."""
    words = queries.select("qid", F.posexplode(light_tokens(F.col("query"))).alias("pos", "term"))
    return words.groupBy("qid", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("ord"))


def idf_classic(n: Column, df: Column) -> Column:
    return F.when(n > 0, F.ln((n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def idf_floored(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), idf_classic(n, df))


def idf_smooth(n: Column, df: Column) -> Column:
    return F.when(n > 0, F.ln((n + 1) / (df + 1)) + 1).otherwise(1.0)


def _bm25(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    norm = k1 * (1 - b + b * dl / F.when(avgdl == 0, 1.0).otherwise(avgdl))
    return idf * tf * (k1 + 1) / (tf + norm)


def _ordered_sum(value: Column) -> Column:
    parts = F.array_sort(F.collect_list(F.struct("ord", value.alias("x"))))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["x"])


def channels(index: Index, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid``, ``doc_id`` and the scores ``bm25``, ``bm25plus`` and ``tfidf``, from one aggregation."""
    q = query_terms(queries)
    asked = [r.term for r in q.select("term").distinct().limit(LITERALS + 1).collect()]
    # Literal words reach the scan, which then reads their ranges alone.
    only = (lambda df: df.where(F.col("term").isin(sorted(asked)))) if len(asked) <= LITERALS else (lambda df: df)
    q = q.join(F.broadcast(index.stats))
    q = q.join(only(index.terms), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    q = q.withColumn("smooth", idf_smooth(F.col("n"), F.col("df")))
    q = q.withColumn("qw", F.col("qtf") * F.col("smooth"))
    norms = q.groupBy("qid").agg(F.sqrt(_ordered_sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    hits = only(index.postings).select("term", "doc_id", "tf").join(F.broadcast(q), "term").join(candidates, ["qid", "doc_id"]).join(index.docs.select("doc_id", "dl"), "doc_id")
    c = lambda *names: [F.col(n) for n in names]
    n, df, tf, dl, avgdl = c("n", "df", "tf", "dl", "avgdl")
    dw = tf * F.col("smooth")
    scored = hits.groupBy("qid", "doc_id").agg(
        _ordered_sum(_bm25(idf_classic(n, df), tf, dl, avgdl, 1.2, 0.75)).alias("bm25"),
        _ordered_sum(_bm25(idf_floored(n, df), tf, dl, avgdl, 1.4, 0.7)).alias("bm25plus"),
        _ordered_sum(F.col("qw") * dw).alias("dot"),
        F.sqrt(_ordered_sum(dw * dw)).alias("d_norm"),
    )
    out = candidates.join(scored, ["qid", "doc_id"], "left").join(F.broadcast(norms), "qid", "left")
    unit = lambda x: F.when(F.coalesce(x, F.lit(0.0)) == 0, 1.0).otherwise(x)
    cosine = F.coalesce("dot", F.lit(0.0)) / (unit(F.col("q_norm")) * unit(F.col("d_norm")))
    zero = F.lit(0.0)
    return out.select("qid", "doc_id", F.coalesce("bm25", zero).alias("bm25"), F.coalesce("bm25plus", zero).alias("bm25plus"), cosine.alias("tfidf"))


def _hybrid(c: DataFrame) -> DataFrame:
    """Both channels scaled to 0..1 over a query's candidates, 0 where they are all equal; the raw
    BM25 scores where both are."""
    ends = c.groupBy("qid").agg(*[f(x).alias(f"{n}_{x}") for x in ("bm25plus", "tfidf") for n, f in (("low", F.min), ("high", F.max))])
    c = c.join(ends, "qid")
    low, high = (lambda x: F.col(f"low_{x}")), (lambda x: F.col(f"high_{x}"))
    even = lambda x: high(x) - low(x) <= NOISE * F.greatest(F.lit(1.0), F.abs(high(x)))
    scaled = lambda x: F.when(even(x), 0.0).otherwise((F.col(x) - low(x)) / (high(x) - low(x)))
    score = F.when(even("bm25plus") & even("tfidf"), F.col("bm25plus")).otherwise(0.8 * scaled("bm25plus") + 0.2 * scaled("tfidf"))
    return c.select("qid", "doc_id", score.alias("score"))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, key=b"13").digest(), "big")


@F.pandas_udf(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("sign", T.IntegerType())]))
def projected(terms: pd.Series) -> pd.DataFrame:
    """Place and sign of each word in the hash projection (keyed BLAKE2b; no built-in has it)."""
    return pd.DataFrame({"idx": [_hash(t + "|proj") % DIM for t in terms], "sign": [1 - 2 * (_hash(t + "|sign") & 1) for t in terms]})


def hash_vectors(words: DataFrame, *keys: str) -> DataFrame:
    """Sparse unit vectors ``keys``, ``idx``, ``val`` of rows ``keys``, ``term``, ``tf``.

    Each distinct word is hashed once.
    """
    vocabulary = words.select("term").distinct().withColumn("h", projected("term"))
    cells = words.join(vocabulary, "term").groupBy(*keys, F.col("h.idx").alias("idx")).agg(F.sum(F.col("tf") * F.col("h.sign")).cast("double").alias("val"))
    norm = cells.groupBy(*keys).agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    return cells.where("val <> 0").join(norm, list(keys)).select(*keys, "idx", (F.col("val") / F.col("norm")).alias("val"))


def _semantic(index: Index, c: DataFrame, queries: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("bm25plus"), "doc_id")
    short = c.withColumn("place", F.row_number().over(order)).where(F.col("place") <= BUDGET).select("qid", "doc_id")
    texts = index.docs.select("doc_id", "tokens").join(short.select("doc_id").distinct(), "doc_id")
    words = texts.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    q = query_terms(queries).select("qid", "term", F.col("qtf").alias("tf"))
    d = hash_vectors(words, "doc_id").withColumnRenamed("val", "dv")
    dot = short.join(hash_vectors(q, "qid"), "qid").join(d, ["doc_id", "idx"]).groupBy("qid", "doc_id").agg(F.sum(F.col("val") * F.col("dv")).alias("cos"))
    short = short.join(dot, ["qid", "doc_id"], "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))
    out = c.join(short, ["qid", "doc_id"], "left")
    return out.select("qid", "doc_id", F.when(F.col("cos").isNull(), F.col("bm25plus")).otherwise(0.6 * F.col("bm25plus") + 0.4 * F.col("cos")).alias("score"))


def rank(index: Index, candidates: DataFrame, queries: DataFrame, method: str | None = None) -> DataFrame:
    """``qid``, ``doc_id``, ``score`` and ``rank`` (ties to the smaller id)."""
    m = (method or DEFAULT).lower()
    if m == "default":
        m = DEFAULT
    if m not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    c = channels(index, candidates, queries)
    if m == "hybrid":
        out = _hybrid(c)
    elif m == "semantic":
        out = _semantic(index, c, queries)
    else:
        out = c.select("qid", "doc_id", F.col(m).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", DIGITS)), "doc_id")
    return out.withColumn("rank", F.row_number().over(order))


def top(ranked: DataFrame, k: int = DEPTH) -> DataFrame:
    return ranked.where(F.col("rank") <= k)
