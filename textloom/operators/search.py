"""Batch search: parse, match, rank and cut, as one plan for all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.operators.rank import DEPTH, rank, top
from textloom.plans.compile import matches, parse_all


def search(index: Index, queries: list[tuple[str, str]], method: str | None = None, k: int = DEPTH) -> DataFrame:
    """``qid``, ``doc_id``, ``score`` and ``rank`` of the first ``k`` documents of each query.

    Documents are matched by the parsed query and ranked by the raw query's words, operators and
    quotes included.
    """
    named = index.docs.sparkSession.createDataFrame(queries, "qid string, query string")
    return top(rank(index, matches(index, parse_all(queries)), named, method), k)


def run_rows(index: Index, queries: list[tuple[str, str]], method: str | None = None, k: int = DEPTH) -> DataFrame:
    """One row for each query, also without results: ``qid``, ``error``, ``doc_ids``, ``results``."""
    spark = index.docs.sparkSession
    status = spark.createDataFrame([(i, p.qid, p.error) for i, p in enumerate(parse_all(queries))], "n int, qid string, error string")
    found = search(index, queries, method, k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r"))
    out = status.join(found, "qid", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<rank:int,doc_id:long,score:double>>")))
    return out.orderBy("n").select("qid", "error", F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("r", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("results"))
