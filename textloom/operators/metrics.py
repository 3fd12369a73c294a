"""Retrieval quality of ranked runs against graded judgments.

``run(qid, doc_id, rank)``; ``qrels(qid, doc_id, rel)``, relevant if above 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.operators.rank import METHODS, rank
from textloom.sources import readers


def _deduped(run: DataFrame) -> DataFrame:
    """Each document at its first place, places counted anew."""
    first = run.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``qid``, ``n_rel``, ``n_ret``, ``ap`` and ``rr`` at ``k`` (no cutoff if it isn't positive) of
    every judged query; those without a run get 0."""
    rel = qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))
    judged = rel.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("n_rel"))
    ranked = _deduped(run)
    size = ranked.groupBy("qid").agg(F.count("*").alias("n_ret"))
    if k > 0:
        ranked = ranked.where(F.col("rank") <= k)
    hits = ranked.join(rel.where(F.col("rel") > 0), ["qid", "doc_id"])
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    scored = hits.groupBy("qid").agg(F.sum(F.col("nth") / F.col("rank")).alias("gain"), F.min("rank").alias("best"))
    out = judged.join(size, "qid", "left").join(scored, "qid", "left")
    return out.select(
        "qid",
        "n_rel",
        F.coalesce("n_ret", F.lit(0)).alias("n_ret"),
        F.coalesce(F.col("gain") / F.when(F.col("n_rel") > 0, F.col("n_rel")), F.lit(0.0)).alias("ap"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"),
    )


def summary(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: ``map``, ``mrr``, ``n_queries`` and ``n_covered`` (judged queries with results)."""
    q = per_query(run, qrels, k)
    return q.agg(F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.count("*").alias("n_queries"), F.count_if(F.col("n_ret") > 0).alias("n_covered"))


def leaderboard(runs: dict[str, DataFrame], qrels: DataFrame, k: int = 10) -> DataFrame:
    """``run`` with its summary, best MAP first, ties by name."""
    parts = [summary(r, qrels, k).select(F.lit(name).alias("run"), "*") for name, r in sorted(runs.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("map"), "run")


def leaderboard_of_files(spark: SparkSession, paths: list[str], qrels: DataFrame, k: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """The leaderboard of run files by name, and the files skipped, each with what is wrong."""
    found, skipped = [], {}
    for path in paths:
        try:
            found.append((path.rstrip("/").rsplit("/", 1)[-1], *summary(readers.runs(spark, path), qrels, k).first()))
        except Exception as e:  # noqa: BLE001 - whatever is wrong with one file, the others count
            skipped[path] = (str(e).strip().splitlines() or [type(e).__name__])[0]
    board = spark.createDataFrame(found, "run string, map double, mrr double, n_queries long, n_covered long")
    return board.orderBy(F.desc("map"), "run"), skipped


def pearson(pairs: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """``keys`` and ``r`` over all pairs; 0 for fewer than two pairs or no variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    means = pairs.groupBy(*keys).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.count("*").alias("_n"))
    joined = pairs.join(F.broadcast(means), list(keys)) if keys else pairs.join(F.broadcast(means))
    da, db = a - F.col("_ma"), b - F.col("_mb")
    sums = joined.groupBy(*keys).agg(F.sum(da * db).alias("_ab"), F.sum(da * da).alias("_aa"), F.sum(db * db).alias("_bb"), F.first("_n").alias("_n"))
    r = F.when((F.col("_n") < 2) | (F.col("_aa") <= 0) | (F.col("_bb") <= 0), 0.0).otherwise(F.try_divide(F.col("_ab"), F.sqrt("_aa") * F.sqrt("_bb")))
    return sums.select(*keys, F.coalesce(r, F.lit(0.0)).alias("r"))


def judged_candidates(index: Index, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """``qid`` and ``doc_id``: a query's judged documents, or all for a query without any.

    A judged document that isn't in the index is an error.
    """
    asked = queries.select("qid").distinct()
    judged = qrels.join(asked, "qid", "left_semi").select("qid", "doc_id").distinct()
    absent = judged.join(index.docs, "doc_id", "left_anti").first()
    if absent:
        raise KeyError(f"document {absent.doc_id}, judged for {absent.qid}, isn't in the index")
    bare = [r.qid for r in asked.join(judged, "qid", "left_anti").collect()]
    if not bare:
        return judged
    every = index.docs.select(F.explode(F.array(*[F.lit(q) for q in bare])).alias("qid"), "doc_id")
    return judged.unionByName(every)


def compare_rankers(index: Index, queries: DataFrame, qrels: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """``method`` and ``r`` over the judged candidates of all queries, best first."""
    candidates = judged_candidates(index, queries, qrels)
    return compare_methods({m: rank(index, candidates, queries, m) for m in methods}, qrels)


def compare_methods(scored: dict[str, DataFrame], qrels: DataFrame) -> DataFrame:
    """``method`` and Pearson's ``r`` of its scores with the grades (0 where not judged), best first."""
    grades = qrels.select("qid", "doc_id", F.col("rel").cast("double"))
    every = None
    for name, s in sorted(scored.items()):
        part = s.join(grades, ["qid", "doc_id"], "left").select(F.lit(name).alias("method"), "score", F.coalesce("rel", F.lit(0.0)).alias("rel"))
        every = part if every is None else every.unionByName(part)
    return pearson(every, "score", "rel", "method").orderBy(F.desc("r"), "method")
