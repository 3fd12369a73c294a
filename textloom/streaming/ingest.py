"""Postings of a growing document stream, appended batch by batch.

Each micro-batch writes its own immutable part of ``docs`` and ``postings`` under a batch number,
so a repeated batch replaces its part and nothing else. ``load`` reads all parts as one index;
documents must be new (an id is indexed once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import Index, tokenised


def append(batch: DataFrame, number: int, path: str) -> None:
    docs = tokenised(batch)
    docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
    stored = Index(batch.sparkSession.read.parquet(f"{path}/docs/batch={number}"))
    stored.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")


def start(documents: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Index a streaming ``documents(doc_id, text)``."""
    write = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: append(df, n, path))
    return write.trigger(**(trigger or {"availableNow": True})).start()


def load(spark: SparkSession, path: str) -> Index:
    """The index over all parts; term frequencies and statistics are those of the whole."""
    out = Index(spark.read.parquet(f"{path}/docs").select("doc_id", "tokens", "dl"))
    out.postings = spark.read.parquet(f"{path}/postings").select("term", "doc_id", F.col("tf"), "positions")
    return out
