"""Writers of runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_run(rows: DataFrame, path: str) -> None:
    """A run as one JSON array, at any path that Spark can write to; parent folders are made.

    Rows are one for each query with at most some ten results.
    """
    out = [{"qid": r.qid, "doc_ids": list(r.doc_ids), "results": [{"doc_id": x.doc_id, "score": x.score} for x in r.results]} for r in rows.select("qid", "doc_ids", "results").toLocalIterator()]
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(json.dumps(out, indent=2).encode())
    finally:
        stream.close()
