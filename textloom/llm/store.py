"""Tables in the folder that driver and executors share.

Lineage is cut by writing Parquet there and reading it back, so a lost executor costs a
reread and never a recomputation of the whole job. The shuffle files that a table was made from
are deleted as soon as it is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.shared import shared_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as zstd Parquet into the shared folder and read back."""
    return read(df.sparkSession, write(df, name, partition_by), df)


def write(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    conf = df.sparkSession.conf
    path = f"{shared_dir(df.sparkSession)}/textloom/{name}-{uuid.uuid4().hex}"
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        # A plan made before keeps the setting of its time, so this makes a new one.
        out = df.select("*").write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return path


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any longer."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
