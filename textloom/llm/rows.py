"""One result row for each input row, computed in Python over Arrow batches.

The input row travels untouched in a struct column ``doc``, so result columns can't clash with
whatever columns the input has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch, whichever comes first.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def small_batches(df: DataFrame) -> DataFrame:
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def per_text(docs: DataFrame, text: str, keep: list[str], results: str, fn: Callable[[pa.Array], list[pa.Array]], extra: dict | None = None) -> DataFrame:
    """``doc`` (the columns ``keep``) and the columns of the DDL ``results``.

    ``fn`` gets the texts of a batch (null where null) and returns an array for each result column,
    as long as the batch. ``extra`` names columns that ``fn`` also gets, in that order.
    """
    extra = extra or {}
    docs = small_batches(docs)
    d = docs.select(
        F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("doc"),
        F.col(quoted(text)).cast("string").alias("_text"),
        *[c.alias(f"_x{i}") for i, c in enumerate(extra.values())],
    )
    schema = T.StructType([d.schema["doc"], *T.StructType.fromDDL(results).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = fn(b.column(1), *b.columns[2:])
                yield pa.RecordBatch.from_arrays([b.column(0), *made], names=schema.names)

    return d.mapInArrow(run, schema)
