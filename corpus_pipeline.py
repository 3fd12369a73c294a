"""A training corpus from raw documents: quality, line dedup, near-dedup, decontamination, packing.

Every stage takes all that the one before kept. All but the last return the columns of their input;
the last returns the placement of token pieces in sequences. Documents with null or empty texts
stay where a stage has no reason to drop them; documents of which line deduplication leaves no
line that isn't blank are dropped. Very long texts are taken whole. Of rows that repeat an id and a
text, and of ties within a near-duplicate group, one row stays. Columns of any other name pass
through as they are, and an empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import store
from textloom.llm.decontaminate import contamination
from textloom.llm.lines import line_dedup
from textloom.llm.neardup import near_duplicates, one_of_each
from textloom.llm.packing import pack
from textloom.llm.quality import quality
from textloom.llm.queries import tokenizer_path

MIN_QUALITY = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fields(docs: DataFrame) -> list:
    return [F.col("doc")[c].alias(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``MIN_QUALITY``."""
    return quality(docs, _table(spark, sf_dir, "labels")).where(F.col("score") >= MIN_QUALITY).select(*_fields(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of one line or more; ``n_chars`` follows."""
    out = line_dedup(docs, min_lines=1)
    blank = F.trim(F.translate("kept", "\n\t\r\x0b\x0c", "     ")) == ""
    out = out.where(~F.coalesce((F.size("removed") > 0) & blank, F.lit(False)))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("removed") > 0, F.char_length("kept")).otherwise(F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return one_of_each(near_duplicates(docs)).select(*_fields(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return contamination(docs, _table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select(*_fields(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    packed = pack(docs, tokenizer=tokenizer_path(), keep=["doc_id"])
    return packed.placed(F.col("doc.doc_id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]

#: A trained classifier and a tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
