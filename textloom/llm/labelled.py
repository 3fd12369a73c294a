"""Labelled samples and held-out splits for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.rows import quoted


def remainder(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, *, key: str, keep: Column, most: int, columns: dict[str, Column]) -> DataFrame:
    """At most ``most`` labelled keys, chosen by hash among those that satisfy ``keep``, joined
    with the documents that have them: ``y``, ``part`` (hash bits for splits) and ``columns``.

    Only the bounded sample of keys is broadcast, and only its texts are shuffled: of documents that
    repeat an id the least counts, so there are no more rows than keys.
    """
    k = F.col(quoted(key))
    order = F.xxhash64(k, F.lit(7))
    rows = labels.where(k.isNotNull() & F.col(quoted(label)).isin(0, 1) & keep).select(k.alias("_k"), F.col(quoted(label)).cast("int").alias("y"), order.alias("part"))
    rows = rows.distinct().orderBy("part", "_k", "y").limit(most)
    d = docs.where(k.isNotNull()).select(k.alias("_k"), *[c.alias(n) for n, c in columns.items()])
    one = d.join(F.broadcast(rows), "_k").groupBy("_k", "y", "part").agg(F.min(F.struct(*columns)).alias("_d"))
    return one.select("y", "part", "_d.*")


#: Bits of the table of marks that tells which documents may have a label.
_MARKS = 1 << 24


def every(docs: DataFrame, labels: DataFrame, label: str, *, key: str, keep: Column, columns: dict[str, Column]) -> DataFrame:
    """All labelled keys that satisfy ``keep``, joined with the documents that have them: ``y``,
    ``part`` (hash bits for splits) and ``columns``.

    Nothing that grows is broadcast: a table of marks of bounded size, set for each key's hash, keeps most
    texts without a label out of the shuffle, and the join decides. Of documents that repeat an id the
    least counts.
    """
    k = F.col(quoted(key))
    rows = labels.where(k.isNotNull() & F.col(quoted(label)).isin(0, 1) & keep).select(k.alias("_k"), F.col(quoted(label)).cast("int").alias("y"), F.xxhash64(k, F.lit(7)).alias("part")).distinct()
    d = docs.where(k.isNotNull()).select(k.alias("_k"), *[c.alias(n) for n, c in columns.items()])
    if d.schema["_k"].dataType == rows.schema["_k"].dataType:
        place = F.pmod(F.xxhash64("_k", F.lit(11)), F.lit(_MARKS))
        word, bit = F.shiftright(place, 6).cast("int"), F.pmod(place, F.lit(64)).cast("int")
        marks = rows.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("_m"))
        d = d.withColumns({"_w": word, "_b": bit}).join(F.broadcast(marks), "_w").where(F.getbit("_m", F.col("_b")) == 1)
    one = d.groupBy("_k").agg(F.min(F.struct(*columns)).alias("_d"))
    return one.join(rows, "_k").select("y", "part", "_d.*")
