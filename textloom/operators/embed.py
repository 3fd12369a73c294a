"""Document vectors pooled from word vectors.

``vectors(word, vec)`` should hold the unknown word ``<unk>``, which stands for words it lacks;
without it they count as zeros. Documents without words get zeros, and no document is lost.

Documents go in blocks of some ``BLOCK`` words. A block gets each of its vectors once, with the
words that have it, and its documents are summed there, so what moves are texts and a block's
distinct vectors: never a vector for each word of a document, nor partial sums of one. Ids of
documents are distinct, as in an index; a document's words and their vectors must fit a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.shared import shared_dir

METHODS = ("mean", "max", "sum", "meanmax", "tfidf_weighted")
UNKNOWN = "<unk>"
#: Words of a block; (document, word) pairs summed at once; what joins a document's words on their way.
BLOCK, STEP, MARK = 4_000_000, 100_000, "\x1f"


def coded(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word``, ``code`` and ``code``, ``vec``: equal vectors have one code, a hash of 64 bits."""
    rows = vectors.select("word", "vec", F.xxhash64("vec").alias("code"))
    return rows.select("word", "code"), rows.groupBy("code").agg(F.any_value("vec").alias("vec"))


def _matrix(vecs: pa.Array, width: int, missing: np.ndarray) -> np.ndarray:
    """Lists as rows of ``width`` numbers, ``missing`` where a list has none, and ``missing`` as last row."""
    out = np.empty((len(vecs) + 1, width), np.float32 if pa.types.is_float32(vecs.type.value_type) else np.float64)
    flat = vecs.flatten()
    if not flat.null_count and len(flat) == len(vecs) * width and pc.all(pc.equal(pc.list_value_length(vecs), width)).as_py() is not False:
        out[:-1] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    else:
        for i, v in enumerate(vecs.to_pylist()):
            v = (v or [])[:width]
            out[i] = [m if x is None else x for x, m in zip(v + [None] * (width - len(v)), missing)]
    out[-1] = missing
    return out


def _words(docs: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The documents' words and their documents' places."""
    parts = []
    for places, lists in (
        (pc.indices_nonzero(pc.is_valid(docs["joined"])), lambda d: pc.split_pattern(d["joined"], MARK)),
        (pc.indices_nonzero(pc.is_valid(docs["tokens"])), lambda d: d["tokens"]),
    ):
        found = lists(docs.take(places)).combine_chunks()
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        parts.append((places.to_numpy().astype(np.int64)[pc.list_parent_indices(found).to_numpy().astype(np.int64)], found.flatten()))
    at, words = np.concatenate([a for a, _ in parts]), pa.concat_arrays([w.cast(pa.string()) for _, w in parts])
    there = pc.is_valid(words)
    return at[there.to_numpy(zero_copy_only=False)], words.filter(there)


def _pool(method: str, width: int, unknown: list[float], n: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A block's documents pooled; for ``tfidf_weighted`` the sums of known words, their weights' sum
    and the number of unknown words."""

    def block(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        docs, known = docs.combine_chunks(), known.combine_chunks()
        one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
        listed, size, weighted = one(known["words"]), docs.num_rows, method == "tfidf_weighted"
        table = _matrix(one(known["vec"]), width, np.zeros(width) if weighted else np.array(unknown, np.float64))
        entries, row_of = listed.flatten(), np.append(pc.list_parent_indices(listed).to_numpy(), len(listed)).astype(np.int64)
        vocabulary = entries.field("word")
        at, words = _words(docs)
        word = pc.fill_null(pc.index_in(words, value_set=vocabulary), len(vocabulary)).to_numpy().astype(np.int64)
        pairs, tf = np.unique(at * (len(vocabulary) + 1) + word, return_counts=True)
        doc, word, tf = pairs // (len(vocabulary) + 1), pairs % (len(vocabulary) + 1), tf.astype(np.float64)
        weight, strange = tf, word == len(vocabulary)
        if weighted:
            df, dl = np.append(entries.field("df").to_numpy().astype(np.float64), n), one(docs["dl"]).to_numpy()
            weight = np.where(strange, 0.0, tf * tf / dl[doc] * np.log(n / df[word]))
        sums, tops = np.zeros((size, width)), np.full((size, width), -np.inf)
        for i in range(0, len(doc), STEP):
            d, x = doc[i : i + STEP], table[row_of[word[i : i + STEP]]].astype(np.float64)
            starts = np.flatnonzero(np.diff(d, prepend=-1))
            if "max" in method:
                tops[d[starts]] = np.maximum(tops[d[starts]], np.maximum.reduceat(x, starts))
            if method != "max":
                sums[d[starts]] += np.add.reduceat(x * weight[i : i + STEP, None], starts)
        total = np.bincount(doc, weight, size)
        tops[~(np.bincount(doc, minlength=size) > 0)] = 0.0
        if method == "mean" or method == "meanmax":
            sums /= np.where(total > 0, total, 1.0)[:, None]
        out = {"mean": [sums], "sum": [sums], "max": [tops], "meanmax": [sums, tops], "tfidf_weighted": [sums]}[method]
        out = np.concatenate(out, axis=1)
        vec = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))
        more = {"w": total, "u": np.bincount(doc, np.where(strange, tf, 0.0), size)} if weighted else {}
        return pa.table({"doc_id": docs["doc_id"], "dl": docs["dl"], "vec": vec} | {k: pa.array(v) for k, v in more.items()})

    return block


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/textloom/embed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vectors(docs: DataFrame, vectors: DataFrame | tuple[DataFrame, DataFrame], method: str, unknown: list[float] | None = None) -> DataFrame:
    """``doc_id`` and ``vec`` (doubles). ``vectors`` may be given as ``coded`` makes them, with the
    vector of unknown words apart."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if isinstance(vectors, DataFrame):
        of_unknown = vectors.where(F.col("word") == UNKNOWN).select(F.col("vec").cast("array<double>")).first()
        unknown = of_unknown[0] if of_unknown else None
        vectors = coded(vectors)
    words, table = vectors
    width = max(table.agg(F.max(F.size("vec"))).first()[0] or 0, len(unknown or []))
    unknown = [0.0 if x is None else float(x) for x in unknown or []]
    unknown += [0.0] * (width - len(unknown))
    n, total = docs.agg(F.count("*"), F.sum(F.greatest(F.size("tokens"), F.lit(0)))).first()
    joined = F.array_join("tokens", MARK)
    plain = (F.size("tokens") > 0) & (F.char_length(joined) - F.char_length(F.replace(joined, F.lit(MARK), F.lit(""))) == F.size("tokens") - 1)
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(-(-(total or 1) // BLOCK))).cast("int").alias("block"), "doc_id", F.size("tokens").alias("dl"), F.when(plain, joined).alias("joined"), F.when(~plain, F.col("tokens")).alias("tokens"))
    each = rows.repartition("block").select("block", F.explode(F.array_distinct(F.coalesce(F.split("joined", MARK), "tokens"))).alias("word"))
    each = each.groupBy("block", "word").agg(F.count("*").alias("df"))
    if method == "tfidf_weighted":
        each = each.withColumn("df", F.sum("df").over(Window.partitionBy("word")))
    known = words.where(F.col("word") != UNKNOWN).groupBy("word").agg(F.min("code").alias("code"))
    known = each.join(known, "word").repartition("code").groupBy("code", "block").agg(F.collect_list(F.struct("word", "df")).alias("words"))
    known = known.join(table.select("code", "vec"), "code").select(F.col("block").alias("part"), "words", "vec")
    fields = [docs.schema["doc_id"], T.StructField("dl", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]
    if method == "tfidf_weighted":
        fields += [T.StructField("w", T.DoubleType()), T.StructField("u", T.DoubleType())]
    out = rows.groupBy("block").cogroup(known.groupBy("part")).applyInArrow(_pool(method, width, unknown, n), T.StructType(fields))
    if method != "tfidf_weighted":
        return out.select("doc_id", "vec")
    out = _written(out)
    df = out.where("u > 0").count()
    own = F.when(F.col("u") > 0, F.col("u") * F.col("u") / F.col("dl") * F.ln(F.lit(float(n)) / F.lit(float(df or 1)))).otherwise(0.0)
    out = out.select("doc_id", F.col("vec").alias("s"), own.alias("own"), (F.col("w") + own).alias("total"))
    each = F.zip_with("s", F.array(*[F.lit(x) for x in unknown]), lambda s, u: F.when(F.col("total") == 0, 0.0).otherwise((s + F.col("own") * u) / F.col("total")))
    return out.select("doc_id", each.alias("vec"))


def pooled(docs: DataFrame, vectors: DataFrame | tuple[DataFrame, DataFrame], method: str = "mean", unknown: list[float] | None = None) -> DataFrame:
    """``doc_id``, ``dim`` and ``value`` in long form."""
    return _vectors(docs, vectors, method, unknown).select("doc_id", F.posexplode("vec").alias("dim", "value"))


def document_vectors(docs: DataFrame, vectors: DataFrame, method: str = "mean") -> DataFrame:
    """``doc_id`` and ``vec``."""
    return _vectors(docs, vectors, method).select("doc_id", F.col("vec").cast("array<float>").alias("vec"))
