"""Readers of documents, queries, judgments, runs and word vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import light_tokens

_VARIANT = "id string, doc_id string, text string, tokens array<string>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (ascending within a file) and ``value``; gzip by its ending."""
    value = decoded(F.col("value").cast("binary"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), value.alias("value"))


def _windows_1252() -> tuple[str, str]:
    """Latin-1's control characters and what Windows-1252 has at their places."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs if c)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 without its mark, or as Windows-1252 where they aren't UTF-8."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.translate(F.decode(content, "ISO-8859-1"), *_windows_1252())), "^\\ufeff", "")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``tokens`` and ``dl`` from JSON lines with ``id`` and ``tokens`` or ``text``.

    Blank and broken lines and those without an id are skipped; an id that is no integer fails; of
    equal ids the first line counts, even if it has neither field, and such documents are skipped;
    ``tokens`` wins over ``text``.
    """
    rows = _lines(spark, path).where(F.trim("value") != "")
    j = F.from_json("value", "id string, text string, tokens array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    has = lambda k: F.array_contains(F.json_object_keys("value"), k)
    rows = rows.withColumn("j", j).where(F.col("j").isNotNull() & F.col("j._bad").isNull() & F.col("j.id").isNotNull())
    rows = rows.select("file", "line", F.col("j.id").cast("long").alias("doc_id"), "j.text", "j.tokens", has("tokens").alias("has_tokens"), has("text").alias("has_text"))
    first = Window.partitionBy("doc_id").orderBy("file", "line")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1 and (has_tokens or has_text)")
    given = F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda w: w.isNotNull())
    tokens = F.when(F.col("has_tokens"), given).otherwise(light_tokens(F.col("text")))
    return rows.select("doc_id", tokens.alias("tokens"), F.size(tokens).cast("long").alias("dl"))


def documents_lenient(spark: SparkSession, path: str) -> DataFrame:
    """The same with ``doc_id`` or ``id``, ``text`` before ``tokens``, and the last of equal ids."""
    rows = _lines(spark, path).where(F.trim("value") != "").withColumn("j", F.from_json("value", _VARIANT))
    rows = rows.select("file", "line", F.coalesce("j.doc_id", "j.id").cast("long").alias("doc_id"), "j.text", "j.tokens").where("doc_id is not null")
    last = Window.partitionBy("doc_id").orderBy(F.desc("file"), F.desc("line"))
    rows = rows.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    tokens = F.when(F.col("text").isNotNull(), light_tokens(F.col("text"))).otherwise(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda w: w.isNotNull()))
    return rows.select("doc_id", tokens.alias("tokens"), F.size(tokens).cast("long").alias("dl"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """``qid`` and ``query`` of a JSON array; a row without either fails."""
    rows = spark.read.schema("qid string, query string").json(path, multiLine=True)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a query has no {c}")).cast("string")).otherwise(F.col(c)).alias(c)
    return rows.select(need("qid"), need("query"))


def queries_lenient(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("qid string, id string, query_id string, qid_str string, query string, text string").json(path, multiLine=True)
    return rows.select(F.coalesce("qid", "id", "query_id", "qid_str").alias("qid"), F.coalesce("query", "text").alias("query"))


#: The names that fields of judgment files go by, the first present one counts. Fixed values.
QUERY_KEYS = ("qid", "query_id", "id", "qid_str")
DOC_KEYS = ("doc_id", "id", "document_id")
FLAT_DOC_KEYS = ("doc_id", "document_id", "doc")
GRADE_KEYS = ("rel", "score", "label", "relevance", "grade")
LIST_KEYS = ("qrels", "relevance", "judgments", "labels", "data")


def _object(value: Column) -> Column:
    """A JSON object as a map to its values' text; null for anything else."""
    return F.from_json(F.when(F.ltrim(value).startswith("{"), value), "map<string,string>")


def _items(value: Column) -> Column:
    return F.from_json(F.when(F.ltrim(value).startswith("["), value), "array<string>")


def _field(row: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(row, F.lit(k)) for k in keys])


def judgments(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``qid``, ``doc_id`` and ``rel`` from any of the known JSON shapes.

    An object of objects (possibly under ``qrels`` or ``judgments``), or an array of rows, by itself
    or as a value of an object. A row names its query and has ``relevance_scores``, a document and
    a grade of its own, ``relevance``, or a list ``docs`` of such pairs; the first of these counts,
    and a pair without a grade has grade 0. Rows without a query are skipped; of repeated pairs the
    last counts. Malformed numbers fail if ``strict``, else they are skipped.
    """
    value = spark.read.text(path, wholetext=True).select(F.col("value").alias("v")).select("v", _object(F.col("v")).alias("top"))
    listed = lambda x: F.when(F.ltrim(x).startswith("["), x)
    named = [listed(F.try_element_at("top", F.lit(k))) for k in LIST_KEYS]
    first = F.get(F.filter(F.map_values("top"), lambda x: F.coalesce(F.ltrim(x).startswith("["), F.lit(False))), F.lit(0))
    value = value.select("top", F.coalesce(listed(F.col("v")), *named, first).alias("rows"))
    objects = lambda m: F.forall(F.map_values(m), lambda x: F.coalesce(F.ltrim(x).startswith("{"), F.lit(False)))
    inner = F.coalesce(*[_object(F.try_element_at("top", F.lit(k))) for k in ("qrels", "judgments")])
    nested = F.when(objects(inner), inner).when(objects("top"), F.col("top"))
    nested = F.coalesce(nested, F.raise_error(F.lit("unknown shape of judgments")).cast("map<string,string>"))
    maps = value.where("rows is null").select(F.posexplode(nested).alias("n", "qid", "m"))
    maps = maps.select(F.lit(0).alias("n"), "qid", F.posexplode(_object(F.col("m"))).alias("at", "doc_id", "rel"))
    rows = value.where("rows is not null").select(F.posexplode(_items(F.col("rows"))).alias("n", "r"))
    rows = rows.select("n", _object(F.col("r")).alias("r")).where("r is not null")
    qid = F.coalesce(*[F.nullif(F.try_element_at("r", F.lit(k)), F.lit("")) for k in QUERY_KEYS])
    pair = lambda d, r: F.struct(d.alias("doc_id"), F.coalesce(r, F.lit("0")).alias("rel"))
    of_map = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("doc_id"), e["value"].alias("rel")))
    own, many = _field(F.col("r"), FLAT_DOC_KEYS), F.transform(_items(F.try_element_at("r", F.lit("docs"))), _object)
    pairs = F.coalesce(
        of_map(_object(F.try_element_at("r", F.lit("relevance_scores")))),
        F.when(own.isNotNull(), F.array(pair(own, _field(F.col("r"), GRADE_KEYS)))),
        of_map(_object(F.try_element_at("r", F.lit("relevance")))),
        F.transform(F.filter(many, lambda d: _field(d, DOC_KEYS).isNotNull()), lambda d: pair(_field(d, DOC_KEYS), _field(d, GRADE_KEYS))),
    )
    rows = rows.select("n", qid.alias("qid"), pairs.alias("pairs")).where("qid is not null")
    rows = rows.select("n", "qid", F.posexplode("pairs").alias("at", "p")).select("n", "qid", "at", "p.doc_id", "p.rel")
    every = maps.unionByName(rows)
    if strict:
        every = every.select("n", "at", "qid", F.col("doc_id").cast("long").alias("doc_id"), F.col("rel").cast("double").alias("rel"))
    else:
        every = every.select("n", "at", "qid", F.col("doc_id").try_cast("long").alias("doc_id"), F.col("rel").try_cast("double").alias("rel"))
        every = every.where("doc_id is not null and rel is not null")
    return every.groupBy("qid", "doc_id").agg(F.max_by("rel", F.struct("n", "at")).alias("rel"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """``run`` (file name), ``qid``, ``doc_id``, ``score`` and ``rank`` of one or many run files.

    Of equal query ids in a file the last counts; rows without an id or results fail.
    """
    schema = "qid string, results array<struct<doc_id:long,score:double>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("run"), F.monotonically_increasing_id().alias("n"), "qid", "results")
    bad = F.col("qid").isNull() | F.col("results").isNull()
    rows = rows.withColumn("qid", F.when(bad, F.raise_error(F.lit("a run row needs qid and results")).cast("string")).otherwise(F.col("qid")))
    last = Window.partitionBy("run", "qid").orderBy(F.desc("n"))
    rows = rows.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    return rows.select("run", "qid", F.posexplode("results").alias("pos", "r")).select("run", "qid", "r.doc_id", "r.score", (F.col("pos") + 1).alias("rank"))


def word_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``word`` and ``vec`` of lines ``word v1 v2 ...``; malformed lines are skipped.

    A file without ``<unk>`` gets one: normal, of deviation 0.05 and a fixed seed.
    """
    parts = F.split(F.rtrim("value"), " ")
    rows = spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("float")).alias("vec"))
    ok = (F.col("word") != "") & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull())
    rows = rows.where(ok & (F.size("vec") == dim) if dim else ok)
    first = rows.select(F.size("vec")).first()
    if not first:
        return rows
    unknown = np.random.default_rng(seed=42).normal(0.0, 0.05, size=first[0]).astype(np.float32)
    added = spark.createDataFrame([("<unk>", unknown.tolist())], "word string, vec array<float>")
    return rows.unionByName(added.join(rows.where(F.col("word") == "<unk>").select("word"), "word", "left_anti"))


def trec_judgments(spark: SparkSession, path: str) -> DataFrame:
    """``qid``, ``doc_id``, ``rel`` of lines ``qid 0 doc grade``."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(p[0].alias("qid"), p[2].cast("long").alias("doc_id"), p[3].cast("double").alias("rel"))


def trec_lists(spark: SparkSession, path: str) -> DataFrame:
    """``qid``, ``doc_id`` and ``rank`` of lines ``qid d1 d2 ...`` or ``qid: d1 d2 ...``."""
    p = F.split(F.trim("value"), r":?\s+")
    # The query's id is taken before the line is exploded: beside the generator the line would be split anew for each of its documents.
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p")).select(F.get("p", F.lit(0)).alias("qid"), F.slice("p", 2, F.size("p") - 1).alias("ids"))
    rows = rows.select("qid", F.posexplode("ids").alias("pos", "d"))
    return rows.select("qid", F.col("d").cast("long").alias("doc_id"), (F.col("pos") + 1).alias("rank"))
