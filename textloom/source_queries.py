"""Queries over sources and sinks: the driver's tables are written in a source's format and read
back by its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.index import Index
from textloom.operators.search import run_rows
from textloom.queries import BATCH, CLEAN_SQL, SQL, TOP_SQL, D, index, rank_sql, register, scratch, table
from textloom.sources import readers, sinks

DIGEST = "CAST(len(toks) AS BIGINT) AS dl, md5(array_to_string(toks, ' ')) AS digest"


def digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "dl", F.md5(F.array_join("tokens", " ")).alias("digest"))


def lines(df: DataFrame, path: str, *columns, **options) -> str:
    """``df`` as JSON lines."""
    df.select(*columns).write.mode("overwrite").options(ignoreNullFields="false", **options).json(path)
    return path


def whole(df: DataFrame, path: str, value) -> str:
    """One file with one JSON value made of all rows; for files that are small by their nature."""
    df.agg(value.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def array_of(*columns) -> Column:
    return F.to_json(F.array_sort(F.collect_list(F.struct(*columns))))


@register("source_jsonl", f"WITH {D} SELECT doc_id, {DIGEST} FROM d")
def _(spark, sf):
    path = lines(table(spark, sf, "documents"), scratch(spark, "jsonl", sf), F.col("doc_id").alias("id"), "text")
    return digest(readers.documents(spark, path))


@register("source_jsonl_gzip", f"WITH {D} SELECT doc_id, {DIGEST} FROM d")
def _(spark, sf):
    path = lines(table(spark, sf, "documents"), scratch(spark, "jsonl-gzip", sf), F.col("doc_id").alias("id"), "text", compression="gzip")
    return digest(readers.documents(spark, path))


@register("source_jsonl_tokens", f"WITH {D} SELECT doc_id, {DIGEST} FROM d")
def _(spark, sf):
    tokens = F.concat(F.array(F.lit(None).cast("string")), X.light_tokens(F.col("text")))
    path = lines(table(spark, sf, "documents"), scratch(spark, "jsonl-tokens", sf), F.col("doc_id").alias("id"), tokens.alias("tokens"), F.lit("unused").alias("text"))
    return digest(readers.documents(spark, path))


@register("source_jsonl_shadow", f"WITH {D} SELECT doc_id, {DIGEST} FROM d JOIN documents USING (doc_id) WHERE lang <> 'en'")
def _(spark, sf):
    """A first line without text hides the later one of its id: here those of English texts."""
    path, docs = scratch(spark, "jsonl-shadow", sf), table(spark, sf, "documents")
    lines(docs.where("lang = 'en'"), f"{path}/a", F.col("doc_id").alias("id"))
    lines(docs, f"{path}/b", F.col("doc_id").alias("id"), "text")
    return digest(readers.documents(spark, f"{path}/*"))


@register("source_docs_lenient", f"WITH {D} SELECT doc_id, CASE WHEN lang = 'en' THEN 2 ELSE CAST(len(toks) AS BIGINT) END AS dl, CASE WHEN lang = 'en' THEN md5('x Y') ELSE md5(array_to_string(toks, ' ')) END AS digest FROM d JOIN documents USING (doc_id)")
def _(spark, sf):
    """The last line of an id counts: for English texts one with tokens alone."""
    path, docs = scratch(spark, "docs-lenient", sf), table(spark, sf, "documents")
    lines(docs, f"{path}/a", "doc_id", "text")
    lines(docs.where("lang = 'en'"), f"{path}/b", F.col("doc_id").alias("id"), F.array(F.lit("x"), F.lit("Y")).alias("tokens"))
    return digest(readers.documents_lenient(spark, f"{path}/*"))


@register("source_queries", "SELECT 'b' || item_id AS qid, text AS query FROM benchmark")
def _(spark, sf):
    path = whole(table(spark, sf, "benchmark"), scratch(spark, "queries", sf), array_of(F.concat(F.lit("b"), "item_id").alias("qid"), F.col("text").alias("query")))
    return readers.queries(spark, path)


@register("source_queries_lenient", "SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark")
def _(spark, sf):
    path = whole(table(spark, sf, "benchmark"), scratch(spark, "queries-lenient", sf), array_of(F.col("item_id").alias("query_id"), "text"))
    return readers.queries_lenient(spark, path)


QRELS_SQL = "SELECT source AS qid, doc_id, CAST(quality AS DOUBLE) AS rel FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND source IS NOT NULL"


def graded(spark, sf) -> DataFrame:
    """A query for each source, with its documents' quality as grades."""
    return table(spark, sf, "labels").where("quality is not null").join(table(spark, sf, "documents").where("source is not null").select("doc_id", "source"), "doc_id").select("source", "doc_id", "quality")


@register("source_judgments", QRELS_SQL)
def _(spark, sf):
    per = graded(spark, sf).groupBy("source").agg(F.collect_list(F.struct(F.col("doc_id").alias("document_id"), F.col("quality").alias("label"))).alias("docs"))
    return readers.judgments(spark, whole(per, scratch(spark, "judgments", sf), array_of(F.col("source").alias("id"), "docs")))


@register("source_judgments_map", QRELS_SQL)
def _(spark, sf):
    per = graded(spark, sf).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), "quality"))).alias("m"))
    value = F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "m"))))
    return readers.judgments(spark, whole(per, scratch(spark, "judgments-map", sf), value))


@register("source_judgments_lenient", QRELS_SQL)
def _(spark, sf):
    """Flat rows wrapped in an object, one of them malformed."""
    rows = graded(spark, sf).select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("doc"), F.col("quality").cast("string").alias("grade"))
    rows = rows.unionByName(spark.createDataFrame([("q", "x", "1"), ("q", "1", "y")], rows.schema))
    path = whole(rows, scratch(spark, "judgments-lenient", sf), F.concat(F.lit('{"data": '), array_of("query_id", "doc", "grade"), F.lit("}")))
    return readers.judgments(spark, path, strict=False)


@register("source_runs", "SELECT 'a' AS qid, doc_id, CAST(quality AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank FROM labels UNION ALL SELECT 'b', doc_id, CAST(toxic AS DOUBLE), CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) FROM labels")
def _(spark, sf):
    """Two run files, found by a pattern."""
    path, labels = scratch(spark, "runs", sf), table(spark, sf, "labels")
    for qid, score in (("a", "quality"), ("b", "toxic")):
        row = labels.agg(F.array_sort(F.collect_list(F.struct("doc_id", F.col(score).cast("double").alias("score")))).alias("results"))
        whole(row, f"{path}/{qid}", array_of(F.lit(qid).alias("qid"), "results"))
    return readers.runs(spark, f"{path}/*/part-*").select("qid", "doc_id", "score", "rank")


@register("sink_run", rank_sql(BATCH, "hybrid", TOP_SQL))
def _(spark, sf):
    path = scratch(spark, "run.json", sf)
    sinks.write_run(run_rows(index(spark, sf), BATCH), path)
    return readers.runs(spark, path).select("qid", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@register("index_saved", SQL["positions_uni"])
def _(spark, sf):
    path = scratch(spark, "saved-index", sf)
    Index(index(spark, sf).docs).save(path)
    return Index.load(spark, path).postings.select("term", "doc_id", "tf", "positions")


@register("index_key_order", "SELECT 0 AS unsorted")
def _(spark, sf):
    """Rows of the stored postings that come before a smaller key in their file: none."""
    rows = index(spark, sf).postings.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.struct("term", "doc_id").alias("key"))
    order = Window.partitionBy("file").orderBy("n")
    return rows.withColumn("before", F.lag("key").over(order)).agg(F.count_if(F.col("before") > F.col("key")).cast("int").alias("unsorted"))


VECTORS_SQL = "SELECT word, CAST(dim - 1 AS INTEGER) AS dim, round(CAST(x AS DOUBLE), 4) + 0e0 AS x FROM (SELECT word, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM (SELECT 'v' || vec_id AS word, embedding AS vec FROM embeddings UNION ALL SELECT '<unk>', embedding FROM embeddings WHERE vec_id = 0))"


@register("source_vectors", VECTORS_SQL)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.select(F.concat(F.lit("v"), "vec_id").alias("word"), "embedding").unionByName(e.where("vec_id = 0").select(F.lit("<unk>").alias("word"), "embedding"))
    path = scratch(spark, "vectors", sf)
    e.select(F.concat_ws(" ", "word", F.transform("embedding", lambda x: x.cast("string"))).alias("value")).write.mode("overwrite").text(path)
    out = readers.word_vectors(spark, path).select("word", F.posexplode("vec").alias("dim", "x"))
    return out.select("word", "dim", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


@register("source_trec_judgments", QRELS_SQL)
def _(spark, sf):
    path = scratch(spark, "trec", sf)
    graded(spark, sf).select(F.concat_ws(" ", "source", F.lit("0"), "doc_id", "quality").alias("value")).write.mode("overwrite").text(path)
    return readers.trec_judgments(spark, path)


@register("source_trec_lists", "SELECT lang AS qid, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS rank FROM documents WHERE lang IS NOT NULL")
def _(spark, sf):
    path = scratch(spark, "trec-lists", sf)
    per = table(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    per.select(F.concat(F.col("lang"), F.lit(": "), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)
    return readers.trec_lists(spark, path)


#: A fragment with every step of cleaning, and what it comes to.
ODD, CLEANED = "<p>AT&amp;T &amp; so­ft a​b ＡＢ ␣x\x07y &lt;b&gt;z&lt;/b&gt;</p><script>no</script>", " AT§AMP§T and soft a b AB x y z"


@register("html_clean_steps", f"SELECT page_id, text || '{CLEANED}' AS text FROM ({CLEAN_SQL})")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean_html(F.concat("html", F.lit(ODD))).alias("text"))
