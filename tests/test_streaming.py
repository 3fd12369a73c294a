from textloom.operators.search import search
from textloom.streaming import ingest


def test_parts_make_one_index(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "ix")
    for rows in ([(1, "a cat"), (2, "a dog")], [(3, "a cat and a cat")]):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        ingest.start(stream, out, str(tmp_path / "check")).awaitTermination(120)
    ix = ingest.load(spark, out)
    assert {r.term: r.df for r in ix.terms.collect()}["cat"] == 2
    assert {r.doc_id for r in search(ix, [("q", "cat")]).collect()} == {1, 3}
