import gzip
import json

import numpy as np
import pytest

from textloom import commands
from textloom.operators.index import Index
from textloom.operators.search import run_rows
from textloom.sources import readers, sinks

LINES = ['{"id": 1}', "", "{broken", '{"text": "no id"}', '{"id": "2", "text": "The Cat"}', '{"id": 2, "text": "later"}', '{"id": 3, "tokens": ["a", null, "B"], "text": "unused"}', '{"id": 4, "text": null}', '{"id": 1, "text": "shadowed"}']


@pytest.mark.parametrize("packed", [False, True])
def test_documents(spark, tmp_path, packed):
    path = tmp_path / ("d.jsonl" + ".gz" * packed)
    path.write_bytes(gzip.compress("\n".join(LINES).encode()) if packed else "\n".join(LINES).encode())
    got = {r.doc_id: list(r.tokens) for r in readers.documents(spark, str(path)).collect()}
    assert got == {2: ["the", "cat"], 3: ["a", "B"], 4: []}
    last = {r.doc_id: list(r.tokens) for r in readers.documents_lenient(spark, str(path)).collect()}
    assert last[2] == ["later"] and last[1] == ["shadowed"]


def test_encodings(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_bytes(b'\xef\xbb\xbf{"id": 1, "text": "caf\xc3\xa9"}\n{"id": 2, "text": "caf\xe9 \x80"}\n')
    assert {r.doc_id: list(r.tokens) for r in readers.documents(spark, str(p)).collect()} == {1: ["caf\u00e9"], 2: ["caf\u00e9", "\u20ac"]}


def test_queries_and_runs(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"qid": "Q1", "query": "a b"}, {"qid": "Q2", "query": "x\ny"}]))
    assert [(r.qid, r.query) for r in readers.queries(spark, str(q)).collect()] == [("Q1", "a b"), ("Q2", "x\ny")]
    q.write_text(json.dumps([{"id": 7, "text": "a"}]))
    assert [tuple(r) for r in readers.queries_lenient(spark, str(q)).collect()] == [("7", "a")]
    with pytest.raises(Exception, match="a query has no qid"):
        readers.queries(spark, str(q)).collect()
    run = tmp_path / "runs" / "run_a.json"
    ix = Index(spark.createDataFrame([(1, ["a"], 1)], "doc_id long, tokens array<string>, dl long"))
    sinks.write_run(run_rows(ix, [("Q1", "a"), ("Q2", "zz")]), str(run))
    got = readers.runs(spark, str(tmp_path / "runs" / "*.json")).collect()
    assert [(r.run, r.qid, r.doc_id, r["rank"]) for r in got] == [("run_a.json", "Q1", 1, 1)]


@pytest.mark.parametrize(
    "content",
    [
        {"q": {"5": 2, "6": 0}}, {"qrels": {"q": {"5": "2", "6": "0"}}}, [{"qid": "q", "relevance_scores": {"5": 2, "6": 0}}], [{"qid": "q", "relevance": {"5": 2, "6": 0}}],
        {"qrels": [{"id": "q", "relevance_scores": {"5": 2, "6": 0}}]}, {"labels": [{"qid_str": "q", "document_id": 5, "label": 2}, {"query_id": "q", "doc": 6, "score": 0}]}, {"x": [{"qid": "q", "relevance": {"5": 2, "6": 0}}]},
        [{"qid": "q", "docs": [{"doc_id": 5, "grade": 2}, {"document_id": "6"}]}, {"docs": [{"id": 1}]}, 7, {"qid": "q"}], [{"qid": "", "id": "q", "doc_id": 5, "label": 1}, {"id": "q", "doc_id": 5, "label": 2}, {"id": "q", "doc": 6}],
        [{"qid": "q", "docs": [{"doc_id": 5, "grade": 2}, {"id": "6", "rel": 0}]}], [{"qid": "q", "doc_id": 5, "rel": 2}, {"qid": "q", "doc_id": 6, "rel": 0}],
    ],
)
def test_judgments(spark, tmp_path, content):
    p = tmp_path / "j.json"
    p.write_text(json.dumps(content))
    assert sorted(tuple(r) for r in readers.judgments(spark, str(p)).collect()) == [("q", 5, 2.0), ("q", 6, 0.0)]


def test_malformed_judgments(spark, tmp_path):
    p = tmp_path / "j.json"
    p.write_text(json.dumps([{"qid": "q", "doc_id": "x", "rel": 1}, {"qid": "q", "doc_id": 5, "rel": "y"}, {"qid": "q", "doc_id": 6, "rel": 1}]))
    assert [tuple(r) for r in readers.judgments(spark, str(p), strict=False).collect()] == [("q", 6, 1.0)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.judgments(spark, str(p)).collect()
    p.write_text(json.dumps({"q": 3}))
    with pytest.raises(Exception, match="unknown shape"):
        readers.judgments(spark, str(p)).collect()


def test_unknown_word_is_added(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("the 0.5 1\ncat 1 2\n")
    got = {r.word: list(r.vec) for r in readers.word_vectors(spark, str(p)).collect()}
    want = np.random.default_rng(42).normal(0, 0.05, 2).astype(np.float32).tolist()
    assert got == {"the": [0.5, 1.0], "cat": [1.0, 2.0], "<unk>": want}
    p.write_text("the 0.5 1\n<unk> 1 2\n")
    assert sorted(r.word for r in readers.word_vectors(spark, str(p)).collect()) == ["<unk>", "the"]


def test_commands(spark, tmp_path, capsys):
    at = {n: str(tmp_path / n) for n in ("q.json", "d.jsonl", "j.json", "bad.json")}
    (tmp_path / "q.json").write_text(json.dumps([{"qid": "a", "query": "cat"}, {"qid": "b", "query": "NOT cat"}, {"qid": "c", "query": "zz"}]))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"id": i, "text": t}) for i, t in ((1, "a cat"), (2, "a dog"), (3, "cat cat"))))
    (tmp_path / "j.json").write_text(json.dumps({"a": {"1": 1, "2": 0}, "c": {"2": 1}}))
    (tmp_path / "bad.json").write_text('{"no": "run"}')
    run = str(tmp_path / "runs" / "r.json")
    assert commands.search(spark, at["q.json"], at["d.jsonl"], run, "bm25") == 0
    assert "b is malformed" in capsys.readouterr().err
    rows = json.loads((tmp_path / "runs" / "r.json").read_text())
    assert [r["qid"] for r in rows] == ["a", "b", "c"] and sorted(rows[0]["doc_ids"]) == [1, 3] and rows[1]["results"] == rows[2]["results"] == []
    assert commands.search(spark, at["bad.json"], at["d.jsonl"], run) == 1
    assert commands.evaluate(spark, at["j.json"], [at["bad.json"], run]) == 0
    out = capsys.readouterr()
    assert "skipped" in out.err and out.out.splitlines()[1].split("\t")[0] == "r.json"
    assert commands.evaluate(spark, at["j.json"], []) == 2


def test_plain_text_sources(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("Q1 0 5 2\nQ1 0 6 0\n")
    assert [tuple(r) for r in readers.trec_judgments(spark, str(p)).collect()] == [("Q1", 5, 2.0), ("Q1", 6, 0.0)]
    p.write_text("Q1: 5 6\nQ2 7\n")
    assert [tuple(r) for r in readers.trec_lists(spark, str(p)).collect()] == [("Q1", 5, 1), ("Q1", 6, 2), ("Q2", 7, 1)]
    p.write_text("the 0.5 1\nbad x 1\n\ncat 1 2\n")
    assert [(r.word, list(r.vec)) for r in readers.word_vectors(spark, str(p), 2).where("word <> '<unk>'").collect()] == [("the", [0.5, 1.0]), ("cat", [1.0, 2.0])]


def test_trec_lists_splits_a_line_once(spark, tmp_path):
    """Not anew for each of its documents, above the generator."""
    p = tmp_path / "lists.txt"
    p.write_text("Q1: " + " ".join(str(i) for i in range(3000)) + "\n")
    df = readers.trec_lists(spark, str(p))
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert df.where("qid = 'Q1' and rank = doc_id + 1").count() == 3000
