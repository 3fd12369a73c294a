import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import embed, features, metrics
from textloom.operators.index import Index, of_tokens
from textloom.operators.rank import _hash, rank
from textloom.operators.search import run_rows, search
from textloom.plans.compile import matches, parse_all

CORPUS = [(11, ["amber", "harbor"]), (22, ["silver", "engine"]), (33, ["amber", "valley"])]


@pytest.fixture(scope="module")
def index(spark):
    return Index(of_tokens(spark.createDataFrame(CORPUS, "doc_id long, tokens array<string>")))


def found(index, query):
    return sorted(r.doc_id for r in matches(index, parse_all([("q", query)])).collect())


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("amber AND harbor", [11]), ('"silver engine"', [22]), ('"amber"', []), ("amb*", [11, 33]), ("amber NEAR/1 harbor", [11]), ("amber NEAR/0 harbor", []),
        ("amber AND NOT harbor", [33]), ("silver OR NOT amber", [22]), ("harbor silver", [11, 22]), ("", []), ("zzz*", []), ("Amber", []), ('"amber" NEAR/3 harbor', []),
    ],
)
def test_queries(index, query, ids):
    assert found(index, query) == ids


def test_batch_with_errors(index):
    rows = {r.qid: r for r in run_rows(index, [("a", "amber"), ("b", "NOT amber"), ("c", "zzz")]).collect()}
    assert sorted(rows["a"].doc_ids) == [11, 33] and rows["b"].error and rows["b"].doc_ids == [] and rows["c"].error is None


def test_index_tables(index, spark, tmp_path):
    assert [r.doc_id for r in index.posting_list("amber").orderBy("doc_id").collect()] == [11, 33]
    assert index.posting_list(("amber",)).count() == 0
    assert [r.doc_id for r in index.posting_list(("amber", "valley")).collect()] == [33]
    assert "amber" in {r.term for r in index.wildcard_terms("$am").collect()}
    assert index.wildcard_terms("$").count() == 0
    assert [r.pos for r in index.positions("amber", 11).collect()] == [0]
    assert tuple(index.stats.first()) == (3, 2.0)
    index.save(str(tmp_path / "ix"))
    again = Index.load(spark, str(tmp_path / "ix"))
    assert found(again, "amb* ".strip()) == [11, 33] and again.chargrams.count() == index.chargrams.count()


def test_near_overlaps_and_same_spans(spark):
    ix = Index(of_tokens(spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")))
    assert found(ix, "a NEAR/2 a") == [1] and found(ix, "a NEAR/1 a") == []
    assert found(ix, '"a b" NEAR/0 "b a"') == [1]
    assert found(ix, "b OR NOT a") == [1, 3]


def test_rankers(index, spark):
    q = spark.createDataFrame([("q", "amber harbor amber")], "qid string, query string")
    c = matches(index, parse_all([("q", "amber harbor")]))
    score = {r.doc_id: r.score for r in rank(index, c, q, "bm25").collect()}
    idf = lambda df: math.log((3 - df + 0.5) / (df + 0.5))
    assert score[33] == pytest.approx(idf(2)) and score[11] == pytest.approx(idf(2) + idf(1))
    plus = {r.doc_id: r.score for r in rank(index, c, q, "bm25plus").collect()}
    assert plus[33] == 0 and plus[11] == pytest.approx(idf(1))
    s1, s2 = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    cos = {r.doc_id: r.score for r in rank(index, c, q, "tfidf").collect()}
    assert cos[33] == pytest.approx(2 * s1 / math.hypot(2 * s1, s2))
    hybrid = {r.doc_id: (r.score, r.rank) for r in rank(index, c, q).collect()}
    assert hybrid[11][1] == 1 and hybrid[11][0] == pytest.approx(1) and hybrid[33][0] == 0
    semantic = rank(index, c, q, "semantic").collect()
    assert {r.doc_id for r in semantic} == {11, 33}
    with pytest.raises(ValueError):
        rank(index, c, q, "other")


def test_flat_candidates_fall_back(index):
    (row,) = search(index, [("q", "silver")]).collect()
    assert row.score == pytest.approx(math.log(2.5 / 1.5))
    assert all(r.score == 0 for r in search(index, [("q", "amb*")]).collect())


def test_hash_values():
    assert _hash("climate|proj") % 256 == 50 and _hash("climate|sign") % 2 == 0 and _hash("the|proj") % 256 == 126 and _hash("the|sign") % 2 == 1


def test_ngrams(spark):
    row = spark.range(1).select(
        X.word_ngrams(F.array(F.lit("a")), 2).alias("w2"), X.word_ngrams(F.array(F.lit("a")), 4).alias("w4"), X.char_ngrams(F.lit("ab c"), 3).alias("c3"), X.char_ngrams(F.lit("a"), 1).alias("c1"),
        X.char_ngrams(F.lit(None).cast("string"), 2).alias("none"), X.light_tokens(F.lit(" The Cat. \n")).alias("light"), X.windows(F.array().cast("array<string>"), 1).alias("empty"),
    ).first()
    assert row.w2 == [["<s>", "a"], ["a", "</s>"]] and row.w4 == [] and row.c3 == ["$ab", "ab$", "$c$"] and row.c1 == ["$", "a", "$"] and row.none == [] and row.light == ["the", "cat."] and row.empty == []
    with pytest.raises(ValueError):
        X.word_ngrams(F.array(), 0)


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        (None, ""), ("&lt;b&gt;x&lt;/b&gt;", "x"), ("AT&amp;T", "AT§AMP§T"), ("a &amp; b", "a and b"), ("so­ft", "soft"), ("a​b", "a b"), ("a␣b", "a b"),
        ("ＡＢ", "AB"), ("<p>un<b>closed", "un closed"), ("x<script>var a = '</p>';</script>y", "x y"), ("<!-- no -->z", "z"), ("a\x07b", "a b"),
    ],
)
def test_clean_html(spark, markup, text):
    df = spark.createDataFrame([(markup,)], "html string")
    assert df.select(X.clean_html(F.col("html")).alias("t")).first().t == text


def test_strip_html_as_its_sql(spark, tmp_path):
    """Letters beside an ampersand: of ASCII or not, and shared by two."""
    import duckdb

    from textloom.queries import QUERIES, SQL

    pages = spark.createDataFrame([(1, "<p>AT&amp;T</p>"), (2, "<p>an\u00e9&am</p>"), (3, "<p>chber\u00df&amp</p>"), (4, "a&amp;b&amp;c &amp; d"), (5, "x&\u00e9")], "page_id long, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(db.execute(SQL["html_strip"]).fetchall())
    assert dict(map(tuple, QUERIES["html_strip"](spark, str(tmp_path)).collect())) == want


def test_word_tokens(spark):
    df = spark.createDataFrame([("<p>Don't stop, AT&amp;T (now).</p>",)], "html string")
    assert df.select(X.word_tokens(F.col("html")).alias("t")).first().t == ["Do", "n't", "stop", ",", "AT&T", "(", "now", ")", "."]


def test_features(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")
    assert {r.term: r.column for r in features.vocabulary(docs).collect()} == {"b": 0, "a": 1}
    w = {(r.doc_id, r.term): r.weight for r in features.tfidf(docs, "raw").collect()}
    assert w[1, "b"] == pytest.approx(2 / 3 * math.log(3), rel=1e-5) and w[2, "a"] == pytest.approx(math.log(1.5), rel=1e-5)
    with pytest.raises(ValueError):
        features.tfidf(docs, "other")


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "x"]), (2, [])], "doc_id long, tokens array<string>")
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("<unk>", [4.0, -1.0])], "word string, vec array<float>")
    got = lambda m: {r.doc_id: list(r.vec) for r in embed.document_vectors(docs, v, m).collect()}
    assert got("mean") == {1: [2.0, 1.0], 2: [0.0, 0.0]} and got("max")[1] == [4.0, 2.0] and got("sum")[1] == [6.0, 3.0] and got("meanmax") == {1: [2.0, 1.0, 4.0, 2.0], 2: [0.0] * 4}
    assert got("tfidf_weighted")[2] == [0.0, 0.0]
    with pytest.raises(ValueError):
        embed.pooled(docs, v, "other")


def test_metrics(spark):
    run = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 1, 3), ("q", 3, 4), ("z", 9, 1)], "qid string, doc_id long, rank int")
    rel = spark.createDataFrame([("q", 2, 1.0), ("q", 3, 2.0), ("q", 7, 1.0), ("n", 1, 1.0), ("z", 9, 0.0)], "qid string, doc_id long, rel double")
    got = {r.qid: (r.ap, r.rr) for r in metrics.per_query(run, rel).collect()}
    assert got["q"] == (pytest.approx((1 / 2 + 2 / 3) / 3), 0.5) and got["n"] == (0, 0) and got["z"] == (0, 0)
    assert {r.qid: r.ap for r in metrics.per_query(run, rel, 2).collect()}["q"] == pytest.approx(1 / 6)
    assert metrics.per_query(run, rel, 0).count() == 3
    s = metrics.summary(run, rel).first()
    assert s.n_queries == 3 and s.n_covered == 2
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert metrics.pearson(flat, "x", "y").first().r == 0
    line = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0)], "x double, y double")
    assert metrics.pearson(line, "x", "y").first().r == pytest.approx(1)


def test_windows_are_linear_and_computed_once(spark):
    """The tokens aren't computed anew for each window."""
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20_000)),)], "text string")
    out = df.select(F.size(X.word_ngrams(X.light_tokens(F.col("text")), 3)).alias("n"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert out.first().n == 20_000


def test_wildcards_of_a_batch_share_one_scan(index):
    asked = [("a", "am*"), ("b", "*ver"), ("c", "s*r"), ("d", "va*y"), ("e", "ambe*er")]
    got = {}
    for r in matches(index, parse_all(asked)).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    assert got == {"a": {11, 33}, "b": {22}, "c": {22}, "d": {33}}


def test_large_batches(index):
    got = [(r.qid, r.doc_id) for r in matches(index, parse_all([(str(i), "silver") for i in range(230)])).collect()]
    assert sorted(got) == sorted((str(i), 22) for i in range(230))


def test_vectors_lose_no_document(spark):
    """Documents of unknown words alone stay, with zeros where there is no ``<unk>``."""
    docs = spark.createDataFrame([(1, ["x"]), (2, ["a", "x"]), (3, ["y", "y"]), (4, [])], "doc_id long, tokens array<string>")
    v = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vec array<float>")
    for method, two in (("mean", [0.5, 1.0]), ("sum", [1.0, 2.0]), ("max", [1.0, 2.0]), ("tfidf_weighted", None)):
        got = {r.doc_id: list(r.vec) for r in embed.document_vectors(docs, v, method).collect()}
        assert set(got) == {1, 2, 3, 4} and got[1] == got[3] == got[4] == [0.0, 0.0]
        assert two is None or got[2] == two


def test_vocabulary_of_scattered_ids(spark):
    docs = spark.createDataFrame([((i * 7919) << 40, [f"w{i}", "same"]) for i in range(500)], "doc_id long, tokens array<string>")
    got = {r.term: r.column for r in features.vocabulary(docs).collect()}
    assert got["w0"] == 0 and got["same"] == 1 and [got[f"w{i}"] for i in range(1, 500)] == list(range(2, 501))


def test_judged_candidates(index, spark):
    queries = spark.createDataFrame([("q", "amber"), ("z", "silver")], "qid string, query string")
    rel = spark.createDataFrame([("q", 11, 1.0), ("other", 99, 1.0)], "qid string, doc_id long, rel double")
    got = sorted((r.qid, r.doc_id) for r in metrics.judged_candidates(index, queries, rel).collect())
    assert got == [("q", 11), ("z", 11), ("z", 22), ("z", 33)]
    assert {r.method for r in metrics.compare_rankers(index, queries, rel).collect()} == set(metrics.METHODS)
    absent = spark.createDataFrame([("q", 99, 1.0)], "qid string, doc_id long, rel double")
    with pytest.raises(KeyError):
        metrics.judged_candidates(index, queries, absent)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_grouped_where_they_are(spark, monkeypatch):
    """Postings and grams of a document come from its row: no shuffle of its tokens."""
    monkeypatch.setattr("textloom.operators.index.PIECE", 5)
    texts = {1: ["b", "a", "b", "a", "b"], 2: [], 3: ["x"], 4: ["a"] * 9, 5: ["b", "a"]}
    ix = Index(of_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, tokens array<string>")).repartition(1))
    for n in (1, 2, 3):
        got = {(tuple(r.gram), r.doc_id): r.positions for r in ix.gram_positions(n).collect()}
        want = {}
        for i, t in texts.items():
            for k in range(len(t) - n + 1):
                want.setdefault((tuple(t[k : k + n]), i), []).append(k)
        assert got == want and {(tuple(r.gram), r.doc_id) for r in ix.grams(n).collect()} == set(want)
    assert {(r.term, r.doc_id): (r.tf, r.positions) for r in ix.postings.collect()}["a", 5] == (1, [1])
    flat = Index(spark.createDataFrame(list(texts.items()), "doc_id long, tokens array<string>"))
    assert not any("Aggregate" in plan(df) for df in (flat.postings, flat.grams(2), flat.gram_positions(2)))
    flat.terms = spark.createDataFrame([("anna", 1)], "term string, df long")
    assert "Aggregate" not in plan(flat.chargrams)
    grams = sorted(r.gram for r in flat.chargrams.collect())
    assert len(grams) == len(set(grams)) and {"a", "an", "$an", "nna", "a$"} <= set(grams)


def test_query_words_reach_the_scan(index, spark):
    queries = spark.createDataFrame([("q", "amber silver")], "qid string, query string")
    candidates = spark.createDataFrame([("q", 11)], "qid string, doc_id long")
    assert "IN (amber,silver)" in plan(rank(index, candidates, queries, "tfidf"))


def test_vectors_move_once_for_a_block(spark, monkeypatch):
    """Many blocks, words that hold the mark, lists too short; no sums of single numbers by Spark."""
    monkeypatch.setattr(embed, "BLOCK", 4)
    monkeypatch.setattr(embed, "STEP", 2)
    texts = {i: ["a", f"b{embed.MARK}c", "zz", "a", "d"][: i % 6] for i in range(1, 13)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, tokens array<string>")
    known = {"a": [1.0, 2.0], f"b{embed.MARK}c": [4.0, -1.0], "d": [1.0, 2.0], "<unk>": [0.5, 0.25]}
    v = spark.createDataFrame(list(known.items()), "word string, vec array<float>")
    out = embed.document_vectors(docs, v, "meanmax")
    assert "partial_sum" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: list(r.vec) for r in out.collect()}
    for i, t in texts.items():
        rows = [known.get(w, known["<unk>"]) for w in t] or [[0.0, 0.0]]
        assert got[i] == pytest.approx([sum(c) / len(rows) for c in zip(*rows)] + [max(c) for c in zip(*rows)], abs=1e-6)


def test_terms_are_counted_in_their_row(spark, monkeypatch):
    """For TF-IDF no shuffle of tokens by document, and the vocabulary without the postings."""
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "doc_id long, tokens array<string>")
    got = {(r.doc_id, r.term): r.weight for r in features.tfidf(docs, "raw").collect()}
    assert got == {(1, "a"): pytest.approx(2 / 3 * math.log(3)), (1, "b"): pytest.approx(1 / 3 * math.log(1.5)), (2, "b"): pytest.approx(math.log(1.5))}
    assert "doc_id" not in "".join(x for x in plan(features.tfidf(docs, "log")).splitlines() if "Aggregate" in x)
    ix = Index(docs)
    monkeypatch.setattr(Index, "postings", None)
    assert sorted(r.term for r in ix.words.collect()) == ["a", "b"]
