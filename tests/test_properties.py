"""Relations between queries that hold for any corpus, on a random one."""

import random

import pytest

from textloom.operators.index import Index, of_tokens
from textloom.operators.search import search
from textloom.plans.compile import matches, parse_all, wildcard_by_grams
from textloom.plans.parser import Wild


@pytest.fixture(scope="module")
def index(spark):
    r = random.Random(4)
    rows = [(i, [r.choice(["ab", "abc", "b", "bc", "c", "ca"]) for _ in range(r.randint(0, 12))]) for i in range(60)]
    return Index(of_tokens(spark.createDataFrame(rows, "doc_id long, tokens array<string>"))).cached()


def test_sets(index):
    asked = ['"ab b"', "ab AND b", "ab OR b", "ab NEAR/1 b", "ab NEAR/2 b", "b NEAR/2 ab", "ab OR NOT b", "ab AND NOT NOT b", "ab*", "ab OR abc", "c AND NOT (ab OR b)", "c"]
    got = {q: set() for q in asked}
    for r in matches(index, parse_all([(q, q) for q in asked])).collect():
        got[r.qid].add(r.doc_id)
    docs = {r.doc_id: list(r.tokens) for r in index.docs.collect()}
    has = lambda w: {i for i, t in docs.items() if w in t}
    assert got['"ab b"'] <= got["ab NEAR/1 b"] <= got["ab NEAR/2 b"] <= got["ab AND b"] <= got["ab OR b"]
    assert got["ab NEAR/2 b"] == got["b NEAR/2 ab"] and got["ab AND NOT NOT b"] == got["ab AND b"] and got["ab*"] == got["ab OR abc"]
    assert got["ab OR NOT b"] == has("ab") | (set(docs) - has("b"))
    assert got["c AND NOT (ab OR b)"] == has("c") - has("ab") - has("b")
    assert got['"ab b"'] == {i for i, t in docs.items() if ("ab", "b") in zip(t, t[1:])}


def test_wildcard_ways_agree(index):
    terms = {r.term for r in index.terms.collect()}
    for left, right in (("a", ""), ("", "c"), ("a", "c"), ("b", "b"), ("ab", "bc")):
        want = {t for t in terms if t.startswith(left) and t.endswith(right) and len(t) >= len(left) + len(right)}
        assert {r.term for r in wildcard_by_grams(index, Wild(left, right)).collect()} == want


@pytest.mark.parametrize("method", ["bm25", "tfidf", "hybrid", "semantic"])
def test_ranking_is_a_permutation_of_the_candidates(index, method):
    got = search(index, [("q", "ab c")], method, 1000).orderBy("rank").collect()
    want = {r.doc_id for r in matches(index, parse_all([("q", "ab c")])).collect()}
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    pairs = [(-round(r.score, 9), r.doc_id) for r in got]
    assert pairs == sorted(pairs)
