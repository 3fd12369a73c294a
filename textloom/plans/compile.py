"""A batch of parsed queries as one DataFrame plan.

Leaves of all queries are numbered. Each kind of leaf gives a relation (leaf, doc_id); their union
is grouped once by query and document, and each query's tree becomes a predicate over the set of
leaves found. Only queries whose predicate holds with no leaf at all (some with NOT) touch the
table of all documents. Leaf tables are made on the driver from the queries alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.plans.parser import And, Near, Not, Or, Phrase, QueryError, Term, Wild, holds, leaves, parse


@dataclass
class Parsed:
    qid: str
    query: str
    tree: object = None
    error: str | None = None


def parse_all(queries: list[tuple[str, str]]) -> list[Parsed]:
    """Malformed queries carry their error and match nothing."""
    out = []
    for qid, query in queries:
        try:
            out.append(Parsed(qid, query, parse(query)))
        except QueryError as e:
            out.append(Parsed(qid, query, None, str(e)))
    return out


def _term_leaves(index: Index, rows: list[tuple[int, str]]) -> DataFrame:
    names = index.docs.sparkSession.createDataFrame(rows, "leaf int, term string")
    return index.postings.where(F.col("term").isin(sorted({t for _, t in rows}))).join(F.broadcast(names), "term").select("leaf", "doc_id")


def _wild_leaves(index: Index, rows: list[tuple[int, Wild]]) -> DataFrame:
    """The vocabulary's terms that fit any of the patterns, then one join with the postings."""
    names = index.docs.sparkSession.createDataFrame([(n, w.left, w.right) for n, w in rows], "leaf int, left string, right string")
    term, left, right = F.col("term"), F.col("left"), F.col("right")
    # Literal patterns reach the scan; prefix and suffix may not overlap.
    some = reduce(lambda a, b: a | b, [term.startswith(w.left) & term.endswith(w.right) for _, w in rows])
    fits = term.startswith(left) & term.endswith(right) & (F.char_length(term) >= F.char_length(left) + F.char_length(right))
    words = index.terms.select("term").where(some).join(F.broadcast(names), fits).select("leaf", "term")
    return index.postings.select("term", "doc_id").join(words, "term").select("leaf", "doc_id").distinct()


def wildcard_by_grams(index: Index, w: Wild) -> DataFrame:
    """The terms of a wildcard by its character grams first and the pattern last."""
    sides = ["$" + w.left] if w.left else []
    sides += [w.right + "$"] if w.right else []
    grams = sorted({s[i : i + n] for s in sides for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {"$"})
    fits = F.col("term").startswith(w.left) & F.col("term").endswith(w.right) & (F.char_length("term") >= len(w.left) + len(w.right))
    hit = index.chargrams.where(F.col("gram").isin(grams)).groupBy("term").agg(F.count("*").alias("n"))
    return hit.where((F.col("n") == len(grams)) & fits).select("term")


def _near_leaves(index: Index, rows: list[tuple[int, Near]]) -> DataFrame | None:
    """Both operands' spans in a document, compared within its arrays."""
    slots, meta = [], []
    for leaf, near in rows:
        sides = [(s.word,) if isinstance(s, Term) else s.words for s in (near.left, near.right)]
        if any(isinstance(s, Phrase) and len(s.words) == 1 for s in (near.left, near.right)):
            continue  # one-word phrases match nothing
        for side, words in enumerate(sides):
            slots += [(2 * leaf + side, i, w) for i, w in enumerate(words)]
        meta.append((leaf, len(sides[0]), len(sides[1]), near.distance))
    if not meta:
        return None
    spans = index.spans(slots)
    side = lambda k: spans.where(F.col("operand") % 2 == k).select((F.col("operand") / 2).cast("int").alias("leaf"), "doc_id", F.col("starts").alias(f"s{k}"))
    pairs = side(0).join(side(1), ["leaf", "doc_id"]).join(F.broadcast(index.docs.sparkSession.createDataFrame(meta, "leaf int, m0 int, m1 int, k int")), "leaf")

    def close(a: Column) -> Column:
        def of(b: Column) -> Column:
            gap = F.greatest(b - (a + F.col("m0") - 1), a - (b + F.col("m1") - 1), F.lit(0))
            return (gap <= F.col("k")) & ~((a == b) & (F.col("m0") == F.col("m1")))

        return F.exists("s1", of)

    return pairs.where(F.exists("s0", close)).select("leaf", "doc_id")


#: Queries in one predicate; larger batches are a union of such plans.
BATCH = 100


def matches(index: Index, parsed: list[Parsed]) -> DataFrame:
    """``qid`` and ``doc_id`` of every query's documents."""
    parts = [_matches(index, parsed[i : i + BATCH]) for i in range(0, max(1, len(parsed)), BATCH)]
    return reduce(DataFrame.unionByName, parts)


def _matches(index: Index, parsed: list[Parsed]) -> DataFrame:
    spark: SparkSession = index.docs.sparkSession
    number: dict[tuple[int, object], int] = {}
    for k, p in enumerate(parsed):
        for leaf in leaves(p.tree):
            number[k, leaf] = len(number)
    kind = lambda c: [(n, x) for (_, x), n in number.items() if isinstance(x, c)]
    found = []
    if terms := kind(Term):
        found.append(_term_leaves(index, [(n, t.word) for n, t in terms]))
    if phrases := [(n, p) for n, p in kind(Phrase) if len(p.words) > 1]:
        found.append(index.spans([(n, i, w) for n, p in phrases for i, w in enumerate(p.words)]).select(F.col("operand").alias("leaf"), "doc_id"))
    if wilds := kind(Wild):
        found.append(_wild_leaves(index, wilds))
    if (nears := kind(Near)) and (near := _near_leaves(index, nears)) is not None:
        found.append(near)
    none = spark.createDataFrame([], "qid string, doc_id long")
    owner = [(n, k) for (k, _), n in number.items()]
    hits = None
    if found:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        every = every.join(F.broadcast(spark.createDataFrame(owner, "leaf int, k int")), "leaf")
        hits = every.groupBy("k", "doc_id").agg(F.collect_set("leaf").alias("leaves"))
    else:
        hits = spark.createDataFrame([], "k int, doc_id long, leaves array<int>")
    alive = [k for k, p in enumerate(parsed) if p.tree is not None]
    universal = [k for k in alive if holds(parsed[k].tree, lambda _: False)]
    if universal:
        world = index.docs.select("doc_id", F.explode(F.array(*[F.lit(k) for k in universal])).alias("k"))
        hits = hits.join(world, ["k", "doc_id"], "full").select("k", "doc_id", F.coalesce("leaves", F.array().cast("array<int>")).alias("leaves"))
    if not alive:
        return none
    test = F.lit(False)
    for k in reversed(alive):
        of_query = holds(parsed[k].tree, lambda x, k=k: F.array_contains("leaves", number[k, x]))
        test = F.when(F.col("k") == k, of_query).otherwise(test)
    names = spark.createDataFrame([(k, p.qid) for k, p in enumerate(parsed)], "k int, qid string")
    return hits.where(test).join(F.broadcast(names), "k").select("qid", "doc_id")


__all__ = ["And", "Not", "Or", "Parsed", "matches", "parse_all", "wildcard_by_grams"]
