"""The engine's registered queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import embed, features, metrics
from textloom.operators.index import Index, Stored, tokenised
from textloom.operators.rank import hash_vectors, query_terms, rank, top
from textloom.operators.search import search
from textloom.plans.compile import matches, parse_all, wildcard_by_grams
from textloom.plans.parser import Wild
from textloom.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_indexes: dict[tuple[str, str], Stored] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of ``documents``; each of its tables is written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = Stored(tokenised(table(spark, sf_dir, "documents")), scratch(spark, "index", sf_dir))
    return _indexes[key]


def scratch(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A folder of this application's own for the files that a query writes and reads back."""
    place = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}/{place}/{name}"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- SQL parts ------------------------------------------------------------------------------------

D = r"d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS toks FROM documents)"
P = f"{D}, p AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM d)"
GRAMS = "SELECT doc_id, s AS pos, list_slice(toks, s + 1, s + {n}) AS g FROM (SELECT doc_id, toks, unnest(generate_series(0, len(toks) - {n})) AS s FROM d WHERE len(toks) >= {n})"


def quote(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def has(word: str) -> str:
    return f"SELECT doc_id FROM d WHERE list_contains(toks, {quote(word)})"


def phrase(*words: str) -> str:
    joins = " ".join(f"JOIN p p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND p{i}.term = {quote(w)}" for i, w in enumerate(words) if i)
    return f"SELECT DISTINCT p0.doc_id FROM p p0 {joins} WHERE p0.term = {quote(words[0])}"


def near(left: tuple[str, ...], right: tuple[str, ...], k: int) -> str:
    spans = lambda words: f"SELECT p0.doc_id, p0.pos AS s, p0.pos + {len(words) - 1} AS e FROM p p0 " + " ".join(f"JOIN p p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND p{i}.term = {quote(w)}" for i, w in enumerate(words) if i) + f" WHERE p0.term = {quote(words[0])}"
    return f"SELECT DISTINCT l.doc_id FROM ({spans(left)}) l JOIN ({spans(right)}) r ON l.doc_id = r.doc_id WHERE NOT (l.s = r.s AND l.e = r.e) AND greatest(r.s - l.e, l.s - r.e, 0) <= {k}"


def wild(left: str, right: str) -> str:
    return f"SELECT DISTINCT doc_id FROM p WHERE starts_with(term, {quote(left)}) AND ends_with(term, {quote(right)}) AND length(term) >= {len(left) + len(right)}"


# --- tokens, n-grams, index -----------------------------------------------------------------------


@register("tokenize_light", f"WITH {D} SELECT doc_id, toks AS tokens FROM d")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.light_tokens(F.col("text")).alias("tokens"))


@register("doc_stats", f"WITH {D} SELECT doc_id, CAST(len(toks) AS BIGINT) AS dl FROM d")
def _(spark, sf):
    return index(spark, sf).docs.select("doc_id", "dl")


@register("corpus_stats", f"WITH {D} SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl FROM d")
def _(spark, sf):
    return index(spark, sf).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@register("ngrams_word_padded", f"WITH {D}, q AS (SELECT doc_id, list_concat(list_concat(['<s>'], toks), ['</s>']) AS t FROM d) SELECT array_to_string(list_slice(t, s, s + 2), ' ') AS gram, count(*) AS n FROM (SELECT t, unnest(generate_series(1, len(t) - 2)) AS s FROM q WHERE len(t) >= 3) GROUP BY 1")
def _(spark, sf):
    grams = X.word_ngrams(X.light_tokens(F.col("text")), 3)
    return table(spark, sf, "documents").select(F.explode(grams).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n"))


@register("ngrams_char", rf"WITH w AS (SELECT '$' || unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) || '$' AS w FROM documents) SELECT substr(w, s, 3) AS gram, count(*) AS n FROM (SELECT w, unnest(generate_series(1, length(w) - 2)) AS s FROM w) GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.explode(X.char_ngrams(F.col("text"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@register("positions_uni", f"WITH {P} SELECT term, doc_id, count(*) AS tf, list(CAST(pos AS INTEGER) ORDER BY pos) AS positions FROM p GROUP BY ALL")
def _(spark, sf):
    return index(spark, sf).postings.select("term", "doc_id", "tf", "positions")


@register("positions_bi", f"WITH {D} SELECT array_to_string(g, ' ') AS gram, doc_id, list(CAST(pos AS INTEGER) ORDER BY pos) AS positions FROM ({GRAMS.format(n=2)}) GROUP BY g, doc_id")
def _(spark, sf):
    return index(spark, sf).gram_positions(2).select(F.array_join("gram", " ").alias("gram"), "doc_id", "positions")


@register("postings_uni", f"WITH {P} SELECT DISTINCT term, doc_id FROM p")
def _(spark, sf):
    return index(spark, sf).postings.select("term", "doc_id")


def _grams(n: int) -> Query:
    return lambda spark, sf: index(spark, sf).grams(n).select(F.array_join("gram", " ").alias("gram"), "doc_id")


for _n, _name in ((2, "postings_bi"), (3, "postings_tri")):
    register(_name, f"WITH {D} SELECT DISTINCT array_to_string(g, ' ') AS gram, doc_id FROM ({GRAMS.format(n=_n)})")(_grams(_n))


@register("term_df", f"WITH {P} SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term")
def _(spark, sf):
    return index(spark, sf).terms.select("term", "df")


@register("chargram_terms", f"WITH {P}, t AS (SELECT DISTINCT term FROM p) SELECT DISTINCT substr(w, s, n) AS gram, term FROM (SELECT term, w, n, unnest(generate_series(1, length(w) - n + 1)) AS s FROM (SELECT term, '$' || term || '$' AS w, unnest([1, 2, 3]) AS n FROM t)) WHERE substr(w, s, n) <> '$'")
def _(spark, sf):
    return index(spark, sf).chargrams


@register("wildcard_lookup", f"WITH {P} SELECT DISTINCT term FROM p WHERE starts_with(term, 'cl')")
def _(spark, sf):
    return index(spark, sf).wildcard_terms("$cl")


@register("posting_lookup", f"WITH {P} SELECT DISTINCT doc_id FROM p WHERE term = 'thin'")
def _(spark, sf):
    return index(spark, sf).posting_list("thin")


@register("posting_lookup_gram", f"WITH {P} {phrase('of', 'the')}")
def _(spark, sf):
    return index(spark, sf).posting_list(("of", "the"))


@register("position_lookup", f"WITH {P} SELECT CAST(pos AS INTEGER) AS pos FROM p WHERE term = 'the' AND doc_id = 1")
def _(spark, sf):
    return index(spark, sf).positions("the", 1)


# --- the query language ---------------------------------------------------------------------------

SETS = {
    "nl_or": ("der pour", f"{has('der')} UNION {has('pour')}"),
    "bool_and": ("the AND thin", f"{has('the')} INTERSECT {has('thin')}"),
    "bool_or": ("thin OR para", f"{has('thin')} UNION {has('para')}"),
    "bool_not": ("thin AND NOT the", f"{has('thin')} EXCEPT {has('the')}"),
    "bool_nested": ("thin AND NOT (der OR pour)", f"{has('thin')} EXCEPT ({has('der')} UNION {has('pour')})"),
    "bool_or_not": ("ouen OR NOT the", f"{has('ouen')} UNION (SELECT doc_id FROM d EXCEPT {has('the')})"),
    "bool_not_not": ("the AND NOT NOT thin", f"{has('the')} INTERSECT {has('thin')}"),
    "phrase2": ('"of the"', phrase("of", "the")),
    "phrase3": ('"and attion to"', phrase("and", "attion", "to")),
    "phrase_in_bool": ('"of the" AND NOT thin', f"({phrase('of', 'the')}) EXCEPT {has('thin')}"),
    "phrase1_empty": ('"the"', "SELECT doc_id FROM d WHERE false"),
    "wild_prefix": ("thin*", wild("thin", "")),
    "wild_suffix": ("*tion", wild("", "tion")),
    "wild_infix": ("th*er", wild("th", "er")),
    "near_terms": ("the NEAR/3 and", near(("the",), ("and",), 3)),
    "near_phrase": ('"of the" NEAR/4 and', near(("of", "the"), ("and",), 4)),
    "near_same_term": ("the NEAR/2 the", near(("the",), ("the",), 2)),
    "near_zero": ("the NEAR/0 and", near(("the",), ("and",), 0)),
}


def _set(query: str) -> Query:
    return lambda spark, sf: matches(index(spark, sf), parse_all([("q", query)])).select("doc_id")


for _name, (_query, _sql) in SETS.items():
    register(_name, f"WITH {P} {_sql}")(_set(_query))


@register("wild_gram_filter", f"WITH {P} SELECT DISTINCT term FROM p WHERE starts_with(term, 'th') AND ends_with(term, 'er') AND length(term) >= 4")
def _(spark, sf):
    return wildcard_by_grams(index(spark, sf), Wild("th", "er"))


# --- ranking --------------------------------------------------------------------------------------

ASKED = [("n1", "the thin attion"), ("n2", "para der pour der"), ("n3", "ouen zzzz")]
BATCH = [*ASKED, ("b1", "thin AND NOT (der OR pour)"), ("b2", "ouen OR NOT the"), ("p1", '"of the"'), ("p2", '"and attion to"'), ("w1", "thin*"), ("x1", "the NEAR/3 and"), ("e1", "NOT the")]
MATCHED = {"b1": SETS["bool_nested"][1], "b2": SETS["bool_or_not"][1], "p1": SETS["phrase2"][1], "p2": SETS["phrase3"][1], "w1": SETS["wild_prefix"][1], "x1": SETS["near_terms"][1]}


def rank_sql(queries: list[tuple[str, str]], method: str, final: str) -> str:
    """Common table expressions up to ``ranked(qid, doc_id, score, rank)``, then ``final``."""
    words = [(qid, query.lower().split()) for qid, query in queries]
    values = ", ".join(f"({quote(qid)}, {quote(w)}, {ws.count(w)}, {i})" for qid, ws in words for i, w in enumerate(ws) if ws.index(w) == i)
    candidates = " UNION ALL ".join(f"SELECT {quote(qid)} AS qid, doc_id FROM ({MATCHED.get(qid) or ' UNION '.join(has(w) for w in query.split())})" for qid, query in queries if qid != "e1")
    bm25 = lambda idf, k1, b: f"sum({idf} * tf * ({k1} + 1e0) / (tf + {k1} * (1e0 - {b} + {b} * dl / avgdl)))"
    score = {"bm25": "bm25", "bm25plus": "bm25plus", "tfidf": "tfidf", "hybrid": "CASE WHEN max(a) OVER (PARTITION BY qid) = 0 AND max(b) OVER (PARTITION BY qid) = 0 THEN bm25plus ELSE 8e-1 * a + 2e-1 * b END"}[method]
    return f"""WITH {P}, tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), l AS (SELECT doc_id, len(toks) AS dl FROM d),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT v.*, coalesce(df, 0) AS df, n, avgdl, ln((n + 1) / CAST(coalesce(df, 0) + 1 AS DOUBLE)) + 1 AS smooth, ln((n - coalesce(df, 0) + 5e-1) / (coalesce(df, 0) + 5e-1)) AS idf
  FROM (VALUES {values}) v(qid, term, qtf, ord) LEFT JOIN df USING (term) CROSS JOIN st),
qn AS (SELECT qid, sqrt(sum(power(qtf * smooth, 2))) AS qn FROM q GROUP BY qid), c AS ({candidates}),
h AS (SELECT qid, doc_id, {bm25("idf", "12e-1", "75e-2")} AS bm25, {bm25("greatest(0e0, idf)", "14e-1", "7e-1")} AS bm25plus, sum(qtf * smooth * tf * smooth) AS dot, sqrt(sum(power(tf * smooth, 2))) AS dn
  FROM c JOIN q USING (qid) JOIN tf USING (doc_id, term) JOIN l USING (doc_id) GROUP BY qid, doc_id),
s AS (SELECT qid, doc_id, coalesce(bm25, 0e0) AS bm25, coalesce(bm25plus, 0e0) AS bm25plus, coalesce(dot / (qn * dn), 0e0) AS tfidf, coalesce(bm25plus, 0e0) AS pl, coalesce(dot / (qn * dn), 0e0) AS co
  FROM c LEFT JOIN h USING (qid, doc_id) LEFT JOIN qn USING (qid)),
m AS (SELECT *, CASE WHEN max(pl) OVER w - min(pl) OVER w < 1e-11 THEN 0e0 ELSE (pl - min(pl) OVER w) / (max(pl) OVER w - min(pl) OVER w) END AS a,
  CASE WHEN max(co) OVER w - min(co) OVER w < 1e-11 THEN 0e0 ELSE (co - min(co) OVER w) / (max(co) OVER w - min(co) OVER w) END AS b FROM s WINDOW w AS (PARTITION BY qid)),
f AS (SELECT qid, doc_id, {score} AS score FROM m),
ranked AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, doc_id) AS rank FROM f)
{final}"""


TOP_SQL = "SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 10"


def shown(df: DataFrame) -> DataFrame:
    return df.select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def named(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "qid string, query string")


def ranked(spark: SparkSession, sf: str, method: str) -> DataFrame:
    ix = index(spark, sf)
    return rank(ix, matches(ix, parse_all(ASKED)), named(spark), method)


for _m in ("bm25", "bm25plus", "tfidf", "hybrid"):
    register(f"rank_{_m}", rank_sql(ASKED, _m, TOP_SQL))(lambda spark, sf, m=_m: shown(search(index(spark, sf), ASKED, m)))


@register("rank_default_batch", rank_sql(BATCH, "hybrid", TOP_SQL))
def _(spark, sf):
    return shown(search(index(spark, sf), BATCH))


@register("rank_semantic")
def _(spark, sf):
    return shown(top(ranked(spark, sf, "semantic")))


@register("hash_vector")
def _(spark, sf):
    words = index(spark, sf).postings.select("doc_id", "term", "tf")
    return hash_vectors(words, "doc_id").select("doc_id", "idx", F.round("val", 6).alias("val"))


def _hash_values() -> str:
    """The query words' places and signs, by the keyed hash itself, which SQL doesn't have."""
    h = lambda w, part: int.from_bytes(hashlib.blake2b(f"{w}|{part}".encode(), digest_size=8, key=b"13").digest(), "big")
    return ", ".join(f"({quote(qid)}, {h(w, 'proj') % 256}, {1 - 2 * (h(w, 'sign') % 2)})" for qid, query in ASKED for w in query.split())


@register("query_vector", f"WITH c AS (SELECT qid, idx, CAST(sum(sign) AS DOUBLE) AS val FROM (VALUES {_hash_values()}) v(qid, idx, sign) GROUP BY ALL), n AS (SELECT qid, sqrt(sum(val * val)) AS norm FROM c GROUP BY qid) SELECT qid, CAST(idx AS INTEGER) AS idx, round(val / norm, 6) AS val FROM c JOIN n USING (qid) WHERE val <> 0")
def _(spark, sf):
    q = query_terms(named(spark)).select("qid", "term", F.col("qtf").alias("tf"))
    return hash_vectors(q, "qid").select("qid", "idx", F.round("val", 6).alias("val"))


# --- features -------------------------------------------------------------------------------------

TF = {"raw": "tf / CAST(dl AS DOUBLE)", "log": "1 + ln(tf)", "bm25": "22e-1 * tf / (12e-1 + tf)"}


def tfidf_sql(mode: str) -> str:
    return f"""WITH {P}, c AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), l AS (SELECT doc_id, len(toks) AS dl FROM d),
i AS (SELECT term, CAST(ln((SELECT count(*) FROM d) / CAST(count(*) AS DOUBLE)) AS FLOAT) AS idf FROM c GROUP BY term)
SELECT doc_id, term, round(CAST(CAST({TF[mode]} AS FLOAT) * idf AS DOUBLE), 4) AS weight FROM c JOIN l USING (doc_id) JOIN i USING (term)"""


def _tfidf(mode: str) -> Query:
    def query(spark, sf):
        return features.tfidf(index(spark, sf).docs, mode).select("doc_id", "term", F.round(F.col("weight").cast("double"), 4).alias("weight"))

    return query


for _m in TF:
    register(f"tfidf_{_m}", tfidf_sql(_m))(_tfidf(_m))


@register("vocab_order", f'WITH {P}, f AS (SELECT term, min((doc_id, pos)) AS k FROM p GROUP BY term) SELECT term, row_number() OVER (ORDER BY k) - 1 AS "column" FROM f')
def _(spark, sf):
    return features.vocabulary(index(spark, sf).docs)


# --- embeddings -----------------------------------------------------------------------------------

VECTORS = """h AS (SELECT term, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT term FROM p)),
v AS (SELECT term AS word, embedding AS vec FROM h JOIN embeddings ON vec_id = h % (SELECT count(*) FROM embeddings) WHERE h % 10 <> 0 UNION ALL SELECT '<unk>', embedding FROM embeddings WHERE vec_id = 0),
m AS (SELECT doc_id, coalesce(v.word, '<unk>') AS word FROM p LEFT JOIN v ON v.word = p.term),
c AS (SELECT doc_id, word, count(*) AS tf FROM m GROUP BY ALL)"""
POOL = {"mean": "sum(tf * x) / sum(tf)", "max": "max(x)", "sum": "sum(tf * x)"}


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A word vector from ``embeddings`` for nine tenths of the vocabulary, by hash: words with the
    ids of their vectors, and the vectors."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("code"), F.col("embedding").alias("vec"))
    h = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    n = e.agg(F.count("*").alias("n"))
    words = index(spark, sf).words.select(F.col("term").alias("word"), h.alias("h")).join(F.broadcast(n)).where("h % 10 <> 0")
    return words.select("word", (F.col("h") % F.col("n")).alias("code")), e


def pool_sql(value: str) -> str:
    return f"WITH {P}, {VECTORS} SELECT doc_id, CAST(dim AS INTEGER) AS dim, round({value}, 3) + 0e0 AS value FROM (SELECT doc_id, tf, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS dim FROM c JOIN v USING (word)) GROUP BY doc_id, dim"


def _embed(method: str) -> Query:
    def query(spark, sf):
        words, e = vectors(spark, sf)
        unknown = e.where("code = 0").select("vec").first()
        out = embed.pooled(index(spark, sf).docs, (words, e), method, unknown and unknown[0])
        return out.select("doc_id", F.col("dim").cast("int").alias("dim"), (F.round("value", 3) + 0.0).alias("value"))

    return query


for _m, _v in POOL.items():
    register(f"embed_{_m}", pool_sql(_v))(_embed(_m))
register("embed_meanmax", f"WITH a AS ({pool_sql(POOL['mean'])}), b AS ({pool_sql(POOL['max'])}) SELECT * FROM a UNION ALL SELECT doc_id, CAST(dim + 64 AS INTEGER) AS dim, value FROM b")(_embed("meanmax"))
register(
    "embed_tfidf_weighted",
    f"""WITH {P}, {VECTORS}, l AS (SELECT doc_id, len(toks) AS dl FROM d), i AS (SELECT word, ln((SELECT count(*) FROM d) / CAST(count(*) AS DOUBLE)) AS idf FROM c GROUP BY word),
x AS (SELECT doc_id, tf * (tf / CAST(dl AS DOUBLE)) * idf AS w, vec FROM c JOIN l USING (doc_id) JOIN i USING (word) JOIN v USING (word))
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN sum(w) = 0 THEN 0e0 ELSE sum(w * x) / sum(w) END, 3) + 0e0 AS value FROM (SELECT doc_id, w, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS dim FROM x) GROUP BY doc_id, dim""",
)(_embed("tfidf_weighted"))


# --- HTML -----------------------------------------------------------------------------------------

_ENTITIES = "t"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '{_e}', '{_c}')"


@register("html_strip", rf"WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages), e AS (SELECT page_id, {_ENTITIES} AS t FROM s) SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '([[:word:]])&([[:word:]])', '\1§AMP§\2', 'g'), '\s*&\s*', ' and ', 'g'), '\s+', ' ', 'g')) AS text FROM e")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


#: The pages' other entities; letters of any script beside an ampersand.
CLEAN_SQL = SQL["html_strip"].replace("regexp_replace(html,", "regexp_replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'),").replace("([[:word:]])", r"([\p{L}\p{N}_])")


@register("html_clean", CLEAN_SQL)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean_html(F.col("html")).alias("text"))


@register("html_tokens")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.word_tokens(F.col("html")).alias("tokens"))


# --- evaluation -----------------------------------------------------------------------------------

QIDS = ", ".join(f"({quote(qid)})" for qid, _ in ASKED)
EVAL = f""", g AS (SELECT qid, doc_id, quality AS rel FROM labels CROSS JOIN (VALUES {QIDS}) v(qid)), run AS (SELECT qid, doc_id, rank FROM ranked WHERE rank <= 10),
j AS (SELECT qid, count(*) FILTER (WHERE rel > 0) AS n_rel FROM g GROUP BY qid), z AS (SELECT qid, count(*) AS n_ret FROM run GROUP BY qid),
hit AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM run JOIN g USING (qid, doc_id) WHERE rel > 0),
k AS (SELECT qid, sum(nth / CAST(rank AS DOUBLE)) AS gain, min(rank) AS best FROM hit GROUP BY qid),
q_ AS (SELECT qid, n_rel, coalesce(n_ret, 0) AS n_ret, coalesce(gain / n_rel, 0) AS ap, coalesce(1e0 / best, 0) AS rr FROM j LEFT JOIN z USING (qid) LEFT JOIN k USING (qid))
"""


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("rel"), F.explode(F.array(*[F.lit(q) for q, _ in ASKED])).alias("qid"))


@register("eval_ap", rank_sql(ASKED, "hybrid", "").rstrip() + EVAL + "SELECT qid, n_rel, n_ret, round(ap, 6) AS ap, round(rr, 6) AS rr FROM q_")
def _(spark, sf):
    q = metrics.per_query(top(ranked(spark, sf, "hybrid")), qrels(spark, sf))
    return q.select("qid", "n_rel", "n_ret", F.round("ap", 6).alias("ap"), F.round("rr", 6).alias("rr"))


@register("eval_map_mrr", rank_sql(ASKED, "hybrid", "").rstrip() + EVAL + "SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, count(*) AS n_queries, count(*) FILTER (WHERE n_ret > 0) AS n_covered FROM q_")
def _(spark, sf):
    s = metrics.summary(top(ranked(spark, sf, "hybrid")), qrels(spark, sf))
    return s.select(F.round("map", 6).alias("map"), F.round("mrr", 6).alias("mrr"), "n_queries", "n_covered")


@register("eval_pearson", rank_sql(ASKED, "bm25plus", "").rstrip() + ", x AS (SELECT score, CAST(coalesce(quality, 0) AS DOUBLE) AS rel FROM ranked LEFT JOIN labels USING (doc_id)) SELECT 'bm25plus' AS method, round(corr(score, rel), 6) AS r FROM x")
def _(spark, sf):
    r = metrics.compare_methods({"bm25plus": ranked(spark, sf, "bm25plus")}, qrels(spark, sf))
    return r.select("method", F.round("r", 6).alias("r"))


LEXICAL = ("bm25", "bm25plus", "tfidf", "hybrid")
_R = ", x AS (SELECT score, CAST(coalesce(quality, 0) AS DOUBLE) AS rel FROM ranked LEFT JOIN labels USING (doc_id)) SELECT '{m}' AS method, round(corr(score, rel), 6) AS r FROM x"
_BOARD = "SELECT '{m}' AS run, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, count(*) AS n_queries, count(*) FILTER (WHERE n_ret > 0) AS n_covered FROM q_"


def _each(final: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({rank_sql(ASKED, m, '').rstrip()}{final.format(m=m)})" for m in LEXICAL)


def _compared(methods: tuple[str, ...]) -> Query:
    return lambda spark, sf: metrics.compare_methods({m: ranked(spark, sf, m) for m in methods}, qrels(spark, sf)).select("method", F.round("r", 6).alias("r"))


def _board(methods: tuple[str, ...]) -> Query:
    def query(spark, sf):
        board = metrics.leaderboard({m: top(ranked(spark, sf, m)) for m in methods}, qrels(spark, sf))
        return board.select("run", F.round("map", 6).alias("map"), F.round("mrr", 6).alias("mrr"), "n_queries", "n_covered")

    return query


register("eval_methods", _each(_R))(_compared(LEXICAL))
register("eval_leaderboard", _each(EVAL + _BOARD))(_board(LEXICAL))
register("eval_semantic")(_compared(("semantic",)))

JUDGED_SQL = rank_sql(ASKED, "bm25plus", "").replace("c AS (" + rank_sql(ASKED, "bm25plus", "").split("c AS (")[-1].split("),\nh AS")[0] + ")", f"c AS (SELECT qid, doc_id FROM labels CROSS JOIN (VALUES {QIDS}) v(qid))")


@register("eval_judged", JUDGED_SQL.rstrip() + ", x AS (SELECT score, CAST(quality AS DOUBLE) AS rel FROM ranked JOIN labels USING (doc_id)) SELECT 'bm25plus' AS method, round(corr(score, rel), 6) AS r FROM x")
def _(spark, sf):
    r = metrics.compare_rankers(index(spark, sf), named(spark), qrels(spark, sf), ("bm25plus",))
    return r.select("method", F.round("r", 6).alias("r"))


from textloom import source_queries  # noqa: E402, F401 - registers its queries here
