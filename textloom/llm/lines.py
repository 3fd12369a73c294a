"""Line deduplication: repeated runs of lines, by prefix doubling over line ids. DataFrame functions only.

The sequence of a document is its lines that aren't blank, each named by a 128-bit hash. A level
names the runs of ``min_lines`` times 1, 2, 4, ... lines by the names of their halves; positions
with one name are an interval of the suffix array whose longest common prefix has at least that
many lines, and only positions in an interval of several go on to the next level, until there is
none. With ``min_lines`` of 1, as the query and the pipeline take it, a single line is a run. Order within the array plays no part, so positions are grouped by name and never sorted
over the corpus.

A position that isn't the first (by document id, then line) of its interval is a later copy: its
longest common prefix with the first of its deepest interval follows exactly by descending the
levels again. Where the position before goes with the position before that first, the prefix is one
line less than its neighbour's, so only the others, the starts of maximal repeated runs, descend.
The lines of all those runs are deleted; the first copy of each is kept.

Grouping is by aggregation with partial sums before the shuffle, then a join with the intervals'
first positions; a very frequent run is split by the engine's skew handling.

Edge cases: null texts have no lines and stay null; empty texts and blank lines stay; documents
with a null id come first; rows equal in id and text count as one document, and each keeps what
that keeps; runs may repeat in one document, overlapping too; a very long text is one row for each of
its lines; an empty table gives an empty result; other columns are carried in ``doc`` whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import bound
from textloom.llm import store
from textloom.llm.rows import quoted


def _names(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """The name of the run made of runs (a, b) and (c, d)."""
    return F.when(c.isNotNull(), F.xxhash64(a, c)), F.when(d.isNotNull(), F.xxhash64(F.lit(1), b, d))


def _solid(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) != ""


def _place(id: Column, copy: Column, n: Column) -> Column:
    return F.struct(id.alias("id"), copy.alias("copy"), n.alias("n"))


def _own() -> Column:
    return _place(F.col("id"), F.col("copy"), F.col("n"))


def base_runs(docs: DataFrame, text: str, key: str, min_lines: int) -> DataFrame:
    """``id``, ``copy`` (hash of the text), ``n`` (place in the document's sequence, from 1) and the
    name ``a``, ``b`` of each run of ``min_lines`` lines."""
    body = F.col(quoted(text)).cast("string")
    lines = docs.select(F.col(quoted(key)).alias("id"), F.xxhash64(body).alias("copy"), F.posexplode(F.split(body, "\n")).alias("pos", "line")).where(_solid(F.col("line")))
    lines = lines.select("id", "copy", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).dropDuplicates(["id", "copy", "pos"])
    order = Window.partitionBy("id", "copy").orderBy("pos")
    rows = lines.withColumn("n", F.row_number().over(order))
    length = 1
    while length < min_lines:
        step = length if 2 * length <= min_lines else min_lines - length
        a, b = _names(F.col("a"), F.col("b"), F.lead("a", step).over(order), F.lead("b", step).over(order))
        rows = rows.withColumns({"a": a, "b": b})
        length += step
    return rows.where(F.col("a").isNotNull()).drop("pos")


def _tied(rows: DataFrame) -> DataFrame:
    """The rows of intervals of several, each with the ``first`` place of its interval."""
    intervals = rows.groupBy("a", "b").agg(F.min(_own()).alias("first"), F.count("*").alias("many")).where("many > 1")
    return rows.join(intervals.select("a", "b", "first"), ["a", "b"]).select("id", "copy", "n", "a", "b", "first")


def levels(docs: DataFrame, text: str, key: str, min_lines: int) -> list[DataFrame]:
    """The tied positions at runs of ``min_lines``, then of twice as many lines, until none is tied."""
    made = [store.written(_tied(base_runs(docs, text, key, min_lines)), "line_level")]
    while not made[-1].isEmpty():
        after = Window.partitionBy("id", "copy").orderBy("n").rangeBetween(min_lines << len(made) - 1, min_lines << len(made) - 1)
        a, b = _names(F.col("a"), F.col("b"), F.first("a").over(after), F.first("b").over(after))
        doubled = made[-1].select("id", "copy", "n", a.alias("a"), b.alias("b")).where(F.col("a").isNotNull())
        made.append(store.written(_tied(doubled), "line_level"))
    store.drop(made[-1])
    return made[:-1]


def _starts(made: list[DataFrame]) -> DataFrame:
    """Later copies with their deepest ``level`` and its ``first``, where a maximal run starts."""
    later = made[0].where("false").select("id", "copy", "n", "first", F.lit(0).alias("level"))
    for k, tied in enumerate(made):
        later = later.unionByName(tied.where(F.col("first") != _own()).select("id", "copy", "n", "first", F.lit(k).alias("level")))
    deepest = later.repartition("id", "copy").groupBy("id", "copy", "n").agg(F.max_by("first", "level").alias("first"), F.max("level").alias("level"))
    order = Window.partitionBy("id", "copy").orderBy("n")
    before = F.struct(F.lag("n").over(order).alias("n"), F.lag("first").over(order).alias("first"))
    goes_on = (F.col("before.n") == F.col("n") - 1) & (F.col("before.first") == _place(F.col("first.id"), F.col("first.copy"), F.col("first.n") - 1))
    return deepest.withColumn("before", before).where(~F.coalesce(goes_on, F.lit(False))).drop("before")


def repeated_runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_lines: int = 2) -> DataFrame:
    """Maximal repeated runs of ``min_lines`` lines or more: ``id``, ``copy`` (hash of the text),
    ``n`` (the run's place among the lines that aren't blank, from 1), ``length`` (the longest
    common prefix with ``first``) and ``first`` (the earlier copy's ``id``, ``copy``, ``n``)."""
    made = levels(docs, text, key, min_lines)
    if not made:
        none = base_runs(docs, text, key, min_lines).where("false")
        return none.select("id", "copy", "n", F.lit(0).alias("length"), _own().alias("first"))
    runs = _starts(made).withColumn("length", (F.lit(min_lines) * F.pow(F.lit(2), F.col("level"))).cast("int"))
    steps = [(k, min_lines << k) for k in reversed(range(len(made) - 1))]
    steps += [(0, 1 << k) for k in reversed(range((min_lines - 1).bit_length()))]
    for k, more in steps:
        # The run of level k that ends ``more`` lines beyond the prefix known so far.
        shift = F.col("length") + F.lit(more - (min_lines << k))
        names = made[k].select(_own().alias("at"), F.struct("a", "b").alias("name"))
        mine = names.select(F.col("at").alias("my_at"), F.col("name").alias("my_name"))
        runs = runs.join(mine, _place(F.col("id"), F.col("copy"), F.col("n") + shift) == F.col("my_at"), "left")
        runs = runs.join(names, _place(F.col("first.id"), F.col("first.copy"), F.col("first.n") + shift) == F.col("at"), "left")
        same = F.coalesce(F.col("name") == F.col("my_name"), F.lit(False))
        runs = runs.select("id", "copy", "n", "first", (F.col("length") + F.when(same, more).otherwise(0)).alias("length"))
    out = store.written(runs.select("id", "copy", "n", "length", "first"), "line_runs")
    store.drop(*made)
    return out


def line_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, min_lines: int = 2) -> DataFrame:
    """Per document: ``doc`` (its columns ``keep``), ``n_lines``, ``removed`` (line numbers from
    0, ascending) and ``kept`` (the text without those lines)."""
    keep = docs.columns if keep is None else keep
    found = repeated_runs(docs, text=text, key=key, min_lines=min_lines)
    # Overlapping runs are cut to what none before them covers, so a document's spans add up to its lines at most.
    covered = F.max(F.col("n") + F.col("length")).over(Window.partitionBy("id", "copy").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("id", "copy", F.greatest("n", covered).alias("from"), (F.col("n") + F.col("length")).alias("to")).where(F.col("to") > F.col("from"))
    spans = spans.groupBy("id", "copy").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))
    body = F.col(quoted(text)).cast("string")
    d = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("doc"), F.col(quoted(key)).alias("_id"), F.xxhash64(body).alias("_copy"), body.alias("_text"))
    # The spans grow with the corpus, so they are never broadcast, however few: small inputs take the plan of large ones.
    d = d.join(spans.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_copy") == F.col("copy")), "left")
    # The text is split once for a document: a lambda that closed over the split would redo it for each line.
    solid = bound(F.split("_text", "\n"), lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: _solid(F.get(p, i))))
    gone = bound(solid, lambda s: F.flatten(F.transform("spans", lambda r: F.slice(s, r["from"], r["to"] - r["from"]))))
    d = d.withColumn("removed", F.when(F.col("spans").isNull(), F.array().cast("array<int>")).otherwise(gone))
    left = bound(F.split("_text", "\n"), lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("removed")), lambda i: F.get(p, i)))
    kept = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    return d.select("doc", F.coalesce(F.size(F.split("_text", "\n")), F.lit(0)).cast("long").alias("n_lines"), "removed", kept.alias("kept"))
