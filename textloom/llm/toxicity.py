"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

Words are lower-cased runs of letters, digits and non-ASCII bytes. A word's embedding is the sum
of the embeddings of three hashes: of the word, of its first four and of its first five bytes, so
that inflected forms share parameters. Filters one, two and three words wide slide over the whole
text; each one's maximum over the text feeds a logistic output. Embeddings start with the
log-odds of their hash among the training documents in one coordinate and noise in the others.

All labelled rows are learnt from, with their whole texts. They are dealt by hash to groups that fit a
task. The log-odds come from counts summed over all groups. In each epoch every group trains the same model by
Adam on its rows, and the changes are averaged: filters by rows, a hash's embedding over the groups
that changed it. Sums go up a tree, so the driver gets one model's worth of numbers an epoch however
many groups there are. Rows kept out of training scale the score (Platt, by Newton steps whose sums
are jobs) and set a threshold for each language, exactly: distinct scores are counted by ranges,
and running counts within a range start from those of the ranges above.

Edge cases: null and empty texts get the score of no filter firing; without usable labels, as for
an empty table, the score is 0, with labels of one class the smoothed share of that class;
languages with too few labelled rows use the threshold of all; repeated rows get equal scores and
count once for training; very long texts are scored and learnt from whole, each by one task; other
columns are carried in ``doc`` whatever their names.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import kernel as K
from textloom.llm import store
from textloom.llm.labelled import every
from textloom.llm.rows import per_text, quoted, small_batches

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
SPANS = (None, 4, 5)
_PIECE = 1 << 19
#: Rows and words of a group of training rows, about; words that filters slide over at a time.
GROUP_ROWS, GROUP_WORDS, _AT_ONCE = 8_000, 4_000_000, 1 << 18
#: Numbers in a slice of a sum, and summands that a task adds up; distinct scores in a range, about.
_SLICE, FAN_IN, RANGE = 1 << 16, 16, 1_000
_OFFSETS = np.arange(len(SPANS), dtype=np.int32) * BUCKETS


def word_ids(w: K.Words) -> np.ndarray:
    """Three embedding rows for each word."""
    return np.stack([(w.hashes(s) % np.uint64(BUCKETS)).astype(np.int32) + k * BUCKETS for k, s in enumerate(SPANS)], axis=1)


def spread(n: int, most: int, run: int = 128) -> np.ndarray:
    """``most`` of ``n`` words, or all: runs of neighbours spread evenly."""
    if n <= most:
        return np.arange(n)
    runs = max(1, -(-most // run))
    begin = np.linspace(0, n - -(-most // runs), runs).astype(np.int64)
    return np.unique((begin[:, None] + np.arange(-(-most // runs))).ravel())[:most]


def common_length(sizes: np.ndarray, most: int) -> int:
    """The greatest length to which texts can be cut so that no more than ``most`` words are left."""
    s = np.sort(sizes)
    whole = np.concatenate([[0], np.cumsum(s)])
    cut = whole[:-1] + s * (len(s) - np.arange(len(s)))
    k = int(np.searchsorted(cut, most, side="right"))
    return int(s[-1]) if k == len(s) else max(1, int((most - whole[k]) // (len(s) - k)))


def _shifted(e: np.ndarray, first: np.ndarray, j: int) -> np.ndarray:
    """Row i is row i + j of ``e``, or zero beyond the end of i's text."""
    if j == 0:
        return e
    out = np.zeros_like(e)
    out[:-j] = e[j:]
    ends = first[1:][np.diff(first) > 0]
    for k in range(1, j + 1):
        at = ends - k
        out[at[at >= 0]] = 0
    return out


@dataclass
class Classifier:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    platt: tuple[float, float] = (1.0, 0.0)

    def maxima(self, ids: np.ndarray, first: np.ndarray, argmax: bool = False):
        """Rectified maximum of each filter over each text, and the word where it is reached."""
        counts = np.diff(first)
        full = np.flatnonzero(counts)
        top = np.zeros((len(counts), len(self.bias)), np.float32)
        where = np.zeros(top.shape, np.int64)
        if len(full):
            e = self.embed[ids[:, 0]]
            for k in range(1, ids.shape[1]):
                e += self.embed[ids[:, k]]
            for k, f in enumerate(self.filters):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                v = e @ f[0]
                for j in range(1, len(f)):
                    v += _shifted(e @ f[j], first, j)
                v += self.bias[own]
                best = np.maximum.reduceat(v, first[:-1][full], axis=0)
                top[full, own] = np.maximum(best, 0)
                if argmax:
                    hit = v == np.repeat(best, counts[full], axis=0)
                    n = np.arange(len(v))[:, None]
                    where[full, own] = np.minimum.reduceat(np.where(hit, n, len(v)), first[:-1][full], axis=0)
        return (top, where) if argmax else top

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        a, b = self.platt
        for base, t in K.pieces(column, _PIECE):
            w = K.Words(t.lower(), K.ALNUM)
            z = self.maxima(word_ids(w), w.first).astype(np.float64) @ self.out + self.out_bias
            out[base : base + len(t)] = sigmoid(a * z + b)
        return out


@dataclass
class Constant:
    value: float

    def __call__(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.value)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _ranges(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = first[at + 1] - first[at]
    own, j = K.ragged(counts)
    return first[at][own] + j, np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Training:
    """A classifier with Adam's moments for all but its embeddings."""

    net: Classifier
    m: list[np.ndarray]
    v: list[np.ndarray]
    step: float = 0.0

    def params(self) -> list[np.ndarray]:
        return [self.net.bias, self.net.out, *self.net.filters]

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.net.out_bias, self.step], *[a.ravel() for a in (*self.params(), *self.m, *self.v)]]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        self.net.out_bias, self.step = float(flat[0]), float(flat[1])
        at = 2
        for a in (*self.params(), *self.m, *self.v):
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size


def begin(odds: np.ndarray | None, share: float, seed: int) -> Training:
    """Embeddings and filters before training; without ``odds`` embeddings are noise alone."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (BUCKETS * len(SPANS), DIM)).astype(np.float32)
    if odds is not None:
        embed[:, 0] = odds
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] += 0.5
    n = FILTERS * len(WIDTHS)
    net = Classifier(embed, filters, np.zeros(n, np.float32), rng.normal(0, 0.1, n) + 0.1, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    state = Training(net, [], [])
    state.m, state.v = ([np.zeros_like(p) for p in state.params()] for _ in range(2))
    return state


def _blocks(counts: np.ndarray) -> Iterator[slice]:
    """Consecutive texts of about ``_AT_ONCE`` words, one at least."""
    whole = np.concatenate([[0], np.cumsum(counts)])
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(whole, whole[i] + _AT_ONCE, side="right")) - 1)
        yield slice(i, j)
        i = j


def epoch(state: Training, ids: np.ndarray, first: np.ndarray, y: np.ndarray, rate: float, rng: np.random.Generator, size: int) -> np.ndarray:
    """Train on each text once; which embeddings changed."""
    net, params = state.net, state.params()
    changed = np.zeros(len(net.embed), bool)
    order = rng.permutation(len(y))
    for i in range(0, len(order), size):
        at = order[i : i + size]
        top, where = np.zeros((len(at), len(net.bias)), np.float32), np.zeros((len(at), len(net.bias)), np.int64)
        for block in _blocks(first[at + 1] - first[at]):
            rows, own = _ranges(first, at[block])
            if len(rows):
                top[block], found = net.maxima(ids[rows] + _OFFSETS, own, argmax=True)
                where[block] = rows[found]
        d = (sigmoid(top @ net.out + net.out_bias) - y[at]) / len(at)
        back = np.where(top > 0, d[:, None] * net.out, 0).astype(np.float32)
        grad = [back.sum(0), top.T @ d + 1e-4 * net.out]
        touched, change = [], []
        for k, f in enumerate(net.filters):
            g = np.zeros_like(f)
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            b, place = back[:, part], where[:, part]
            for j in range(len(f)):
                inside = (b != 0) & (place + j < first[at + 1][:, None])
                doc, flt = np.nonzero(inside)
                word = ids[place[doc, flt] + j] + _OFFSETS
                e, w = net.embed[word].sum(axis=1), b[doc, flt]
                np.add.at(g[j].T, flt, e * w[:, None])
                touched.append(word.ravel())
                change.append(np.repeat(f[j][:, flt].T * w[:, None], word.shape[1], axis=0))
            grad.append(g)
        state.step += 1
        for p, g, m, v in zip(params, grad, state.m, state.v):
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * g * g
            p -= rate * 0.5 * (m / (1 - 0.9**state.step)) / (np.sqrt(v / (1 - 0.999**state.step)) + 1e-7)
        net.out_bias -= rate * float(d.sum())
        every_ = np.concatenate(touched)
        np.add.at(net.embed, every_, -rate * 10 * np.concatenate(change))
        changed[every_] = True
    return changed


def _vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word ids and the words before each text."""
    made = column.to_pylist()
    first = np.concatenate([[0], np.cumsum([len(m) // (2 * len(SPANS)) for m in made])]).astype(np.int64)
    return np.frombuffer(b"".join(made), np.uint16).reshape(-1, len(SPANS)), first


def _summed(rows: DataFrame, groups: int, fn) -> np.ndarray:
    """The sum of ``fn(group's number, ids, first, y)`` over all groups of ``rows``, added up by a
    tree of tasks, equal results for equal rows."""
    schema = "slice int, g int, data binary"

    def sliced(g: int, made: Iterator[tuple[int, np.ndarray]]) -> pa.Table:
        k, data = zip(*made)
        return pa.table({"slice": pa.array(k, pa.int32()), "g": pa.array([g] * len(k), pa.int32()), "data": pa.array([x.tobytes() for x in data], pa.binary())})

    def one(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        table = table.sort_by([("part", "ascending"), ("y", "ascending"), ("x", "ascending")])
        made = np.asarray(fn(g, *_vectors(table.column("x")), table.column("y").to_numpy()), np.float64)
        return sliced(g, ((k, made[i : i + _SLICE]) for k, i in enumerate(range(0, len(made), _SLICE))))

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        total = 0
        for x in table.column("data"):
            total = total + np.frombuffer(x.as_buffer(), np.float64)
        return sliced(table.column("g")[0].as_py() // FAN_IN, [(table.column("slice")[0].as_py(), total)])

    spark = rows.sparkSession
    sums = rows.select("part", "y", "x", F.pmod(F.shiftright("part", 12), F.lit(groups)).cast("int").alias("g")).groupBy("g").applyInArrow(one, schema)
    while True:
        sums = sums.groupBy("slice", F.floor(F.col("g") / FAN_IN)).applyInArrow(add, schema)
        groups = -(-groups // FAN_IN)
        if groups == 1:
            break
    path = store.write(sums, "sums")
    got = spark.read.schema(schema).parquet(path).toArrow().sort_by("slice")
    store.remove(spark, path)
    return np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in got.column("data")])


def fit(rows: DataFrame, apart: Column, epochs: int = 3, seed: int = 5, start: bool = True):
    """A model of all ``rows`` (``y``, ``part``, ``lang``, ``n``, ``x``), trained on those not ``apart``, and the
    thresholds by language (``l``, the empty one for all, and ``limit``), or none. Those ``apart`` set the
    scale and the thresholds. Without ``start`` embeddings begin as noise alone."""
    have = {(r.a, r.y): (r.rows, r.words) for r in rows.groupBy(apart.alias("a"), "y").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).collect()}
    if not have:
        return Constant(0.0), None
    if len({y for _, y in have}) < 2:
        total = sum(n for n, _ in have.values())
        return Constant((total * next(y for _, y in have) + 1) / (total + 2)), None
    if len(have) < 4:
        have = {(False, y): tuple(map(sum, zip(*[v for (_, y_), v in have.items() if y_ == y]))) for y in (0, 1)}
        train = held = rows
    else:
        train, held = rows.where(~apart), rows.where(apart)
    n = [have[False, y][0] for y in (0, 1)]
    words = have[False, 0][1] + have[False, 1][1]
    groups = max(1, -(-sum(n) // GROUP_ROWS), -(-words // GROUP_WORDS))
    state = begin(_log_odds(train, groups, n) if start else None, n[1] / sum(n), seed)
    n_embed = state.net.embed.size
    for e in range(epochs):
        rate = 0.02 * (1 - e / epochs)

        def change(g, ids, first, y, state=state, rate=rate, e=e):
            new = copy.deepcopy(state)
            # Groups of few long texts take smaller steps of rows, so that they take enough of them.
            size = 64 if groups == 1 else min(64, max(8, len(y) // 125))
            changed = epoch(new, ids, first, y, rate, np.random.default_rng((seed, e, g)), size)
            return np.concatenate([[len(y)], len(y) * (new.flat() - state.flat()), changed, (new.net.embed - state.net.embed).ravel()])

        total = _summed(train, groups, change)
        flat = state.flat()
        state = copy.deepcopy(state)
        state.load(flat + total[1 : 1 + len(flat)] / total[0])
        by = np.maximum(total[1 + len(flat) : -n_embed], 1)
        state.net.embed += (total[-n_embed:].reshape(-1, DIM) / by[:, None]).astype(np.float32)
    net = state.net

    def logits(batches):
        for b in batches:
            ids, first = _vectors(b.column(2))
            z = np.zeros(len(first) - 1)
            for block in _blocks(np.diff(first)):
                own, i = first[block.start : block.stop + 1], first[block.start]
                z[block] = net.maxima(ids[i : own[-1]] + _OFFSETS, own - i).astype(np.float64) @ net.out + net.out_bias
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z)], names=["y", "lang", "z"])

    scored = store.written(small_batches(held).select("y", "lang", "x").mapInArrow(logits, "y int, lang string, z double"), "logits")
    net.platt = _platt(scored, *[have.get((True, y), have[False, y])[0] for y in (0, 1)])
    found = limits(scored.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigmoid(net.platt[0] * b.column(2).to_numpy() + net.platt[1]))], names=["y", "lang", "score"]) for b in batches), "y int, lang string, score double"))
    store.drop(scored)
    return net, found


def _log_odds(train: DataFrame, groups: int, n: list[int]) -> np.ndarray:
    """Shrunk log-odds of each hash by the texts of either class that hold it."""

    def count(g, ids, first, y):
        hold = np.zeros((2, BUCKETS * len(SPANS)))
        for i in range(len(y)):
            hold[y[i], np.unique(ids[first[i] : first[i + 1]] + _OFFSETS)] += 1
        return hold.ravel()

    hold = 1 + _summed(train, groups, count).reshape(2, -1)
    odds = np.log(hold[1] / (n[1] + 2)) - np.log(hold[0] / (n[0] + 2))
    sure = (hold.sum(0) - 2) / (hold.sum(0) + 3)
    return np.clip(odds * sure, -1, 3).astype(np.float32)


def _platt(scored: DataFrame, n0: int, n1: int) -> tuple[float, float]:
    """Scale and shift of the logit on smoothed targets, by Newton steps on the standardised logit, halved
    until the loss is no larger."""
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    mean, deviation = scored.agg(F.avg("z"), F.stddev_pop("z")).first()
    deviation = deviation or 1.0

    def at(a: float, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and second derivatives."""

        def sums(batches):
            total = np.zeros(6)
            for x in batches:
                y, z = x.column(0).to_numpy(), (x.column(1).to_numpy() - mean) / deviation
                t, m = np.where(y == 1, high, low), a * z + b
                p = sigmoid(m)
                r, w = p - t, p * (1 - p) + 1e-6
                total += [(np.logaddexp(0, m) - t * m).sum(), (r * z).sum(), r.sum(), (w * z * z).sum(), (w * z).sum(), w.sum()]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=list("uvwxyz"))

        loss, rz, r, wzz, wz, w = scored.select("y", "z").mapInArrow(sums, ", ".join(f"{c} double" for c in "uvwxyz")).agg(*[F.sum(c) for c in "uvwxyz"]).first()
        return loss + 5e-4 * (a - 1) ** 2, np.array([rz + 1e-3 * (a - 1), r]), np.array([[wzz + 1e-3, wz], [wz, w]])

    now = np.array([1.0, 0.0])
    loss, g, h = at(*now.tolist())
    step = np.linalg.solve(h, g)
    for _ in range(60):
        if np.abs(step).max() < 1e-9:
            break
        found = at(*(now - step).tolist())
        if found[0] > loss + 1e-12 * abs(loss):
            step = step / 2
            continue
        now, (loss, g, h) = now - step, found
        step = np.linalg.solve(h, g)
    a = max(now[0] / deviation, 1e-3)
    return float(a), float(now[1] - a * mean)


def limits(scored: DataFrame) -> DataFrame:
    """For each language ``l`` with ten rows of either class and, as the empty one, for all rows the
    ``limit`` at which F1 is largest: halfway from that score to the next below."""
    key = F.explode(F.array(F.lit(""), F.nullif(F.col("lang"), F.lit(""))))
    points = scored.select(key.alias("l"), "score", "y").where(F.col("l").isNotNull()).groupBy("l", "score").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    points = store.written(points, "points")
    steps = int(min(1_000, points.where("l = ''").count() // RANGE + 1))
    bounds = points.where("l = ''").select(F.percentile_approx("score", [i / steps for i in range(1, steps)], F.lit(10 * steps))).first()[0] if steps > 1 else []
    every_ = F.array(*[F.lit(x) for x in sorted(set(bounds))]).cast("array<double>")
    ranged = points.withColumn("range", F.size(F.filter(every_, lambda x: x <= F.col("score"))))
    down = Window.partitionBy("l").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("l")
    above = ranged.groupBy("l", "range").agg(F.sum("n").alias("n_"), F.sum("hits").alias("hits_"))
    above = above.select("l", "range", *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(c + "above") for c in ("n_", "hits_")], *[F.sum(c).over(whole).alias(c + "all") for c in ("n_", "hits_")])
    inside = Window.partitionBy("l", "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    n, hits = (F.sum(c).over(inside) + F.col(c + "_above") for c in ("n", "hits"))
    enough = (F.col("l") == "") | (F.least("hits_all", F.col("n_all") - F.col("hits_all")) >= 10)
    f1 = ranged.join(above, ["l", "range"]).where(enough).select("l", "score", (2 * hits / (n + F.col("hits_all"))).alias("f1"))
    best = f1.groupBy("l").agg(F.max(F.struct("f1", "score")).alias("b")).select("l", F.col("b.score").alias("at"))
    below = points.join(best, "l").groupBy("l", "at").agg(F.max(F.when(F.col("score") < F.col("at"), F.col("score"))).alias("below"))
    found = store.written(below.select("l", F.coalesce((F.col("at") + F.col("below")) / 2, F.col("at")).alias("limit")), "limits")
    store.drop(points)
    return found


def train(docs: DataFrame, labels: DataFrame, *, text: str, key: str, label: str, language: str, learn: Column, start: bool = True):
    rows = every(docs, labels, label, key=key, keep=learn, columns={"text": F.col(quoted(text)).cast("string"), "lang": F.col(quoted(language)).cast("string")})

    def vectorise(batches):
        for b in batches:
            made, sizes = [], [np.zeros(0, np.int64)]
            for _, t in K.pieces(b.column(3), _PIECE):
                w = K.Words(t.lower(), K.ALNUM)
                x = (word_ids(w) - _OFFSETS).astype(np.uint16)
                made += [x[i:j].tobytes() for i, j in zip(w.first[:-1], w.first[1:])]
                sizes.append(np.diff(w.first))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.concatenate(sizes), pa.int64()), pa.array(made, pa.binary())], names=["y", "part", "lang", "n", "x"])

    rows = store.written(small_batches(rows).select("y", "part", "lang", "text").mapInArrow(vectorise, "y int, part long, lang string, n long, x binary"), "vectors")
    found = fit(rows, F.col("part").bitwiseAND(0xF00) < 0x300, start=start)
    store.drop(rows)
    return found


def toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", language: str = "lang", learn: Column | None = None, keep: list[str] | None = None, start: bool = True) -> DataFrame:
    """``doc`` (the columns ``keep``), ``score``, the probability that ``label`` is 1, and
    ``flagged``, whether it reaches the threshold of the document's language.

    ``learn`` is a condition on the rows of ``labels`` that may be learnt from; all of them are. The
    language is no input of the score. Without ``start`` embeddings don't begin with log-odds.
    """
    model, found = train(docs, labels, text=text, key=key, label=label, language=language, learn=F.lit(True) if learn is None else learn, start=start)
    keep = docs.columns if keep is None else keep
    with_lang = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("d"), F.col(quoted(text)).alias("t"), F.col(quoted(language)).cast("string").alias("l"))
    scored = per_text(with_lang, "t", ["d", "l"], "score double", lambda c: [pa.array(model(c))])
    scored = scored.select(F.col("doc.d").alias("doc"), "score", F.col("doc.l").alias("l"))
    usual = F.lit(0.5)
    if found is not None:
        usual = F.lit(found.where("l = ''").first().limit)
        scored = scored.join(found, "l", "left")
    limit = usual if found is None else F.coalesce("limit", usual)
    return scored.select("doc", "score", (F.col("score") >= limit).alias("flagged"))
