"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Words are runs without ASCII white space, case kept; each gives two hashed features, the word
and its last two bytes. Every feature has a sparse random index vector; a feature's context
vector is the sum of the index vectors of the neighbouring words, over the whole corpus. Those
sums form a matrix of fixed size, so each task adds up its own and only matrices are shuffled.
A document is the mean of its words' context vectors plus a few scalars (length, the means'
norms), scored by a two-layer network trained in numpy on a bounded sample of labelled rows;
a temperature fitted on rows kept out of training calibrates the probabilities.

Edge cases: null and empty texts are scored from their zero vector; without usable labels the
score is 0.5, with labels of one class the smoothed share of that class; documents without an
id are scored and never trained on; repeated rows get equal scores and count once for training; an
empty table gives an empty result; very long texts are pooled whole; other columns are carried in
``doc`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernel as K
from textloom.llm.labelled import sample
from textloom.llm.rows import per_text, quoted, small_batches

WORD_BUCKETS, TAIL_BUCKETS, DIM = 1 << 14, 1 << 11, 48
BUCKETS, NONZERO, BLOCKS = WORD_BUCKETS + TAIL_BUCKETS, 2, 18
EXTRA = 5


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each feature's random index vector."""
    h = K.mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0x51ED270B))
    return (h % np.uint64(DIM)).astype(np.int32).reshape(BUCKETS, NONZERO), np.where(h >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, NONZERO)


def features(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    word = (w.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int32)
    tail = (w.hashes(-2) % np.uint64(TAIL_BUCKETS)).astype(np.int32) + WORD_BUCKETS
    return word, tail


def context_sums(docs: DataFrame, text: str) -> np.ndarray:
    """Context vectors of all features over the whole corpus."""
    place, sign = index_vectors()
    size = BUCKETS // BLOCKS

    def add(batches):
        total, any_ = np.zeros(BUCKETS * DIM), False
        for b in batches:
            for _, t in K.pieces(b.column(0)):
                w = K.Words(t, K.NON_SPACE)
                if len(w) < 2:
                    continue
                any_ = True
                own = w.owner()
                i = np.flatnonzero(own[1:] == own[:-1])
                for f in features(w):
                    for a, c in ((i, i + 1), (i + 1, i)):
                        for k in range(NONZERO):
                            total += np.bincount(f[a] * DIM + place[f[c], k], weights=sign[f[c], k], minlength=len(total))
        if any_:
            for k in range(BLOCKS):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k * size * DIM : (k + 1) * size * DIM].astype(np.float32).tobytes()])], names=["block", "sums"])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(x.as_buffer(), np.float32)
                found[k] = found[k] + part if k in found else part.astype(np.float64)
        for k, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()])], names=["block", "sums"])

    parts = small_batches(docs).select(F.col(quoted(text)).cast("string")).mapInArrow(add, "block long, sums binary")
    sums = parts.repartition(BLOCKS, "block").mapInArrow(merge, "block long, sums binary").toArrow()
    out = np.zeros((BUCKETS, DIM))
    for k, x in zip(sums.column("block").to_pylist(), sums.column("sums").to_pylist()):
        out[k * size : (k + 1) * size] = np.frombuffer(x).reshape(size, DIM)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors on the unit sphere; features never seen beside another word stay zero."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of 2 * DIM + EXTRA features for each text."""
    out = np.zeros((len(column), 2 * DIM + EXTRA), np.float32)
    for base, t in K.pieces(column, K.PIECE // 4):
        w = K.Words(t, K.NON_SPACE)
        counts = np.diff(w.first)
        rows, full = out[base : base + len(t)], np.flatnonzero(counts)
        rows[:, -1] = np.log1p(np.diff(t.offsets))
        rows[:, -2] = np.log1p(counts)
        if not len(full):
            continue
        for k, f in enumerate(features(w)):
            mean = np.add.reduceat(vectors[f], w.first[:-1][full], axis=0) / counts[full, None]
            rows[full, k * DIM : (k + 1) * DIM] = mean
            rows[full, 2 * DIM + k] = np.linalg.norm(mean, axis=1)
        rows[full, 2 * DIM + 2] = np.add.reduceat((w.end - w.start).astype(np.float32), w.first[:-1][full]) / counts[full]
    return out


@dataclass
class Network:
    """Two layers over standardised features, and the temperature of the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x).astype(np.float64) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Constant:
    value: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda u: np.mean(np.logaddexp(0, -(2 * y - 1) * logit / np.exp(u)))
    low, high, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray, hidden: int = 48, epochs: int = 30, seed: int = 11):
    """Network trained on the rows not ``apart``; those set the temperature."""
    if len(set(y.tolist())) < 2:
        return Constant((y.sum() + 1) / (len(y) + 2))
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    x = x.astype(np.float32)
    xt, yt = x[~apart], y[~apart].astype(np.float32)
    rng = np.random.default_rng(seed)
    mean, scale = xt.mean(0), xt.std(0) + 1e-3
    p = {"w1": rng.normal(0, xt.shape[1] ** -0.5, (xt.shape[1], hidden)).astype(np.float32), "b1": np.zeros(hidden, np.float32), "w2": rng.normal(0, hidden**-0.5, hidden).astype(np.float32), "b2": np.zeros(1, np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    z = (xt - mean) / scale
    step, rate, size = 0, 3e-3, 256
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(order), size):
            at = order[i : i + size]
            a = z[at]
            h = np.tanh(a @ p["w1"] + p["b1"])
            d = (sigmoid(h @ p["w2"] + p["b2"]) - yt[at]).astype(np.float32) / len(at)
            dh = d[:, None] * p["w2"] * (1 - h * h)
            grad = {"w1": a.T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum(keepdims=True)}
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
    if apart.any():
        net.temperature = fit_temperature(net.logit(x[apart]).astype(np.float64), y[apart])
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, *, text: str, key: str, label: str, learn: Column, most: int):
    rows = sample(docs, labels, label, key=key, keep=learn, most=most, columns={"text": F.col(quoted(text)).cast("string")})

    def vectorise(batches):
        for b in batches:
            x = pooled(b.column(2), vectors)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "part", "x"])

    got = small_batches(rows).select("y", "part", "text").mapInArrow(vectorise, "y int, part long, x binary").toArrow()
    if not got.num_rows:
        return Constant(0.5)
    part = got.column("part").to_numpy()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(part), -1)
    y = got.column("y").to_numpy()
    order = np.lexsort((x[:, 0], y, part))
    return fit(x[order], y[order], (part[order] & 0xF00) < 0x300)


def quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", learn: Column | None = None, keep: list[str] | None = None, most: int = 16_000) -> DataFrame:
    """``doc`` (the columns ``keep``) and ``score``, the probability that ``label`` is 1.

    ``learn`` is a condition on the rows of ``labels`` that may be learnt from; at most ``most``
    of them are.
    """
    vectors = word_vectors(context_sums(docs, text))
    net = train(docs, labels, vectors, text=text, key=key, label=label, learn=F.lit(True) if learn is None else learn, most=most)
    return per_text(docs, text, docs.columns if keep is None else keep, "score double", lambda c: [pa.array(net(pooled(c, vectors)))])
