"""Near-duplicate groups: improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (lower-cased letters, digits and non-ASCII bytes; a
shorter text is one shingle). A shingle weighs its count in the text times the mean inverse
document frequency of its words, 1 + ln(1 + N / df) / ln(1 + N), with document frequencies over
the whole corpus, counted in a table of hashed words whose size is fixed. Each of
``bands * rows`` consistent weighted samples agrees between two texts with a probability equal to
their weighted Jaccard similarity; texts that agree in all rows of a band share a bucket, and all
links are verified on the texts.

Equal texts are one node. Buckets are never expanded into all pairs:

1. Each text is compared with the least text of each of its buckets, and the links found give
   components. A large group of near copies takes one comparison for each text and bucket.
2. Where a bucket still holds several components, the texts outside its largest are compared with
   the others on the texts, in blocks dealt to different tasks, each text with all of a block at
   once. Only links that join components are returned, so their number is below that of the texts.

So every link between texts that share a bucket joins texts of one class. Every document gets the class of its component.

Edge cases: equal texts are duplicates even without any word, so empty ones are one class; null
texts are each alone; null ids are allowed and count as the
largest, 2^63 - 1, and such a row whose class has no smaller one gets no ``class_id``; repeated rows are rows of the
result; ties of ids within a class give it that id; very long texts are compared whole; an empty
table gives an empty result; other columns are carried in ``doc`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import kernel as K
from textloom.llm import store
from textloom.llm.rows import quoted, small_batches

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 12, 3
WORD_BITS, POOL, BLOCK, GROUP = 18, 1 << 12, 1024, 512
_U = np.uint64


def _words(t: K.Texts) -> K.Words:
    return K.Words(t.lower(), K.ALNUM)


def _bucket(wh: np.ndarray) -> np.ndarray:
    return (wh >> _U(64 - WORD_BITS)).astype(np.int64)


def idf_table(docs: DataFrame, text: str) -> np.ndarray:
    """Inverse document frequency of each hashed word."""
    size, blocks = 1 << WORD_BITS, 16
    part = size // blocks

    def count(batches):
        df, n = np.zeros(size + 1, np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, t in K.pieces(b.column(0)):
                w = _words(t)
                seen = np.unique((w.owner() << WORD_BITS) | _bucket(w.hashes()))
                df[:size] += np.bincount(seen & (size - 1), minlength=size)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(blocks), -1]), pa.array([*[df[k * part : (k + 1) * part].astype(np.int32).tobytes() for k in range(blocks)], np.array([n], np.int32).tobytes()])], names=["block", "sums"])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                found[k] = found.get(k, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
        for k, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()])], names=["block", "sums"])

    parts = small_batches(docs).select(F.col(quoted(text)).cast("string")).mapInArrow(count, "block long, sums binary")
    got = parts.repartition(blocks, "block").mapInArrow(merge, "block long, sums binary").toArrow()
    df, n = np.zeros(size), 1
    for k, x in zip(got.column("block").to_pylist(), got.column("sums").to_pylist()):
        if k < 0:
            n = int(np.frombuffer(x, np.int64)[0])
        else:
            df[k * part : (k + 1) * part] = np.frombuffer(x, np.int64)
    return (1 + np.log1p(n / np.maximum(df, 1)) / np.log1p(n)).astype(np.float32)


def weighted_shingles(t: K.Texts, idf: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of (text, hash): text, hash and weight."""
    w = _words(t)
    counts = np.diff(w.first)
    wh = w.hashes()
    start = K.windows(w.first, size)
    h = K.sequences(wh, size)[start] if len(start) else np.zeros(0, _U)
    rare = np.concatenate([[0.0], np.cumsum(idf[_bucket(wh)].astype(np.float64))])
    owner, mean = np.searchsorted(w.first, start, side="right") - 1, (rare[start + size] - rare[start]) / size if len(start) else np.zeros(0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        one = np.array([K.sequences(wh[w.first[i] : w.first[i + 1]], int(counts[i]))[0] for i in short], _U)
        owner, h = np.concatenate([owner, short]), np.concatenate([h, one])
        mean = np.concatenate([mean, (rare[w.first[short + 1]] - rare[w.first[short]]) / counts[short]])
    order = np.lexsort((h, owner))
    owner, h, mean = owner[order], h[order], mean[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    # The mean of a shingle's words, summed in text order, is rounded so that it is the same everywhere.
    return owner[at], h[at], np.round(mean[at], 6) * tf


def _pools(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.random.default_rng(17)
    return g.gamma(2, 1, (samples, POOL)).astype(np.float32), np.log(g.gamma(2, 1, (samples, POOL))).astype(np.float32), g.random((samples, POOL)).astype(np.float32)


def signatures(t: K.Texts, idf: np.ndarray, samples: int, pools) -> np.ndarray:
    """A row of 32-bit sample names for each text; zeros without shingles."""
    out = np.zeros((len(t), samples), np.uint32)
    owner, h, weight = weighted_shingles(t, idf)
    if not len(h):
        return out
    full, first = np.unique(owner, return_index=True)
    log = np.log(weight).astype(np.float32)
    index = [((h >> _U(s)) & _U(POOL - 1)).astype(np.int32) for s in (0, 12, 24)]
    low = (h >> _U(32)).astype(np.uint32)
    r_pool, c_pool, b_pool = pools
    for k in range(samples):
        r, c, b = r_pool[k][index[0]], c_pool[k][index[1]], b_pool[k][index[2]]
        step = np.floor(log / r + b)
        a = c - r * (step - b + 1)
        bits = a.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        name = low ^ (step.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        out[full, k] = np.minimum.reduceat((bits.astype(_U) << _U(32)) | name, first).astype(np.uint32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (hashes in order, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _whole_weights(t: K.Texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``weighted_shingles`` with weights in millionths, whose sums are exact in any order."""
    owner, h, weight = weighted_shingles(t, idf)
    return owner, h, np.rint(weight * 1e6)


def _sets(column: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, t in K.pieces(column):
        owner, h, weight = _whole_weights(t, idf)
        at = np.searchsorted(owner, np.arange(len(t) + 1))
        out += [(h[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:])]
    return out


def _sketches(nodes: DataFrame, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    samples = bands * rows
    pools = _pools(samples)

    def sketch(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = np.concatenate([signatures(t, idf, samples, pools) for _, t in K.pieces(b.column(2), K.PIECE // 2)])
            band = np.stack([K.sequences(s[:, i * rows : (i + 1) * rows].astype(_U).ravel(), rows)[::rows] for i in range(bands)], axis=1)
            empty = ~s.any(axis=1)
            lists = K.list_array(pa.array(band[~empty].ravel().view(np.int64)), np.where(empty, 0, bands))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["node", "id", "bands"])

    return small_batches(nodes).mapInArrow(sketch, "node long, id long, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose similarity reaches the threshold."""
    # A text compared with many gets as many groups as keep each of a bounded size.
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    salted = pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups"))).drop("groups")
    left = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").toDF("left_a", "left_salt", "left_text")
    right = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text").toDF("right_a", "right_salt", "b", "text")

    def check(key, x: pa.Table, y: pa.Table) -> pa.Table:
        found = []
        if x.num_rows and y.num_rows:
            head = _sets(x.column("left_text").combine_chunks().slice(0, 1), idf)[0]
            ids = y.column("b").to_pylist()
            found = [i for i, s in zip(ids, _sets(y.column("text").combine_chunks(), idf)) if similarity(head, s) >= threshold]
        return pa.table({"a": pa.array([key[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return left.groupBy("left_a", "left_salt").cogroup(right.groupBy("right_a", "right_salt")).applyInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node connected) of every node that has a link."""
    spark = links.sparkSession
    both = links.union(links.select("b", "a")).toDF("node", "other").distinct()
    both = store.written(both, "edges")
    labels = store.written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = step.join(jump, "root").select("node", F.least("root", "next").alias("root"), "was")
        after = store.written(step, "labels")
        store.drop(labels)
        if not after.where("root <> was").limit(1).count():
            store.drop(both)
            return after.select("node", "root")
        labels = after.select("node", "root")


def _across(buckets: DataFrame, sketches: DataFrame, comps: DataFrame, named: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links that join different components within a bucket: at most one less than components.

    The texts outside a bucket's largest component are compared with all of the bucket, blocks of
    the ones with blocks of the others, and a pair already connected is passed over. A pair that
    shares several buckets is compared in the first band alone.
    """
    parts = buckets.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = parts.groupBy("band", "value", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "value").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = store.written(mixed.select("band", "value", "major", blocks(F.col("n") - F.col("most")).alias("minor_blocks"), blocks(F.col("n")).alias("all_blocks")), "mixed")
    rows = parts.join(mixed, ["band", "value"])
    rows = store.written(rows.join(sketches.select("node", "bands"), "node"), "open")
    texts = _texts(named, sketches, rows.select("node").distinct())
    rows = rows.join(texts, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["node", "root", "bands", "text"]
    left = rows.where("root <> major").select(F.col("band").alias("lb"), F.col("value").alias("lv"), deal("minor_blocks").alias("li"), every("all_blocks").alias("lj"), *[F.col(c).alias("l_" + c) for c in columns])
    right = rows.select("band", "value", deal("all_blocks").alias("j"), every("minor_blocks").alias("i"), *columns)

    def compare(key, x: pa.Table, y: pa.Table) -> pa.Table:
        band, links = key[0].as_py(), []
        if x.num_rows and y.num_rows:
            links = _join_components(band, *_compared(x, "l_"), *_compared(y, ""), idf, threshold)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("lb", "lv", "li", "lj").cogroup(right.groupBy("band", "value", "i", "j")).applyInArrow(compare, "a long, b long").distinct()


def _compared(t: pa.Table, prefix: str):
    bands = t.column(prefix + "bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    return t.column(prefix + "node").to_numpy(), t.column(prefix + "root").to_numpy(), bands, t.column(prefix + "text").combine_chunks()


def _join_components(band, node, root, bands, texts, node2, root2, bands2, texts2, idf, threshold) -> list[tuple[int, int]]:
    """Links between a text of the left and one of the right that join components, one for each join."""
    mine, links, at = _sets(texts, idf), [], 0
    root, root2 = root.copy(), root2.copy()
    for _, t in K.pieces(texts2):
        here = slice(at, at + len(t))
        at += len(t)
        owner, h, weight = _whole_weights(t, idf)
        names, code = np.unique(h, return_inverse=True)
        total = np.bincount(owner, weight, len(t))
        dense = np.zeros(len(names))
        for k, (h1, w1) in enumerate(mine):
            own = w1.sum()
            # No similarity exceeds the ratio of the smaller total to the larger; the slack is for rounding.
            near = (root2[here] != root[k]) & (np.minimum(total, own) >= threshold * (1 - 1e-9) * np.maximum(total, own))
            near[near] = np.argmax(bands2[here][near] == bands[k], axis=1) == band
            if not near.any():
                continue
            place = np.minimum(np.searchsorted(names, h1), len(names) - 1)
            same = names[place] == h1
            dense[place[same]] = w1[same]
            pick = np.flatnonzero(near[owner])
            both = np.bincount(owner[pick], np.minimum(weight[pick], dense[code[pick]]), len(t))
            dense[place[same]] = 0
            hits = np.flatnonzero(near & (both / (total + own - both) >= threshold))
            joined, one = np.unique(root2[here][hits], return_index=True)
            for i in hits[one] + here.start:
                links.append((min(int(node[k]), int(node2[i])), max(int(node[k]), int(node2[i]))))
            if len(joined):
                to = root[k]
                root[np.isin(root, joined)], root2[np.isin(root2, joined)] = to, to
    return links


def _texts(named: DataFrame, sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``text``, one row for each of the nodes."""
    own = nodes.join(sketches.select("node", "id"), "node")
    return named.join(own, ["node", "id"]).dropDuplicates(["node"]).select("node", "text")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: ``doc`` (its columns ``keep``), ``class_id`` (the least id of its group),
    ``id`` (its own), and ``component`` (the group, null for a null text)."""
    keep = docs.columns if keep is None else keep
    body = F.col(quoted(text)).cast("string")
    ident = F.coalesce(F.col(quoted(key)).cast("long"), F.lit((1 << 63) - 1))
    idf = idf_table(docs, text)
    named = docs.where(body.isNotNull()).select(F.xxhash64(body).alias("node"), ident.alias("id"), body.alias("text"))
    every = _sketches(named, idf, bands, rows)
    sketches = store.written(every.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "sketches")
    buckets = store.written(sketches.select("node", F.posexplode("bands").alias("band", "value")), "buckets")
    shared = buckets.groupBy("band", "value").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "value", "a")
    star = store.written(buckets.join(shared, ["band", "value"]).where("a <> node").select("a", F.col("node").alias("b")).distinct(), "star")
    ends = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = store.written(_verify(star, _texts(named, sketches, ends), idf, threshold), "links")
    comps = components(links)
    more = store.written(_across(buckets, sketches, comps, named, idf, threshold), "across")
    if more.limit(1).count():
        links = links.union(more)
        comps = components(links)
    classes = comps.join(sketches.select("node", "id"), "node")
    least_id = classes.groupBy("root").agg(F.min("id").alias("class_id"))
    classes = store.written(classes.join(least_id, "root").select("node", "class_id", "root"), "classes")
    d = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("doc"), F.when(body.isNotNull(), F.xxhash64(body)).alias("node"), ident.alias("id"), F.col(quoted(key)).isNull().alias("nameless"))
    d = d.join(sketches.select("node", F.col("id").alias("own")), "node", "left").join(classes, "node", "left")
    class_id = F.coalesce("class_id", "own", "id")
    # A class of nothing but rows without an id has none either.
    return d.select("doc", F.when(~(F.col("nameless") & (class_id == (1 << 63) - 1)), class_id).alias("class_id"), F.coalesce("root", "node").alias("component"), "id")


def one_of_each(groups: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` to keep: of each group the one with the least id."""
    order = Window.partitionBy("component").orderBy("id")
    alone = groups.where(F.col("component").isNull())
    return groups.where(F.col("component").isNotNull()).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth").unionByName(alone)
