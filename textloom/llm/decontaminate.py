"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of ``size`` consecutive words (an item with fewer words, but
not none, is one window). A window is contained in a document if all of its words are found
there in order, so the join's required overlap is the whole window and one token of it, the
rarest by document-corpus counts, is a sufficient prefix. Document words that are no prefix of
any window are dropped; the rest are aligned at each offset that their prefix has (positional
bound), must leave room for the window in their document (length bound), and are then verified
word by word. Words are known by hash but compared by their bytes, so hashes that collide cost
time and change nothing. Nothing is shuffled but the counts of the item words.

The benchmark's distinct rows are taken in blocks of about ``block_bytes`` of text (an item is in
one block); only one block's windows, some four times its text, are broadcast at once, so that
has a bound however large the benchmark. Each further block is a further pass over the documents.

Edge cases: null, empty or word-free texts have no words and no hits; an empty benchmark hits
nothing and an empty table of documents gives an empty result; repeated documents are judged one
by one; repeated items count once by id; items without an id mark words but aren't listed; very
long texts are taken whole, a batch ends after some bytes; extra columns of documents are
carried in ``doc`` whatever their names, those of the benchmark are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernel as K
from textloom.llm import store
from textloom.llm.rows import per_text, quoted, small_batches

_BITS = 20


@dataclass
class Vocabulary:
    """The distinct words of some items, in order of their hashes, with their bytes."""

    hash: np.ndarray
    data: np.ndarray
    at: np.ndarray
    bitmap: np.ndarray

    def ids(self, w: K.Words) -> np.ndarray:
        """The number of each word, -1 for others: found by hash, decided by the bytes."""
        wh = w.hashes()
        p = np.flatnonzero(self.bitmap[_slot(wh)])
        out = np.full(len(wh), -1, np.int32)
        i = np.searchsorted(self.hash, wh[p])
        while len(p):
            some = (i < len(self.hash)) & (self.hash[np.minimum(i, len(self.hash) - 1)] == wh[p])
            p, i = p[some], i[some]
            size = self.at[i + 1] - self.at[i]
            same = size == (w.end - w.start)[p]
            same[same] = K.equal_bytes(w.texts.data, w.start[p[same]], self.data, self.at[i[same]], size[same])
            out[p[same]] = i[same]
            p, i = p[~same], i[~same] + 1
        return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def _vocabulary(w: K.Words) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of some words, and the number of each word in it."""
    body, wh = w.texts.data.tobytes(), w.hashes()
    known: dict[bytes, int] = {}
    first = np.array([known.setdefault(body[s:e], k) for k, (s, e) in enumerate(zip(w.start.tolist(), w.end.tolist()))], np.int64)
    one = np.unique(first)
    one = one[np.argsort(wh[one], kind="stable")]
    number = np.zeros(len(wh), np.int32)
    number[one] = np.arange(len(one))
    own, j = K.ragged((w.end - w.start)[one])
    at = np.concatenate([[0], np.cumsum((w.end - w.start)[one])])
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[_slot(wh[one])] = True
    return Vocabulary(wh[one], w.texts.data[w.start[one][own] + j], at, bitmap), number[first]


@dataclass
class Windows:
    """Distinct item windows of one length, in order of a hash: where each begins among the items'
    words, and the items that have it."""

    size: int
    start: np.ndarray
    key: np.ndarray
    item_at: np.ndarray
    items: np.ndarray


@dataclass
class Block:
    ids: pa.Array
    words: np.ndarray
    windows: list[Windows]
    vocabulary: Vocabulary


def _keys(numbers: np.ndarray, size: int) -> np.ndarray:
    return K.sequences(K.mix(numbers.astype(np.uint64) + np.uint64(1)), size)


def _block(items: pa.Table, size: int) -> Block:
    t = K.texts(items.column("text").combine_chunks()).lower()
    w = K.Words(t, K.ALNUM)
    vocabulary, words = _vocabulary(w)
    n_words, owner = np.diff(w.first), w.owner()
    out = []
    for length in sorted({size, *n_words[(n_words > 0) & (n_words < size)].tolist()}):
        start = K.windows(w.first, size) if length == size else w.first[:-1][n_words == length]
        if not len(start):
            continue
        key = _keys(words, length)[start]
        order = np.lexsort([*[words[start + j] for j in range(length - 1, -1, -1)], key])
        start, key = start[order], key[order]
        new = np.ones(len(start), bool)
        new[1:] = key[1:] != key[:-1]
        for j in range(length):
            new[1:] |= words[start[1:] + j] != words[start[:-1] + j]
        pairs = np.unique(np.stack([np.cumsum(new) - 1, owner[start]]), axis=1)
        out.append(Windows(length, start[new], key[new], np.searchsorted(pairs[0], np.arange(int(new.sum()) + 1)), pairs[1]))
    return Block(items.column("item").combine_chunks(), words, out, vocabulary)


def _counts(docs: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """How often each vocabulary word occurs in all documents."""
    size = len(vocabulary.hash)

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, t in K.pieces(b.column(0)):
                i = vocabulary.ids(K.Words(t.lower(), K.ALNUM))
                total += np.bincount(i[i >= 0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    found = small_batches(docs).select(F.col(quoted(text)).cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("word").to_numpy()] = found.column("n").to_numpy()
    return out


@dataclass
class Prefixes:
    """For each vocabulary word the alignments (window set, offset) at which to try it, if any."""

    at: np.ndarray
    which: np.ndarray
    offset: np.ndarray


def _prefixes(block: Block, counts: np.ndarray) -> Prefixes:
    rows = []
    for k, x in enumerate(block.windows):
        least = np.full(len(x.start), np.iinfo(np.int64).max)
        word, offset = np.zeros(len(x.start), np.int64), np.zeros(len(x.start), np.int64)
        for j in range(x.size):
            own = block.words[x.start + j]
            rarer = (counts[own] < least) | ((counts[own] == least) & (own < word))
            least[rarer], word[rarer], offset[rarer] = counts[own][rarer], own[rarer], j
        rows.append(np.unique(np.stack([word, np.full(len(word), k), offset]), axis=1))
    pairs = np.unique(np.concatenate(rows, axis=1), axis=1)
    return Prefixes(np.searchsorted(pairs[0], np.arange(len(block.vocabulary.hash) + 1)), pairs[1], pairs[2])


def _hits(w: K.Words, block: Block, pre: Prefixes):
    """(start word, window set, window) of every verified occurrence."""
    ids = block.vocabulary.ids(w)
    p = np.flatnonzero(ids >= 0)
    i = ids[p]
    own, step = K.ragged(pre.at[i + 1] - pre.at[i])
    a = pre.at[i[own]] + step
    set_, start = pre.which[a], p[own] - pre.offset[a]
    doc = np.searchsorted(w.first, p[own], side="right") - 1
    low, high = w.first[doc], w.first[doc + 1]
    for k, x in enumerate(block.windows):
        ok = (set_ == k) & (start >= low) & (start + x.size <= high)
        s = np.unique(start[ok])
        for j in range(x.size):
            s = s[ids[s + j] >= 0]
        if not len(s):
            continue
        around = s[:, None] + np.arange(x.size)
        key = _keys(ids[around].ravel(), x.size)[:: x.size]
        at = np.searchsorted(x.key, key)
        while len(s):
            some = (at < len(x.key)) & (x.key[np.minimum(at, len(x.key) - 1)] == key)
            s, at, key = s[some], at[some], key[some]
            same = np.ones(len(s), bool)
            for j in range(x.size):
                same &= ids[s + j] == block.words[x.start[at] + j]
            yield s[same], x, at[same]
            s, at, key = s[~same], at[~same] + 1, key[~same]


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document: ``doc`` (its columns ``keep``), ``n_words``, ``hits`` (word ranges from
    ``start`` up to, not including, ``end``) and ``items`` (ids of items with a window in it)."""
    keep = docs.columns if keep is None else keep
    bench = benchmark.select(F.col(quoted(item)).alias("item"), F.col(quoted(item_text)).cast("string").alias("text")).distinct()
    volume = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(volume) // block_bytes
    id_type = bench.schema["item"].dataType.simpleString()
    if blocks == 1:
        return _pass(None, docs, text, keep, _block(bench.toArrow(), size), id_type).withColumn("items", F.array_distinct("items"))
    out, inner = None, docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("d"), F.col(quoted(text)).alias("t"))
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        out = store.written(_pass(out, inner, "t", ["d", "t"], _block(rows.toArrow(), size), id_type), "contamination")
    return out.select(F.col("doc.d").alias("doc"), "n_words", "hits", F.array_distinct("items").alias("items"))


def _pass(before: DataFrame | None, docs: DataFrame, text: str, keep: list[str], block: Block, id_type: str) -> DataFrame:
    pre = _prefixes(block, _counts(docs, text, block.vocabulary)) if block.windows else None
    sent = docs.sparkSession.sparkContext.broadcast((block, pre))

    def match(column: pa.Array, old_hits: pa.Array | None = None, old_items: pa.Array | None = None) -> list[pa.Array]:
        block, pre = sent.value
        ids = block.ids
        n_words, starts, ends, n_spans, found, n_found = [], [], [], [], [], []
        for base, t in K.pieces(column):
            w = K.Words(t.lower(), K.ALNUM)
            n, docs_here = len(w), len(t)
            step = np.zeros(n + 1, np.int64)
            pairs = [np.zeros((2, 0), np.int64)]
            if pre is not None and n:
                for s, x, at in _hits(w, block, pre):
                    step += np.bincount(s, minlength=n + 1) - np.bincount(s + x.size, minlength=n + 1)
                    doc = np.searchsorted(w.first, s, side="right") - 1
                    seen = np.unique(np.stack([doc, at]), axis=1)
                    own, j = K.ragged(x.item_at[seen[1] + 1] - x.item_at[seen[1]])
                    pairs.append(np.stack([seen[0][own], x.items[x.item_at[seen[1][own]] + j]]))
            if old_hits is not None:
                for i in range(docs_here):
                    for span in old_hits[base + i].as_py():
                        step[w.first[i] + span["start"]] += 1
                        step[w.first[i] + span["end"]] -= 1
            inside = np.cumsum(step[:n]) > 0
            edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cut = w.first[1:-1]
            cut = np.unique(cut[(cut > 0) & (cut < n)])
            cut = cut[inside[cut] & inside[cut - 1]] if n else cut
            s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
            doc = np.searchsorted(w.first, s, side="right") - 1
            n_words.append(np.diff(w.first))
            starts.append(s - w.first[doc])
            ends.append(e - w.first[doc])
            n_spans.append(np.bincount(doc, minlength=docs_here))
            both = np.unique(np.concatenate(pairs, axis=1), axis=1)
            named = ids.is_valid().to_numpy(zero_copy_only=False)[both[1]] if both.shape[1] else np.zeros(0, bool)
            both = both[:, named]
            found.append(both[1])
            n_found.append(np.bincount(both[0], minlength=docs_here))
        cat = np.concatenate
        spans = pa.StructArray.from_arrays([pa.array(cat(starts)), pa.array(cat(ends))], names=["start", "end"])
        items = K.list_array(ids.take(pa.array(cat(found))), cat(n_found))
        if old_items is not None:
            items = pa.array([sorted({*a.as_py(), *b.as_py()}) for a, b in zip(items, old_items)], items.type)
        return [pa.array(cat(n_words)), K.list_array(spans, cat(n_spans)), items]

    results = f"n_words long, hits array<struct<start:long,end:long>>, items array<{id_type}>"
    if before is None:
        return per_text(docs, text, keep, results, match)
    again = before.select("doc.*", "hits", "items")
    return per_text(again, text, keep, results, match, {"hits": F.col("hits"), "items": F.col("items")})
