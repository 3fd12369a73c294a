"""Each operator against brute force or an exact round trip, on rows with nulls, empty and long
texts, ties, repeated rows and clashing extra columns, and on empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, neardup, packing, queries, runs
from textloom.llm import kernel as K
from textloom.llm.decontaminate import contamination
from textloom.llm.lines import line_dedup, repeated_runs
from textloom.llm.neardup import near_duplicates, one_of_each
from textloom.llm.neighbours import neighbours
from textloom.llm.quality import quality
from textloom.llm.queries import tokenizer_path
from textloom.llm.substring import Index, substring_dedup
from textloom.llm.suffixes import difference_cover, repeated_bytes
from textloom.llm.tokens import encoder
from textloom.llm.toxicity import common_length, spread, toxicity

#: The extra columns have the names of the operators' results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, score double, n_words long, removed string, kept string, class_id long, id long, node long"


def word(r):
    return "".join(r.choice("abcdé") for _ in range(r.randint(1, 3)))


def corpus(seed=1, n=40):
    r = random.Random(seed)
    texts = [" ".join(word(r) for _ in range(r.randint(1, 60))) for _ in range(n)]
    for i in range(0, n, 4):
        cut = texts[r.randrange(n)].split(" ")
        texts[i] += "\n" + " ".join(cut[: r.randint(5, 40)]) + "\nsame line\nother line\n\nend" + str(i)
    texts += [None, "", " \n ", "x" * 3000, texts[0], texts[3] + " tail", texts[3], "ab " * 400]
    return [(i if i != n + 2 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "d", 0.5, 1, "r", "k", 2, 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return -(1 << 63) if i is None else i


def spans(flags):
    edge = np.diff(np.concatenate([[0], np.array(flags, int), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def test_kernel():
    t = K.texts(pa.array(["ab c", None, "", "c ab", "é  é"]).slice(0, 5))
    w = K.Words(t, K.NON_SPACE)
    assert w.first.tolist() == [0, 2, 2, 2, 4, 6]
    h = w.hashes()
    assert h[0] == h[3] and h[1] == h[2] and h[4] == h[5] and h[0] != h[1]
    x = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    back = np.concatenate([runs.decode(b, blob, 6) for b, blob in runs.encode(x, 6)])
    assert (back == x).all() and runs.bucket_counts(x, 6).sum() == len(x)


@pytest.mark.parametrize("q", [2, 3, 5, 7])
def test_difference_cover(q):
    period, cover = difference_cover(q)
    assert len(cover) == q + 1 and {(a - b) % period for a in cover for b in cover} == set(range(period))


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


#: Two words whose polynomial hashes modulo 2**64 are alike whatever the base.
TWIN, OTHER = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_twin_words_differ(spark):
    w = K.Words(K.texts(pa.array([TWIN + " " + OTHER + " " + TWIN])), K.NON_SPACE)
    h = w.hashes()
    assert h[0] == h[2] != h[1]
    rest = [f"w{i}" for i in range(12)]
    df = spark.createDataFrame([(1, " ".join([TWIN, *rest])), (2, " ".join([OTHER, *rest])), (3, " ".join([TWIN, *rest]))], "doc_id long, text string")
    assert {r.doc.doc_id: r.removed for r in substring_dedup(df).collect()} == {1: [], 2: [], 3: [(0, 13)]}
    bench = spark.createDataFrame([(7, " ".join([TWIN, *rest[:9]]))], "item_id long, text string")
    assert {r.doc.doc_id: r["items"] for r in contamination(df, bench).collect()} == {1: [7], 2: [], 3: [7]}


@pytest.mark.parametrize("bits", [64, 20])
def test_substring(spark, docs, rows, none, bits):
    """With fingerprints of 20 bits too, whose chance matches the check has to turn down."""
    size = 4
    want = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, split):
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            least[g] = min(least.get(g, key(i)), key(i))
    for (i, t), w in zip(rows, split):
        gone = [0] * len(w)
        for s in range(len(w) - size + 1):
            if least[tuple(w[s : s + size])] < key(i):
                gone[s : s + size] = [1] * size
        want[i, t] = (len(w), spans(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = substring_dedup(docs, size=size, batches=3, index=Index(size, 6, key=77, hash_bits=bits)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, [tuple(s) for s in r.removed], r.kept) == want[r.doc.doc_id, r.doc.text]
    assert substring_dedup(none, size=size).count() == 0


def test_substring_index_is_incremental(spark):
    index = Index(3, 6, fan_in=2)
    for batch, kept in (("a b c d", "a b c d"), ("x y z", "x y z"), ("q b c d x y z", "q"), ("q b c d", "")):
        i = len(index.runs) * 10 + ord(batch[0])
        df = spark.createDataFrame([(i, batch)], "doc_id long, text string")
        assert substring_dedup(df, size=3, index=index).first().kept == kept
    assert len(index.runs) < 4


def test_substring_of_one_hot_id(spark, monkeypatch):
    """An id with most of the rows is split over chunks, and its rows don't remove one another's words."""
    from textloom.llm import substring

    r = random.Random(5)
    rows = [(None if i % 3 else i, " ".join(r.choice("abcdefgh") for _ in range(3000))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    split = []
    place = substring._chunks
    monkeypatch.setattr(substring, "_chunks", lambda *a: split.append(a[-1]) or place(*a))
    got = substring_dedup(df, size=13, batches=2).collect()
    assert split[0] and all(not r.removed for r in got if r.doc.doc_id is None) and len(got) == 300


def test_decontamination_with_colliding_hashes(monkeypatch, docs, rows, none, spark):
    """Hashes of eight values change nothing: words are compared by their bytes."""
    real = K.byte_hashes
    weak = lambda *a: (real(*a) >> np.uint64(61)) << np.uint64(61)
    from textloom.llm import decontaminate

    texts = pa.array([t for _, t in rows])
    items = pa.table({"item": pa.array([1, 2], pa.int64()), "text": pa.array([rows[3][1], rows[7][1]])})
    found = []
    for hashes in (real, weak):
        monkeypatch.setattr(K, "byte_hashes", hashes)
        block = decontaminate._block(items, 4)
        pre = decontaminate._prefixes(block, np.ones(len(block.vocabulary.hash), np.int64))
        w = K.Words(K.texts(texts).lower(), K.ALNUM)
        found.append(sorted((int(s), x.size, int(i)) for starts, x, at in decontaminate._hits(w, block, pre) for s, a in zip(starts, at) for i in x.items[x.item_at[a] : x.item_at[a + 1]]))
    assert found[0] and found[0] == found[1]


@pytest.mark.parametrize("bits", [64, 20])
def test_suffixes(docs, rows, none, bits):
    """With fingerprints of 20 bits too, whose chance matches the check has to turn down."""
    size = 12
    body = [(i, t, (t or "").encode()) for i, t in rows]
    n = Counter(b[s : s + size] for *_, b in body for s in range(len(b) - size + 1))
    got = {(r.doc.doc_id, r.doc.text): r for r in repeated_bytes(docs, size=size, blocks=3, hash_bits=bits).collect()}
    for i, t, b in body:
        gone = [0] * len(b)
        for s in range(len(b) - size + 1):
            if n[b[s : s + size]] > 1:
                gone[s : s + size] = [1] * size
        r = got[i, t]
        assert (r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) == (len(b), spans(gone), bytes(x for x, g in zip(b, gone) if not g))
    assert repeated_bytes(none, size=size).count() == 0


@pytest.mark.parametrize("least", [2, 3])
def test_lines(docs, rows, none, least):
    once = sorted({(key(i), t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    seen, first, gone = {}, {}, {x: set() for x in once}
    for x in once:
        seq = [p for p, line in enumerate(x[1].split("\n")) if line.strip(" \t\r\x0b\x0c")]
        for s in range(len(seq) - least + 1):
            g = tuple(x[1].split("\n")[p] for p in seq[s : s + least])
            first.setdefault(g, (x, s))
            seen.setdefault(g, []).append((x, seq[s : s + least], s))
    for g, places in seen.items():
        for x, p, s in places:
            if (x, s) != first[g]:
                gone[x] |= set(p)
    got = line_dedup(docs, min_lines=least).collect()
    assert len(got) == len(rows)
    some = 0
    for r in got:
        t = r.doc.text
        if t is None:
            assert r.kept is None and r.n_lines == 0
            continue
        want = gone[key(r.doc.doc_id), t]
        if sum(1 for x in once if x[0] == key(r.doc.doc_id)) == 1:
            assert list(r.removed) == sorted(want)
        some += len(r.removed)
        assert r.kept == "\n".join(line for p, line in enumerate(t.split("\n")) if p not in r.removed)
    assert some and line_dedup(none).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_maximal_runs_of_lines(spark, least):
    """Periodic and overlapping runs: each is as long as it goes, starts where none goes on, and all cover every later copy."""
    r = random.Random(least)
    seqs = ["abc" * 7, "a" * 40, "".join(r.choice("ab") for _ in range(90)), "".join(r.choice("abcdef") for _ in range(200))]
    seqs += [seqs[3][20:150] + "x" + seqs[2][5:60], "xy" + seqs[3], "abc" * 7, "z"]
    df = spark.createDataFrame([(i, "\n".join(s)) for i, s in enumerate(seqs)], "doc_id long, text string")
    places, later = {}, set()
    for i, s in enumerate(seqs):
        for n in range(1, len(s) - least + 2):
            if places.setdefault(s[n - 1 : n - 1 + least], (i, n)) != (i, n):
                later.add((i, n))
    covered, starts = set(), set()
    for x in repeated_runs(df, min_lines=least).collect():
        s, t, m = seqs[x.id][x.n - 1 :], seqs[x.first.id][x.first.n - 1 :], x.length
        assert (x.first.id, x.first.n) < (x.id, x.n) and m >= least
        assert s[:m] == t[:m] and s[m : m + 1] != t[m : m + 1] or m == min(len(s), len(t))
        assert (x.id, x.n) not in starts
        starts.add((x.id, x.n))
        covered |= {(x.id, x.n + k) for k in range(m - least + 1)}
    assert covered == later
    gone = {r.doc_id: list(r.removed) for r in line_dedup(df, min_lines=least, keep=["doc_id"]).select("doc.doc_id", "removed").collect()}
    assert gone == {i: sorted({n - 1 + k for j, n in later if j == i for k in range(least)}) for i in range(len(seqs))}


def test_pipeline_drops_copies_of_single_lines(spark):
    """Of each line that isn't blank the first copy is left, also between lines that differ."""
    long = " ".join(f"w{i}" for i in range(60))
    texts = ["a\n" + long + "\nb", "c\n" + long + "\n\nd", long, "e", "e", None, "", "f\nf\ng\n" + long]
    df = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    seen, want = set(), {}
    for i, t in enumerate(texts):
        left = None
        if t is not None:
            lines, left = t.split("\n"), []
            for line in lines:
                if not line or line not in seen:
                    left.append(line)
                seen.add(line)
            if len(left) < len(lines) and not any(left):
                continue
            left = "\n".join(left)
        want[i] = (left, None if left is None else len(left))
    assert got == want


def test_decontamination(spark, docs, rows, none):
    size = 4
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bench = [(1, rows[3][1]), (2, "b"), (3, None), (4, "..."), (5, rows[8][1][:30].upper().replace("É", "é")), (5, rows[8][1][:30]), (None, rows[9][1]), (10, rows[3][1])]
    table = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, n_words int")
    windows = [(i, tuple(w[s : s + min(size, len(w))])) for i, t in bench for w in [find(t)] if w for s in range(len(w) - min(size, len(w)) + 1)]
    for limit in (16 << 20, 100):
        got = {(r.doc.doc_id, r.doc.text): r for r in contamination(docs, table, size=size, block_bytes=limit).collect()}
        for i, t in rows:
            w = find(t)
            hit, items = [0] * len(w), set()
            for k, g in windows:
                for s in range(len(w) - len(g) + 1):
                    if tuple(w[s : s + len(g)]) == g:
                        hit[s : s + len(g)] = [1] * len(g)
                        items |= {k} - {None}
            r = got[i, t]
            assert (r.n_words, sorted(r.items)) == (len(w), sorted(items))
            assert sorted(p for s in r.hits for p in range(s.start, s.end)) == [p for p, h in enumerate(hit) if h]
    assert contamination(none, table).count() == 0 and all(r.items == [] for r in contamination(docs, table.limit(0)).collect())


def test_neardup(docs, rows, none):
    got = near_duplicates(docs)
    found = {(r.doc.doc_id, r.doc.text): r.class_id for r in got.collect()}
    assert found[0, rows[0][1]] == 0 and found[44, rows[44][1]] == 0
    assert found[46, rows[46][1]] == 3
    kept = [(r.doc.doc_id, r.doc.text) for r in one_of_each(got).collect()]
    assert kept.count((0, rows[0][1])) == 1 and (44, rows[44][1]) not in kept and (40, None) in kept
    assert near_duplicates(none).count() == 0


def test_neardup_against_all_pairs(spark):
    """Classes are those of the links that comparing all pairs finds, but for one in ten at most."""
    r = random.Random(21)
    texts = []
    for i in range(60):
        w = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(r.randint(30, 120))]
        texts.append(" ".join(w))
        for _ in range(r.randint(0, 3)):
            v = w[:]
            for p in r.sample(range(len(v)), r.randint(1, 4)):
                v[p] = "".join(r.choice("xyz") for _ in range(4))
            texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = neardup.idf_table(df, "text")
    sets = neardup._sets(pa.array(texts), idf)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similarity(sets[i], sets[j]) >= 0.8]
    # The similarity itself, from the texts.
    for i, j in near[:20]:
        weights = []
        for k in (i, j):
            w = texts[k].split()
            weights.append(Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4)))
        both = sum((weights[0] & weights[1]).values()) / sum((weights[0] | weights[1]).values())
        assert both > 0.7
    for i, j in near:
        root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(find(i), i)
    got = {x.doc.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert all(least[find(i)] == least[find(got[i])] for i in got)
    assert len(near) > 30 and sum(got[i] == got[j] for i, j in near) >= 0.99 * len(near)


def test_neardup_ids_at_the_limit(spark):
    df = spark.createDataFrame([((1 << 63) - 1, "a b c"), (None, "a b c"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = sorted((x.doc.text, x.doc.doc_id is None, x.class_id) for x in near_duplicates(df).collect() if x.doc.text != "x")
    assert got == [("a b c", False, (1 << 63) - 1), ("a b c", True, None)]
    assert [x.class_id for x in near_duplicates(df).where("doc.text = 'x'").collect()] == [None, None]


def test_neardup_chains(spark):
    """A chain of texts each near the next joins into one class; far ones stay apart."""
    r = random.Random(3)
    w = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = []
    for _ in range(8):
        texts.append(" ".join(w))
        w = w[:]
        for p in r.sample(range(400), 2):
            w[p] = "".join(r.choice("xyz") for _ in range(6))
    far = [" ".join(r.sample(w, 300)) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts + far)), "doc_id long, text string")
    assert {r.doc.doc_id: r.class_id for r in near_duplicates(df).collect()} == {**{i: 0 for i in range(8)}, 8: 8, 9: 9, 10: 10}


def test_neardup_compares_pairs_with_few_samples_alike():
    """Within a bucket the exact similarity alone decides, however few samples agree."""
    texts = pa.array([" ".join(f"w{i}" for i in range(n)) for n in (100, 95, 40)])
    bands = np.arange(3 * 12).reshape(3, 12)
    bands[:, 0] = 7
    node, idf = np.array([10, 11, 12]), np.ones(1 << neardup.WORD_BITS, np.float32)
    one = (node, node, bands, texts)
    assert neardup._join_components(0, *one, *one, idf, 0.8) == [(10, 11)]
    # Pieces of the right side: one text each, and a chain whose ends are far apart joins in two links.
    long = pa.array([" ".join(f"w{i}" for i in range(a, a + 400_000)) for a in (0, 20_000, 60_000)])
    assert len(list(neardup.K.pieces(long))) == 3
    got = neardup._join_components(0, node, node, bands, long, node, node, bands, long, idf, 0.8)
    assert sorted(got) == [(10, 11), (11, 12)] or sorted(got) == [(10, 11), (10, 12)]


def test_neighbours(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 8)).round(3)
    x[10:20] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (350, [0.0] * 8), (301, [float("nan")] * 8), (302, [None] * 8), (None, x[0].tolist()), (400, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = {}
    for r in neighbours(df, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 300, 10):
        s = unit @ unit[q]
        s[q] = -9
        want = sorted(range(300), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5]
        hit += len({v for _, v, _ in mine} & set(want))
        for _, v, score in mine:
            assert score == pytest.approx(s[v], abs=1e-12)
    assert hit >= 0.9 * 150 and set(got) == set(range(0, 300, 10))
    assert [v for _, v, _ in sorted(got[10])] == [11, 12, 13, 14, 15]
    assert neighbours(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_route_by_prefix(spark):
    """Among clustered vectors a query visits a small share of the rows; recall is that of all rows."""
    g = np.random.default_rng(8)
    centres = g.normal(size=(150, 32))
    x = np.repeat(centres, 40, axis=0) + 0.15 * g.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    report = {}
    got = {}
    for r in neighbours(df, F.col("vec_id") % 50 == 0, report=report).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert hit >= 0.9 * 600 and report["share"] < 0.5 and report["floor"] > 0


def test_neighbours_of_repeated_rows(spark):
    """Six repeats of a query row don't hide a twin with another id, whose repeats are rows."""
    rows = [(1, [1.0, 0.0])] * 6 + [(2, [1.0, 0.0])] * 2 + [(3, [1.0, 0.1]), (4, [1.0, 0.2]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours(df, F.col("vec_id") == 1, k=5).collect())
    assert [v for _, v, _ in got] == [2, 2, 3, 4, 5] and [s for *_, s in got[:2]] == [1.0, 1.0]


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    ours = encoder(tokenizer_path())
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "it's <|endoftext|> ok", "né 12 34!!", "tab\t x", "\u00a0 x", "a\u3000 b", "x" * 200, "don't  'tis\n\n\n", "emoji \U0001f600 ok"]
    r = random.Random(2)
    odd += ["".join(r.choice("ab '\n\t12é!") for _ in range(60)) for _ in range(200)]
    for x in odd:
        assert np.frombuffer(ours(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_added_tokens_equal_the_library_default(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ours, end = encoder(tokenizer_path(), added=True), "<|endoftext|>"
    texts = ["ok <|endoftext|> no", end, end + end, f"a{end}b", f" {end} ", f"x \n {end}\n\n y", "<|endoftext|", "plain", f"a  b{end}  c {end[1:]}"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [482, 220, 50256, 645]
    assert [np.frombuffer(ours(x), "<u4").tolist() for x in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(df, tokenizer=tokenizer_path(), capacity=64, end_id=0).placed("doc", "ids").collect()
    assert {r.doc.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got} == {i: [*x, 0] for i, x in enumerate(want)}


def test_packing(docs, rows, none):
    packed = packing.pack(docs, tokenizer=tokenizer_path(), capacity=64)
    got = packed.placed("doc", "piece", "start", "length", "ids").collect()
    encode = encoder(tokenizer_path())
    by = {}
    for r in got:
        by.setdefault((r.doc.doc_id, r.doc.text), []).append(r)
    for i, t in rows:
        own = sorted(by[i, t], key=lambda r: (r.piece, r.sequence_id))
        copies = rows.count((i, t))
        ids = (encode(t) if t else b"") + bytes(4)
        assert b"".join(bytes(r.ids) for r in own[::copies]) == ids
        assert all(r.length == 64 for r in own if r.piece > 0)
    seq = {}
    for r in got:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(seq) <= -(-total // 64) * 1.15 + 1
    assert packed.sequences().agg(F.sum("n_tokens")).first()[0] == total
    assert packing.pack(none, tokenizer=tokenizer_path()).placed("piece").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    g = np.random.default_rng(seed)
    counts = np.bincount(g.integers(1, 101, 3000), minlength=101) * g.integers(0, 4, 101)
    p = packing.plan(counts, 100)
    used = np.zeros(p.sequences, np.int64)
    for length in np.flatnonzero(counts):
        own = p.length == length
        ends = np.append(p.rank[own], counts[length])
        for s, n in zip(p.sequence[own], np.diff(ends)):
            used[s : s + n] += length
    assert used.max(initial=0) <= 100 and used.sum() == (counts * np.arange(101)).sum()
    assert p.sequences <= 1.05 * max(used.sum() / 100, counts[51:].sum()) + 1


def test_chat(spark):
    rows = [(1, 2, "assistant", "hi [INST] \\</s> x"), (1, 1, "user", None), (1, 3, "us%er\n<s>[", "<s>"), (None, 1, "assistant", "lone"), (2, 1, None, ""), (1, 3, "us%er\n<s>[", "<s>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, seq long, role string, text string, conv string")
    out = chat.render(chat.fold(df))
    read = out.select("conv", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    got = {r.conv: ([tuple(t) for t in r.turns], r.loss) for r in read}
    tail = ("us%er\n<s>[", "<s>")
    assert got == {1: ([("user", ""), ("assistant", "hi [INST] \\</s> x"), tail, tail], "hi [INST] \\</s> x"), None: ([("assistant", "lone")], "lone"), 2: ([("", "")], "")}
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_chat_events(spark):
    e = [(1, "message", "m1", "user", "ask"), (2, "message", "m2", "assistant", "He"), (3, "delta", "m2", "assistant", "llo"), (4, "message", "m3", "user", "more"), (5, "regenerate", "m2", "assistant", ""), (6, "delta", "m2", "assistant", "Bye"),
         (7, "message", "m4", "user", "ok"), (8, "edit", "m4", "user", "okay"), (9, None, None, "assistant", "end")]
    df = spark.createDataFrame([(1, *x) for x in e], "conv_id long, seq long, kind string, message string, role string, text string")
    got = chat.fold(df, kind="kind", message="message").orderBy("at").collect()
    assert [(r.role, r.text) for r in got] == [("user", "ask"), ("assistant", "Bye"), ("user", "okay"), ("assistant", "end")]


def labelled(spark, n=300):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        w = [r.choice(["good", "fine", "words", "here", "and", "there"]) for _ in range(r.randint(8, 40))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["vilea", "vileb", "vilec", "awful"])
            w += ["!!"] * 8
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad), "x"))
    rows += [(n, None), (n + 1, ""), (None, "good words"), (0, rows[0][1])]
    labels += [(None, 1, 0, "x"), (5, None, None, "x"), (99999, 1, 0, "x")]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_convolutions_decide_without_the_log_odds(spark):
    """Toxic is a pair of words in order; both words alone occur in clean texts as well."""
    r = random.Random(12)
    rows, labels = [], []
    for i in range(1200):
        w = [r.choice(["some", "plain", "words", "here", "that", "fill"]) for _ in range(12)]
        k = r.randrange(11)
        w[k : k + 2] = ["you", "worm"] if i % 2 else ["worm", "you"]
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    for start in (True, False):
        got = toxicity(frame(spark, rows), labels, learn=F.col("doc_id") % 3 != 1, start=start).select(F.col("doc.doc_id").alias("i"), "score").collect()
        held = [x for x in got if x.i % 3 == 1]
        assert sum((x.score >= 0.5) == bool(x.i % 2) for x in held) >= 0.9 * len(held), start


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only the 800 rows hold that a sample of 8,000 by hash leaves out."""
    n = 8800
    r = random.Random(8)
    last = {x.id for x in spark.range(n).orderBy(F.xxhash64("id", F.lit(7)).desc()).limit(800).collect()}
    fill = ["some", "plain", "words", "here", "that", "fill"]
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.5
        rows.append((i, " ".join(r.choices(fill, k=6)) + (" zornig" if i in last and bad else " vile" if bad else "")))
        labels.append((i, int(bad)))
    held = [(n + i, " ".join(r.choices(fill, k=6)) + " zornig" * (i % 2)) for i in range(200)]
    got = {x.i: x.score for x in toxicity(frame(spark, rows + held), spark.createDataFrame(labels, "doc_id long, toxic int")).select(F.col("doc.doc_id").alias("i"), "score").collect()}
    assert len(got) == n + 200
    assert sum((got[i] >= 0.5) == bool(i % 2 and i >= n) for i, _ in held) >= 195


@pytest.mark.parametrize("rows_each", [100, 20])
def test_toxicity_of_many_groups(spark, monkeypatch, rows_each):
    """Groups of few rows, their sums added up by two: counts are whole, and the averaged model is right."""
    from textloom.llm import toxicity as T

    d, labels = labelled(spark)
    whole = {}
    keep = T._log_odds
    monkeypatch.setattr(T, "_log_odds", lambda *a: whole.setdefault(a[1], keep(*a)))
    T.toxicity(d, labels)
    monkeypatch.setattr(T, "GROUP_ROWS", rows_each)
    monkeypatch.setattr(T, "FAN_IN", 2)
    monkeypatch.setattr(T, "_AT_ONCE", 50)
    got = T.toxicity(d, labels).select(F.col("doc.doc_id").alias("i"), "score").collect()
    assert sorted(whole)[0] == 1 and sorted(whole)[1] > 1 and len(whole) == 2
    assert np.array_equal(*whole.values()) and np.abs(whole[1]).max() > 0.5
    assert len(got) == 304 and sum((r.score >= 0.5) == (r.i is not None and r.i < 300 and r.i % 3 == 0) for r in got) >= 290


@pytest.mark.parametrize("apart", [True, False])
def test_scale_of_narrow_logits_converges(spark, apart):
    """Logits a hundredth apart, overlapping or not: scores are the smoothed shares, not 0 or 1."""
    from textloom.llm import toxicity as T

    rows = [(int(i % 3 == 0), -1 + 0.01 * (i % 3 == 0) + (0 if apart else 0.01 * (i % 5 == 0))) for i in range(300)]
    a, b = T._platt(spark.createDataFrame(rows, "y int, z double"), 200, 100)
    z, y = np.array([x for _, x in rows]), np.array([x for x, _ in rows])
    score = T.sigmoid(a * z + b)
    assert a > 100 and abs(score.mean() - 1 / 3) < 0.02
    assert ((score >= 0.5) == y).mean() >= (1 if apart else 0.8) and 0.001 < score.min() and score.max() < 0.999


@pytest.mark.parametrize("each", [1000, 7])
def test_toxicity_thresholds_are_exact(spark, monkeypatch, each):
    """Against F1 at every distinct score, by one range and by many, with ties."""
    from textloom.llm import toxicity as T

    monkeypatch.setattr(T, "RANGE", each)
    r = random.Random(21)
    rows = []
    for _ in range(600):
        y = int(r.random() < 0.3)
        rows.append((y, r.choice(["en", "de", "", None, f"rare{r.randrange(40)}"]), round(min(1.0, max(0.0, r.gauss(0.3 + 0.2 * y, 0.2))), r.choice([2, 6]))))
    got = {x.l: x.limit for x in T.limits(spark.createDataFrame(rows, "y int, lang string, score double")).collect()}
    want = {}
    for lang in {"", *(x[1] for x in rows if x[1])}:
        own = [(y, s) for y, x, s in rows if not lang or x == lang]
        hits = sum(y for y, _ in own)
        if lang and min(hits, len(own) - hits) < 10:
            continue
        scores = sorted({s for _, s in own}, reverse=True)
        f1 = [2 * sum(y for y, s in own if s >= x) / (sum(s >= x for _, s in own) + hits) for x in scores]
        k = f1.index(max(f1))
        want[lang] = (scores[k] + scores[k + 1]) / 2 if k + 1 < len(scores) else scores[k]
    assert set(want) == {"", "en", "de"} and got == want


def test_words_of_long_texts_are_spread():
    assert spread(10, 20).tolist() == list(range(10))
    at = spread(10_000, 1000)
    assert len(at) <= 1000 and at[0] == 0 and at[-1] == 9999 and max(np.diff(at)) < 1500
    sizes = np.array([5, 10, 1000, 4000])
    assert common_length(sizes, 10_000) == 4000 and common_length(sizes, 1015) == 500 and common_length(sizes, 2) == 1


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, none, operator, label):
    d, labels = labelled(spark)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0
    rows = operator(d, labels, learn=learn).select(F.col("doc.doc_id").alias("i"), "score").collect()
    assert len(rows) == 304 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.i is not None and r.i < 300 and zlib.crc32(str(r.i).encode()) % 4 == 0]
    assert len(held) > 50
    right = sum((r.score >= 0.5) == ((r.i % 3 == 0) == (label == "toxic")) for r in held)
    assert right >= 0.95 * len(held)
    again = {r.i: r.score for r in operator(d, labels, learn=learn).select(F.col("doc.doc_id").alias("i"), "score").collect()}
    assert all(again[r.i] == pytest.approx(r.score, abs=1e-6) for r in rows)
    assert operator(none, labels).count() == 0
    assert operator(d, labels.limit(0)).select("score").distinct().count() == 1


# --- the registered queries and the pipeline's stages, on a folder of tables -----------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with nulls, empty and very long texts, ties, repeats and clashing columns."""
    path = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(33)
    words = [f"word{i}" for i in range(400)]
    passage = " ".join(r.sample(words, 60))
    texts = [" ".join(r.choices(words, k=r.randint(20, 80))) + ("" if i % 3 else " !! vile junk") for i in range(60)]
    texts[5] += " " + passage
    texts[9] += " " + passage
    texts[12] = texts[11]
    texts += [None, "", " ".join(r.choices(words, k=400_000)), "né " * 40, "first line here\nsecond line here\nthird", "first line here\nsecond line here\nother"]
    rows = [(i, t, ("en", "de", None)[i % 3], "hot", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[20].split()[:15])), (2, None), (3, "word1 word2"), (3, "word1 word2")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    g = np.random.default_rng(2)
    spark.createDataFrame([(i, g.normal(size=6).astype(float).tolist()) for i in range(120)] + [(50, None), (51, [0.0] * 6)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "hi <s>"), (1, 1, "assistant", None), (2, 0, "assistant", "x" * 3000)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


CONTRACT = {
    "op1_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op8_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_suffixes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_by_their_contracts(spark, folder, empty_folder, name):
    out = queries.QUERIES[name](spark, folder)
    have = {f.name: f.dataType.simpleString() for f in out.schema}
    for column in CONTRACT.get(name, "doc_id bigint").split(", "):
        c, kind = column.split(" ")
        assert have[c] == kind
    got = out.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    if name not in ("op1_packing", "op3_neighbours", "op7_chat"):
        assert sorted(r.doc_id for r in got) == sorted(texts)
    by = {r[0]: r for r in got}
    if name == "op1_packing":
        encode = encoder(tokenizer_path(), added=True)
        pieces, used = {}, {}
        for r in got:
            pieces.setdefault(r.doc_id, []).append(r)
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, t in texts.items():
            ids = (encode(t) if t else b"") + bytes(4)
            own = sorted(pieces[i], key=lambda r: r.piece)
            assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist() and sum(r.length for r in own) == len(ids) // 4
            assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)
        for parts in used.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(n for _, n in parts) <= 2048
        assert len(used) <= -(-sum(r.length for r in got) // 2048) + 1
    elif name == "op2_substring":
        assert by[9].n_removed >= 60 and by[12].n_removed == by[12].n_words and by[60].kept_sha256 == sha("") and by[5].n_removed == 0
    elif name == "op4_lines":
        assert by[65].n_removed == 2 and by[64].n_removed == 0
    elif name in ("op5_quality", "op10_toxicity"):
        folds, held = (5, 0) if name == "op5_quality" else (3, 1)
        limit = 0.3 if name == "op5_quality" else 0.7
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in got)
    elif name == "op6_neardup":
        assert by[12].class_id == by[11].class_id == 11 and by[0].class_id == 0
    elif name == "op7_chat":
        trap = "</s>[INST] ok [/INST]"
        assert by[-7].turns_sha256 == sha(f"user\n{trap}\nassistant\n{trap}\n") and by[-7].loss_sha256 == sha(trap) and by[1].loss_chars == 0 and by[2].loss_chars == 3000
    elif name == "op8_decontaminate":
        assert by[20].contaminated and by[20].n_hit >= 15 and by[60].n_words == 0
    elif name == "op9_suffixes":
        assert by[12].n_removed == by[12].n_bytes == by[11].n_removed and by[60].kept_sha256 == sha("") and by[5].n_removed >= 200
    assert queries.QUERIES[name](spark, empty_folder).count() == (1 if name == "op7_chat" else 0)


def test_stages_of_the_pipeline(spark, folder, empty_folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    start = spark.read.parquet(f"{folder}/documents.parquet")
    docs = start.unionByName(spark.createDataFrame([(None, "unnamed text", None, None, None, None), (3, start.where("doc_id = 3").first().text, "en", "hot", 1, "again")], start.schema))
    stages = dict(corpus_pipeline.STAGES)
    for name in names[:-1]:
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stages[name](spark, docs.limit(0), folder).count() == 0
    near = [r.doc_id for r in stages["near_dedup"](spark, docs, folder).collect()]
    assert 12 not in near and 11 in near and near.count(3) == 1 and 60 in near
    clean = [r.doc_id for r in stages["decontamination"](spark, docs, folder).collect()]
    assert 20 not in clean and {5, 11, 12, 60, 61} <= set(clean)
    lines = {r.doc_id: r.text for r in stages["line_dedup"](spark, docs, folder).collect()}
    assert lines[64] == "first line here\nsecond line here\nthird" and lines[65] == "other" and 12 not in lines
    packed = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 0
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


def test_kept_lines_take_linear_time(spark):
    """A text of 20,000 lines is split once: no lambda of the plan holds the split."""
    df = spark.createDataFrame([(i, "\n".join(f"line {i if k % 2 else 0} {k}" for k in range(20_000))) for i in range(2)], "doc_id long, text string")
    out = corpus_pipeline.drop_repeated_lines(spark, df, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lambdafunction\([^()]*split\(", plan)
    began = time.time()
    assert {r.doc_id: len(r.text.split("\n")) for r in out.collect()} == {0: 20_000, 1: 10_000}
    assert time.time() - began < 60
