"""Neighbouring words in packed blocks, beside brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from braidstone.functions.packed import packed, summed, unpacked
from braidstone.operators import neighbours, text

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, range(1, 61), k=rng.choice([0, 1, 1, 2, 3, 7, 40, 300]))) for _ in range(150)]
    return spark.createDataFrame([*enumerate([None, *texts])], "doc_id long, text string").repartition(5), [w for t in texts for w in t.split()]


def counted(stream: list[str], vocab: set[str], window: int) -> Counter:
    near = ((i, i + d) for d in range(1, window + 1) for i in range(len(stream) - d))
    return Counter(p for i, j in near if stream[i] in vocab and stream[j] in vocab for p in ((stream[i], stream[j]), (stream[j], stream[i])))


def small(monkeypatch):
    """Many flushes, buckets and blocks of places."""
    for name, n in (("FLUSH", 700), ("BUCKET", 500), ("PLACES", 90), ("CHUNK", 50)):
        monkeypatch.setattr(neighbours, name, n)


def test_packed_blocks():
    rng = np.random.default_rng(2)
    for top in (5, 300, 1 << 20, 1 << 60):
        codes, n = np.unique(rng.integers(0, top, 4000), return_counts=True)
        got = unpacked(packed(codes, n))
        assert (got[0] == codes).all() and (got[1] == n).all()
        both = summed([packed(codes, n), packed(codes[:1], n[:1]), packed(codes, n)])
        assert (both[0] == codes).all() and both[1][0] == 3 * n[0] and (both[1][1:] == 2 * n[1:]).all()
    dense = np.sort(rng.choice(1 << 28, 1 << 20, replace=False))
    assert len(packed(dense, np.ones_like(dense))) < 2 * len(dense)


def test_window_rows(spark, docs, monkeypatch):
    """Every count of each window, from many flushes, in a few bytes a pair; the words of the stream meet over documents and blocks."""
    small(monkeypatch)
    df, stream = docs
    arrays, vocab = text.corpus(df)
    words = neighbours.Words(vocab)
    assert 20 < len(words) < 60
    rows = neighbours.word_rows(text.ring_counts(arrays, words, (1, 2, 5)), words, (1, 2, 5), "window", sums=True).collect()
    for window in (1, 2, 5):
        assert {(r.w, r.c): r.n for r in rows if r.window == window} == counted(stream, set(words.names.to_pylist()), window)


def test_ppmi_of_cells(spark, docs, monkeypatch):
    """As by joins on words, but for the order of sums; both orders of a pair alike."""
    small(monkeypatch)
    arrays, vocab = text.corpus(docs[0])
    words = neighbours.Words(vocab)
    found = neighbours.cells(text.ring_counts(arrays, words, (2,)), words)
    got = {(r.w, r.c): (r.n, r.ppmi) for r in neighbours.ppmi(found, words).collect()}
    want = counted(docs[1], set(words.names.to_pylist()), 2)
    assert {k: n for k, (n, _) in got.items()} == want
    sums, total = Counter(), sum(want.values())
    for (w, _), n in want.items():
        sums[w] += n
    for (w, c), (n, v) in got.items():
        assert v == pytest.approx(max(0, np.log2(n * total / (sums[w] * sums[c]))), abs=1e-12)


@pytest.mark.parametrize("dense", [1, 24, 10**9])
def test_nearest(monkeypatch, dense):
    """Dense and sparse columns, slabs, rows and targets of zeros, ties by number."""
    monkeypatch.setattr(neighbours, "DENSE", dense)
    monkeypatch.setattr(neighbours, "DENSE_SIZE", 100)
    monkeypatch.setattr(neighbours, "PRODUCTS", 50)
    rng = np.random.default_rng(4)
    full = rng.integers(0, 4, (90, 40)) * (rng.random((90, 40)) < 0.2) * 1.0
    full[[3, 20, 40]], full[50:60] = 0, full[49]
    targets = np.arange(0, 90, 20)
    sparse = lambda keep: (*(z := np.nonzero(full * keep[:, None])), full[z])
    norm = np.sqrt((full**2).sum(1))
    cosine = np.nan_to_num(full @ full.T / np.where(norm, norm, np.inf)[:, None] / np.where(norm, norm, np.inf))
    for lo, hi in ((0, 90), (30, 75)):
        span = np.arange(90)
        a, b, sim = neighbours.nearest(targets, sparse(np.isin(span, targets)), lo, hi, sparse((span >= lo) & (span < hi)), 6)
        for t in targets:
            best = sorted((-np.round(cosine[t, x], 6), x) for x in range(lo, hi) if x != t)[:6]
            assert sorted(b[a == t].tolist()) == sorted(x for _, x in best)
        assert np.allclose(sim, cosine[a, b])


def test_similar_and_pairs(spark, docs, monkeypatch):
    """Tiles of targets, ranges of words and pairs as by joins."""
    small(monkeypatch)
    arrays, vocab = text.corpus(docs[0])
    words = neighbours.Words(vocab)
    found = neighbours.cells(text.ring_counts(arrays, words, (2,)), words)
    cells = neighbours.ppmi(found, words).cache()
    targets = np.arange(0, len(words), 3)
    chosen = spark.createDataFrame([(w,) for w in np.array(words.names.to_pylist())[targets].tolist()], "word string")
    for value in ("n", "ppmi"):
        got = text.top(neighbours.similar(found, words, value, targets, 4), "word", "sim", "neighbour", 4).collect()
        want = text.similar(cells, value, chosen, vocab, 4).collect()
        assert {(r.word, r.neighbour, r["rank"]): round(r.sim, 6) for r in got} == {(r.word, r.neighbour, r["rank"]): round(r.sim, 6) for r in want}
    names = words.names.to_pylist()
    pairs = spark.createDataFrame([(a, b, 0.0) for a, b in [*zip(names, names[1:]), *zip(names, reversed(names)), (names[0], "not a word")]], "w1 string, w2 string, human double")
    got = {(r.w1, r.w2): r.score for r in neighbours.pair_scores(found, words, pairs).collect()}
    want = {(r.w1, r.w2): r.score for r in text.sparse_pair_scores(pairs, cells, "ppmi", vocab).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
