"""Counts of neighbouring words, and what is computed from them, in numbers of words and packed blocks.

A pair of words is counted in one of its two orders, as both counts are equal: the order depends on whether the sum of
the two numbers is odd, which deals the pairs of a frequent word evenly over the rows. A task sorts FLUSH codes at a time
and sends what it counted, packed, to the range of first words (bucket) the codes belong to. A bucket is added up where it
arrives. Neighbours of different documents meet by their places in the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidstone.functions.packed import entries, packed, summed
from braidstone.functions.staging import stage
from braidstone.llm.common import frugal

#: Codes that a task sorts at once, and those of a bucket as expected.
FLUSH, BUCKET = 6_000_000, 3_000_000
#: Places of the stream of one block; pieces near its end are seen by the next one too.
PLACES = 1_000_000
#: Pairs that are written out at once.
CHUNK = 50_000

_BLOCKS = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_BLOCKS_SQL = "bucket int, data binary"


class Words:
    """A vocabulary that every task holds: words in order (their places are their numbers), counts, and buckets of near equal weight."""

    def __init__(self, vocab: DataFrame):
        spark = vocab.sparkSession
        table = vocab.select("word", *(["n"] if "n" in vocab.columns else [])).toArrow().sort_by("word").combine_chunks()
        self.names = pa.array(table.column("word").combine_chunks() if table.num_rows else [], pa.string())
        self.n = table.column("n").to_numpy() if "n" in table.column_names else np.ones(len(self.names), np.int64)
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.sent = spark.sparkContext.broadcast(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def cuts(self, entries: float) -> np.ndarray:
        """First numbers of ranges of words that hold BUCKET of ``entries`` each, about; a very frequent word weighs less than its count."""
        buckets = max(self.parts, -(-int(entries) // BUCKET))
        weight = self.n / (1 + 200 * self.n / max(1, self.n.sum()))
        before = np.cumsum(weight) - weight
        return np.unique(np.searchsorted(before, np.arange(buckets) * (weight.sum() / buckets)))


def _flushed(held: list[np.ndarray], cuts: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The codes held, counted, by bucket; a word's codes are ``width`` numbers."""
    codes = np.concatenate(held) if held else np.zeros(0, np.int64)
    held.clear()
    if not len(codes):
        return
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    n = np.diff(np.append(first, len(codes)))
    codes = codes[first]
    yield from _blocks(codes, n, np.append(np.searchsorted(codes, cuts * width), len(codes)))


def _blocks(codes: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    full = np.flatnonzero(np.diff(at))
    if len(full):
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array([packed(codes[at[k] : at[k + 1]], n[at[k] : at[k + 1]]) for k in full], pa.binary())], schema=_BLOCKS)


def _codes(w: np.ndarray, c: np.ndarray, size: int, rings: int, ring: int) -> np.ndarray:
    low, high = np.minimum(w, c), np.maximum(w, c)
    odd = ((low + high) & 1).astype(bool)
    return (np.where(odd, low, high) * size + np.where(odd, high, low)) * rings + ring


def _numbers(lists: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _inside(sent: Broadcast, cuts: np.ndarray, rings: tuple[int, ...]):
    """Neighbours within ``words``."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = sent.value, [], 0
        step, width = max(1, FLUSH // rings[-1]), len(known) * len(rings)
        for b in batches:
            lists = b.column(0)
            ids = _numbers(lists, known)
            doc = np.repeat(np.arange(b.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
            for s in range(0, len(ids), step):
                e = min(s + step, len(ids))
                for d in range(1, rings[-1] + 1):
                    lo = max(s, d)
                    w, c = ids[lo:e], ids[lo - d : max(lo, e) - d]
                    met = (w >= 0) & (c >= 0) & (doc[lo:e] == doc[lo - d : max(lo, e) - d])
                    held.append(_codes(w[met], c[met], len(known), len(rings), int(np.searchsorted(rings, d))))
                    size += len(held[-1])
                    if size >= FLUSH:
                        yield from _flushed(held, cuts, width)
                        size = 0
        yield from _flushed(held, cuts, width)

    return run


def _across(sent: Broadcast, cuts: np.ndarray, rings: tuple[int, ...]):
    """Neighbours of different documents among pieces ``(block, start, doc, own, words)`` sorted by block and start; the second of a pair is the block's own."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, now, pieces = sent.value, [], None, []
        width = len(known) * len(rings)

        def met() -> Iterator[pa.RecordBatch]:
            place, doc, own, ids = (np.concatenate(x) for x in zip(*pieces, strict=True))
            size = 0
            for d in range(1, rings[-1] + 1):
                at = np.searchsorted(place, place - d)
                ok = own & (place[at] == place - d) & (doc[at] != doc) & (ids >= 0) & (ids[at] >= 0)
                held.append(_codes(ids[ok], ids[at[ok]], len(known), len(rings), int(np.searchsorted(rings, d))))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from _flushed(held, cuts, width)
                    size = 0
            if sum(map(len, held)) >= FLUSH // 2:
                yield from _flushed(held, cuts, width)

        for b in batches:
            block = b.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else []
            for lo, hi in zip(edges, [*edges[1:], len(block)], strict=True):
                if block[lo] != now:
                    if pieces:
                        yield from met()
                    now, pieces = block[lo], []
                part = b.slice(lo, hi - lo)
                lists = part.column(4)
                sizes = np.diff(lists.offsets.to_numpy())
                ids = _numbers(lists, known)
                inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                pieces.append((np.repeat(part.column(1).to_numpy(), sizes) + inside, np.repeat(part.column(2).to_numpy(), sizes), np.repeat(part.column(3).to_numpy(zero_copy_only=False), sizes), ids))
        if pieces:
            yield from met()
        yield from _flushed(held, cuts, width)

    return run


def ends(arrays: DataFrame, window: int) -> DataFrame:
    """``arrays(words, ...)`` with ``size``, and the first and last ``window`` words of each row that has any instead of all (``head``, ``tail``)."""
    rest = f"greatest(least({window}, size(words) - {window}), 0)"
    tail = F.expr(f"slice(words, size(words) - {rest} + 1, {rest})")
    return arrays.filter(F.size("words") > 0).withColumns({"size": F.size("words").cast("long"), "head": F.expr(f"slice(words, 1, {window})"), "tail": tail}).drop("words")


def counts(arrays: DataFrame, ended: DataFrame, words: Words, rings: tuple[int, ...]) -> DataFrame:
    """Packed blocks ``(bucket, data)``, those of a bucket one after another in one task.

    ``arrays(words)``: the documents; ``ended(offset, size, head, tail)``: their ends and places in the stream. Codes are
    (first * words + second) * rings + ring, where ring k counts distances up to ``rings[k]`` that are beyond the ring before.
    """
    window = rings[-1]
    cuts = words.cuts(0.6 * window * int(words.n.sum()))
    inside = arrays.select(F.coalesce("words", F.array().cast("array<string>")).alias("words")).mapInArrow(_inside(words.sent, cuts, rings), _BLOCKS_SQL)
    pieces = ended.select(F.col("offset").alias("doc"), F.explode(F.array(F.struct(F.col("offset").alias("start"), F.col("head").alias("words")), F.struct((F.col("offset") + F.col("size") - F.size("tail")).alias("start"), F.col("tail").alias("words")))).alias("x"))
    pieces = pieces.select("doc", "x.start", "x.words").filter(F.size("words") > 0).withColumn("k", F.floor(F.col("start") / PLACES))
    seen = F.when(F.col("start") + 2 * window >= (F.col("k") + 1) * PLACES, F.array(F.col("k"), F.col("k") + 1)).otherwise(F.array("k"))
    pieces = pieces.withColumn("block", F.explode(seen)).select("block", "start", "doc", (F.col("block") == F.col("k")).alias("own"), "words")
    across = pieces.repartition(words.parts, "block").sortWithinPartitions("block", "start").mapInArrow(_across(words.sent, cuts, rings), _BLOCKS_SQL)
    return inside.unionByName(across).repartition(max(words.parts, len(cuts) // 4), "bucket").sortWithinPartitions("bucket")


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[bytes]]]:
    """The blocks of each key, of rows ``(*key, data)`` sorted by key; as they come, BUCKET entries of them are made one block."""
    now, held, more = None, [], 0
    for b in batches:
        for *key, data in zip(*(b.column(i).to_pylist() for i in range(keys + 1)), strict=True):
            if key != now:
                if held:
                    yield tuple(now), held
                now, held, more = key, [], 0
            held.append(data)
            more += entries(data)
            if more > BUCKET and len(held) > 1:
                held, more = [packed(*summed(held))], 0
    if held:
        yield tuple(now), held


def word_rows(blocks: DataFrame, words: Words, rings: tuple[int, ...], name: str | None = "d", sums: bool = False) -> DataFrame:
    """``(w, c, [name], n)`` of ``counts``, in both orders; ``sums``: each ring includes those before it."""
    sent, size, labels = words.sent, len(words), np.array(rings, np.int32)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for _, held in _by_key(batches, 1):
            codes, n = summed(held)
            pair, ring = np.divmod(codes, len(labels))
            fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
            at, first = np.cumsum(fresh) - 1, np.append(np.flatnonzero(fresh), len(pair))
            pair = pair[fresh]
            for s in range(0, len(pair), CHUNK):
                e = min(s + CHUNK, len(pair))
                some = slice(first[s], first[e])
                table = np.zeros((e - s, len(labels)), np.int64)
                table[at[some] - s, ring[some]] = n[some]
                if sums:
                    table = np.cumsum(table, axis=1)
                i, k = np.nonzero(table)
                a, b = np.divmod(pair[s:e][i], size)
                m = table[i, k] * np.where(a == b, 2, 1)
                two = a != b
                w, c = known.take(pa.array(np.concatenate((a, b[two])))), known.take(pa.array(np.concatenate((b, a[two]))))
                own = [] if name is None else [pa.array(labels[np.concatenate((k, k[two]))])]
                yield pa.record_batch([w, c, *own, pa.array(np.concatenate((m, m[two])))], ["w", "c", *([name] if own else []), "n"])

    return blocks.mapInArrow(run, f"w string, c string, {f'{name} int, ' if name else ''}n long")


def cells(blocks: DataFrame, words: Words) -> DataFrame:
    """``(a, b, n)``, stored: of ``counts`` with one ring, in one order, by numbers; n as in the row of a."""
    size = len(words)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_key(batches, 1):
            codes, n = summed(held)
            for s in range(0, len(codes), 10 * CHUNK):
                a, b = np.divmod(codes[s : s + 10 * CHUNK], size)
                yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n[s : s + 10 * CHUNK] * np.where(a == b, 2, 1))], ["a", "b", "n"])

    return stage(blocks.mapInArrow(run, "a int, b int, n long"), "cells")


def margins(found: DataFrame, words: Words) -> np.ndarray:
    """The sum of each word's row, by number."""
    sides = found.select("a", F.col("n").alias("x")).unionByName(found.filter("a <> b").select(F.col("b").alias("a"), F.col("n").alias("x")))
    table = sides.groupBy("a").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(len(words), np.int64)
    out[table.column("a").to_numpy()] = table.column("x").to_numpy()
    return out


def _ppmi(a: np.ndarray, b: np.ndarray, n: np.ndarray, sums: np.ndarray, total: int) -> np.ndarray:
    return np.maximum(0.0, np.log2(n * float(total) / (sums[a].astype(float) * sums[b])))


def ppmi(found: DataFrame, words: Words) -> DataFrame:
    """``(w, c, n, ppmi)`` of ``cells``, in both orders."""
    sums = margins(found, words)
    sent, held, total = words.sent, found.sparkSession.sparkContext.broadcast(sums), int(sums.sum())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for x in batches:
            a, b, n = (x.column(i).to_numpy() for i in range(3))
            v, two = _ppmi(a, b, n, held.value, total), a != b
            w, c = known.take(pa.array(np.concatenate((a, b[two])))), known.take(pa.array(np.concatenate((b, a[two]))))
            yield pa.record_batch([w, c, pa.array(np.concatenate((n, n[two]))), pa.array(np.concatenate((v, v[two])))], ["w", "c", "n", "ppmi"])

    return found.mapInArrow(run, "w string, c string, n long, ppmi double")


def _dealt(found: DataFrame, words: Words, first: np.ndarray, keys: np.ndarray, groups: int) -> DataFrame:
    """Packed blocks ``(grp, side, data)`` of ``cells`` in both orders, sorted: word w goes to ``keys[first[w]:first[w + 1]]``, each 2 * grp + side."""
    size, sent = len(words), found.sparkSession.sparkContext.broadcast((first, keys))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, keys = sent.value
        held, most = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            key, code, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key * size * size + code)
            key, code, n = key[order], code[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(at[1:], len(key))
            for s in range(0, len(at), 200):
                some = range(s, min(s + 200, len(at)))
                data = [packed(code[at[i] : last[i]], n[at[i] : last[i]]) for i in some]
                k = key[at[some.start : some.stop]]
                yield pa.record_batch([pa.array((k // 2).astype(np.int32)), pa.array((k % 2).astype(np.int32)), pa.array(data, pa.binary())], ["grp", "side", "data"])

        for x in batches:
            a, b, n = (x.column(i).to_numpy().astype(np.int64) for i in range(3))
            two = a != b
            w, c, n = np.concatenate((a, b[two])), np.concatenate((b, a[two])), np.concatenate((n, n[two]))
            times = first[w + 1] - first[w]
            row = np.repeat(np.arange(len(w)), times)
            if len(row):
                key = keys[first[w][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
                held.append((key, w[row] * size + c[row], n[row]))
                most += len(row)
            if most >= FLUSH // 2:
                yield from flushed()
                most = 0
        if held:
            yield from flushed()

    return found.mapInArrow(run, "grp int, side int, data binary").repartition(max(words.parts, groups), "grp").sortWithinPartitions("grp", "side")


def _values(value: str, size: int, held: list[bytes], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(w, c, v)`` sorted, without zeros."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes, n = summed(held)
    w, c = np.divmod(codes, size)
    if value == "n":
        return w, c, n.astype(float)
    v = _ppmi(w, c, n, sums, int(sums.sum()))
    return w[v > 0], c[v > 0], v[v > 0]


#: Columns that one target in so many has are multiplied as dense ones; numbers of a dense block; products added at once.
DENSE, DENSE_SIZE, PRODUCTS = 24, 16_000_000, 6_000_000
#: Similarities are compared by six places, then by the number of the word, both in one exact float.
_TIE = float(1 << 22)


def nearest(targets: np.ndarray, t: tuple, lo: int, hi: int, x: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(target, row, cosine)`` of the k best rows of ``x`` among numbers lo to hi for each target; rows of zeros score 0.

    ``t`` and ``x``: ``(w, c, v)`` sorted. Columns many targets have are multiplied as matrices, the others entry by entry.
    """
    tw, tc, tv = t
    tr, m = np.searchsorted(targets, tw), len(targets)
    tn, width = np.sqrt(np.bincount(tr, tv * tv, m)), int(max(tc.max(initial=0), x[1].max(initial=0))) + 1
    has = np.bincount(tc, minlength=width)
    dense = has * DENSE > m
    column = np.cumsum(dense) - 1
    order = np.argsort(tc, kind="stable")
    rr, rv, start = tr[order], tv[order], np.cumsum(has) - has
    own, step = dense[tc], max(1, DENSE_SIZE // max(1, m))
    slabs = []
    for c in range(0, int(dense.sum()), step):
        a = np.zeros((m, min(step, int(dense.sum()) - c)))
        at = own & (column[tc] >= c) & (column[tc] < c + a.shape[1])
        a[tr[at], column[tc[at]] - c] = tv[at]
        slabs.append((c, a))
    keys, sims = np.zeros((m, 0)), np.zeros((m, 0))
    rows = max(16, min(512, 2_000_000 // max(1, m)))
    for b in range(lo, hi, rows):
        n = min(rows, hi - b)
        e = slice(*np.searchsorted(x[0], (b, b + n)))
        w, c, v = x[0][e] - b, x[1][e], x[2][e]
        dots = np.zeros((m, n))
        for base, a in slabs:
            at = dense[c] & (column[c] >= base) & (column[c] < base + a.shape[1])
            y = np.zeros((a.shape[1], n))
            y[column[c[at]] - base, w[at]] = v[at]
            dots += a @ y
        at = ~dense[c] & (has[c] > 0)
        sw, sc, sv = w[at], c[at], v[at]
        times = has[sc]
        for part in np.split(np.arange(len(sc)), np.flatnonzero(np.diff(np.cumsum(times) // PRODUCTS)) + 1):
            if len(part):
                q, many = times[part], int(times[part].sum())
                i = np.repeat(start[sc[part]] - (np.cumsum(q) - q), q) + np.arange(many)
                dots += np.bincount(rr[i] * n + np.repeat(sw[part], q), rv[i] * np.repeat(sv[part], q), m * n).reshape(m, n)
        norm = tn[:, None] * np.sqrt(np.bincount(w, v * v, n))
        sim = np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)
        names = np.arange(b, b + n)
        key = np.rint(sim * 1e6) * _TIE - names
        key[targets[:, None] == names] = -np.inf
        keys, sims = np.concatenate((keys, key), 1), np.concatenate((sims, sim), 1)
        if keys.shape[1] > k:
            best = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]
            keys, sims = np.take_along_axis(keys, best, 1), np.take_along_axis(sims, best, 1)
    i, j = np.nonzero(np.isfinite(keys))
    names = np.rint(-keys[i, j] + np.ceil(keys[i, j] / _TIE) * _TIE).astype(np.int64)  # a number is under _TIE
    return targets[i], names, sims[i, j]


def similar(found: DataFrame, words: Words, value: str, targets: np.ndarray, k: int = 10) -> DataFrame:
    """``(word, neighbour, sim)``: of each range of words the k whose rows of ``cells`` are most like a target's, by ``value`` (n or ppmi).

    Tiles of targets meet ranges of words; each pair of them is one group, multiplied where it lies.
    """
    size, sent = len(words), words.sent
    sums = margins(found, words)
    total = 2 * found.count()
    row_sizes = np.minimum(words.n, size)
    tiles = max(1, -(-int(total * row_sizes[targets].sum() / max(1, row_sizes.sum())) // (2 * BUCKET)), -(-len(targets) // 4096))
    cuts = words.cuts(total)
    ranges, tile_of = len(cuts), np.arange(len(targets)) * tiles // max(1, len(targets))
    bucket = np.searchsorted(cuts, np.arange(size), "right") - 1
    each = np.arange(tiles)
    is_target = np.zeros(size, np.int64)
    is_target[targets] = 1
    first = np.concatenate(([0], np.cumsum(tiles + is_target * ranges)))
    keys = np.zeros(first[-1], np.int64)
    keys[(first[:-1, None] + each).ravel()] = 2 * (bucket[:, None] * tiles + each).ravel() + 1
    keys[(first[targets][:, None] + tiles + np.arange(ranges)).ravel()] = 2 * (np.arange(ranges) * tiles + tile_of[:, None]).ravel()
    marks = found.sparkSession.sparkContext.broadcast((sums, targets, tile_of, cuts))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums, targets, tile_of, cuts = marks.value
        now, held = None, ([], [])

        def met() -> Iterator[pa.RecordBatch]:
            j, i = divmod(now, tiles)
            t, x = (_values(value, size, h, sums) for h in held)
            a, b, sim = nearest(targets[tile_of == i], t, int(cuts[j]), int(cuts[j + 1]) if j + 1 < len(cuts) else size, x, k)
            yield pa.record_batch([known.take(pa.array(a)), known.take(pa.array(b)), pa.array(sim)], ["word", "neighbour", "sim"])

        for b in batches:
            for grp, side, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if grp != now:
                    if now is not None:
                        yield from met()
                    now, held = grp, ([], [])
                held[side].append(data)
        if now is not None:
            yield from met()

    return _dealt(found, words, first, keys, ranges * tiles).mapInArrow(run, "word string, neighbour string, sim double")


def pair_scores(found: DataFrame, words: Words, pairs: DataFrame, value: str = "ppmi") -> DataFrame:
    """``(w1, w2, score)``: the cosine of two rows of ``cells`` for each of ``pairs(w1, w2)``; rows without a common column score 0."""
    size, sent = len(words), words.sent
    table = pairs.select("w1", "w2").distinct().toArrow()
    ids = np.stack([pc.fill_null(pc.index_in(table.column(c).combine_chunks(), value_set=words.names), -1).to_numpy().astype(np.int64) for c in ("w1", "w2")], 1) if table.num_rows else np.zeros((0, 2), np.int64)
    ids = ids[(ids >= 0).all(1)]
    ids = ids[np.lexsort((ids[:, 1], ids[:, 0]))]
    cuts = words.cuts(2 * found.count())
    grp = np.searchsorted(cuts, ids[:, 0], "right") - 1
    need = np.unique(np.concatenate((ids[:, 0] * len(cuts) + grp, ids[:, 1] * len(cuts) + grp))) if len(ids) else np.zeros(0, np.int64)
    need = need.astype(np.int64)
    first = np.searchsorted(need // max(1, len(cuts)), np.arange(size + 1))
    marks = found.sparkSession.sparkContext.broadcast((margins(found, words), ids, grp))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums, ids, grp = marks.value
        for (key,), held in _by_key((pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["grp", "data"]) for b in batches), 1):
            w, c, v = _values(value, size, held, sums)
            own = ids[slice(*np.searchsorted(grp, (key, key + 1)))]
            at = np.stack((np.searchsorted(w, own), np.searchsorted(w, own, "right")), 2)
            scores = np.zeros(len(own))
            for i, ((a, b), (d, e)) in enumerate(at):
                if e - d < b - a:
                    a, b, d, e = d, e, a, b
                if b > a:
                    place = np.minimum(np.searchsorted(c[d:e], c[a:b]), e - d - 1) + d
                    same = c[place] == c[a:b]
                    scores[i] = np.dot(v[a:b][same], v[place[same]]) / np.sqrt(np.dot(v[a:b], v[a:b]) * np.dot(v[d:e], v[d:e]))
            yield pa.record_batch([known.take(pa.array(own[:, 0])), known.take(pa.array(own[:, 1])), pa.array(scores)], ["w1", "w2", "score"])

    return _dealt(found, words, first, 2 * (need % max(1, len(cuts))), len(cuts)).mapInArrow(run, "w1 string, w2 string, score double")
