"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles. For a size band the hash range is split into lanes; each token
XORs its hash into one lane. Two sets' sketches then differ in at most as many lanes as the sets differ in tokens, so a
Jaccard similarity of t or more between sizes a <= b leaves at most (a + b)(1 - t)/(1 + t) lanes unlike. With more
lanes than that, at least one is alike (pigeonhole), and an equi-join on (band, lane, bits) meets every such pair. A
second sketch of single bits gives a Hamming distance that lower-bounds the symmetric difference and rejects most
false candidates; the rest are verified on whole sets.

Rows of equal sets collapse to the smallest id first. Within the documents that share a key each is compared with the
one that shares most keys with others, as an original does among its edited copies; in groups that are not of one
component after that, also with the next such; pairs still in different components are then compared, so no link that
could join two components is left out.

Of its lanes that are not empty a document needs only the first d + 1, when d lanes at most can differ: before the first
lane that two such sets have alike, both have only unlike ones. Lanes skip shingles that very many documents hold:
leaving the same tokens out on both sides never makes two sets differ more, so any choice of them is lossless. They
are estimated from a sample of the documents, which decides cost only. A document left with d lanes or fewer emits
those, then also lanes of a finer split, and if those are d or fewer too, the lanes of its whole set, each kind kept
apart: of two such documents, both emit the next kind.

Links are counted in the end: two sets that link are in one class, so the sets of each class are compared with each
other, in blocks of bounded size, each pair of blocks once. Intersections are counted by matrix products over shingles
that many sets of the blocks hold and by an index over the others. Nothing but a number for each set leaves a block.

Defined cases: a null or blank text has the empty set and links with nothing. Fewer than five words make one shingle.
Each row is a document of its own and links on its own, also rows that repeat a doc_id; component_id is an id, so such
rows may share one. Ties do not occur: components and counts have one value. Empty tables give empty results. Long
texts are one set. Extra columns are not carried. Rows with a null doc_id are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidstone.functions.staging import sized, stage
from braidstone.llm.common import attach, components, frugal

WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Sizes in one band differ by this factor at most.
BAND = 1.6
#: Bits of the second sketch.
BITS = 1024
#: One document in so many is in the sample that looks for common shingles; one that COMMON of them hold is common
#: (about COMMON * SAMPLE_EVERY documents of all). The most frequent COMMON_MOST at most are broadcast.
SAMPLE_EVERY, COMMON, COMMON_MOST = 20, 4, 2_000_000
#: Batches of documents and rows of pairs handled at once in Python.
CHUNK = 500
#: Bytes of text whose keys make one bucket; keys that a task gathers before it deals them to buckets, and those of one row.
BUCKET_BYTES, GATHERED, ROW_KEYS = 2_000_000, 1_000_000, 512

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit word per byte and the odd multiplier's powers, from a fixed seed."""
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + rng.integers(0, 2, 256, dtype=np.uint64), rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, A-Z lowered, by a polynomial over its bytes."""
    b = np.frombuffer(text, np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    values, out = _tables()[0][b], np.zeros(len(start), np.uint64)
    longest = int((end - start).max())
    if longest <= 64:
        for i in range(longest):  # all words at once, one byte after another
            live = start + i < end
            out = np.where(live, out * _MULT + values[np.minimum(start + i, len(b) - 1)], out)
    else:
        powers = _powers(len(b))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[: len(b)], dtype=np.uint64)))
        short = end - start <= 64
        for i in range(int((end - start)[short].max(initial=0))):
            live = short & (start + i < end)
            out = np.where(live, out * _MULT + values[np.minimum(start + i, len(b) - 1)], out)
        for w in np.flatnonzero(~short):  # the value of one long word, in the same polynomial
            part = values[start[w] : end[w]]
            out[w] = np.sum(part * powers[: len(part)][::-1], dtype=np.uint64)
        del total
    return _mix(out + (end - start).astype(np.uint64))


@lru_cache(maxsize=4)
def _powers_to(n: int) -> np.ndarray:
    p = np.full(n, _MULT, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _powers_to(1 << max(10, int(n).bit_length()))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = word_hashes(text.encode()) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    salt = _tables()[1] if words <= WORDS else np.random.default_rng(words).integers(1, 1 << 62, words, dtype=np.uint64) * _U(2) + _U(1)
    n = max(1, len(h) - words + 1)
    acc = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        acc += h[i : i + n] * salt[i]
    acc = np.sort(_mix(acc + _U(min(words, len(h)))))
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


#: Rounds in which each group compares its members with one of them only.
STARS = 2


class Bands:
    """Which bands a size belongs to and how many lanes each has, for a threshold."""

    def __init__(self, threshold: Fraction = THRESHOLD, ratio: float = BAND):
        self.threshold, low = threshold, [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * ratio)))
        self.low = np.array(low, np.int64)
        #: A band is that of the smaller set: sizes a in it, partners up to a / t.
        self.unlike = np.array([int((u - 1) * (1 + 1 / threshold) * (1 - threshold) / (1 + threshold)) for u in [*low[1:], 1 << 41]], np.int64)
        self.lanes = self.unlike * 3 // 2 + 2

    def of(self, n: int) -> list[int]:
        own = int(np.searchsorted(self.low, n, "right")) - 1
        out, k = [own], own - 1
        while k >= 0 and (self.low[k + 1] - 1) >= self.threshold * n:
            out.append(k)
            k -= 1
        return [k for k in out if self.unlike[k]]


def _lanes(shingle: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The lanes that are not empty, ascending, and their bits."""
    lane = ((shingle >> _U(32)) * _U(p)) >> _U(32)  # rises with the hash, so that a lane is one run
    first = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1]))) if len(lane) else np.zeros(0, np.int64)
    return lane[first], np.bitwise_xor.reduceat(_mix(shingle + _U(7)), first) if len(first) else np.zeros(0, np.uint64)


def lane_keys(whole: np.ndarray, rare: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys (band, lane, bits) of a set; ``rare``: the set without common shingles."""
    out = []

    def add(lane: np.ndarray, bits: np.ndarray, kind: int) -> None:
        out.append(_mix(bits + _mix(lane * _MULT + _U(kind))))

    for k in bands.of(len(whole)):
        p, d = int(bands.lanes[k]), int(bands.unlike[k])
        for kind, (tokens, lanes) in enumerate(((rare, p), (rare, 8 * p), (whole, p))):
            lane, bits = _lanes(tokens, lanes)
            add(lane[: d + 1], bits[: d + 1], 3 * k + kind)
            if len(lane) > d:
                break
        else:
            empty = np.setdiff1d(np.arange(p, dtype=np.uint64), lane)
            add(empty, np.zeros(len(empty), np.uint64), 3 * k + 2)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bit_sketch(shingle: np.ndarray, bits: int = BITS) -> bytes:
    odd = np.bincount((shingle & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _set_id(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a sorted set."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


_ROWS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()), ("keys", pa.binary()), ("ids", pa.binary())])
_ROWS_SQL = "bucket int, doc_id long, tag long, n long, s1 long, s2 long, sketch binary, keys binary, ids binary"


def _emit(words: int, bands: Bands, buckets: int, common):
    """Per document a row of its set's size, digest and bit sketch; rows of one bucket's keys and their ids.

    Keys are gathered over blocks, 64 for each bucket at least, so that rows grow with the keys, however many buckets
    there are. A set seen before in the same partition emits no keys again: its digest joins it to the first, and the row with
    the smaller id is found later. That keeps groups of copies from weighing on their keys' buckets.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip, seen = common.value, set()
        keys, owners, held, most = [], [], 0, max(GATHERED, 64 * buckets)

        def gathered() -> Iterator[pa.RecordBatch]:
            k, o = np.concatenate(keys), np.concatenate(owners)
            keys.clear()
            owners.clear()
            b = (k % _U(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            k, o, b = k[order], o[order], b[order]
            run = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            times = -(-np.diff(np.append(run, len(k))) // ROW_KEYS)
            first = np.repeat(run, times) + ROW_KEYS * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            last = np.append(first[1:], len(k))
            none = pa.nulls(len(first), pa.int64())
            yield pa.record_batch([pa.array(b[first]), none, none, none, none, none, pa.nulls(len(first), pa.binary()), pa.array([k[x:y].tobytes() for x, y in zip(first, last, strict=True)], pa.binary()), pa.array([o[x:y].tobytes() for x, y in zip(first, last, strict=True)], pa.binary())], schema=_ROWS)

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, texts, tags = (part.column(i).to_pylist() for i in range(3))
                rows = []
                for doc_id, text, tag in zip(ids, texts, tags, strict=True):
                    s = shingles(text, words)
                    s1, s2 = _set_id(s)
                    rows.append((doc_id, tag, len(s), s1, s2, bit_sketch(s)))
                    if not len(s) or doc_id is None or (s1, s2) in seen:
                        continue
                    if len(seen) < 2_000_000:
                        seen.add((s1, s2))
                    rare = s[skip[np.minimum(np.searchsorted(skip, s), len(skip) - 1)] != s] if len(skip) else s
                    k = lane_keys(s, rare, bands)
                    keys.append(k)
                    owners.append(np.full(len(k), s1, np.int64))
                    held += len(k)
                m = len(rows)
                cols = list(zip(*rows, strict=True))
                own = np.array([x or 0 for x in cols[0]], np.int64).view(np.uint64)
                spread = pa.array((_mix(own + np.array([x or 0 for x in cols[1]], np.int64).view(np.uint64)) % _U(buckets)).astype(np.int32))
                none = pa.nulls(m, pa.binary())
                yield pa.record_batch([spread, *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary()), none, none], schema=_ROWS)
                if held >= most:
                    yield from gathered()
                    held = 0
        if held:
            yield from gathered()

    return run


_MET = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()), ("g1", pa.int64()), ("g2", pa.int64()), ("part", pa.int32()), ("members", pa.list_(pa.int64()))])
_MET_SQL = "doc_id long, tag long, n long, s1 long, s2 long, sketch binary, g1 long, g2 long, part int, members array<long>"
#: Members of one stored group row; a larger group becomes several rows.
GROUP_ROW = 4096
#: The keys of a bucket that a task holds before it lets those of large groups go.
HELD = 1_000_000


class _Bucket:
    """The keys of one bucket and the sets that have them, until the groups of sets with a key in common are told.

    Of a bucket with more than HELD keys those that GROUP_ROW sets or more have are told as they come, row by row
    under the key itself, so that a group's size bounds nothing here.
    """

    def __init__(self):
        self.keys, self.owners, self.held, self.told, self.part = [], [], 0, np.zeros(0, np.uint64), 0

    def add(self, keys: bytes, owners: bytes) -> Iterator[tuple]:
        self.keys.append(np.frombuffer(keys, np.uint64))
        self.owners.append(np.frombuffer(owners, np.int64))
        self.held += len(self.keys[-1])
        if self.held > HELD:
            k, o = self._sorted()
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(first, len(k)))
            large = (size >= GROUP_ROW) | np.isin(k[first], self.told)
            yield from self._tell(k, o, first[large], size[large])
            self.told = np.union1d(self.told, k[first[large]])
            rest = np.repeat(~large, size)
            self.keys, self.owners, self.held = [k[rest]], [o[rest]], int(rest.sum()) // 2  # half as many more may come before the next time

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        k, o = np.concatenate(self.keys), np.concatenate(self.owners)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))  # copies in several partitions
        return k[fresh], o[fresh]

    def _tell(self, k: np.ndarray, o: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        for i, n in zip(first.tolist(), size.tolist(), strict=True):
            for x in range(i, i + n, GROUP_ROW):
                self.part += 1
                yield k[i].astype(np.int64), _mix(k[i : i + 1] + _MULT)[0].astype(np.int64), self.part, o[x : min(x + GROUP_ROW, i + n)]

    def groups(self) -> Iterator[tuple]:
        """(g1, g2, part, members) of what is left; of equal groups under several keys one."""
        if not self.keys:
            return
        k, o = self._sorted()
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(first, len(k)))
        old = np.isin(k[first], self.told)
        yield from self._tell(k, o, first[old], size[old])
        some = (size > 1) & ~old
        first, size = first[some], size[some]
        if not len(first):
            return
        start = np.repeat(np.cumsum(size) - size, size)
        member = o[np.repeat(first, size) + np.arange(size.sum()) - start]
        at = np.cumsum(size) - size
        h = _mix(member.view(np.uint64))
        g1, g2 = np.add.reduceat(h, at), np.bitwise_xor.reduceat(_mix(h + _MULT), at)
        _, once = np.unique(np.stack((g1, g2), 1), axis=0, return_index=True)
        for i in once:
            for x in range(0, size[i], GROUP_ROW):
                yield g1[i].astype(np.int64), g2[i].astype(np.int64), -1 - x, member[at[i] + x : at[i] + min(x + GROUP_ROW, size[i])]


@frugal
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by bucket: document rows as they are, and the groups of sets that share a key."""
    at, bucket, out = None, _Bucket(), []

    def ready(more: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for row in more:
            out.append(row)
            if len(out) >= 2000 or len(row[3]) == GROUP_ROW:
                yield _groups(out)
                out.clear()

    for b in batches:
        docs = b.filter(pa.compute.is_null(b.column("keys")))
        if docs.num_rows:
            none = pa.nulls(docs.num_rows, pa.int64())
            yield pa.record_batch([*(docs.column(c) for c in ("doc_id", "tag", "n", "s1", "s2", "sketch")), none, none, pa.nulls(docs.num_rows, pa.int32()), pa.nulls(docs.num_rows, pa.list_(pa.int64()))], schema=_MET)
        blocks = b.filter(pa.compute.is_valid(b.column("keys")))
        for name, keys, owners in zip(blocks.column("bucket").to_pylist(), blocks.column("keys").to_pylist(), blocks.column("ids").to_pylist(), strict=True):
            if name != at:
                yield from ready(bucket.groups())
                at, bucket = name, _Bucket()
            yield from ready(bucket.add(keys, owners))
    yield from ready(bucket.groups())
    if out:
        yield _groups(out)


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    m = len(rows)
    none = pa.nulls(m, pa.int64())
    cols = list(zip(*rows, strict=True))
    return pa.record_batch([none, none, none, none, none, pa.nulls(m, pa.binary()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))], schema=_MET)


def _common(rows: DataFrame, words: int) -> np.ndarray:
    """Sorted shingles that at least COMMON documents of the sample hold; COMMON_MOST at most."""

    @frugal
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1).to_pylist():
                if len(s := shingles(t, words)):
                    yield pa.record_batch([pa.array(s.view(np.int64))], ["h"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_EVERY)) == 0)
    found = sample.mapInArrow(each, "h long").groupBy("h").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(COMMON_MOST).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def _near_enough(threshold: Fraction):
    """Keeps pairs ``(a, b, na, nb, ka, kb)`` whose sizes and bit sketches allow the threshold."""
    t = threshold

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            na, nb = x.column(2).to_numpy(), x.column(3).to_numpy()
            bits = [np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(x.num_rows, -1) for i in (4, 5)]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            most = (na + nb) * (t.denominator - t.numerator) // (t.denominator + t.numerator)
            keep = (apart <= most) & (np.minimum(na, nb) * t.denominator >= np.maximum(na, nb) * t.numerator)
            yield pa.record_batch([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _set_rows(words: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                sets = [shingles(t, words) for t in b.column(0).slice(at, CHUNK).to_pylist()]
                yield pa.record_batch([pa.array([_set_id(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["s", "tokens"])

    return run


def _verified(threshold: Fraction):
    t = threshold

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column(2), x.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((p, q)))
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(t.denominator * inter >= t.numerator * (len(p) + len(q) - inter))
            yield pa.record_batch([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """The pairs ``(a, b)`` of set ids that meet the threshold, and the sets ``(s, tokens)`` they were verified on."""
    of = lambda x: nodes.select(F.col("s1").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    likely = stage(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_near_enough(threshold), "a long, b long"), "likely")
    ends = likely.select(F.col("a").alias("s1")).union(likely.select(F.col("b").alias("s1"))).distinct()
    wanted = stage(nodes.join(ends, "s1", "left_semi").select(F.col("doc_id").alias("rep"), F.col("tag").alias("rep_tag")), "wanted")
    texts = rows.join(sized(wanted, wanted.count()), (F.col("doc_id") == F.col("rep")) & (F.col("tag") == F.col("rep_tag")), "left_semi").select("text")
    sets = stage(texts.mapInArrow(_set_rows(words), "s long, tokens binary"), "sets").dropDuplicates(["s"])
    one = likely.join(sets.select(F.col("s").alias("a"), F.col("tokens").alias("ta")), "a")
    two = one.join(sets.select(F.col("s").alias("b"), F.col("tokens").alias("tb")), "b")
    return stage(two.select("a", "b", "ta", "tb").mapInArrow(_verified(threshold), "a long, b long"), "links"), sets


#: Members and visitors that are compared at once.
BLOCK = 4096
#: Groups up to this size are joined with themselves, which makes fewer rows than this for each member.
SMALL = 32


def _compare(threshold: Fraction):
    """Pairs of a visitor and a member in different components whose sizes and bit sketches allow the threshold."""
    t = threshold

    def run(key, members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"s": np.zeros(0, np.int64), "hub": np.zeros(0, np.int64)})]
        bits = lambda f: np.frombuffer(b"".join(f["sketch"]), np.uint64).reshape(len(f), -1)
        if not members.empty and not visitors.empty:
            y, ys, yc, yn = bits(members), members["s"].to_numpy(), members["c"].to_numpy(), members["n"].to_numpy()
            for at in range(0, len(visitors), 64):
                v = visitors.iloc[at : at + 64]
                x, xn = bits(v), v["n"].to_numpy()[:, None]
                near = (v["c"].to_numpy()[:, None] != yc) & (np.minimum(xn, yn) * t.denominator >= np.maximum(xn, yn) * t.numerator)
                i, j = np.nonzero(near)
                apart = np.concatenate([np.bitwise_count(x[i[k : k + 100_000]] ^ y[j[k : k + 100_000]]).sum(1, dtype=np.int64) for k in range(0, len(i), 100_000)] or [np.zeros(0, np.int64)])
                good = apart <= (xn[i, 0] + yn[j]) * (t.denominator - t.numerator) // (t.denominator + t.numerator)
                out.append(pd.DataFrame({"s": v["s"].to_numpy()[i[good]], "hub": ys[j[good]]}))
        return pd.concat(out)

    return run


def _left_over(mixed: DataFrame, nodes: DataFrame, key: list[str], threshold: Fraction) -> DataFrame:
    """Likely pairs of different components in a group: its members outside its largest component against all, in blocks. They may repeat.

    Sizes, members with their sketches and the pairs of large groups are stored one after another: in one query their
    shuffles, each with the tasks of all partitions, would run at once, which the driver's memory bears.
    """
    parts = mixed.groupBy(*key, "c").count()
    sizes = parts.groupBy(*key).agg(F.max(F.struct("count", "c"))["c"].alias("big"), F.sum("count").alias("m"), (F.sum("count") - F.max("count")).alias("v"))
    counted = stage(mixed.join(sizes, key), "left-over")
    few = counted.filter(F.col("m") <= SMALL)
    other = few.select(*key, F.col("s").alias("hub"), F.col("c").alias("d"))
    small = few.join(other, key).filter("c < d").select("s", "hub")
    wide = counted.filter(F.col("m") > SMALL).join(nodes.select(F.col("s1").alias("s"), "n", "sketch"), "s")
    wide = wide.select(*key, "s", "c", "n", "sketch", "big", F.ceil(F.col("m") / BLOCK).cast("int").alias("bm"), F.ceil(F.col("v") / BLOCK).cast("int").alias("bv"))
    wide = stage(wide, "left-over-wide")
    salt = lambda n: F.pmod(F.xxhash64("s"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own, cols = [*key, "pm", "pv"], ["s", "c", "n", "sketch"]
    members = wide.withColumn("pm", salt("bm")).withColumn("pv", each("bv")).select(*own, *cols)
    visitors = wide.filter("c <> big").withColumn("pv", salt("bv")).withColumn("pm", each("bm"))
    visitors = visitors.select(*(F.col(k).alias(f"v_{k}") for k in own), *(F.col(c).alias(c) for c in cols))
    large = members.groupBy(*own).cogroup(visitors.groupBy(*(f"v_{k}" for k in own))).applyInPandas(_compare(threshold), "s long, hub long")
    return small.unionByName(stage(large, "left-over-pairs"))


#: Shingles of all sets of a block of a class; those that more sets of two blocks hold than this are counted by products.
BLOCK_TOKENS, FREQUENT = 600_000, 32


def count_links(x: list[np.ndarray], y: list[np.ndarray], mx: np.ndarray, my: np.ndarray, threshold: Fraction, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each set of ``x`` the weights ``my`` of the sets of ``y`` that meet the threshold added up, and the other way round.

    ``same``: y is x, a set does not link with itself, and both results are one.
    """
    t, nx, ny = threshold, np.array([*map(len, x)]), np.array([*map(len, y)])
    tokens, at = np.unique(np.concatenate((*x, *(() if same else y))), return_inverse=True)
    ax, ay = at[: nx.sum()], at if same else at[nx.sum() :]
    ry = np.repeat(np.arange(len(y)), ny)
    held = np.bincount(ay, minlength=len(tokens))
    frequent = held > FREQUENT
    column = np.cumsum(frequent) - 1
    order = np.argsort(ay, kind="stable")  # an index of y: the sets that hold a token
    sets, first = ry[order], np.concatenate(([0], np.cumsum(held)))
    of_x, of_y, ends = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), np.concatenate(([0], np.cumsum(nx)))
    wide, step = (ry[frequent[ay]], column[ay[frequent[ay]]]), max(64, 16_000_000 // max(1, len(y)))
    b, here = None, -1
    for lo in range(0, len(x), 512):
        hi = min(lo + 512, len(x))
        part = ax[ends[lo] : ends[hi]]
        row = np.repeat(np.arange(hi - lo), nx[lo:hi])
        inter = np.zeros((hi - lo, len(y)), np.float32)
        for c in range(0, int(frequent.sum()), step):
            size = min(step, int(frequent.sum()) - c)
            own = frequent[part] & (column[part] >= c) & (column[part] < c + size)
            if not own.any():
                continue
            a = np.zeros((hi - lo, size), np.float32)
            a[row[own], column[part[own]] - c] = 1
            if here != c:
                b, here = np.zeros((size, len(y)), np.float32), c
                there = (wide[1] >= c) & (wide[1] < c + size)
                b[wide[1][there] - c, wide[0][there]] = 1
            inter += a @ b
        rare = ~frequent[part]
        times = held[part[rare]]
        if times.sum():
            start = np.repeat(first[part[rare]], times)
            each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            np.add.at(inter, (np.repeat(row[rare], times), sets[start + each]), 1)
        inter = inter.astype(np.int64)
        linked = inter * (t.denominator + t.numerator) >= (nx[lo:hi, None] + ny[None]) * t.numerator
        if same:
            linked[np.arange(hi - lo), np.arange(lo, hi)] = False
        of_x[lo:hi] = linked @ my
        of_y += mx[lo:hi] @ linked
    return of_x, of_y


def _count_links(threshold: Fraction):
    """Of rows ``(class, i, j, side, s, m, tokens)`` sorted by class, i, j and side: ``(s, links)``, one pair of blocks at a time."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if not held[0] or now[1] != now[2] and not held[1]:
                return
            (xs, xm, x), (ys, ym, y) = (zip(*h, strict=True) if h else ((), (), ()) for h in held)
            xm, ym = np.array(xm, np.int64), np.array(ym, np.int64)
            same = now[1] == now[2]
            of_x, of_y = count_links(x, x if same else y, xm, xm if same else ym, threshold, same)
            s, n = (np.array(xs), of_x) if same else (np.array([*xs, *ys]), np.concatenate((of_x, of_y)))
            yield pa.record_batch([pa.array(s[n > 0], pa.int64()), pa.array(n[n > 0], pa.int64())], ["s", "links"])

        for b in batches:
            for *key, side, s, m, tokens in zip(*(b.column(i) for i in range(7)), strict=True):
                key = tuple(k.as_py() for k in key)
                if key != now:
                    yield from done()
                    now, held = key, ([], [])
                held[side.as_py()].append((s.as_py(), m.as_py(), np.frombuffer(tokens.as_py(), np.uint64)))
        yield from done()

    return run


def _link_counts(of_set: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """``(s, links)`` of the sets of ``of_set(s1, component, n, m)`` that link: how many documents with another set each links with."""
    classes = of_set.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size")).filter("k > 1")
    classes = classes.select("component", F.ceil(F.col("size") / BLOCK_TOKENS).cast("int").alias("blocks"))
    own = of_set.join(classes, "component").select(F.col("s1").alias("s"), "component", "m", "blocks", F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int").alias("b"))
    there = sets.join(own, "s")
    left = there.withColumn("j", F.explode(F.sequence(F.col("b"), F.col("blocks") - 1))).select("component", F.col("b").alias("i"), "j", F.lit(0).alias("side"), "s", "m", "tokens")
    right = there.filter("b > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("component", "i", F.col("b").alias("j"), F.lit(1).alias("side"), "s", "m", "tokens")
    pairs = left.unionByName(right).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side")
    return pairs.mapInArrow(_count_links(threshold), "s long, links long").groupBy("s").agg(F.sum("links").alias("links"))


def jaccard_classes(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, links: bool = True) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links, class_id, text_hash)``, one row per row of ``docs``.

    ``n_links``: other rows it links with (null if not ``links``). ``class_id`` names a component of rows, null for a
    row that cannot link; ``text_hash`` tells rows with one doc_id apart.
    """
    spark = docs.sparkSession
    bands = Bands(threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tag"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = spark.sparkContext.broadcast(_common(rows, words))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    emitted = rows.mapInArrow(_emit(words, bands, max(parts, -(-size // BUCKET_BYTES)), common), _ROWS_SQL).repartition(parts, "bucket").sortWithinPartitions("bucket")
    met = stage(emitted.mapInArrow(_meet, _MET_SQL), "met")
    sets = met.filter(F.col("n").isNotNull()).select("doc_id", "tag", "n", "s1", "s2", "sketch")
    least = F.min(F.struct("doc_id", "tag"))
    nodes = stage(sets.filter("n > 0 and doc_id is not null").groupBy("s1").agg(least["doc_id"].alias("doc_id"), least["tag"].alias("tag"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    groups = stage(met.filter(F.col("members").isNotNull()).select("g1", "g2", "part", "members").dropDuplicates(["g1", "g2", "part"]), "groups")

    member = stage(groups.select("g1", "g2", F.explode("members").alias("s")).distinct(), "members")
    key = ["g1", "g2"]
    degree = member.join(member.groupBy(*key).count(), key).groupBy("s").agg(F.sum("count").alias("degree"))
    member = stage(member.join(degree, "s"), "degrees")
    tried, linked, joined, spent, seen = None, None, None, None, []
    for k in range(STARS + 1):
        here = member
        if joined is not None:
            here = here.join(joined.withColumnRenamed("node", "s"), "s", "left").withColumn("c", F.coalesce("component", "s"))
            mixed = here.groupBy(*key).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select(*key)
            here = stage(here.select(*key, "s", "degree", "c").join(mixed, key, "left_semi"), f"mixed-{k}")
        if k < STARS:  # the k-th hub of each group against its other members
            best = F.max(F.struct("degree", "s", *(["c"] if k else [])))
            hubs = here if not k else here.join(spent, [here["s"] == spent["h"], *(here[x] == spent[f"h_{x}"] for x in key)], "left_anti")
            hubs = stage(hubs.groupBy(*key).agg(best.alias("x")).select(*key, F.col("x.s").alias("hub"), *([F.col("x.c").alias("d")] if k else [])), f"hubs-{k}")
            was = hubs.select(F.col("hub").alias("h"), *(F.col(x).alias(f"h_{x}") for x in key))
            spent = was if not k else spent.union(was)
            pairs = here.join(hubs, key).filter("s <> hub")
            pairs = pairs.filter("c <> d") if k else pairs
        else:
            pairs = _left_over(here, nodes, key, threshold)
        pairs = pairs.select(F.least("s", "hub").alias("a"), F.greatest("s", "hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, f"pairs-{k}")
        if k and pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found, verified = _links(pairs, nodes, rows, words, threshold)
        seen.append(verified)
        linked = found if linked is None else linked.union(found)
        joined = stage(components(linked), "joined")

    of_set = stage(nodes.select("s1", "doc_id", "n", "m").join(joined.withColumnRenamed("node", "s1"), "s1", "left").withColumn("component", F.coalesce("component", "s1")), "set-classes")
    lowest = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    told = of_set.join(lowest, "component").select("s1", "m", "component", "component_id")
    if links:
        sets_of = seen[0]
        for more in seen[1:]:
            sets_of = sets_of.unionByName(more)
        told = told.join(_link_counts(of_set, sets_of.dropDuplicates(["s"]), threshold).withColumnRenamed("s", "s1"), "s1", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("m") - 1 if links else F.lit(None)).cast("long")
    told = stage(told.select("s1", "m", "component_id", n_links.alias("n_links"), F.col("component").alias("class_id")), "told")
    can = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    named = ["doc_id", F.col("n").alias("n_shingles")]
    of_rows = stage(sets.filter(can).select("doc_id", "tag", "n", "s1"), "set-rows")
    out = attach(of_rows, told, ["s1"], "m", of_rows.count()).select(*named, "component_id", "n_links", "class_id", F.col("tag").alias("text_hash"))
    none = F.lit(None).cast("long")
    alone = sets.filter(F.coalesce(~can, F.lit(True))).select(*named, F.col("doc_id").alias("component_id"), (F.lit(0).cast("long") if links else none).alias("n_links"), none.alias("class_id"), F.col("tag").alias("text_hash"))
    return out.unionByName(alone)


def first_of_each(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` but those of a class whose first row, by doc_id and then the hash of its text, is another one.

    Rows that cannot link stay. Rows that repeat both id and text are one document and stay or go together.
    """
    said = stage(jaccard_classes(docs.select("doc_id", "text"), words, threshold, links=False).filter("class_id is not null").select("doc_id", "component_id", "class_id", "text_hash"), "classes")
    lead = said.filter("doc_id = component_id")
    first = lead.groupBy("class_id").agg(F.min("text_hash").alias("first"))
    later = lead.join(first, "class_id").filter("text_hash <> first")
    gone = stage(said.filter("doc_id <> component_id").select("doc_id", "text_hash").unionByName(later.select("doc_id", "text_hash")).distinct().select(F.col("doc_id").alias("__bs_id"), F.col("text_hash").alias("__bs_hash")), "gone")
    match = (docs["doc_id"].cast("long") == F.col("__bs_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__bs_hash"))
    return docs.join(sized(gone, gone.count()), match, "left_anti")
