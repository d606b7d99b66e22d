"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch that a worker has not met are concatenated; a suffix array indexes the text, and all
pieces of the vocabulary are searched in it at once by binary search, character by character, which gives every
occurrence of every piece as an edge. The edges, sorted by position, are then relaxed from left to right: a byte-pair
encoding is the one path whose neighbouring pieces each encode to themselves, so the piece that ends at a position is
the one compatible with the piece that ends at its start. Characters outside the vocabulary become bytes.

A word is what no piece reaches beyond: in this kind of vocabulary only a word's start mark or a run of marks holds
one, which is checked when the vocabulary is read.

Defined cases: a null text gives no ids, like the empty text. A mark in a text is a blank, as in the library, so the
round trip returns a blank for it. Repeated rows are encoded alike. An empty table gives an empty result. Extra
columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Known words of a worker; a full cache is emptied, which changes no result.
CACHE_WORDS = 600_000
#: Known pairs of pieces of a worker, sorted; forgotten beyond this, which changes no result.
PAIRS = 2_000_000
#: Bits of the table in front of them, one pair a slot.
RECENT = 20
#: Characters indexed at once.
INDEX_CHARS = 2_000_000
_RUN = re.compile(f"{MARK}+")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i, p in enumerate(self.text) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score = {self.text[i]: sp.get_score(i) for i in usable}
        self.id = {self.text[i]: i for i in usable}
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in self.id):
            raise ValueError("a piece of this vocabulary reaches beyond a word")
        self.runs = sorted((len(p) for p in self.id if not p.strip(MARK)), reverse=True)
        self.searched = [p for p in self.id if len(p) == 1 or p.strip(MARK)]
        self.matrix = np.zeros((len(self.searched), max(map(len, self.searched))), np.uint32)
        for row, p in enumerate(self.searched):
            self.matrix[row, : len(p)] = [ord(c) for c in p]
        self.size = np.array([len(p) for p in self.searched])
        self.raw = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.text)]
        self.words: dict[str, bytes] = {}
        self.piece_id = np.array([self.id[p] for p in self.searched])
        self.pair, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.recent, self.recent_fits = np.full(1 << RECENT, -1), np.zeros(1 << RECENT, bool)
        self.names = [*self.searched, ""]

    # --- suffix array -------------------------------------------------------------------------------------------

    def suffix_array(self, text: np.ndarray) -> np.ndarray:
        """Suffixes ordered by as many characters as the longest piece has, by doubling."""
        _, rank = np.unique(text, return_inverse=True)
        rank, n, h = rank.astype(np.int64) + 1, len(text), 1
        while True:
            key = rank * (n + 2) + np.concatenate((rank[h:], np.zeros(min(h, n), np.int64)))[:n]
            order = np.argsort(key)  # equal keys get equal ranks, in whatever order
            key = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.concatenate(([1], key[1:] != key[:-1])))
            rank, h = fresh, h * 2
            if h >= self.matrix.shape[1] or rank.max() == n:
                return order

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece row) of every occurrence of every piece."""
        sa, n = self.suffix_array(text), len(text)
        padded = np.concatenate((text, np.zeros(self.matrix.shape[1] + 1, np.uint32)))
        lo, hi = np.zeros(len(self.size), np.int64), np.full(len(self.size), n, np.int64)
        for d in range(self.matrix.shape[1]):
            live = np.flatnonzero((self.size > d) & (lo < hi))
            if not len(live):
                break
            c = self.matrix[live, d]
            ends = []
            for right in (False, True):
                a, b = lo[live].copy(), hi[live].copy()
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) // 2
                    got = padded[sa[np.minimum(mid, n - 1)] + d]
                    less = (got <= c) if right else (got < c)
                    a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
                ends.append(a)
            lo[live], hi[live] = ends
        count = np.maximum(hi - lo, 0)
        row = np.repeat(np.arange(len(count)), count)
        at = sa[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        return at, row

    # --- relaxing -----------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[p + q], -i) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if p + q in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [x for x in (a, b) if x]

    def learn(self, words: list[str]) -> None:
        """Encode new words, INDEX_CHARS at a time."""
        at, size = 0, 0
        for i, w in enumerate(words):
            size += len(w) + 1
            if size >= INDEX_CHARS or i == len(words) - 1:
                self._learn(words[at : i + 1])
                at, size = i + 1, 0

    def _learn(self, words: list[str]) -> None:
        marked = [w if w[0] == "\n" else MARK + w for w in words]
        joined = "\0" + "\0".join(marked) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([1, *(len(w) + 1 for w in marked)])
        starts, ends = starts[:-1], starts[1:] - 1
        at, row = self.occurrences(text)
        bare = np.ones(len(text), bool)
        bare[at] = False  # where no piece begins: bytes, which nothing merges with
        bare[0] = bare[starts - 1] = bare[ends] = False
        bare = np.flatnonzero(bare)
        none = len(self.size)
        at, row = np.concatenate((at, bare)), np.concatenate((row, np.full(len(bare), none)))
        first = np.zeros(len(text) + 1, bool)
        first[starts] = True
        depth = at - np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))[at]
        order = np.argsort(depth.astype(np.uint16), kind="stable") if depth.max(initial=0) < 65536 else np.argsort(depth)
        at, row, depth = at[order], row[order], depth[order]
        level = np.searchsorted(depth, np.arange(int(depth[-1]) + 2)) if len(depth) else [0]
        to = at + np.append(self.size, 1)[row]
        last, origin = np.full(len(text) + 1, -1), np.zeros(len(text) + 1, np.int64)  # the piece that ends at a position and its start
        last[starts] = none
        for lo, hi in zip(level[:-1], level[1:], strict=True):  # edges that begin as far into their words, of all words at once
            p, r, q = at[lo:hi], row[lo:hi], to[lo:hi]
            open_ = (last[p] >= 0) & (last[q] < 0)
            p, r, q = p[open_], r[open_], q[open_]
            fits = self.compatible(last[p], r)
            last[q[fits]], origin[q[fits]] = r[fits], p[fits]
        if (last[ends] < 0).any():
            raise AssertionError("a word has no path")
        path, p = np.zeros(len(text) + 1, bool), ends[ends > starts]
        while len(p):
            path[p] = True
            p = origin[p]
            p = p[~first[p]]
        path = np.flatnonzero(path)
        raw = [[self.byte[b] for b in joined[p - 1].encode("utf-8", "surrogatepass")] for p in path[last[path] == none].tolist()]
        size = np.ones(len(path), np.int64)
        size[last[path] == none] = [len(x) for x in raw]
        ids = np.repeat(np.append(self.piece_id, 0)[last[path]], size)
        ids[np.repeat(last[path] == none, size)] = [i for x in raw for i in x]
        done = np.concatenate(([0], np.cumsum(size)))
        lo, hi = (done[np.searchsorted(path, x, "right")] * 4 for x in (starts, ends))
        held = ids.astype("<u4").tobytes()
        for w, x, y in zip(words, lo.tolist(), hi.tolist(), strict=True):
            self.words[w] = held[x:y]

    def compatible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it; both are rows, the row after the last is nothing."""
        key = before * (len(self.size) + 1) + piece
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - RECENT)).astype(np.int64)
        out = self.recent_fits[slot]
        miss = np.flatnonzero(self.recent[slot] != key)
        if len(miss):
            out[miss] = fits = self.looked_up(key[miss])
            want, first = np.unique(slot[miss], return_index=True)  # one key of those that want a slot
            self.recent[want], self.recent_fits[want] = key[miss][first], fits[first]
        return out

    def looked_up(self, key: np.ndarray) -> np.ndarray:
        none = len(self.size)
        if len(self.pair) > PAIRS:
            self.pair, self.pair_fits = self.pair[:0], self.pair_fits[:0]
        key, inverse = np.unique(key, return_inverse=True)
        known = np.append(self.pair, -1)[np.searchsorted(self.pair, key)] == key
        if not known.all():
            new = key[~known]
            name = self.names
            fits = np.array([k % (none + 1) == none or self.fit(name[k // (none + 1)], name[k % (none + 1)]) for k in new.tolist()], bool)
            where = np.searchsorted(self.pair, new)
            self.pair, self.pair_fits = np.insert(self.pair, where, new), np.insert(self.pair_fits, where, fits)
        return self.pair_fits[np.searchsorted(self.pair, key)][inverse]

    # --- texts --------------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """Words of a text: each begins with its mark, or with a line feed in place of it."""
        return (" " + text.replace(MARK, " ")).replace("\n", " \n").split(" ")[1:]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.words) > CACHE_WORDS:  # before looking up, so that no word of these texts is lost
            self.words.clear()
        new = {w for p in parts for w in p if w not in self.words}
        new.discard("")
        if new:
            self.learn(list(new))
        out, one = [], self.id.get(MARK)
        for p in parts:
            if "" not in p:
                out.append(np.frombuffer(b"".join([self.words[w] for w in p]), "<u4"))
                continue
            ids: list[int] = []
            held = 0  # marks without a word yet
            for w in p:
                if not w:
                    held += 1
                    continue
                mine = np.frombuffer(self.words[w], "<u4").tolist()
                if w[0] != "\n" and held and mine[0] == one:
                    held, mine = held + 1, mine[1:]
                ids += self.marks(held) + mine
                held = 0
            out.append(np.array(ids + self.marks(held), "<u4"))
        return out

    def marks(self, n: int) -> list[int]:
        out = []
        while n:
            k = next((k for k in self.runs if k <= n), 1)
            out.append(self.id[MARK * k])
            n -= k
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(path)
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                yield pa.record_batch([part.column(0), pa.array([x.astype(np.int32) for x in codec.encode(part.column(1).to_pylist())], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids)`` of the texts, as the library encodes them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(model)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([codec.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, same)``: what encoding gives and whether decoding returns the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(model)
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                texts = part.column(1).to_pylist()
                ids = codec.encode(texts)
                same = [codec.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, same boolean")
