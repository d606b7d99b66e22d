"""Packing of tokenised documents into windows by minimum bin slack.

Each document's ids are cut into full windows and one remainder. Only how many remainders have each length decides
the plan, so the planner sees at most ``window`` numbers however large the corpus is. For each window a bitset
subset-sum dynamic program over the remaining length multiset finds the sum closest to capacity and backtracks how
many of each length reach it; that pattern is repeated as often as the counts allow. A window that no multiset fills
takes the head of one more remainder, whose tail goes back into the multiset as a length of its own. What is left at
the end, less than a window, is cut into powers of two, which take no padding.

Defined cases: a null or empty text is one end id. Rows that repeat an id are packed as documents of their own. An
empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidstone.functions.staging import BROADCAST_ROWS, stage
from braidstone.llm.common import frugal

WINDOW, END_ID = 2048, 1
#: Ranks are counted within (length, salt), so that one very common length is spread over so many groups.
SALTS = 256
#: Of a worker's memory for chunk ids; a full cache is emptied, which changes no result.
CACHE_CHUNKS = 250_000
#: Texts held as Python strings at once.
BATCH = 1000


class ChunkIds(dict):
    """Ids of a chunk of text as bytes, computed on first sight.

    A chunk begins at a blank or line feed that follows something else, or at a single blank between line feeds and
    a word, and no pre-token of a byte-level BPE spans such a place, so a text's ids are the ids of its chunks in
    order. Line feeds in a row are one pre-token or more and stay together.

    Added tokens are found before pre-tokens, so a text that holds the content of one is encoded as a whole, between
    them. ``literal``: the content of special ones is plain text (the library's ``encode_special_tokens``).
    """

    def __init__(self, path: str, literal: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
        ranks = {bytes(back[c] for c in token): i for token, i in held["model"]["vocab"].items() if all(c in back for c in token)}
        # The pre-token pattern of byte-level BPE: a fixed value of the vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        for added in held["added_tokens"]:
            ranks.pop(added["content"].encode(), None)
            if any(added[k] for k in ("single_word", "lstrip", "rstrip")) or re.search(r"\s", added["content"]):
                raise ValueError(f"an added token that looks at what is around it, or has blanks: {added}")
        self.added = {a["content"]: a["id"] for a in held["added_tokens"] if not (literal and a["special"])}
        self._split = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split
        self._plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._code, self._native = "H" if max(*ranks.values(), *self.added.values()) < 65536 else "I", sys.byteorder == "little"
        self.kind = "<u2" if self._code == "H" else "<u4"

    def marked(self, text: str) -> bool:
        return any(c in text for c in self.added)

    def encode(self, text: str) -> list[int]:
        if not self.marked(text):
            return self._plain(text)
        return [i for part in self._split(text) if part for i in ([self.added[part]] if part in self.added else self._plain(part))]

    def __missing__(self, part: str) -> bytes:
        ids = self._plain(part if part[0] == "\n" else f" {part}")  # ``cut`` leaves no added token in a part
        ids = array(self._code, ids).tobytes() if self._native else np.array(ids, self.kind).tobytes()
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        self[part] = ids
        return ids

    def cut(self, text: str) -> list[str] | None:
        """The chunks of a text, those after the first without their blank; none for a text that is encoded as a whole."""
        joined = text.replace("\n", " \n")
        if "\n \n" in joined:  # twice, as matches that overlap are left by the first
            joined = joined.replace("\n \n", "\n\n").replace("\n \n", "\n\n")
        parts = joined.split(" ")
        return None if "" in parts or _odd(text) or self.marked(text) else parts

    def ids(self, text: str) -> np.ndarray:
        parts = self.cut(text)
        if parts is None:
            return np.array(self.encode(text), self.kind)
        first = np.array(self.encode(parts[0]), self.kind).tobytes() if parts[0] else b""
        return np.frombuffer(first + b"".join(map(self.__getitem__, parts[1:])), self.kind)


#: White space of Unicode other than blank and line feed; a text that has any is encoded as a whole.
_ODD = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"


def _odd(text: str) -> bool:
    return any(c in text for c in _ODD)


_chunk_ids: dict[tuple[str, bool], ChunkIds] = {}


def chunk_ids(path: str, literal: bool = False) -> ChunkIds:
    if (path, literal) not in _chunk_ids:
        _chunk_ids[path, literal] = ChunkIds(path, literal)
    return _chunk_ids[path, literal]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(path: str, window: int, end_id: int, schema: pa.Schema, literal: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(path, literal)
        end = np.array([end_id], known.kind)
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            row, start, length, crc, total, held = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([known.ids(text), end]) if text else end
                n = len(ids)
                for at in range(0, n, window):
                    part = ids[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(_crc(part))
                    total.append(n)
                    held.append(part.tobytes() if len(part) < window else None)
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int32())), *map(pa.array, (start, length, crc, total)), pa.array(held, pa.binary()), pa.array([known.kind] * len(row), pa.string())], schema=schema)

    return run


def _closest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, how many) multiset whose sum is the largest that fits in ``room``."""
    mask, reach, before = (1 << (room + 1)) - 1, 1, []
    for length, count in zip(lengths, counts, strict=True):
        before.append(reach)
        left, step = min(count, room // length), 1
        while left > 0:  # binary splitting of the count
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, count, had in reversed(list(zip(lengths, counts, before, strict=False))):
        k = 0
        while not had >> total & 1:
            total, k = total - length, k + 1
            if k > count:
                raise AssertionError("the sum cannot be traced back")
        if k:
            out.append((length, k))
    return out


class Plan:
    """Which sequence and offset the rank-th item of a length goes to, as intervals of ranks.

    An interval of ranks of a length, from ``first`` on, either places whole items, ``per`` in each of the sequences
    from ``base`` on, or cuts ``cut`` ids off each item; the rest of it becomes an item of length ``then`` whose ranks
    begin at ``then_first``, after those of the table's own items of that length.
    """

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        self.window, self.rows, self.sequences = window, [], 0
        self.total = {x: n for x, n in histogram.items() if n > 0}
        self.left, self.used = dict(self.total), dict.fromkeys(self.total, 0)
        while self.left:
            if sum(self.left.values()) < window and (rest := sum(x * n for x, n in self.left.items())) < window:
                self._last(rest)
            else:
                self._fill()

    def _take(self, length: int, n: int, per: int, base: int, offset: int, cut: int = 0) -> None:
        then = length - cut if cut else 0
        self.rows.append((length, self.used[length], base, per, offset, cut, then, self.total.get(then, 0)))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
        if cut:
            self.total[then] = self.total.get(then, 0) + n
            self.left[then] = self.left.get(then, 0) + n
            self.used.setdefault(then, 0)

    def _fill(self) -> None:
        lengths = sorted(self.left, reverse=True)
        per = dict(_closest(lengths, [self.left[x] for x in lengths], self.window))
        slack = self.window - sum(x * k for x, k in per.items())
        cut = max((x for x in lengths if self.left[x] > per.get(x, 0)), key=lambda x: (self.left[x] - per.get(x, 0), x)) if slack else 0
        need = per | {cut: per.get(cut, 0) + 1} if cut else per
        times = min(self.left[x] // k for x, k in need.items())
        base, offset = self.sequences, 0
        self.sequences += times
        for length, k in sorted(per.items()):
            self._take(length, k * times, k, base, offset)
            offset += k * length
        if cut:
            self._take(cut, times, 1, base, offset, slack)

    def _last(self, rest: int) -> None:
        """Less than a window is left: fill sequences of the powers of two that add up to it."""
        sizes = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        queue, room, offset = [x for x in sorted(self.left) for _ in range(self.left[x])], 0, 0
        while queue:
            if not room:
                self.sequences, room, offset = self.sequences + 1, sizes.pop(0), 0
            length = queue.pop(0)
            fits = length <= room
            self._take(length, 1, 1, self.sequences - 1, offset, 0 if fits else room)
            if not fits:
                queue.insert(0, length - room)
            room, offset = (room - length, offset + length) if fits else (0, 0)

    def arrays(self) -> dict[str, np.ndarray]:
        names = ("kind", "first", "base", "per", "offset", "cut", "then", "then_first")
        return dict(zip(names, np.array(sorted(self.rows), np.int64).reshape(-1, 8).T, strict=True))


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, skip, length, sequence, offset) of every piece of the items with this length and rank."""
    wide = 1 << 46
    starts = plan["kind"] * wide + plan["first"]
    item, skip, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
    length, rank = length.astype(np.int64), rank.astype(np.int64)
    while len(item):
        at = np.searchsorted(starts, length * wide + rank, "right") - 1
        k, cut = rank - plan["first"][at], plan["cut"][at]
        out.append((item, skip, np.where(cut > 0, cut, length), plan["base"][at] + k // plan["per"][at], plan["offset"][at] + k % plan["per"][at] * length))
        more = cut > 0
        item, skip, length, rank = item[more], (skip + cut)[more], plan["then"][at][more], (plan["then_first"][at] + k)[more]
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 5


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placed(plan, schema: pa.Schema):
    """Places rows ``(doc_id, start, length, ids_crc32, doc_tokens, rank[, ids, kind])``; cut items need their ids."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, length, crc, tokens, rank = (b.column(i).to_numpy() for i in range(1, 6))
            item, skip, took, sequence, offset = place(plan.value, length, rank)
            crc = crc[item]
            if b.num_columns > 6:
                ids, kind = b.column(6).to_pylist(), b.column(7).to_pylist()
                crc = np.array([_crc(np.frombuffer(ids[i], kind[i])[a : a + n]) for i, a, n in zip(item, skip, took, strict=True)], np.int64)
            yield pa.record_batch([b.column(0).take(pa.array(item)), *map(pa.array, (start[item] + skip, took, crc, tokens[item], sequence, offset))], schema=schema)

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, literal: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    The texts are tokenised once; remainders are stored with their ids, so that one that is cut gets its checksums
    without a second pass; the ids of the others are not moved while the cut ones are few enough to broadcast. Ranks within a length come from counts per (length, salt); the plan, a few thousand
    intervals at most, is broadcast. ``literal``: a special token's content in a text is plain text; the queries take
    it as the token, as the library does by default.
    """
    spark = docs.sparkSession
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    held = pa.schema([*fields, ("ids", pa.binary()), ("kind", pa.string())])
    placed = pa.schema([*fields, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keys = ["doc_id", "start", "length", "ids_crc32"]
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
    pieces = stage(rows.mapInArrow(_pieces(vocabulary, window, end_id, held, literal), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, kind string"), "pieces").withColumn("salt", salt)
    counts = stage(pieces.groupBy("length", "salt").count(), "counts")
    plan = Plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, window).arrays()  # `window` rows at most
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    inner = (F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1).cast("long")
    ranked = pieces.select(*keys, "doc_tokens", "salt").withColumn("inner", inner).join(before, ["length", "salt"])
    ranked = ranked.select(*keys, "doc_tokens", (F.col("inner") + F.col("before")).alias("rank"))
    sent = spark.sparkContext.broadcast(plan)
    cuts = _cut_ranks(plan)
    if not cuts:
        return ranked.mapInArrow(_placed(sent, placed), _PLACED)
    ranked = stage(ranked, "ranked")
    spans = F.broadcast(spark.createDataFrame(cuts, "cut_length long, a long, b long"))
    is_cut = (F.col("length") == F.col("cut_length")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))
    whole, torn = ranked.join(spans, is_cut, "left_anti"), ranked.join(spans, is_cut, "left_semi")
    torn = stage(torn, "torn")
    few = F.broadcast(torn.select(*(F.col(k).alias(f"of_{k}") for k in keys)).distinct()) if torn.count() <= BROADCAST_ROWS else torn.select(*(F.col(k).alias(f"of_{k}") for k in keys)).distinct()
    with_ids = pieces.filter(F.col("ids").isNotNull()).join(few, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]).select(*(f"of_{k}" for k in keys), "ids", "kind").dropDuplicates([f"of_{k}" for k in keys])
    torn = torn.join(with_ids, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]).select(*keys, "doc_tokens", "rank", "ids", "kind")
    return whole.mapInArrow(_placed(sent, placed), _PLACED).unionByName(torn.mapInArrow(_placed(sent, placed), _PLACED))


def _cut_ranks(plan: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """(length, from, to) of the ranks whose items are cut; to is open-ended at a length's last interval."""
    out, kind, first = [], plan["kind"].tolist(), plan["first"].tolist()
    for i, cut in enumerate(plan["cut"].tolist()):
        if cut:
            out.append((kind[i], first[i], first[i + 1] if kind[i + 1 : i + 2] == kind[i : i + 1] else 1 << 60))
    return out
