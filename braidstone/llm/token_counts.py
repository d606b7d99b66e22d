"""Edit-aware token counts.

A document is kept as a segment tree over its chunks (what no pre-token reaches beyond): each leaf has its chunk's
tokens and characters, each node the sums below it. An edit finds its leaves by descending on characters, re-encodes
only those and one on either side, further while a chunk border is no longer one, and updates the sums above. Where an
edit makes more chunks than it found leaves, the leaves of the smallest subtree with room are spread out in it, and
the tree doubles when none has: every chunk keeps a leaf of its own, however often and long text is inserted.

Defined cases: a null text is empty and has no tokens. Edits apply in order, each to the text the one before left;
positions and lengths beyond the text are cut to it, null ones are 0; a null edit list is none, a null edit inserts
nothing. Repeated rows, null ids too, are counted one by one. An empty table gives an empty result. Extra columns are
not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidstone.llm.common import frugal
from braidstone.llm.packing import CACHE_CHUNKS, ChunkIds, chunk_ids

_BORDER = re.compile(r"(?<=\S)(?=[ \n])")
#: Chunks of more characters are counted anew each time; texts held as Python strings at once.
LONG, BATCH = 64, 500


def chunks(text: str, known: ChunkIds) -> list[str]:
    """Parts that tokenise on their own: a border lies between a character that is no blank and a blank or line feed.

    A text that ``ChunkIds.cut`` takes has one also between line feeds and the single blank of a word.
    """
    if not text:
        return []
    parts = known.cut(text)
    if parts is None:
        return _BORDER.split(text)
    return [parts[0], *[p if p[0] == "\n" else " " + p for p in parts[1:]]] if parts[0] else [p if p[0] == "\n" else " " + p for p in parts[1:]]


class ChunkCounts(dict):
    """How many tokens a chunk has, computed on first sight."""

    def __init__(self, known: ChunkIds):
        self.encode = known.encode

    def __missing__(self, chunk: str) -> int:
        n = len(self.encode(chunk))
        if len(chunk) <= LONG:
            if len(self) >= 2 * CACHE_CHUNKS:
                self.clear()
            self[chunk] = n
        return n


_counts: dict[int, ChunkCounts] = {}


def chunk_counts(known: ChunkIds) -> ChunkCounts:
    if id(known) not in _counts:
        _counts[id(known)] = ChunkCounts(known)
    return _counts[id(known)]


class TokenTree:
    """Sums of tokens and characters over chunks, as a binary heap of ``2 * width`` nodes for each; a leaf may be empty."""

    def __init__(self, text: str, known: ChunkIds):
        self.known, self.count = known, chunk_counts(known)
        parts = chunks(text, known)
        self.size, self.encoded = len(parts), 0  # chunks at first; chunks encoded again by edits
        self._lay(parts, [*map(self.count.__getitem__, parts)], 1 << max(0, (len(parts) - 1).bit_length()))

    def _lay(self, parts: list[str], tokens: list[int], width: int) -> None:
        n = len(parts)
        self.width, self.leaves = width, parts + [""] * (width - n)
        self.sums = np.zeros((2, 2 * width), np.int64)
        self.sums[0, width : width + n] = tokens
        self.sums[1, width : width + n] = [*map(len, parts)]
        self._sum(width, width)

    def _sum(self, node: int, span: int) -> None:
        """The sums of the levels above the ``span`` leaves from heap place ``node`` on, within their subtree."""
        while span > 1:
            below = self.sums[:, node : node + span]
            node, span = node // 2, span // 2
            self.sums[:, node : node + span] = below[:, ::2] + below[:, 1::2]

    @property
    def total(self) -> int:
        return int(self.sums[0, 1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and where it begins; the last leaf that is not empty for the text's end."""
        node, start, chars = 1, 0, self.sums[1]
        while node < self.width:
            node *= 2
            if at - start >= chars[node] and chars[node + 1] > 0:
                start += int(chars[node])
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, chunk: str) -> None:
        self.leaves[leaf] = chunk
        node = leaf + self.width
        change = (self.count[chunk] if chunk else 0) - int(self.sums[0, node]), len(chunk) - int(self.sums[1, node])
        tokens, chars = self.sums
        while node:
            tokens[node] += change[0]
            chars[node] += change[1]
            node //= 2

    def _spread(self, a: int, b: int, parts: list[str]) -> None:
        """Puts ``parts`` in place of the leaves a to b, with the others of the smallest subtree that has room."""
        span = 1
        while span <= self.width:
            lo = a // span * span
            if b < lo + span:
                left, right = ([i for i in r if self.leaves[i]] for r in (range(lo, a), range(b + 1, lo + span)))
                if 4 * (m := len(left) + len(parts) + len(right)) <= 3 * span:
                    break
            span *= 2
        chunk = [*(self.leaves[i] for i in left), *parts, *(self.leaves[i] for i in right)]
        tokens = [*(int(self.sums[0, self.width + i]) for i in left), *map(self.count.__getitem__, parts), *(int(self.sums[0, self.width + i]) for i in right)]
        if span > self.width:  # the whole tree has no room
            self._lay([], [], 1 << (2 * m - 1).bit_length())
            lo, span = 0, self.width
        before = self.sums[:, (self.width + lo) // span].copy()
        self.leaves[lo : lo + span] = [""] * span
        under = self.sums[:, self.width + lo : self.width + lo + span]
        under[:] = 0
        for i, (c, t) in enumerate(zip(chunk, tokens, strict=True)):
            at = i * span // m
            self.leaves[lo + at], under[0, at], under[1, at] = c, t, len(c)
        self._sum(self.width + lo, span)
        node = (self.width + lo) // span
        change = self.sums[:, node] - before
        while node > 1:
            node //= 2
            self.sums[:, node] += change

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters from ``at`` on by ``inserted``."""
        whole = int(self.sums[1, 1])
        at = min(max(at, 0), whole)
        deleted = min(max(deleted, 0), whole - at)
        a, start = self._leaf(at)
        b = self._leaf(max(at, at + deleted - 1))[0]
        new = "".join(self.leaves[a : b + 1])
        new = new[: at - start] + inserted + new[at - start + deleted :]

        def step(i: int, by: int) -> int:
            i += by
            while 0 <= i < self.width and not self.leaves[i]:
                i += by
            return i

        grew = True
        while grew:  # one leaf on either side, then on while a border no longer is one
            grew = False
            left = step(a, -1)
            if left >= 0 and not (new and _BORDER.search(self.leaves[left][-1] + new[0])):
                a, new, grew = left, self.leaves[left] + new, True
            right = step(b, 1)
            if right < self.width and not (new and _BORDER.search(new[-1] + self.leaves[right][0])):
                b, new, grew = right, new + self.leaves[right], True
        parts, old = chunks(new, self.known), self.leaves[a : b + 1]
        self.encoded += sum(p not in old for p in parts)
        if len(parts) > len(old):
            self._spread(a, b, parts)
            return
        for i, was in enumerate(old):
            chunk = parts[i] if i < len(parts) else ""
            if chunk != was:
                self._set(a + i, chunk)


def edited_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, n_edits, n_tokens_after, n_chunks, n_encoded)`` of ``docs(doc_id, text, edits)``.

    ``edits``: array of structs (at, deleted, inserted).
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(vocabulary)
        names = ["n_tokens", "n_edits", "n_tokens_after", "n_chunks", "n_encoded"]
        for b in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            out = []
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tree = TokenTree(text or "", known)
                before = tree.total
                for e in filter(None, edits or []):
                    tree.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
                out.append((before, len(edits or []), tree.total, tree.size, tree.encoded))
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), "edits")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chunks long, n_encoded long")


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with three edits each: one inserted, one replaced, one removed, at places that follow from the length."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    edit = lambda at, deleted, inserted: F.struct(at.cast("int").alias("at"), F.lit(deleted).alias("deleted"), F.lit(inserted).alias("inserted"))
    return docs.select("doc_id", "text", F.array(edit(n / 3, 0, " as amended in 2024,"), edit(n / 2, 12, "the"), edit(n * 2 / 3, 9, "")).alias("edits"))
