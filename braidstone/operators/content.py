"""Kernels over contents: ids, content-defined chunks, three-way text merge."""

from __future__ import annotations

import difflib
import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the chunk format: sizes, the seed of the byte table, how many top bits of the rolling value are zero at a cut.
CHUNK_MIN, CHUNK_MAX, CUT_BITS, GEAR_SEED = 2 * 1024, 64 * 1024, 13, 0xC0FFEE


def content_id(data: bytes) -> str:
    return "b2:" + hashlib.blake2b(data, digest_size=16).hexdigest()


@F.pandas_udf(T.StringType())
def content_ids(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in data:
        yield s.map(lambda x: None if x is None else content_id(bytes(x)))


@F.pandas_udf(T.StringType())
def op_ids(replica: pd.Series, kind: pd.Series, path: pd.Series, cid: pd.Series, vv: pd.Series) -> pd.Series:
    """``replica:`` and 96 bits over replica, kind, path, content (``-`` for none) and the vector's canonical text."""
    parts = zip(replica, kind, path, cid, vv, strict=True)
    return pd.Series([f"{r}:" + hashlib.blake2b("|".join((r, k, p, c or "-", v)).encode(), digest_size=12).hexdigest() for r, k, p, c, v in parts])


@lru_cache
def _gear() -> np.ndarray:
    rng = random.Random(GEAR_SEED)
    return np.array([rng.getrandbits(64) for _ in range(256)], np.uint64)


def boundaries(data: bytes) -> list[int]:
    """Chunk ends. The rolling value at a byte depends on the 64 bytes up to it, so all candidates come from one pass."""
    n = len(data)
    g = _gear()[np.frombuffer(data, np.uint8)]
    h = g.copy()
    width = 1
    while width < 64:  # h over 2w bytes from two of w
        h[width:] = h[width:] + (h[:-width] << np.uint64(width)) if n > width else h[width:]
        width *= 2
    cuts = np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1
    out, start = [], 0
    while start < n:
        i = int(np.searchsorted(cuts, start + CHUNK_MIN))
        end = min(start + CHUNK_MAX, n, int(cuts[i]) if i < len(cuts) else n)
        out.append(end)
        start = end
    return out


def chunk_rows(files: DataFrame) -> DataFrame:
    """``(file, pos, chunk, size, data)`` of ``files(file, data)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, data in zip(f["file"], f["data"], strict=True):
                start, data = 0, bytes(data or b"")
                for pos, end in enumerate(boundaries(data)):
                    part = data[start:end]
                    out.append((name, pos, content_id(part), len(part), part))
                    start = end
            yield pd.DataFrame(out, columns=["file", "pos", "chunk", "size", "data"])

    return files.select(F.col("file").cast("string"), F.col("data").cast("binary")).mapInPandas(run, "file string, pos int, chunk string, size long, data binary")


def is_text(data: bytes) -> bool:
    head = data[:8192]
    try:
        head.decode()
    except UnicodeDecodeError:
        return False
    return b"\0" not in head


def merge_text(base: bytes, mine: bytes, theirs: bytes) -> tuple[bytes, bool, int] | None:
    """(merged, clean, conflicting regions) of line edits on both sides; None unless all three are text.

    Edits at disjoint places of the base both apply, overlapping ones with one text once, other overlaps between
    markers. Two insertions at one place are no conflict: mine, then theirs. After an overlap both sides go on one edit;
    a later one may begin before it.
    """
    if not all(map(is_text, (base, mine, theirs))):
        return None
    old = base.decode("utf-8", "replace").splitlines(keepends=True)

    def edits(new: bytes) -> list[tuple[int, int, list[str]]]:
        lines = new.decode("utf-8", "replace").splitlines(keepends=True)
        ops = difflib.SequenceMatcher(None, old, lines).get_opcodes()
        return [(i1, i2, lines[j1:j2]) for tag, i1, i2, j1, j2 in ops if tag != "equal"]

    queue = {"mine": edits(mine), "theirs": edits(theirs)}
    out, at, regions = [], 0, 0

    def copy_to(line: int) -> None:
        out.extend(old[at:line])

    def apply(side: str) -> None:
        nonlocal at
        lo, hi, lines = queue[side].pop(0)
        copy_to(lo)
        out.extend(lines)
        at = hi

    while queue["mine"] or queue["theirs"]:
        if not queue["theirs"] or queue["mine"] and queue["mine"][0][1] <= queue["theirs"][0][0]:
            apply("mine")
        elif not queue["mine"] or queue["theirs"][0][1] <= queue["mine"][0][0]:
            apply("theirs")
        else:
            a, b = queue["mine"].pop(0), queue["theirs"].pop(0)
            copy_to(min(a[0], b[0]))
            if a[2] == b[2]:
                out.extend(a[2])
            else:
                regions += 1
                out += ["<<<<<<< mine\n", *a[2], "=======\n", *b[2], ">>>>>>> theirs\n"]
            at = max(a[1], b[1])
    copy_to(len(old))
    return "".join(out).encode(), regions == 0, regions


def merge_rows(rows: DataFrame, key: str) -> DataFrame:
    """``(key, merged, clean, regions)`` of ``rows(key, base, mine, theirs)``; nulls where one side is binary or absent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [merge_text(bytes(b), bytes(m), bytes(t)) if None not in (b, m, t) else None for b, m, t in zip(f["base"], f["mine"], f["theirs"], strict=True)]
            yield pd.DataFrame({key: f[key], "merged": [g and g[0] for g in got], "clean": pd.array([g and g[1] for g in got], "boolean"), "regions": pd.array([g and g[2] for g in got], "Int64")})

    return rows.select(key, *(F.col(c).cast("binary").alias(c) for c in ("base", "mine", "theirs"))).mapInPandas(run, f"{key} long, merged binary, clean boolean, regions long")


def merge_outcome(merged: DataFrame, markers: bool = False) -> DataFrame:
    """``merge_rows`` with ``op``: the merged text is written (MERGED), or both versions stay (CONFLICT_SPLIT).

    Both stay where a side or the ancestor is absent or no text, and where edits overlap unless ``markers`` may be written.
    """
    good = F.col("merged").isNotNull() & (F.col("clean") | F.lit(markers))
    return merged.withColumn("op", F.when(good, "MERGED").otherwise("CONFLICT_SPLIT")).withColumn("merged", F.when(good, F.col("merged")))
