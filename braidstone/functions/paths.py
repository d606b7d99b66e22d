"""Paths of synchronised trees: normalising, safety, parts; names of conflict copies."""

from __future__ import annotations

import posixpath
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The folder of a tree that holds its own records, by default.
META_DIR = ".replica"
# Device names that some systems reserve: fixed values.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


@F.pandas_udf(T.StringType())
def normalise(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Forward slashes, composed characters, no ``.`` and no double slashes, no slash at either end."""

    def one(p: str | None) -> str | None:
        if p is None:
            return None
        p = posixpath.normpath(unicodedata.normalize("NFC", p.replace("\\", "/"))).strip("/")
        return "" if p == "." else p

    for s in paths:
        yield s.map(one)


def is_safe(p: Column, meta: str = META_DIR) -> Column:
    """Whether a relative path may be written: no way out of the tree, nothing reserved, no control characters."""
    parts = F.split(p, "/")
    bad = F.exists(parts, lambda s: s.isin("", ".", "..") | F.lower(F.regexp_extract(s, r"^([^.]*)", 1)).isin(*RESERVED) | s.rlike(r"[ .]$"))
    return F.coalesce((p != "") & ~p.startswith("/") & ~p.rlike(r"(?s)^.:") & ~p.rlike(r"[\x00-\x1f]") & (parts[0] != meta) & ~bad, F.lit(False))


def parent_of(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def depth(p: Column) -> Column:
    return (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).cast("int")


def ancestors(p: Column) -> Column:
    """Every proper prefix, shortest first."""
    parts = F.split(p, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def conflict_name(p: Column, replica: Column, stamp: Column, n: Column) -> Column:
    """`` (conflicted copy from R STAMP[ #n])`` before the last extension of the last part."""
    folder, name = F.regexp_extract(p, r"^(.*/)?[^/]*$", 1), F.regexp_extract(p, r"([^/]*)$", 1)
    stem = F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
    ext = F.when(name.contains("."), F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))
    again = F.when(n > 1, F.concat(F.lit(" #"), n.cast("string"))).otherwise(F.lit(""))
    return F.concat(folder, stem, F.lit(" (conflicted copy from "), replica, F.lit(" "), stamp, again, F.lit(")"), ext)


def looks_like_text(data: Column) -> Column:
    """Of a file's first 8192 bytes: no zero byte, valid UTF-8 (a character cut at the end is not)."""
    head = F.substring(data, 1, 8192)
    return F.is_valid_utf8(head.cast("string")) & ~F.contains(head, F.unhex(F.lit("00")))


def backoff(attempt: Column, seed: int) -> Column:
    """Full jitter below 0.5 * 2^attempt seconds, 60 at most."""
    return F.rand(seed) * F.least(F.lit(60.0), F.lit(0.5) * F.pow(F.lit(2.0), attempt))


def check_safe(p: Column, meta: str = META_DIR) -> Column:
    """``p``, or an error where it is not safe."""
    return F.when(is_safe(p, meta), p).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.coalesce(p, F.lit("null")))).cast("string"))


def short_id(content_id: Column) -> Column:
    """The first eight characters behind an id's prefix; ``-`` for none."""
    return F.coalesce(F.substring(F.substring_index(content_id, ":", -1), 1, 8), F.lit("-"))
