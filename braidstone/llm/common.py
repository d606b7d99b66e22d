"""What several operators share: batches of texts, connected components, joins that survive hot keys."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidstone.functions.staging import stage

#: Words are runs of anything but these six characters; A-Z are lowered, nothing else is.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: A key that holds at least one row in this many is hot. At most so many keys can be hot, which bounds a broadcast.
HOT_SHARE = 500


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def hand_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task function that hands freed memory back to the system when it ends.

    Workers are reused by later stages, and allocators would keep what the largest batch took.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


def attach(left: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``table`` (one row per key, ``count`` = rows of ``left`` under it).

    Keys that hold 1/500 of ``total`` or more are at most 500 and are joined by broadcast; the others by shuffle.
    Both inputs must be stored tables (they are read twice). Keys must not be null.
    """
    hot = table.filter(F.col(count) * HOT_SHARE >= F.lit(max(total, HOT_SHARE))).drop(count)
    cold = table.filter(F.col(count) * HOT_SHARE < F.lit(max(total, HOT_SHARE))).drop(count)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a long, b long)``; the component is its smallest node.

    Alternating large-star and small-star rounds; each is two aggregations and joins on edge rows, stored before the
    next, until the edges form stars. Rounds grow with the logarithm of a component's diameter.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(60):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = stage(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        forked = e.groupBy("u").count().filter("count > 1")
        deep = e.join(e.select(F.col("u").alias("v")), "v", "left_semi")
        if forked.isEmpty() and deep.isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle in 60 rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
