"""Vector arithmetic on array columns, in built-in expressions and double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where either vector has length zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """Mean 0 and variance 1 over the array."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / n
    var = dot(a, a) / n - mean * mean
    # the two sums once for all elements, not once for each
    once = F.array(F.struct(mean.alias("mean"), F.sqrt(var + eps).alias("sd")))
    return F.transform(once, lambda s: F.transform(a, lambda x: (x - s["mean"]) / s["sd"]))[0]


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def linear(a: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """One output per row of ``weights``."""
    rows = [dot(a, F.array(*map(F.lit, map(float, w)))) + F.lit(float(bias[i]) if bias else 0.0) for i, w in enumerate(weights)]
    return F.array(*rows)
