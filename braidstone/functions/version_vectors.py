"""Version vectors as MAP<STRING, BIGINT>: replica to counter, a missing replica counts 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def of(m: Column) -> Column:
    """Without zeros; null as empty."""
    return F.map_filter(F.coalesce(m, F.create_map().cast("map<string,bigint>")), lambda k, v: v != 0)


def get(m: Column, replica: Column) -> Column:
    return F.coalesce(F.try_element_at(m, replica), F.lit(0).cast("bigint"))


def is_empty(m: Column) -> Column:
    return F.size(m) == 0


def replicas(m: Column) -> Column:
    """The replicas that count, sorted."""
    return F.sort_array(F.map_keys(of(m)))


def bump(m: Column, replica: Column) -> Column:
    one = F.create_map(replica, F.lit(1).cast("bigint"))
    return F.map_zip_with(m, one, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def merge(a: Column, b: Column) -> Column:
    """The larger counter of each replica."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def descends_from(a: Column, b: Column) -> Column:
    """Every counter of b is reached in a; true for an empty b."""
    return F.forall(F.map_entries(b), lambda e: get(a, e["key"]) >= e["value"])


def dominates(a: Column, b: Column) -> Column:
    """Descends from b and is not the same."""
    return descends_from(a, b) & ~descends_from(b, a)


def concurrent_with(a: Column, b: Column) -> Column:
    """Neither descends from the other."""
    return ~descends_from(a, b) & ~descends_from(b, a)


def compare(a: Column, b: Column) -> Column:
    """``same``, ``newer``, ``older`` or ``concurrent``."""
    up, down = descends_from(a, b), descends_from(b, a)
    return F.when(up & down, "same").when(up, "newer").when(down, "older").otherwise("concurrent")


def to_json(m: Column) -> Column:
    """Canonical text: keys sorted, no blanks, no zeros."""
    entries = F.sort_array(F.map_entries(of(m)))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"), e["value"].cast("string"))), ","), F.lit("}"))


def from_json(text: Column) -> Column:
    return of(F.from_json(F.when(F.length(text) > 0, text).otherwise("{}"), "map<string,bigint>"))
