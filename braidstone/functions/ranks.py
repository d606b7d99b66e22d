"""Places of rows in an order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidstone.functions.staging import stage


def placed(rows: DataFrame, by: list[str], name: str, parts: int) -> DataFrame:
    """``rows`` with their place in the order of ``by`` as ``name``: places within ranges, after the counts of the ranges before."""
    dealt = stage(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    offsets, before = [], 0
    for part, n in sorted(map(tuple, dealt.groupBy("part").count().collect())):
        offsets.append((part, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1 + F.col("before")
    return stage(dealt.join(F.broadcast(table), "part").select(*rows.columns, place.cast("long").alias(name)), name)
