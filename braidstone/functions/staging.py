"""Tables that cut lineage: written to the shared folder the cluster names, read back with a known schema."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}

#: A side is broadcast only when its counted rows stay under this; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local master without one gets a folder of its own."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _local:
        _local[key] = "file://" + tempfile.mkdtemp(prefix="braidstone-")
    return _local[key]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of the files, so that later uses never recompute it."""
    path = f"{shared_folder(df.sparkSession)}/braidstone/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted ``rows`` stay within ``bound``; unchanged otherwise."""
    return F.broadcast(df) if rows <= bound else df
