"""Session factory: what a local run or a test needs; on a cluster the submitter's settings win."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession


def session(app: str = "braidstone", cpus: str | None = None) -> SparkSession:
    """The active session, else one with AQE and UTC; of what a submitter has set nothing is changed."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    own = {
        "spark.app.name": app,
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # submitted: the JVM runs and knows its settings
        said = SparkConf()
        own = {k: v for k, v in own.items() if not said.contains(k) and k not in ("spark.sql.shuffle.partitions", "spark.driver.memory")}
    return SparkSession.builder.config(map=own).getOrCreate()
