"""Streams: compare-and-swap commits with keyed state, the change feed of a commit log, bursts of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "path string, arrival long, op_id string, status string"
_STATE = "replicas array<string>, counters array<long>, accepted array<string>"


def commit_stream(requests: DataFrame) -> DataFrame:
    """``(path, arrival, op_id, status)`` of a stream of ``(path, arrival, op_id, vv)``; a path's vector is its state.

    Requests of one micro-batch are taken in order of arrival. Ids are remembered by path, as they name it.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, done = {}, []
        if state.exists:
            replicas, counters, done = state.get
            now, done = dict(zip(replicas, counters, strict=True)), list(done)
        f = pd.concat(list(frames)).sort_values("arrival")
        said = []
        for op_id, vv in zip(f["op_id"], f["vv"], strict=True):
            vv = {k: v for k, v in dict(vv).items() if v}
            if op_id in done:
                said.append("replay")
            elif any(vv.get(k, 0) < n for k, n in now.items()):
                said.append("conflict")
            else:
                said.append("ok")
                now = vv
                done.append(op_id)
        state.update((list(now), list(now.values()), done))
        yield pd.DataFrame({"path": f["path"], "arrival": f["arrival"], "op_id": f["op_id"], "status": said})

    return requests.groupBy("path").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def burst_stream(events: DataFrame, key: str, ts: str, gap: str, late: str, capacity: int = 1024) -> DataFrame:
    """``(key, start, end, n, rescan)`` of bursts without a pause of ``gap``, once the watermark has passed them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    bursts = timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return bursts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") >= capacity).alias("rescan"))
