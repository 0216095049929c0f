"""Counters of a stream of events that need no timeline, taken in the pass that reads it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counters(slot: list[str]) -> list[Column]:
    """Of events: records, tombstones, changes by kind, those without their whole merge key, first and last position."""
    change = ~F.col("tombstone")
    missing = F.exists(F.array(*[F.col(c).isNull() for c in slot]), lambda x: x)
    kinds = [F.count_if(change & (F.col("op") == op)).alias(name) for op, name in (("c", "creates"), ("u", "updates"), ("d", "deletes"))]
    return [
        F.count(F.lit(1)).alias("records"), F.count_if("tombstone").alias("tombstones"), *kinds,
        F.count_if(change & missing).alias("changes_with_no_merge_key"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"),
    ]


def counted(events: DataFrame, slot: list[str]) -> tuple[DataFrame, Observation]:
    """events, and an observation that has their counters when a job has read them to the end."""
    seen = Observation()
    return events.observe(seen, *counters(slot)), seen


def counted_stream(events: DataFrame, slot: list[str], name: str = "events") -> DataFrame:
    """A stream whose progress has the counters of each micro-batch, under name."""
    return events.observe(name, *counters(slot))


def totals(query: StreamingQuery, name: str = "events") -> dict:
    """The counters of a query's recent micro-batches, added up; positions are the lowest and the highest."""
    out: dict = {}
    for progress in query.recentProgress:
        seen = (json.loads(progress.json) if hasattr(progress, "json") else progress).get("observedMetrics", {}).get(name)
        for k, v in (seen or {}).items():
            if v is not None:
                out[k] = v if k not in out else min(out[k], v) if k == "first_lsn" else max(out[k], v) if k == "last_lsn" else out[k] + v
    return out
