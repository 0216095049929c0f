"""Keyed envelopes, and the tombstone that follows each delete.

Events have topic, table, record_key, op, the row's columns or images, lsn, tombstone and seq. seq is the
place in the log: a delete and its tombstone share a log position, so the position alone is no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(changes: DataFrame, topic: Column, record_key: Column, images: list[str], tombstones: bool = True, log_index: Column | None = None) -> DataFrame:
    """changes (op, lsn, images...) as events; log_index numbers them in log order (default: lsn).

    A tombstone has op d and null in every column of images.
    """
    index = F.col("lsn") if log_index is None else log_index
    known = F.when(F.col("op").isin("c", "u", "d"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    marks = F.when(F.col("op") == "d", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))) if tombstones else F.array(F.lit(False))
    out = changes.withColumns({"op": known, "topic": topic, "record_key": record_key, "_index": index}).withColumn("tombstone", F.explode(marks))
    out = out.withColumns({c: F.when(~F.col("tombstone"), F.col(c)) for c in images})
    return out.withColumn("seq", F.col("_index") * 2 + F.col("tombstone").cast("long")).drop("_index")


def key_reuse(events: DataFrame, primary_key: list[str]) -> DataFrame:
    """One row: record keys, those that carry more than one row, and the most rows under one key.

    Tombstones are left out; a change that lacks its primary key counts its record key only.
    """
    pk = F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in primary_key]), lambda x: x), F.struct(*primary_key))
    per_key = events.where("not tombstone").groupBy("topic", "record_key").agg(F.count_distinct(pk).alias("rows"))
    return per_key.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("rows") > 1).alias("keys_carrying_more_than_one_row"), F.coalesce(F.max("rows"), F.lit(0)).alias("max_rows_under_one_key"))


def rekeyed(changes: DataFrame, before_key: Column, after_key: Column) -> DataFrame:
    """Updates that change the primary key as a delete of the old row and an insert of the new one."""
    moved = (F.col("op") == "u") & before_key.isNotNull() & ~before_key.eqNullSafe(after_key)
    parts = F.when(moved, F.array(F.lit("d"), F.lit("c"))).otherwise(F.array(F.col("op")))
    return changes.withColumn("_part", F.explode(parts)).withColumn("op", F.col("_part")).drop("_part")
