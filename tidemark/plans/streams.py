"""The change stream that the registered queries run on, derived from the events table.

lsn is the event's number; signup creates, error deletes, everything else updates; the row is
(user_id, line_no), and the record key that or user_id alone ("wide", which covers several rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import record_key
from tidemark.operators.delivery import scattered
from tidemark.operators.envelope import envelope

TOPIC = "cdc.shop.event"
SLOT = ["user_id", "line_no"]
PAYLOAD = ["event_type", "cents"]


def base_changes(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return e.select(
        F.expr("event_id div 2" if ties else "event_id").cast("long").alias("lsn"),
        F.col("event_id").alias("log_index"),
        op.alias("op"),
        "user_id",
        (F.regexp_extract("props", "(-?[0-9]+)", 1).cast("long") % 10).alias("line_no"),
        F.floor(F.col("value") * 100).cast("long").alias("cents"),
        "event_type",
    )


def change_stream(spark: SparkSession, sf_dir: str, key: str = "row", order: str = "shuffled", ties: bool = False, tombstones: bool = True) -> DataFrame:
    """Events with arrival: "log" order, or "shuffled" by a fixed permutation."""
    rows = base_changes(spark, sf_dir, ties)
    of = record_key(*SLOT) if key == "row" else record_key("user_id")
    rows = rows.withColumn("_pk_user", F.col("user_id")).withColumn("_pk_line", F.col("line_no"))
    out = envelope(rows, F.lit(TOPIC), of, PAYLOAD, tombstones, F.col("log_index")).drop("_pk_user", "_pk_line", "log_index")
    return out.withColumn("arrival", F.col("seq") if order == "log" else scattered(F.col("seq")))
