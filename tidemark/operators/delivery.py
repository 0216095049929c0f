"""Delivery orders of an event stream, and how far they are from log order.

Spark has no implicit order: each order is a column, arrival, numbered from 1 where it is dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import partition_for
from tidemark.operators import shared
from tidemark.operators.stretches import numbered, running, same


def route(events: DataFrame, partitions: int) -> DataFrame:
    """Adds partition (by record key) and offset (from 0, in log order within the partition)."""
    return numbered(events.withColumn("partition", partition_for(F.col("record_key"), partitions)), ["partition"], "seq", "offset")


def interleave(routed: DataFrame, seed: int = 0) -> DataFrame:
    """Adds arrival_key: an arbitrary merge of the partitions that keeps each one's order.

    Each record draws a number; a partition's numbers are dealt to its records in order of offset.
    """
    draws = routed.select(F.col("partition").alias("_p"), F.xxhash64(F.lit(seed), "seq").alias("arrival_key"))  # of one partition all differ, or nearly
    draws = numbered(draws, ["_p"], "arrival_key", "_o")
    return routed.join(draws, (F.col("partition") == F.col("_p")) & (F.col("offset") == F.col("_o"))).drop("_p", "_o")


PERIODS = 1 << 43  # of the prime, below 2**63
#: Stretches of scattered(): a remainder's rows, a thousand remainders.
SCATTERED = (43, 53)


def scattered(seq: Column, prime: int = 1_000_003, factor: int = 7919) -> Column:
    """An order without any order, by (seq * factor) % prime and then by seq: no two numbers from 0 get the same."""
    whole = seq.cast("long")
    return (whole % prime * factor) % prime * F.lit(PERIODS) + F.call_function("div", whole, F.lit(prime))


def shuffle(events: DataFrame, seed: int = 0) -> DataFrame:
    """Adds arrival_key, a hash of seed and seq."""
    return events.withColumn("arrival_key", F.xxhash64(F.lit(seed), "seq"))


def compact(events: DataFrame, order: str = "arrival") -> DataFrame:
    """The last record of each (topic, record key), tombstones then left out."""
    w = Window.partitionBy("topic", "record_key").orderBy(F.desc(order))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1 and not tombstone").drop("_n")


def batches(events: DataFrame, size: int, rank: str = "arrival") -> DataFrame:
    """Adds batch, from 1: contiguous chunks of a dense arrival rank."""
    if size < 1:
        raise ValueError("a batch has one record at least")
    return events.withColumn("batch", F.expr(f"({rank} - 1) div {int(size)} + 1"))


def prefix_cut(events: DataFrame, fraction: float, total: int, rank: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """What has been applied and what is held back, when a fraction of the stream has come (half to even)."""
    cut = round(total * fraction)
    return events.where(F.col(rank) <= cut), events.where(F.col(rank) > cut)


def partition_spread(routed: DataFrame, partitions: int) -> DataFrame:
    """Records of each partition, empty ones too."""
    counts = routed.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    every = routed.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition"))
    return every.join(counts, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("records"))


def same_key_inversions(events: DataFrame, order: str = "arrival") -> DataFrame:
    """One row: pairs of records of one (topic, record_key) that arrive against their log positions, equal positions
    not counted. Keys are told apart by 96 bits of hash."""
    return _inversions(_keyed(events, order), ["k", "k2"]).withColumnRenamed("inversions", "same_key")


def _keyed(events: DataFrame, order: str) -> DataFrame:
    key = [F.xxhash64("topic", "record_key").alias("k"), F.hash("record_key", "topic").alias("k2")]
    return events.select(*key, F.col(order).alias("x"), "lsn")


def inversions(events: DataFrame, order: str = "arrival") -> DataFrame:
    """One row: all pairs that arrive against their log positions, equal positions not counted."""
    return _inversions(events.select(F.col(order).alias("x"), "lsn"), [])


#: Numbers below 2 ** LOW_BITS are merged within a task, DIGIT_BITS more by each further pass.
LOW_BITS, DIGIT_BITS = 13, 3


def _merged(bits: np.ndarray, block: np.ndarray) -> int:
    """Pairs of a block, in order, of which the first has the larger number (below 2 ** LOW_BITS)."""
    key, found = (block << LOW_BITS) | bits, 0
    for b in range(LOW_BITS - 1, -1, -1):  # key is in order of its bits above b, and of arrival where they agree
        upper = key >> b & 1
        ones = np.cumsum(upper) - upper
        begin = np.flatnonzero(np.diff(key >> (b + 1), prepend=-1))
        before = ones - np.repeat(ones[begin], np.diff(np.append(begin, len(key))))
        found += int(before[upper == 0].sum())
        key = key[np.argsort(key >> b, kind="stable")]
    return found


def _inversions(rows: DataFrame, within: list[str]) -> DataFrame:
    """Pairs of rows (x, lsn and within) alike in within, of which the one of smaller x has the larger lsn.

    Rows are numbered by position (r; those of equal position as they arrive), so numbers that agree above
    their lowest LOW_BITS bits are few: their rows come together in order of arrival, and are merged in Arrow batches.
    Only groups of more rows go on: in each further pass, of those that agree above DIGIT_BITS more bits, running
    counts of each digit say how many larger ones came before. No pairs are made, and no task holds a group. The
    numbered rows are written once, as several passes read them.
    """
    placed = shared.kept(numbered(rows, within, "lsn", "r", then=["x"]).drop("lsn"), shared.folder(rows.sparkSession, "placed"))
    parts = [*within, "part"]
    low = placed.withColumn("part", F.shiftright("r", LOW_BITS)).repartition(*parts).sortWithinPartitions(*parts, "x").select(F.xxhash64(*parts).alias("h"), "part", F.col("r").bitwiseAND(F.lit((1 << LOW_BITS) - 1)).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        total = 0
        for batch in batches:
            held = [np.concatenate([a, b.to_numpy()]) for a, b in zip(held, batch.columns, strict=True)]
            edge = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(edge):  # all blocks but the last one are whole
                end = int(edge[-1]) + 1
                block = np.zeros(end, np.int64)
                block[edge[:-1] + 1] = 1
                total += _merged(held[2][:end], np.cumsum(block))
                held = [c[end:] for c in held]
        total += _merged(held[2], np.zeros(len(held[2]), np.int64)) if len(held[2]) else 0
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    sums = low.mapInArrow(run, "n long")
    sizes = placed.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1 << LOW_BITS)  # the few large groups
    large = placed.join(sizes.select(*[F.col(c).alias(f"_{c}") for c in within], "_n"), same(within, [f"_{c}" for c in within]) if within else F.lit(True)).select(*within, "x", "r", "_n")
    passes = F.ceil((F.ceil(F.log2(F.col("_n").cast("double"))) - LOW_BITS) / DIGIT_BITS)
    levels = large.withColumn("level", F.explode(F.sequence(F.lit(0), (F.greatest(passes, F.lit(1)) - 1).cast("int"))))
    shift = F.lit(LOW_BITS) + F.col("level") * DIGIT_BITS
    levels = levels.withColumn("block", F.call_function("shiftright", F.col("r"), (shift + DIGIT_BITS).cast("int"))).withColumn("digit", F.call_function("shiftright", F.col("r"), shift.cast("int")).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)))
    counted = running(levels, [*within, "level", "block"], "x", {f"d{d}": ("sum", (F.col("digit") == d).cast("long")) for d in range(1, 1 << DIGIT_BITS)})
    larger = sum((F.when(F.col("digit") < d, F.col(f"d{d}")).otherwise(0) for d in range(1, 1 << DIGIT_BITS)), F.lit(0))
    sums = sums.unionByName(counted.select(larger.cast("long").alias("n")))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inversions"))


def disorder(events: DataFrame, order: str = "arrival") -> DataFrame:
    """One row: records, inversions, those of one key and those across keys."""
    rows = shared.kept(_keyed(events, order), shared.folder(events.sparkSession, "disorder"))
    both = _inversions(rows.select("x", "lsn"), []).crossJoin(_inversions(rows, ["k", "k2"]).withColumnRenamed("inversions", "same_key"))
    return rows.agg(F.count(F.lit(1)).alias("records")).crossJoin(both).withColumn("cross_key", F.col("inversions") - F.col("same_key"))


def fanout(keyed: DataFrame, group: list[str]) -> DataFrame:
    """keyed (group..., partition): rows and partitions of each group."""
    return keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("partition").alias("partitions"))


def split_rate(keyed: DataFrame, group: list[str]) -> DataFrame:
    """One row: groups, those of several rows, those over several partitions, and the rate (null if none could split)."""
    f = fanout(keyed, group)
    return f.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("rows") > 1).alias("splittable"), F.count_if((F.col("rows") > 1) & (F.col("partitions") > 1)).alias("split")).withColumn("rate", F.round(F.try_divide(F.col("split").cast("double"), F.col("splittable").cast("double")), 4))
