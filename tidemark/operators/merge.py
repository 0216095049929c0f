"""Batch reduction and merge into a target with soft deletes.

A target row has its business columns, cdc_record_key, cdc_lsn, cdc_deleted and cdc_batch. A batch is
reduced to one row a slot, merged where its position is higher, and then its tombstones flag what their
record keys cover, whatever came in the batch (the arrival-independent rule).

Ties of log position: the row merged first stays, within a batch the later arrival. Replaying a batch
therefore changes nothing, its number included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ["cdc_record_key", "cdc_lsn", "cdc_deleted", "cdc_batch"]


def reduce_batch(events: DataFrame, slot: list[str], versioned: bool = False, per: list[str] | None = None, order: str = "arrival") -> DataFrame:
    """Of each slot (and position, if versioned) the row of the highest position, the later on a tie.

    per: columns such as batch within which to reduce.
    """
    keys = [*(per or []), *slot, *(["lsn"] if versioned else [])]
    w = Window.partitionBy(*keys).orderBy(F.desc("lsn"), F.desc(order))
    there = F.forall(F.array(*[F.col(c).isNotNull() for c in slot]), lambda x: x)
    return events.where("not tombstone").where(there).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reduce_tombstones(events: DataFrame, per: list[str] | None = None) -> DataFrame:
    """The highest position of a tombstone for each (topic, record key)."""
    return events.where("tombstone").groupBy(*(per or []), "topic", "record_key").agg(F.max("lsn").alias("t_lsn"))


def reduction_counters(events: DataFrame, slot: list[str], batch: str = "batch", order: str = "arrival") -> DataFrame:
    """Per batch: records, tombstones, staged rows, superseded changes and tombstoned keys."""
    missing = F.exists(F.array(*[F.col(c).isNull() for c in slot]), lambda x: x)
    of_all = events.groupBy(batch).agg(F.count(F.lit(1)).alias("records"), F.count_if("tombstone").alias("tombstones"), F.count_if(~F.col("tombstone") & missing).alias("no_merge_key"), F.count_distinct(F.when(F.col("tombstone"), F.struct("topic", "record_key"))).alias("tombstoned_keys"))
    staged = reduce_batch(events, slot, per=[batch], order=order).groupBy(batch).agg(F.count(F.lit(1)).alias("staged_rows"))
    out = of_all.join(staged, batch, "left").withColumn("staged_rows", F.coalesce("staged_rows", F.lit(0)))
    return out.withColumn("superseded", F.col("records") - F.col("tombstones") - F.col("no_merge_key") - F.col("staged_rows"))


def staged_twice(events: DataFrame, slot: list[str], batch: str = "batch") -> DataFrame:
    """Per batch the slots that an unreduced stage would hold more than once, and the rows too many. A merge
    of such a stage has no defined result, so merge() refuses it."""
    per = events.where("not tombstone").groupBy(batch, *slot).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.groupBy(batch).agg(F.count(F.lit(1)).alias("slots"), F.sum(F.col("n") - 1).alias("rows_too_many"))


def topic_counts(events: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: records, and those of topics that aren't among topics (topic), which no target takes."""
    known = F.broadcast(topics.select(F.col("topic").alias("_t")).distinct())  # a row a target
    met = events.select("topic").join(known, F.col("topic") == F.col("_t"), "left")
    return met.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("_t").isNull()).alias("unknown_topic"))


def to_target(staged: DataFrame, columns: list[str], batch) -> DataFrame:
    b = F.col(batch) if isinstance(batch, str) else F.lit(batch)
    return staged.select(*columns, F.col("record_key").alias("cdc_record_key"), F.col("lsn").cast("long").alias("cdc_lsn"), (F.col("op") == "d").alias("cdc_deleted"), b.cast("long").alias("cdc_batch"))


def one_per_slot(staged: DataFrame, slot: list[str]) -> DataFrame:
    """staged, or an error when it is read if a slot is there twice: an unreduced stage must not merge."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*slot))
    return staged.withColumn("_ok", F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a merge key is staged twice")))).where("_ok").drop("_ok")


def merge(target: DataFrame, staged: DataFrame, slot: list[str], guard: bool = True, reduced: bool = False) -> DataFrame:
    """target after the staged rows (both in the target's columns): a full outer join on the slot. Rows that
    reduce_batch() has made are known to be one a slot."""
    columns = target.columns
    staged = staged if reduced else one_per_slot(staged, slot)
    cond = [F.col(f"t.{c}") == F.col(f"s.{c}") for c in slot]
    met = target.withColumn("_there", F.lit(True)).alias("t").join(staged.withColumn("_new", F.lit(True)).alias("s"), cond, "full_outer")
    take = F.col("_new").isNotNull() & (F.col("_there").isNull() | (F.col("s.cdc_lsn") > F.col("t.cdc_lsn") if guard else F.lit(True)))
    return met.select(*[F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns])


def apply_tombstones(target: DataFrame, tombstones: DataFrame, batch: int) -> DataFrame:
    """Flags live rows whose record key has a tombstone at their position or above."""
    marks = tombstones.select(F.col("record_key").alias("_k"), "t_lsn")
    met = target.join(marks, F.col("cdc_record_key") == F.col("_k"), "left")
    hit = F.coalesce((F.col("t_lsn") >= F.col("cdc_lsn")) & ~F.col("cdc_deleted"), F.lit(False))
    met = met.withColumn("_hit", hit)
    return met.withColumns({"cdc_deleted": F.col("cdc_deleted") | F.col("_hit"), "cdc_batch": F.when(F.col("_hit"), F.lit(batch).cast("long")).otherwise(F.col("cdc_batch"))}).select(*target.columns)


def merged_state(events: DataFrame, slot: list[str], columns: list[str], batch: str = "batch", guard: bool = True, on_tombstone: str = "delete", order: str = "arrival") -> DataFrame:
    """The target after all batches, in closed form: no loop over batches.

    Guarded, a slot ends with its highest position, the earliest batch on a tie; it is flagged if it is a
    delete or a tombstone of that position or above came in its batch or later. Unguarded, with the last
    batch's reduced row, tombstones still gated by position.
    """
    reduced = reduce_batch(events, slot, per=[batch], order=order)
    by = [F.desc("lsn"), F.asc(batch)] if guard else [F.desc(batch)]
    w = Window.partitionBy(*slot).orderBy(*by)
    last = to_target(reduced.withColumn("_n", F.row_number().over(w)).where("_n = 1"), columns, batch)
    if on_tombstone == "ignore":
        return last
    first = with_first_mark(last, events, batch)
    hit = F.col("_first").isNotNull() & ~F.col("cdc_deleted")
    return first.withColumns({"cdc_deleted": F.col("cdc_deleted") | hit, "cdc_batch": F.when(hit, F.col("_first")).otherwise(F.col("cdc_batch")).cast("long")}).select(*last.columns)


def with_first_mark(rows: DataFrame, events: DataFrame, batch: str = "batch") -> DataFrame:
    """Adds _first to rows (in the target's columns): the first batch, from the row's own on, whose tombstone of the
    row's record key has its position or a higher one.

    A record key's tombstones are one a batch at most, and meet its rows as one array: whatever slots the key covers,
    no row is made for a pair of them.
    """
    marks = reduce_tombstones(events, per=[batch]).groupBy(F.col("record_key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col(batch).cast("long").alias("b"), F.col("t_lsn").alias("t")))).alias("_marks"))
    met = rows.join(marks, F.col("cdc_record_key") == F.col("_k"), "left")
    reach = F.filter("_marks", lambda m: (m["b"] >= F.col("cdc_batch")) & (m["t"] >= F.col("cdc_lsn")))
    return met.withColumn("_first", F.get(reach, F.lit(0))["b"]).drop("_k", "_marks")


def versioned_state(events: DataFrame, slot: list[str], columns: list[str], batch: str = "batch", order: str = "arrival") -> DataFrame:
    """The history table: a row for each slot and position, from the first batch that brought it."""
    reduced = reduce_batch(events, slot, versioned=True, per=[batch], order=order)
    w = Window.partitionBy(*slot, "lsn").orderBy(batch)
    return to_target(reduced.withColumn("_n", F.row_number().over(w)).where("_n = 1"), columns, batch)


def purged_state(events: DataFrame, slot: list[str], columns: list[str], batch: str = "batch", order: str = "arrival") -> DataFrame:
    """The target if flagged rows are deleted after every batch (the losing arm): their positions go with
    them, so a late change brings a row back. A record key may cover several slots.

    Each staged row is good until a batch: its own if it is a delete, else the first one from then on whose tombstone
    reaches it. A slot's rows, one a batch at most, are then taken in order of batch: a row is accepted if the one
    that is held is below it or was gone before, and what is held at the end stays if nothing ends it.
    """
    staged = with_first_mark(to_target(reduce_batch(events, slot, per=[batch], order=order), columns, batch), events, batch)
    forever = F.lit(2**63 - 1)
    until = F.when(F.col("cdc_deleted"), F.col("cdc_batch")).otherwise(F.coalesce("_first", forever))
    rest = [c for c in staged.columns if c not in slot and c != "_first"]
    row = F.struct(F.col("cdc_batch").alias("at"), F.col("cdc_lsn").alias("lsn"), until.alias("until"), F.struct(*rest).alias("row"))
    none = F.lit(None)

    def held(now: Column, new: Column) -> Column:
        return F.when(now.isNull() | (now["until"] < new["at"]) | (new["lsn"] > now["lsn"]), new).otherwise(now)

    rows = staged.groupBy(*slot).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = rows.schema["_rows"].dataType.elementType
    last = rows.withColumn("_last", F.aggregate("_rows", none.cast(kind), held)).where(F.col("_last.until") == forever)
    return last.select(*slot, *[F.col(f"_last.row.{c}").alias(c) for c in rest]).select(*[c for c in staged.columns if c != "_first"])


def purge(target: DataFrame) -> DataFrame:
    """Hard delete: flagged rows go, and their positions with them (the losing arm)."""
    return target.where("not cdc_deleted")


def counts(target: DataFrame) -> DataFrame:
    return target.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("cdc_deleted")).alias("live"), F.count_if("cdc_deleted").alias("soft_deleted"))


def fingerprint(target: DataFrame, include_batch: bool = True) -> DataFrame:
    """One row that depends on the rows and not on their order: their number and the sum of their hashes."""
    columns = [c for c in target.columns if include_batch or c != "cdc_batch"]
    return target.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash"))


def live_rows(target: DataFrame, columns: list[str]) -> DataFrame:
    return target.where("not cdc_deleted").select(*columns)
