"""The fold of an event stream into a keyed table, in closed form.

Highest log position per slot wins, whatever the arrival order, and the position outlives the row. A slot
is the merge key (or the record key where merge keys are switched off). Tombstones act through the record
key, which may cover several slots.

Modes: guard=False is the open fold, in which the last arrival wins and tombstones act unconditionally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stretches import running


#: Of a record key's tombstones and slots, along arrival: what a task sorts at once, and what is summed up of those.
STRETCHES = (24, 48)


def _checked(on_tombstone: str) -> None:
    if on_tombstone not in ("delete", "ignore"):
        raise ValueError("on_tombstone is delete or ignore")


def usable(events: DataFrame, slot: list[str]) -> DataFrame:
    """Changes whose slot columns are all there."""
    return events.where("not tombstone").where(F.forall(F.array(*[F.col(c).isNotNull() for c in slot]), lambda x: x))


def winners(events: DataFrame, slot: list[str], guard: bool = True, order: str = "arrival") -> DataFrame:
    """The change that each slot ends with, deletes too: Catalyst keeps one row a slot before the shuffle."""
    by = [F.desc("lsn"), F.desc(order)] if guard else [F.desc(order)]
    w = Window.partitionBy(*slot).orderBy(*by)
    return usable(events, slot).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fold(events: DataFrame, slot: list[str], guard: bool = True, on_tombstone: str = "delete", order: str = "arrival") -> DataFrame:
    """The live rows. Expects op, lsn, tombstone, topic, record_key, the slot columns and an arrival order (whole numbers).

    A row goes if a tombstone of its record key arrives later (at its position or above, if guarded): winners and
    tombstones are lined up from the last arrival back, and the highest position seen so far decides. Rows grow with
    winners plus tombstones, however many slots a record key covers, and a task sees at most 2 ** 24 arrivals of a key.
    """
    _checked(on_tombstone)
    last = winners(events, slot, guard, order)
    if on_tombstone == "delete":
        marks = events.where("tombstone").select("topic", "record_key", "lsn", order)
        if guard:
            both = last.withColumn("_mark", F.lit(None).cast("long")).unionByName(marks.withColumn("_mark", F.col("lsn").cast("long")), allowMissingColumns=True)
            seen = running(both.withColumn("_back", -F.col(order)), ["topic", "record_key"], "_back", {"_top": ("max", F.col("_mark"))}, shifts=STRETCHES)
            last = seen.where(F.col("_mark").isNull() & ~F.coalesce(F.col("_top") >= F.col("lsn"), F.lit(False))).drop("_mark", "_back", "_top")
        else:
            ends = marks.groupBy(F.col("topic").alias("_t"), F.col("record_key").alias("_k")).agg(F.max(order).alias("_at"))
            last = last.join(ends, (F.col("topic") == F.col("_t")) & (F.col("record_key") == F.col("_k")) & (F.col("_at") > F.col(order)), "left_anti")
    return last.where("op <> 'd'")


#: Levels of an order's bits: one for each, and the one above all of them, at which everything is in one node.
ALL = 64


def _reached(asked: DataFrame, marks: DataFrame, keys: list[str], guard: bool) -> DataFrame:
    """asked (topic, record_key, since, until, lsn, keys), once each, with hit: whether a mark (topic, record_key, at,
    lsn) comes after since and before until (null: ever), at its position or above if guarded.

    The highest bit in which since and until differ is a level, at which they lie in two neighbouring nodes. What lies
    between them comes after the one in its node, or before the other in its own, so two running maxima tell. A mark goes
    to the nodes of the levels that its record key is asked at, at most 65 and about the logarithm of how many ask."""
    level = F.when(F.col("until").isNull(), ALL).otherwise(F.length(F.bin(F.col("since").bitwiseXOR(F.col("until")))) - 1).cast("int")
    one = lambda at, right: F.struct(F.col(at).alias("at"), F.lit(right).alias("right"))
    ends = F.when(F.col("until").isNull(), F.array(one("since", False))).otherwise(F.array(one("since", False), one("until", True)))
    sides = asked.withColumn("level", level).withColumn("_e", F.explode(ends)).select("topic", "record_key", "level", "_e.*", *keys, F.col("lsn").alias("_least"), F.lit(None).cast("long").alias("_mark"))
    levels = sides.groupBy(F.col("topic").alias("_t"), F.col("record_key").alias("_k")).agg(F.collect_set("level").alias("_levels"))
    near = marks.join(levels, (F.col("topic") == F.col("_t")) & (F.col("record_key") == F.col("_k"))).withColumn("level", F.explode("_levels"))
    right = F.when(F.col("level") == ALL, False).when(F.col("level") == ALL - 1, F.col("at") >= 0).otherwise(F.expr("shiftright(at, level) & 1 = 1"))
    both = sides.unionByName(near.select("topic", "record_key", "level", "at", right.alias("right"), F.col("lsn").cast("long").alias("_mark")), allowMissingColumns=True)
    both = both.withColumn("_node", F.when(F.col("level") == ALL, F.lit(0).cast("long")).otherwise(F.expr("shiftright(at, level)"))).withColumn("_along", F.when(F.col("right"), F.col("at")).otherwise(-F.col("at")))
    seen = running(both, ["topic", "record_key", "level", "_node"], "_along", {"_top": ("max", F.col("_mark"))}, ["_mark"], STRETCHES)
    hit = F.coalesce(F.col("_top") >= F.col("_least"), F.lit(False)) if guard else F.col("_top").isNotNull()
    return seen.where("_least is not null").groupBy(*keys).agg(F.bool_or(hit).alias("hit"))


def counters(events: DataFrame, slot: list[str], guard: bool = True, on_tombstone: str = "delete", order: str = "arrival") -> DataFrame:
    """One row of what the fold did.

    A row is removed by the first tombstone of one of its slot's record keys that comes before the slot's next accepted
    change (at its position or above, if guarded). Rows grow with changes, and with tombstones times the levels of
    their order that changes ask at; slots and tombstones of a record key never meet in pairs."""
    _checked(on_tombstone)
    rows = usable(events, slot).select(*slot, "topic", "record_key", F.col("lsn").cast("long").alias("lsn"), F.col(order).cast("long").alias("at"), F.col("op").alias("act"))
    w = Window.partitionBy(*slot).orderBy("at")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    line = rows.withColumn("hw", F.max("lsn").over(past)).withColumn("_held", F.col("hw") if guard else F.last("lsn", ignorenulls=True).over(past))
    line = line.withColumn("accepted", (F.col("hw").isNull() | (F.col("lsn") >= F.col("hw"))) if guard else F.lit(True))
    prior = F.last(F.when(F.col("accepted"), F.col("act")), ignorenulls=True).over(past)
    gone = F.coalesce("_prior", F.lit("d")) == "d"
    done = line.withColumn("_prior", prior).agg(
        F.count_if(~F.col("accepted")).alias("stale_dropped"),
        F.count_if(F.col("lsn") == F.col("_held")).alias("same_position"),
        F.count_if(F.col("accepted") & (F.col("act") == "d")).alias("deletes"),
        F.count_if(F.col("accepted") & (F.col("act") == "d") & gone).alias("_d"),
        F.count_if(F.col("accepted") & (F.col("act") == "u") & gone).alias("_u"),
        F.count_if(F.col("accepted") & (F.col("act") != "d")).alias("upserts"),
    )
    if on_tombstone == "delete":
        marks = events.where("tombstone").select("topic", "record_key", F.col(order).cast("long").alias("at"), "lsn")
        of_slot = F.collect_set(F.struct("topic", "record_key")).over(Window.partitionBy(*slot))
        held = line.withColumn("_keys", of_slot).where("accepted").withColumns({"until": F.lead("at").over(w), "_next": F.lead("act").over(w)}).where("act <> 'd'")
        asked = held.select(*slot, F.col("at").alias("since"), "until", "lsn", "_next", F.explode("_keys").alias("_k")).select("_k.*", *slot, "since", "until", "lsn", "_next")
        hits = _reached(asked.withColumn("_since", F.col("since")), marks, [*slot, "_since", "_next"], guard).where("hit")
        removed = hits.agg(F.count(F.lit(1)).alias("rows_removed_by_tombstones"), F.count_if(F.col("_next") == "d").alias("_more_d"), F.count_if(F.col("_next") == "u").alias("_more_u"))
    else:
        removed = events.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(c) for c in ("rows_removed_by_tombstones", "_more_d", "_more_u")))
    missing = F.exists(F.array(*[F.col(c).isNull() for c in slot]), lambda x: x)
    of_all = events.agg(F.count(F.lit(1)).alias("records"), F.count_if("tombstone").alias("tombstones"), F.count_if(~F.col("tombstone") & missing).alias("changes_with_no_merge_key"))
    return of_all.crossJoin(done).crossJoin(removed).select(  # of one row each
        "records", "tombstones", "changes_with_no_merge_key", "stale_dropped", "same_position", "deletes",
        (F.col("_d") + F.col("_more_d")).alias("deletes_of_a_row_not_held"), (F.col("_u") + F.col("_more_u")).alias("updates_of_a_row_not_held"),
        "upserts", "rows_removed_by_tombstones",
    )


def compare_sets(applied: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: sizes of both sets of rows, how many match, are missing or extra, and whether all match."""
    a, t = applied.distinct(), truth.distinct()
    both = a.withColumn("_a", F.lit(1)).alias("a")
    cond = None
    for c in applied.columns:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}"))
        cond = same if cond is None else cond & same
    met = both.join(t.withColumn("_t", F.lit(1)).alias("t"), cond, "full_outer")
    out = met.agg(F.count("_t").alias("source_rows"), F.count("_a").alias("applied_rows"), F.count_if(F.col("_a").isNotNull() & F.col("_t").isNotNull()).alias("matching"))
    out = out.withColumn("missing", F.col("source_rows") - F.col("matching")).withColumn("extra", F.col("applied_rows") - F.col("matching"))
    return out.withColumn("exact", (F.col("missing") == 0) & (F.col("extra") == 0))


def as_row_set(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of text."""
    return rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).distinct()


def key_of(columns: list[str]) -> Column:
    return F.struct(*columns)
