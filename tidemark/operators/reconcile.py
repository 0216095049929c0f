"""Key-by-key reconciliation of a source with a target, and what its verdict covers.

Keys in flight are left out on both sides. The verdict says clean only if every key was checked: it
compares counts, never a rounded share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = ["drift", "no_coverage", "clean_partial", "clean"]


def index_by_key(rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Per key its rows, duplicates kept, in order."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def keys_in_flight(events: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct keys of the changes, and one row of counts: tombstones and changes without a key."""
    missing = F.exists(F.array(*[F.col(c).isNull() for c in key]), lambda x: x)
    keys = events.where("not tombstone").where(~missing).select(*key).distinct()
    return keys, events.agg(F.count_if("tombstone").alias("tombstones"), F.count_if(~F.col("tombstone") & missing).alias("changes_with_no_key"))


def matched(source: DataFrame, target: DataFrame, columns: list[str], key: list[str], in_flight: DataFrame | None = None) -> DataFrame:
    """A row a key: left and right, their rows in order (null if absent), and whether it is in flight."""
    left = index_by_key(source, columns, key).withColumnRenamed("rows", "left")
    right = index_by_key(target, columns, key).withColumnRenamed("rows", "right")
    cond = None
    for c in key:
        same = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        cond = same if cond is None else cond & same
    met = left.alias("l").join(right.alias("r"), cond, "full_outer").select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in key], "left", "right")
    if in_flight is None:
        return met.withColumn("held_back", F.lit(False))
    flight = in_flight.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct().withColumn("_in", F.lit(True))
    cond = None
    for c in key:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = same if cond is None else cond & same
    return met.join(flight, cond, "left").withColumn("held_back", F.col("_in").isNotNull()).select(*key, "left", "right", "held_back")


def verdict(bad: Column, checked: Column, keys: Column) -> Column:
    return F.when(bad > 0, "drift").when(checked == 0, "no_coverage").when(checked < keys, "clean_partial").otherwise("clean")


def reconcile(source: DataFrame, target: DataFrame, columns: list[str], key: list[str], in_flight: DataFrame | None = None) -> DataFrame:
    """One row: per key exactly one of matching, missing, extra and differing; duplicates by side; coverage."""
    met = matched(source, target, columns, key, in_flight)
    on, l, r = ~F.col("held_back"), F.col("left").isNotNull(), F.col("right").isNotNull()  # noqa: E741
    out = met.agg(
        F.count(F.lit(1)).alias("keys_either_side"),
        F.count_if(on).alias("keys_checked"),
        F.count_if(on & l & r & (F.col("left") == F.col("right"))).alias("matching"),
        F.count_if(on & l & ~r).alias("missing_in_target"),
        F.count_if(on & ~l & r).alias("extra_in_target"),
        F.count_if(on & l & r & (F.col("left") != F.col("right"))).alias("differing"),
        F.count_if(on & l & (F.size("left") > 1)).alias("duplicate_in_source"),
        F.count_if(on & r & (F.size("right") > 1)).alias("duplicate_in_target"),
    )
    bad = F.col("missing_in_target") + F.col("extra_in_target") + F.col("differing") + F.col("duplicate_in_target")
    return out.withColumn("coverage", F.round(F.try_divide(F.col("keys_checked").cast("double"), F.col("keys_either_side").cast("double")), 4)).withColumn("verdict", verdict(bad, F.col("keys_checked"), F.col("keys_either_side")))


def columns_differing(source: DataFrame, target: DataFrame, columns: list[str], key: list[str], in_flight: DataFrame | None = None) -> DataFrame:
    """Per column in how many differing keys the first rows of both sides differ in it."""
    met = matched(source, target, columns, key, in_flight).where("not held_back and left is not null and right is not null")
    rest = [c for c in columns if c not in key]
    pairs = F.array(*[F.when(~F.col("left")[0][c].eqNullSafe(F.col("right")[0][c]), F.lit(c)) for c in rest])
    return met.select(F.explode(F.array_compact(pairs)).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("keys"))


def run(tables: dict[str, tuple[DataFrame, DataFrame, list[str], list[str]]], in_flight: dict[str, DataFrame] | None = None) -> DataFrame:
    """A report for each table (its name in table) of name: (source, target, columns, key); keys in flight by name."""
    if not tables:
        raise ValueError("there is no table to reconcile")
    reports = [reconcile(s, t, columns, key, (in_flight or {}).get(name)).select(F.lit(name).alias("table"), "*") for name, (s, t, columns, key) in sorted(tables.items())]
    return reduce(DataFrame.unionByName, reports)


def rollup(reports: DataFrame) -> DataFrame:
    """The worst verdict of all; none at all is no coverage."""
    rank = F.array_position(F.array(*[F.lit(v) for v in RANK]), F.col("verdict"))
    known = F.when(rank > 0, rank).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.col("verdict"))))
    worst = F.min(known).cast("int")
    # an element of an array of literals counts as never null, so that a coalesce around it would be dropped
    return reports.agg(F.when(worst.isNull(), "no_coverage").otherwise(F.element_at(F.array(*[F.lit(v) for v in RANK]), worst)).alias("verdict"))


def one_line(reports: DataFrame) -> DataFrame:
    """Sums over all tables, and the coverage of the sums."""
    names = ["keys_either_side", "keys_checked", "missing_in_target", "extra_in_target", "differing", "duplicate_in_target"]
    out = reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    out = out.withColumn("coverage", F.round(F.try_divide(F.col("keys_checked").cast("double"), F.col("keys_either_side").cast("double")), 4))
    return out.withColumn("mismatched", F.col("missing_in_target") + F.col("extra_in_target") + F.col("differing") + F.col("duplicate_in_target"))


def coverage_between(reports: DataFrame) -> DataFrame:
    """Whether the overall coverage lies between the tables'; null without any."""
    line = one_line(reports).select("coverage")
    return reports.agg(F.min("coverage").alias("low"), F.max("coverage").alias("high")).crossJoin(line).select(((F.col("coverage") >= F.col("low")) & (F.col("coverage") <= F.col("high"))).alias("between"))


def set_difference(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """Set subtraction both ways, which counts a row that differs twice."""
    s, t = source.select(*columns), target.select(*columns)
    only = s.subtract(t).agg(F.count(F.lit(1)).alias("only_in_source")).crossJoin(t.subtract(s).agg(F.count(F.lit(1)).alias("only_in_target")))
    return only.withColumn("reported", F.col("only_in_source") + F.col("only_in_target"))


def corrupt(target: DataFrame, condition: Column, column: str, value) -> DataFrame:
    """target with one column set to a constant where the condition holds."""
    return target.withColumn(column, F.when(condition, F.lit(value).cast(target.schema[column].dataType)).otherwise(F.col(column)))
