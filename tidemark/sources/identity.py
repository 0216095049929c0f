"""What a table's replica identity puts into the log, and what the source refuses under it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import decode, stats

MODES = ("default", "full", "nothing")


def checked_mode(mode: str) -> str:
    if mode.lower() not in MODES:
        raise ValueError(f"a replica identity is one of {', '.join(MODES)}")
    return mode.lower()


def _fields(rows: DataFrame, columns: list[str], prefix: str = "") -> Column:
    """name[type]:value of each column, text quoted, nulls as null."""
    kinds = dict(rows.dtypes)

    def field(c: str) -> Column:
        value = F.col(prefix + c)
        text = value.cast("string") if kinds[c] != "string" else F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.concat(F.lit(f"{c}[{ {'string': 'text', 'int': 'integer', 'smallint': 'smallint'}.get(kinds[c], kinds[c]) }]:"), F.coalesce(text, F.lit("null")))

    return F.concat_ws(" ", *[field(c) for c in columns])


def log_lines(changes: DataFrame, table: str, key: list[str], columns: list[str], mode: str = "default") -> DataFrame:
    """changes (op, the columns, and each one's value before as old_<column>) with data, their line in the log.

    default logs the key of what is deleted, full the whole row before, nothing no row before at all."""
    mode = checked_mode(mode)
    new, old, keys = _fields(changes, columns), _fields(changes, columns, "old_"), _fields(changes, key, "old_")
    update = F.concat(F.lit("UPDATE: old-key: "), old, F.lit(" new-tuple: "), new) if mode == "full" else F.concat(F.lit("UPDATE: "), new)
    delete = F.concat(F.lit("DELETE: "), {"full": old, "default": keys, "nothing": F.lit("(no-tuple-data)")}[mode])
    data = F.when(F.col("op") == "c", F.concat(F.lit("INSERT: "), new)).when(F.col("op") == "u", update).otherwise(delete)
    return changes.withColumn("data", F.concat(F.lit(f"table {table}: "), data))


def refused(changes: DataFrame, mode: str, published: bool = True) -> DataFrame:
    """The changes that the source doesn't accept: without an identity, updates and deletes of a published table."""
    return changes.where(F.col("op").isin("u", "d") if checked_mode(mode) == "nothing" and published else F.lit(False))


def arms(changes: DataFrame, table: str, key: list[str], columns: list[str], published: bool = True) -> DataFrame:
    """A row for each identity: measured, with bytes of the log (and their ratio to the default's) and images before,
    or refused, with the first position that was and nothing measured: a hard stop is no small number."""

    def arm(mode: str) -> DataFrame:
        no = refused(changes, mode, published).agg(F.min("lsn").alias("first_refused"))
        lines = log_lines(changes, table, key, columns, mode)
        summary = stats.summarise(decode.changes(lines.select("seq", "lsn", "data"))).crossJoin(lines.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("log_bytes")))
        ok = F.col("first_refused").isNull()
        shown = ["log_bytes", "changes", "before_present", "before_absent", "updates_with_before"]
        out = no.crossJoin(summary.select(*shown))
        return out.select(F.lit(mode).alias("arm"), F.when(ok, "measured").otherwise("refused").alias("outcome"), "first_refused", *[F.when(ok, F.col(c)).alias(c) for c in shown])

    rows = reduce(DataFrame.unionByName, [arm(m) for m in MODES])
    base = rows.where("arm = 'default'").select(F.col("log_bytes").alias("_base"))
    return rows.crossJoin(base).withColumn("ratio", F.round(F.try_divide(F.col("log_bytes").cast("double"), F.col("_base").cast("double")), 4)).drop("_base")
