"""Tables of a database as DataFrames: read over JDBC in ranges of the key, and their catalog."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import checked_name
from tidemark.sources.logs import table_as_text
from tidemark.sources.store import Target


def jdbc_options(dsn: str, fetch: int = 10_000) -> dict[str, str]:
    """Options of Spark's JDBC source for a Postgres address: postgresql://user:password@host:port/name?x=y,
    or words such as "host=h port=5432 dbname=d user=u"."""
    if "://" in dsn:
        at = urlsplit(dsn)
        if at.scheme not in ("postgres", "postgresql") or not at.path.strip("/"):
            raise ValueError("an address is postgresql://host/name")
        parts = {"host": at.hostname, "port": at.port, "dbname": at.path.strip("/"), "user": at.username and unquote(at.username), "password": at.password and unquote(at.password), **dict(parse_qsl(at.query))}
    else:
        parts = dict(word.split("=", 1) for word in dsn.split())
    if not parts.get("dbname"):
        raise ValueError("the address names no database")
    more = {k: v for k, v in parts.items() if k not in ("host", "port", "dbname", "user", "password") and v}
    url = f"jdbc:postgresql://{parts.get('host') or 'localhost'}:{parts.get('port') or 5432}/{parts['dbname']}"
    url += "?" * bool(more) + "&".join(f"{k}={v}" for k, v in sorted(more.items()))
    named = {k: str(parts[k]) for k in ("user", "password") if parts.get(k)}
    return {"url": url, "driver": "org.postgresql.Driver", "fetchsize": str(fetch), **named}


def ranges(column: str, low: int, high: int, partitions: int) -> dict[str, str]:
    """Options that read a table in ranges of a numeric column, a task each; rows outside low and high are
    read too, by the first and the last of them."""
    if partitions < 1 or high < low:
        raise ValueError("one partition at least, from low to high")
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(partitions)}


def read_table(spark: SparkSession, options: dict[str, str], table: str, more: dict[str, str] | None = None) -> DataFrame:
    """A table as it stands. Filters and columns that are asked for later go to the database."""
    return spark.read.format("jdbc").options(**options, **(more or {}), dbtable=table).load()


def read_target(rows: DataFrame, target: Target) -> DataFrame:
    """The business columns of a target's source table, as the distinct rows of their text."""
    for c in target.columns:
        checked_name(c)
    return table_as_text(rows, list(target.columns))


def publication_tables(published: DataFrame, publication: str) -> DataFrame:
    """Of (pubname, schemaname, tablename) the tables of a publication, in order of name."""
    return published.where(F.col("pubname") == publication).select("schemaname", "tablename").orderBy("schemaname", "tablename")


def primary_keys(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per table its key columns in the order of the key: indexes (table, is_primary, columns: array of
    numbers), attributes (table, number, name)."""
    keys = indexes.where("is_primary").select(F.col("table").alias("_t"), F.posexplode("columns").alias("at", "_n"))
    met = keys.join(attributes, (F.col("_t") == F.col("table")) & (F.col("_n") == F.col("number")))
    return met.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("named")).select("table", F.col("named.name").alias("key"))


def current_position(log: DataFrame) -> DataFrame:
    """One row: the highest log position, null for an empty log."""
    return log.agg(F.max("lsn").alias("lsn"))


def slot_positions(slots: DataFrame, current: Column, slot: str | None = None) -> DataFrame:
    """slots (slot, restart_lsn, confirmed_lsn) plus what each holds back: retained bytes since its restart
    position and bytes that its consumer has not confirmed. A slot that is asked for by name must be there."""
    own = slots if slot is None else slots.where(F.col("slot") == slot)
    out = own.withColumn("retained_bytes", current - F.col("restart_lsn")).withColumn("unconfirmed_bytes", current - F.col("confirmed_lsn"))
    if slot is not None and out.isEmpty():
        raise KeyError(slot)
    return out


def slot_retention(slots: DataFrame, current: Column) -> DataFrame:
    """Per slot the bytes it retains, the one that holds most back first."""
    return slot_positions(slots, current).select("slot", "retained_bytes").orderBy(F.desc("retained_bytes"), "slot")
