"""Summaries of decoded changes and comparisons of probe arms, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """b / a to four places; null where a is zero."""
    return F.round(F.try_divide(b.cast("double"), a.cast("double")), 4)


def summarise(changes: DataFrame) -> DataFrame:
    """One row over changes (action, before, after): counts, before images over updates and deletes (an
    empty one counts as absent), and mean numbers of columns to four places, 0 where there are none."""
    moved = F.col("action").isin("UPDATE", "DELETE")
    has = F.col("before").isNotNull() & (F.size("before") > 0)

    def mean(name: str) -> Column:
        c = F.col(name)
        return F.coalesce(F.round(F.avg(F.when(c.isNotNull() & (F.size(c) > 0), F.size(c))), 4), F.lit(0.0))

    return changes.agg(
        F.count(F.lit(1)).alias("changes"),
        *[F.count_if(F.col("action") == a).alias(a.lower() + "s") for a in ("INSERT", "UPDATE", "DELETE")],
        F.count_if(moved & has).alias("before_present"),
        F.count_if(moved & ~has).alias("before_absent"),
        F.count_if((F.col("action") == "UPDATE") & has).alias("updates_with_before"),
        mean("before").alias("mean_before_fields"),
        mean("after").alias("mean_after_fields"),
    )


def by_table(changes: DataFrame) -> DataFrame:
    return changes.groupBy("table", "action").agg(F.count(F.lit(1)).alias("changes"))


def before_coverage(summary: DataFrame) -> DataFrame:
    """Share of updates and deletes that bring a before image; null if there are none."""
    all_of = F.col("before_present") + F.col("before_absent")
    return summary.select(F.round(F.try_divide(F.col("before_present").cast("double"), all_of.cast("double")), 4).alias("before_coverage"))


def spread(values: DataFrame, column: str, *by: str) -> DataFrame:
    """n, least, most, range, and the range over the least (null if that is zero)."""
    low, high = F.min(column), F.max(column)
    return values.groupBy(*by).agg(F.count(column).alias("n"), low.alias("least"), high.alias("most"), (high - low).alias("range"), F.round(F.try_divide((high - low).cast("double"), low.cast("double")), 6).alias("relative"))


def spread_unrounded(values: DataFrame, column: str, *by: str) -> DataFrame:
    """As spread(), the share of the least as it is."""
    low, high = F.min(column), F.max(column)
    return values.groupBy(*by).agg(F.count(column).alias("n"), low.alias("least"), high.alias("most"), (high - low).alias("range"), F.try_divide((high - low).cast("double"), low.cast("double")).alias("relative"))


def compare_arms(arms: DataFrame, column: str, baseline: str = "default") -> DataFrame:
    """Each arm (arm, column) over the baseline arm, which must be there; the baseline is one row."""
    base = arms.where(F.col("arm") == baseline).agg(F.max(column).alias("base"), F.count(F.lit(1)).alias("found"))
    base = base.select(F.when(F.col("found") == 1, F.col("base")).otherwise(F.raise_error(F.lit(f"arm {baseline} is not there once"))).alias("base"))
    return arms.crossJoin(F.broadcast(base)).select("arm", column, ratio(F.col("base"), F.col(column)).alias("ratio"))


def frame_split(kinds: DataFrame) -> DataFrame:
    """Framing against row changes over (kind, n). share leaves unknown and empty frames out of its
    denominator, share_of_all does not; both are null over no frames."""
    n = F.col("n")
    framing = F.sum(F.when(F.col("kind").isin("begin", "commit", "relation", "origin", "type"), n).otherwise(0))
    rows = F.sum(F.when(F.col("kind").isin("insert", "update", "delete", "truncate"), n).otherwise(0))
    return kinds.agg(framing.alias("framing"), rows.alias("rows"), F.sum("n").alias("frames")).select(
        F.coalesce("framing", F.lit(0)).cast("long").alias("framing"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.round(F.try_divide(F.col("rows").cast("double"), (F.col("framing") + F.col("rows")).cast("double")), 4).alias("share"),
        F.round(F.try_divide(F.col("rows").cast("double"), F.col("frames").cast("double")), 4).alias("share_of_all"),
    )


def split_cost(frames: DataFrame) -> DataFrame:
    """frames (connector, kind, n), connector "single" or the name of one of several: what splitting costs."""
    framing, single = F.col("kind").isin("begin", "commit", "relation", "origin", "type"), F.col("connector") == "single"
    row = F.col("kind").isin("insert", "update", "delete", "truncate")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).cast("long")

    sums = frames.agg(total(single & framing).alias("single_framing"), total(~single & framing).alias("split_framing"), total(single & row).alias("single_rows"), total(~single & row).alias("split_rows"))
    return sums.select(
        "*",
        ratio(F.col("single_framing"), F.col("split_framing")).alias("framing_multiple"),
        ratio(F.col("single_framing") + F.col("single_rows"), F.col("split_framing") + F.col("split_rows")).alias("message_multiple"),
        (F.col("single_rows") == F.col("split_rows")).alias("rows_agree"),
    )


def figure_verdict(published: Column, observed: Column, kind: Column) -> Column:
    """EXACT, WITHIN_BAND (a volume within a thousandth, inclusive), MOVED (a timing) or BROKEN."""
    near = F.abs(observed - published) * 1000 <= F.abs(published)
    return F.when(kind == "timing", F.when(published == observed, "EXACT").otherwise("MOVED")).when(published == observed, "EXACT").when((kind == "volume") & near, "WITHIN_BAND").otherwise("BROKEN")
