"""Running sums, maxima and last values along an order, without a task that sees all of it.

The order is a column of whole numbers. Its values are cut into stretches that agree in all but the lowest
bits, those into stretches of stretches and so on, by SHIFTS. A task goes along the rows of one stretch;
what all earlier stretches came to is found the same way among their totals, one level up. Whatever the values,
a stretch holds at most 2 ** 16 different ones, and the top level 2 ** 16 rows. No job runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFTS = (16, 32, 48)

#: Of each kind: over a window, of a group (value, order), and of an earlier part and a later one.
KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (lambda v, w: F.sum(v).over(w), lambda v, o: F.sum(v), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (lambda v, w: F.max(v).over(w), lambda v, o: F.max(v), lambda a, b: F.greatest(a, b)),
    "last": (lambda v, w: F.last(v, ignorenulls=True).over(w), lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), lambda a, b: F.coalesce(b, a)),
}
Spec = dict[str, tuple[str, Column]]


def same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def _joined(rows: DataFrame, totals: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """rows with the columns _up_<name> of what comes before, from totals (by, name)."""
    renamed = totals.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[F.col(n).alias(f"_up_{n}") for n in names])
    return rows.join(renamed, same(by, [f"_r_{c}" for c in by])).drop(*[f"_r_{c}" for c in by])


def _before(totals: DataFrame, by: list[str], key: str, kinds: dict[str, str], steps: list[int], level: int) -> DataFrame:
    """totals (by, key, a column a name) with each column turned into that of all earlier keys of by."""
    names = list(kinds)
    if not steps:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*by, key, *[KINDS[k][0](F.col(n), w).alias(n) for n, k in kinds.items()])
    up = f"_s{level}"
    cut = totals.withColumn(up, F.shiftright(F.col(key), steps[0]))
    over = _before(cut.groupBy(*by, up).agg(*[KINDS[k][1](F.col(n), F.col(key)).alias(n) for n, k in kinds.items()]), by, up, kinds, steps[1:], level + 1)
    w = Window.partitionBy(*by, up).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    near = cut.select(*by, up, key, *[KINDS[k][0](F.col(n), w).alias(n) for n, k in kinds.items()])
    met = _joined(near, over, [*by, up], names)
    return met.select(*by, key, *[KINDS[k][2](F.col(f"_up_{n}"), F.col(n)).alias(n) for n, k in kinds.items()])


def running(rows: DataFrame, by: list[str], order: str, what: Spec, then: list[str] | None = None, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """Adds, by name, the sum, max or last value (not null) of a column over the rows alike in by that come before
    in the order, and in that of the columns then where it is equal. Sums are 0 and others null where nothing does.

    what: name -> (sum, max or last, column). A last value asks for an order without ties."""
    kinds = {f"_v{i}": kind for i, (kind, _) in enumerate(what.values())}
    cut = rows.withColumns({f"_v{i}": c for i, (_, c) in enumerate(what.values())} | {"_o": F.col(order).cast("long")}).withColumn("_s0", F.shiftright("_o", shifts[0]))
    totals = cut.groupBy(*by, "_s0").agg(*[KINDS[k][1](F.col(n), F.col("_o")).alias(n) for n, k in kinds.items()])
    over = _before(totals, by, "_s0", kinds, [b - a for a, b in zip(shifts, shifts[1:], strict=False)], 1)
    w = Window.partitionBy(*by, "_s0").orderBy("_o", *(then or [])).rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumns({f"_n{n}": KINDS[k][0](F.col(n), w) for n, k in kinds.items()})
    met = _joined(near, over, [*by, "_s0"], list(kinds))
    return met.select(*rows.columns, *[KINDS[k][2](F.col(f"_up_{n}"), F.col(f"_n{n}")).alias(name) for (n, k), name in zip(kinds.items(), what, strict=True)])


def numbered(rows: DataFrame, by: list[str], order: str, name: str, then: list[str] | None = None, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """Adds name, from 0: each row's place among those alike in by, in the order of a column of whole numbers,
    and of the columns then where it is equal."""
    return running(rows, by, order, {name: ("sum", F.lit(1).cast("long"))}, then, shifts)
