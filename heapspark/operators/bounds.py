"""Sizes that are known exactly, at least, at most or about: a value with a mark, through differences, totals and texts.

A bounded size is struct<value: bigint, mark: string>.  The least retained size of several objects is a lower bound
of what they retain together; a difference of two lower bounds is neither bound.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How marks are written.
EXACT, AT_LEAST, AT_MOST, ABOUT = "=", ">=", "<=", "~"


def bounded(value: Column, mark: str | Column = EXACT) -> Column:
    """Null where value is."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.when(value.isNotNull(), F.struct(value.cast("long").alias("value"), mark.alias("mark")))


def _opposite(mark: Column) -> Column:
    return F.when(mark == AT_LEAST, AT_MOST).when(mark == AT_MOST, AT_LEAST).otherwise(mark)


def _together(a: Column, b: Column) -> Column:
    """The mark of a sum of two."""
    return F.when(a == EXACT, b).when((b == EXACT) | (a == b), a).otherwise(ABOUT)


def plus(a: Column, b: Column) -> Column:
    return bounded(a["value"] + b["value"], _together(a["mark"], b["mark"]))


def minus(now: Column, before: Column) -> Column:
    """now - before; null where now is missing, now itself where before is missing."""
    return F.when(before.isNull(), now).otherwise(bounded(now["value"] - before["value"], _together(now["mark"], _opposite(before["mark"]))))


def total(size: Column) -> Column:
    """Sum over rows, nulls left out; exact only where all are, a bound where no row speaks for another one."""
    marks = [F.coalesce(F.bool_or(size["mark"] == m), F.lit(False)) for m in (AT_LEAST, AT_MOST, ABOUT)]
    low, high, about = marks
    mark = F.when(about | (low & high), ABOUT).when(low, AT_LEAST).when(high, AT_MOST).otherwise(EXACT)
    return F.struct(F.coalesce(F.sum(size["value"]), F.lit(0)).cast("long").alias("value"), mark.alias("mark"))


def order(size: Column) -> Column:
    """What rows are sorted and filtered by."""
    return size["value"]


def surely(size: Column, op: str, limit: int) -> Column:
    """Whether the size is certainly > (>=, <, <=) limit, by its bound; unknown counts as no."""
    v, mark = size["value"], size["mark"]
    up = {">": v > limit, ">=": v >= limit}
    down = {"<": v < limit, "<=": v <= limit}
    known = mark.isin(EXACT, AT_LEAST) & up[op] if op in up else mark.isin(EXACT, AT_MOST) & down[op]
    return F.coalesce(known, F.lit(False))


def text(size: Column) -> Column:
    """12, >= 12, <= 12 or ~ 12; null where size is."""
    return F.when(size["mark"] == EXACT, size["value"].cast("string")).otherwise(F.concat(size["mark"], F.lit(" "), size["value"].cast("string")))
