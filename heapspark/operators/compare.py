"""Comparison of result tables: k tables aligned on a key, differences, sets behind rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bounds

# Parts of keys that differ between runs: addresses, array indexes, array sizes.
MASKS = (r"\s*@ 0x[0-9a-f]+", r"^(\[[0-9]+\], ){0,100}\[[0-9]+\](,\.\.\.)?$", r"(?<=\p{javaJavaIdentifierPart}\[)\d+(?=\])")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def mask_key(key: Column, pattern: str, replace: str = "", prefix: str = "", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(key, pattern, replace), F.lit(suffix))


def align(tables: Sequence[DataFrame], key: str, values: Sequence[str]) -> DataFrame:
    """One row for each key and repeat of it, with columns value_i of table i (null where absent).

    Repeated keys pair up in the order of their values: the first with the first.  Tables are
    stacked and grouped, so k tables need one shuffle by key and not k joins.
    """
    stacked = []
    for i, t in enumerate(tables):
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*values))
        own = t.select(key, *values).withColumn("nth", nth)
        stacked.append(own.select(key, "nth", F.lit(i).alias("table"), *values))
    both = reduce(DataFrame.unionByName, stacked)
    cells = [F.max(F.when(F.col("table") == i, F.col(v))).alias(f"{v}_{i}") for i in range(len(tables)) for v in values]
    seen = [F.max((F.col("table") == i).cast("int")).alias(f"in_{i}") for i in range(len(tables))]
    return both.groupBy(key, "nth").agg(*cells, *seen)


def difference(now: Column, before: Column) -> Column:
    """now - before; null where now is missing, now itself where before is missing."""
    return F.when(now.isNull(), F.lit(None)).when(before.isNull(), now).otherwise(now - before)


def ratio(now: Column, before: Column, integer: bool = True) -> Column:
    """The difference as a share of before: null if either is missing; whole 0/0 is 0; else as doubles divide."""
    d, b = (now - before).cast("double"), before.cast("double")
    zero = F.when(d == 0, F.lit(0.0) if integer else F.lit(float("nan"))).when(d > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(now.isNull() | before.isNull(), F.lit(None)).when(b == 0, zero).otherwise(d / F.when(b != 0, b))


def changed(now: Column, before: Column) -> Column:
    """What is not a number: the value where it changed."""
    return F.when(~now.eqNullSafe(before), now)


def compare(tables: Sequence[DataFrame], key: str, values: Sequence[str], mode: str = "ABSOLUTE") -> DataFrame:
    """Modes ABSOLUTE, DIFF_TO_FIRST, DIFF_TO_PREVIOUS, DIFF_RATIO_TO_FIRST, DIFF_RATIO_TO_PREVIOUS.

    The first table is always shown as it is; ratios add columns value_i_ratio.  Columns that are
    not numbers show their value where it changed; bounded sizes (bounds) keep their marks.
    """
    met = align(tables, key, values)
    return met.select(F.col(key), F.col("nth"), *cells(F.col, values, len(tables), dict(tables[0].dtypes), mode))


def cells(of: Callable[[str], Column], values: Sequence[str], tables: int, types: Mapping[str, str], mode: str) -> list[Column]:
    """Columns value_i, and ratios, of rows that hold value_i of each table."""
    out: list[Column] = []
    for i in range(tables):
        base = 0 if mode.endswith("FIRST") else i - 1
        for v in values:
            now = of(f"{v}_{i}")
            if i == 0 or mode == "ABSOLUTE":
                out.append(now)
                continue
            before = of(f"{v}_{base}")
            if types[v].startswith("struct"):
                out.append(bounds.minus(now, before).alias(f"{v}_{i}"))
                continue
            if types[v] not in _NUMBERS and not types[v].startswith("decimal"):
                out.append(changed(now, before).alias(f"{v}_{i}"))
                continue
            out.append(difference(now, before).alias(f"{v}_{i}"))
            if "RATIO" in mode:
                out.append(ratio(now, before).alias(f"{v}_{i}_ratio"))
    return out


def histogram_difference(now: DataFrame, before: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """now - before by key; absent counts as 0."""
    sides = [now.select(*keys, *[F.col(v) for v in values]), before.select(*keys, *[(-F.col(v)).alias(v) for v in values])]
    return sides[0].unionByName(sides[1]).groupBy(*keys).agg(*[F.sum(v).cast("long").alias(v) for v in values])


def absolute_totals(diff: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row: each column's sum, and the sum of its absolute values as value_moved: growth and shrinking don't cancel out."""
    return diff.agg(*[x for v in values for x in (F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(v), F.coalesce(F.sum(F.abs(v)), F.lit(0)).cast("long").alias(f"{v}_moved"))])


def histogram_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str], count: str, size: str) -> DataFrame:
    """Classes with equal counts other than 0 in both; sizes are summed."""
    other = b.select(*keys, F.col(count), F.col(size).alias("size__"))
    return a.where(F.col(count) != 0).join(other, [*keys, count]).select(*keys, count, (F.col(size) + F.col("size__")).cast("long").alias(size))


def row_sets(a: Column, b: Column, op: str) -> Column:
    """Set operations on the ids behind two rows; a missing row is the empty set."""
    a, b = F.coalesce(a, F.array().cast("array<long>")), F.coalesce(b, F.array().cast("array<long>"))
    return F.sort_array({
        "INTERSECTION": F.array_intersect(a, b), "UNION": F.array_union(a, b), "DIFFERENCE": F.array_except(a, b), "REVERSE_DIFFERENCE": F.array_except(b, a),
        "SYMMETRIC_DIFFERENCE": F.array_union(F.array_except(a, b), F.array_except(b, a)), "ALL": F.concat(a, b), "NONE": F.array().cast("array<long>"),
    }[op])


def set_totals(a: DataFrame, b: DataFrame, key: str, member: str, op: str) -> DataFrame:
    """(key, n, total): number and sum of the members that a set operation on two tables leaves of each key.

    Sides are flags of (key, member) groups, so no group meets in one row.
    """
    sides = [t.select(key, member, *[F.lit(side == i).alias(f"in_{i}") for i in (0, 1)]) for side, t in enumerate((a, b))]
    met = sides[0].unionByName(sides[1]).groupBy(key, member).agg(F.max("in_0").alias("in_0"), F.max("in_1").alias("in_1"))
    x, y = F.col("in_0"), F.col("in_1")
    keep = {"INTERSECTION": x & y, "UNION": x | y, "DIFFERENCE": x & ~y, "REVERSE_DIFFERENCE": y & ~x, "SYMMETRIC_DIFFERENCE": x != y}[op]
    own = F.when(keep, F.col(member))
    return met.groupBy(key).agg(F.count(own).alias("n"), F.coalesce(F.sum(own), F.lit(0)).cast("long").alias("total"))
