"""Distributions: grouping of result rows by values or by ranges, with the reports' aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.snapshot import class_ancestors


def count() -> Column:
    return F.count(F.lit(1))


def total(x: Column | str, kind: str = "long") -> Column:
    """Sum without nulls; 0 of nothing."""
    return F.coalesce(F.sum(x), F.lit(0)).cast(kind)


def least(x: Column | str, of_bytes: bool = False) -> Column:
    """Minimum without nulls; of nothing 0, or null for bytes."""
    return F.min(x) if of_bytes else F.coalesce(F.min(x), F.lit(0))


def greatest(x: Column | str, of_bytes: bool = False) -> Column:
    return F.max(x) if of_bytes else F.coalesce(F.max(x), F.lit(0))


def average(x: Column | str) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def average_long(x: Column | str, of_bytes: bool = False) -> Column:
    """Whole division of sum by count; of nothing 0, or 1 for bytes."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.count(x)
    return F.coalesce(truncated(F.sum(x), F.when(n > 0, n)), F.lit(1 if of_bytes else 0)).cast("long")


def truncated(a: Column, b: Column) -> Column:
    """Whole division of longs, towards 0, exact at any size."""
    wide = "decimal(20,0)"
    return ((a - a % b).cast(wide) / b.cast(wide)).cast("long")


def latest(x: Column | str, order: Column | str) -> Column:
    """Value of the row that comes last in order."""
    return F.max_by(x, order)


def context(x: str = "object_id") -> Column:
    """Ids of the objects in a group.  For reports on small groups: the list grows with its group."""
    return F.sort_array(F.collect_list(x))


def by_value(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row for each combination of keys, nulls included."""
    return df.groupBy(*keys).agg(*aggregates)


def linear_double(x: Column, low: float, high: float, step: float) -> Column:
    """Upper bound of x's range, counted down from high: low for all at or under it, the greatest double above high."""
    bound = F.lit(high) - F.floor((F.lit(high) - x) / F.lit(step)) * F.lit(step)
    return F.when(x <= low, F.lit(low)).when(x > high, F.lit(1.7976931348623157e308)).otherwise(bound)


def linear_long(x: Column, low: int, high: int, step: int) -> Column:
    """As above for whole numbers; ranges are aligned to 0 (division truncates) and shifted by low."""
    inside = F.when((x > low) & (x <= high), x.cast("long"))
    return F.when(x <= low, F.lit(low).cast("long")).when(x > high, F.lit(2**63 - 1)).otherwise(F.lit(low) + step * (truncated(inside - 1, F.lit(step).cast("long")) + 1)).cast("long")


def totals(df: DataFrame, *columns: str) -> DataFrame:
    """The row of sums; nulls count 0."""
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def by_package(df: DataFrame, name: str, *aggregates: Column) -> DataFrame:
    """One row for each package prefix and each class (whole name), with all below it summed.

    Classes without a package are below <ROOT>.  A class and a package of one name are rows of their own.
    """
    parts = F.split(F.col(name), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    nodes = F.when(F.size(parts) == 1, F.array(F.lit("<ROOT>"), F.col(name))).otherwise(prefixes)
    last = F.size(nodes) - 1
    marked = F.transform(nodes, lambda n, i: F.struct(n.alias("package"), (i == last).alias("is_class")))
    return df.withColumn("node__", F.explode(marked)).select("*", "node__.*").groupBy("package", "is_class").agg(*aggregates).drop("is_class")


def by_superclass(df: DataFrame, classes: DataFrame, *aggregates: Column) -> DataFrame:
    """One row for each class (of each loader) with its subclasses' rows summed in: df has class_id.

    Rows are summed by class before they meet the closure, so the join is between classes.
    """
    up = class_ancestors(classes).select("class_id", "ancestor_id")
    named = classes.select(F.col("class_id").alias("ancestor_id"), "name")
    return df.join(F.broadcast(up), "class_id").join(F.broadcast(named), "ancestor_id").groupBy("ancestor_id", "name").agg(*aggregates).drop("ancestor_id")


def by_loader(df: DataFrame, classes: DataFrame, *aggregates: Column) -> DataFrame:
    """Loaders, and classes below them (name null on a loader's own row)."""
    named = df.join(F.broadcast(classes.select("class_id", "loader_id", "name")), "class_id")
    return named.rollup("loader_id", "name").agg(*aggregates).where("loader_id is not null")
